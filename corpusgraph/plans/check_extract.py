"""Check queries: prompts, completions, tuple records, merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import completions as cp, extract as ex, merge as mg, records as rc, vectors as vx
from ..session import cut
from . import inputs
from .catalog import register, with_views

_PAYLOAD = """concat('2', chr(0), system, chr(0), usr, chr(0), 'mock')"""


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PROMPT = {
    "prompts": f"""SELECT doc_id AS text_unit_id, {_q(rc.extract_system())} AS system,
        concat('Text:', chr(10), text, chr(10), chr(10), 'Extract every entity and relationship now.') AS usr FROM documents""",
    "keyed": f"SELECT *, sha256({_PAYLOAD}) AS cache_key FROM prompts",
    # distinct texts give distinct keys; equal documents share a completion
    "cached": """SELECT k.cache_key, min(c.response) AS response FROM keyed k JOIN completions_v c ON c.doc_id = k.text_unit_id
                 WHERE c.lang <> 'fr' GROUP BY k.cache_key""",
}

# The tuple format read back with plain SQL; the fixture never nests parentheses.
RECORDS = {
    "opened": """SELECT doc_id, CASE WHEN position('```' IN response) > 0
        THEN trim(regexp_extract(response, '(?s)```(?:\\w+)?\\s*(.*?)```', 1)) ELSE response END AS r FROM completions_v""",
    "bodies": "SELECT doc_id, CASE WHEN position('<|COMPLETE|>' IN r) > 0 THEN substr(r, 1, position('<|COMPLETE|>' IN r) - 1) ELSE r END AS r FROM opened",
    "pieces": """SELECT doc_id, trim(p) AS p, i - 1 AS ordinal FROM (SELECT doc_id, unnest(x) AS p, generate_subscripts(x, 1) AS i FROM (
        SELECT doc_id, list_filter(string_split(r, '##'), lambda s: trim(s) <> '' AND position('(' IN s) > 0) AS x FROM bodies) a) b""",
    "inner_": """SELECT doc_id, ordinal, CASE WHEN starts_with(p, '(') AND ends_with(p, ')') THEN p[2:-2] ELSE substr(p, position('(' IN p) + 1) END AS q FROM pieces""",
    "recs": """SELECT doc_id, ordinal, list_transform(string_split(q, '<|>'), lambda f: trim(trim(f), '"')) AS f FROM inner_""",
    "ents0": """SELECT doc_id, ordinal, upper(trim(f[2])) AS title, CASE WHEN upper(trim(f[3])) IN ('PERSON','ORGANIZATION','LOCATION','EVENT','CONCEPT','OTHER')
        THEN upper(trim(f[3])) ELSE 'OTHER' END AS type, f[4] AS description FROM recs WHERE lower(f[1]) = 'entity' AND len(f) >= 4 AND trim(f[2]) <> ''""",
    "ents": "SELECT doc_id, title, type, min(ordinal) AS ordinal, min_by(description, ordinal) AS description FROM ents0 GROUP BY doc_id, title, type",
    "rels": """SELECT doc_id, ordinal, upper(trim(f[2])) AS source, upper(trim(f[3])) AS target, f[4] AS description,
        coalesce(try_cast(trim(f[5]) AS DOUBLE), 1.0) AS weight FROM recs WHERE lower(f[1]) = 'relationship' AND len(f) >= 4""",
    "lastt": "SELECT doc_id, title, max_by(type, ordinal) AS type FROM ents GROUP BY doc_id, title",
    "resolved": """SELECT r.*, s.type AS st, t.type AS tt FROM rels r JOIN lastt s ON s.doc_id = r.doc_id AND s.title = r.source
        JOIN lastt t ON t.doc_id = r.doc_id AND t.title = r.target""",
}


def _answers(spark, sf):
    return inputs.view(spark, sf, "completions_v").select(F.col("doc_id").alias("text_unit_id"), "response")


def _records(spark, sf):
    return cut(rc.parse_records(_answers(spark, sf)).withColumn("turn_map", F.create_map().cast("map<string,string>")))


def _units(spark, sf):
    return inputs.table(spark, sf, "documents").select(F.col("doc_id").alias("text_unit_id"), "text")


def entities(spark, sf):
    """Entity mentions of all documents, in document order."""
    e = ex.entity_mentions(_records(spark, sf))
    return e.withColumn("page_path", F.col("text_unit_id")).withColumn("chunk_index", F.lit(0))


@register("extract_prompts", with_views(**{"prompts": PROMPT["prompts"]}) + "SELECT text_unit_id, sha256(system) AS system_hash, sha256(usr) AS user_hash FROM prompts")
def extract_prompts(spark, sf):
    p = rc.extract_prompts(_units(spark, sf))
    return p.select("text_unit_id", F.sha2("system", 256).alias("system_hash"), F.sha2("user", 256).alias("user_hash"))


@register("cache_key", with_views(**{k: PROMPT[k] for k in ("prompts", "keyed")}) + "SELECT text_unit_id, cache_key FROM keyed")
def cache_key(spark, sf):
    return cp.with_cache_key(rc.extract_prompts(_units(spark, sf))).select("text_unit_id", "cache_key")


def _completed(spark, sf):
    """Completions of most documents are known; the rest are misses."""
    keyed = cp.with_cache_key(rc.extract_prompts(_units(spark, sf)))
    c = inputs.view(spark, sf, "completions_v").where("lang <> 'fr'").select(F.col("doc_id").alias("text_unit_id"), "response")
    cache = keyed.select("text_unit_id", "cache_key").join(c, "text_unit_id").groupBy("cache_key").agg(F.min("response").alias("response"))
    return cp.complete(keyed, cache)


@register(
    "complete_answered",
    with_views("completions_v", **PROMPT) + "SELECT text_unit_id, response, response IS NOT NULL AS hit FROM keyed LEFT JOIN cached USING (cache_key)",
)
def complete_answered(spark, sf):
    return _completed(spark, sf).answered.select("text_unit_id", "response", "hit")


@register(
    "complete_misses",
    with_views("completions_v", **PROMPT) + "SELECT DISTINCT cache_key FROM keyed WHERE cache_key NOT IN (SELECT cache_key FROM cached)",
)
def complete_misses(spark, sf):
    return _completed(spark, sf).misses.select("cache_key")


@register(
    "parse_records",
    with_views("completions_v", **RECORDS) + "SELECT doc_id AS text_unit_id, ordinal, lower(f[1]) AS kind, array_to_string(f, '|') AS fields FROM recs",
)
def parse_records(spark, sf):
    return rc.parse_records(_answers(spark, sf)).withColumn("fields", F.array_join("fields", "|"))


@register("entity_mentions", with_views("completions_v", **RECORDS) + "SELECT doc_id AS text_unit_id, ordinal, title, type, description FROM ents")
def entity_mentions(spark, sf):
    return ex.entity_mentions(_records(spark, sf))


@register(
    "relationship_mentions",
    with_views("completions_v", **RECORDS) + "SELECT doc_id AS text_unit_id, ordinal, source, target, description, weight FROM rels WHERE source <> '' AND target <> ''",
)
def relationship_mentions(spark, sf):
    return ex.relationship_mentions(_records(spark, sf))


_CLAIMS = {
    "said": """SELECT doc_id, source AS subject, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE target END AS object, CASE WHEN doc_id % 2 = 0 THEN 'LINK' ELSE 'OTHER' END AS type,
        CASE WHEN weight > 6 THEN 'TRUE' ELSE 'SUSPECTED' END AS status, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE '2024' END AS period_start, description
        FROM rels WHERE source <> '' AND target <> ''""",
}


@register(
    "claims",
    with_views("completions_v", **RECORDS, **_CLAIMS)
    + """SELECT c.doc_id AS text_unit_id, subject, o.title AS object, c.type, status, period_start, c.description, s.type AS subject_type FROM said c
         JOIN lastt s ON s.doc_id = c.doc_id AND s.title = c.subject LEFT JOIN lastt o ON o.doc_id = c.doc_id AND o.title = c.object""",
)
def claims(spark, sf):
    """Claim answers written from the relationship records, then read back."""
    rel = ex.relationship_mentions(_records(spark, sf))
    d = F.col("text_unit_id")
    text = F.concat_ws(
        "<|>", F.lit('("claim"'), F.lower("source"), F.when(d % 3 == 0, "none").otherwise(F.col("target")), F.when(d % 2 == 0, "link").otherwise(F.lit("")),
        F.when(F.col("weight") > 6, "true").otherwise("maybe"), F.when(d % 5 == 0, "N/A").otherwise("2024"), F.lit("NONE"), F.concat("description", F.lit(")")),
    )
    records = rc.parse_records(rel.select("text_unit_id", text.alias("response"))).withColumn("turn_map", F.create_map().cast("map<string,string>"))
    return ex.claim_rows(records, cut(ex.entity_mentions(_records(spark, sf)))).drop("ordinal", "object_type", "period_end")


_FOLD = """list_reduce(list(description ORDER BY doc_id, ordinal), lambda a, x: CASE WHEN a = '' THEN x WHEN x = '' OR x = a THEN a ELSE concat(a, ' ', x) END, '')"""
MERGED = {"merged": f"SELECT title, type, {_FOLD} AS description FROM ents GROUP BY title, type"}


@register("merge_entities", with_views("completions_v", **RECORDS, **MERGED) + "SELECT title, type, description FROM merged")
def merge_entities(spark, sf):
    return mg.merge_entities(entities(spark, sf)).drop("entity_id")


def _resolved(spark, sf):
    rel = ex.relationship_mentions(_records(spark, sf))
    ents = cut(ex.entity_mentions(_records(spark, sf)))
    return mg.resolve_relationships(rel, ents).withColumn("page_path", F.col("text_unit_id")).withColumn("chunk_index", F.lit(0))


@register(
    "merge_relationships",
    with_views("completions_v", **RECORDS)
    + """SELECT source, st AS source_type, target, tt AS target_type, 'related' AS type, max(weight) AS weight,
         coalesce(max_by(description, doc_id * 1000 + ordinal) FILTER (description <> ''), '') AS description FROM resolved GROUP BY ALL""",
)
def merge_relationships(spark, sf):
    merged = mg.merge_relationships(_resolved(spark, sf))
    e = mg.merge_entities(entities(spark, sf)).drop("description")
    src = e.select(F.col("entity_id").alias("source_id"), F.col("title").alias("source"), F.col("type").alias("source_type"))
    dst = e.select(F.col("entity_id").alias("target_id"), F.col("title").alias("target"), F.col("type").alias("target_type"))
    return merged.join(src, "source_id").join(dst, "target_id").drop("source_id", "target_id")


@register(
    "merge_order_lines",
    with_views("rel_v")
    + """SELECT source_id, target_id, type, max(weight) AS weight,
         coalesce(max_by(description, l_orderkey * 1000 + l_linenumber) FILTER (description <> ''), '') AS description FROM rel_v GROUP BY ALL""",
)
def merge_order_lines(spark, sf):
    return mg.merge_relationships(inputs.view(spark, sf, "rel_v"), order=("l_orderkey", "l_linenumber"))


@register(
    "provenance",
    with_views("completions_v", **RECORDS) + "SELECT DISTINCT title, type, concat('raw/', doc_id, '.md') AS page_path FROM ents",
)
def provenance(spark, sf):
    e = cut(entities(spark, sf))
    links = mg.text_unit_entities(e)
    units = _units(spark, sf).select("text_unit_id", F.concat(F.lit("raw/"), F.col("text_unit_id").cast("string"), F.lit(".md")).alias("page_path"))
    names = e.select(mg.entity_id(F.col("title"), F.col("type")).alias("entity_id"), "title", "type").distinct()
    return mg.entity_sources(links, units).join(names, "entity_id").drop("entity_id")


@register(
    "degree",
    with_views("rel_v")
    + "SELECT entity_id, count(*) AS degree FROM (SELECT source_id AS entity_id FROM rel_v UNION ALL SELECT target_id FROM rel_v WHERE target_id <> source_id) x GROUP BY entity_id",
)
def degree(spark, sf):
    return mg.degree(inputs.view(spark, sf, "rel_v"))


@register("extract_graph")
def extract_graph(spark, sf):
    """Whole extraction with repair and gleaning against the completion table."""
    units = _units(spark, sf)
    keyed = cp.with_cache_key(rc.extract_prompts(units)).select("text_unit_id", "cache_key")
    cache = keyed.join(_answers(spark, sf), "text_unit_id").groupBy("cache_key").agg(F.min("response").alias("response"))
    return ex.extract_graph(units, cut(cache)).entities


@register("embed_entities")
def embed_entities(spark, sf):
    e = mg.merge_entities(entities(spark, sf))
    return mg.embed_graph(cut(e), _units(spark, sf))[0].select("entity_id", F.posexplode("vector").alias("pos", "value"))

"""Check queries: incremental upkeep of the page index, text units and graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunk as ck, maintain as mt
from ..session import cut
from . import inputs
from .catalog import pages, register, with_views
from .check_pages import NOW, stored_index
from .check_search import TOKENS

_DIFF = {
    "diff": """SELECT coalesce(p.page_path, s.page_path) AS page_path, CASE WHEN s.page_path IS NULL THEN 'added' WHEN p.page_path IS NULL THEN 'deleted'
               WHEN sha256(p.body) <> sha256(s.body) THEN 'updated' ELSE 'unchanged' END AS change
               FROM pages_v p FULL OUTER JOIN stored_v s ON p.page_path = s.page_path""",
}
CHUNKS = """
  SELECT page_path, idx - 1 AS chunk_index, c AS text, len(list_filter(regexp_split_to_array(c, '\\s+'), lambda w: w <> '')) AS n_tokens, sha256(c) AS content_hash FROM (
    SELECT page_path, unnest(cs) AS c, generate_subscripts(cs, 1) AS idx FROM (
      SELECT page_path, list_filter(list_transform(flatten(list_transform(list_filter(string_split(regexp_replace(s, '(?m)^(#{{1,6}}\\s)', chr(1) || '\\1', 'g'), chr(1)),
          lambda x: regexp_replace(x, '\\s+', '', 'g') <> ''),
        lambda sec: CASE WHEN length(sec) <= 800 THEN [sec] ELSE list_reduce(
            list_filter(string_split(regexp_replace(sec, '\\n\\s*\\n', chr(2), 'g'), chr(2)), lambda p: regexp_replace(p, '\\s+', '', 'g') <> ''),
            lambda acc, p: CASE WHEN length(acc[-1]) = 0 THEN list_append(acc[1:-2], p)
              WHEN length(acc[-1]) + length(p) + 2 > 800 THEN list_append(acc, p)
              ELSE list_append(acc[1:-2], concat(acc[-1], chr(10), chr(10), p)) END, ['']) END)),
        lambda c: regexp_replace(c, '^\\s+|\\s+$', '', 'g')), lambda c: c <> '') AS cs
      FROM (SELECT page_path, regexp_replace(body, '^\\s+|\\s+$', '', 'g') AS s FROM {source}) a) b) d"""
CHUNK_PAGES = CHUNKS.replace("{{1,6}}", "{1,6}").replace("{source}", "pages_v")
CHUNK_STORED = CHUNKS.replace("{{1,6}}", "{1,6}").replace("{source}", "stored_v")


def _stored_pages(spark, sf):
    return inputs.view(spark, sf, "stored_v").select(
        "page_path", "title", "page_type", F.array().cast("array<string>").alias("tags"),
        F.create_map().cast("map<string,string>").alias("frontmatter"), "body",
    )


@register("diff_pages", with_views("pages_v", "stored_v", **_DIFF) + "SELECT page_path, change FROM diff")
def diff_pages(spark, sf):
    return mt.diff_pages(pages(spark, sf), stored_index(spark, sf))


@register("diff_counts", with_views("pages_v", "stored_v", **_DIFF) + "SELECT change, count(*) AS n FROM diff GROUP BY change")
def diff_counts(spark, sf):
    return mt.diff_counts(mt.diff_pages(pages(spark, sf), stored_index(spark, sf)))


def _applied(spark, sf):
    old = mt.build_index(_stored_pages(spark, sf), "2024-01-01")
    return mt.apply_page_diff(pages(spark, sf), old, NOW)


@register(
    "apply_diff_index",
    with_views("pages_v", "stored_v", **_DIFF)
    + f"""SELECT page_path, title, page_type, sha256(body) AS content_hash, CASE change WHEN 'unchanged' THEN '2024-01-01' ELSE '{NOW}' END AS updated
          FROM pages_v JOIN diff USING (page_path)""",
)
def apply_diff_index(spark, sf):
    return _applied(spark, sf).index


@register(
    "apply_diff_postings",
    with_views("pages_v", **{"toks": f"SELECT page_path, {TOKENS.format(c='title')} AS t, {TOKENS.format(c='body')} AS b FROM pages_v"})
    + """SELECT doc_id, term, count(*) AS tf, sum(i) AS tf_title, any_value(dl) AS dl FROM (
         SELECT page_path AS doc_id, unnest(t) AS term, 1 AS i, len(t)+len(b) AS dl FROM toks
         UNION ALL SELECT page_path, unnest(b), 0, len(t)+len(b) FROM toks) u GROUP BY doc_id, term""",
)
def apply_diff_postings(spark, sf):
    return _applied(spark, sf).postings


@register("chunk", with_views("pages_v") + CHUNK_PAGES)
def chunk(spark, sf):
    return ck.chunk(pages(spark, sf)).drop("text_unit_id")


_UNITS = {
    "cur": CHUNK_PAGES, "old": CHUNK_STORED,
    "udiff": """SELECT coalesce(c.page_path, o.page_path) AS page_path, coalesce(c.chunk_index, o.chunk_index) AS chunk_index,
                CASE WHEN o.page_path IS NULL THEN 'added' WHEN c.page_path IS NULL THEN 'deleted' WHEN c.content_hash <> o.content_hash THEN 'updated'
                ELSE 'unchanged' END AS change FROM cur c FULL OUTER JOIN old o ON c.page_path = o.page_path AND c.chunk_index = o.chunk_index""",
}


def _unit_diff(spark, sf):
    return mt.diff_text_units(ck.chunk(pages(spark, sf)), ck.chunk(_stored_pages(spark, sf)))


@register("diff_text_units", with_views("pages_v", "stored_v", **_UNITS) + "SELECT page_path, chunk_index, change FROM udiff")
def diff_text_units(spark, sf):
    return _unit_diff(spark, sf)


@register(
    "cleared_links",
    with_views("pages_v", "stored_v", **_UNITS)
    + "SELECT page_path, chunk_index, o.n_tokens AS entity_id FROM old o JOIN udiff USING (page_path, chunk_index) WHERE change NOT IN ('updated','deleted')",
)
def cleared_links(spark, sf):
    """One stand-in link per stored unit; those of changed and deleted units go."""
    # cut once without texts: the units are links, keys of the difference and places at once
    units = cut(ck.chunk(_stored_pages(spark, sf)).drop("text"))
    links = units.select("text_unit_id", F.col("n_tokens").alias("entity_id"))
    kept, _ = mt.clear_text_units(links, links, units, mt.diff_text_units(ck.chunk(pages(spark, sf)), units))
    return kept.join(units.select("text_unit_id", "page_path", "chunk_index"), "text_unit_id").drop("text_unit_id")


# Order lines as provenance: a part lives while some order line names it.
_SWEEP = """FROM rel_v r WHERE {s} AND {t}"""
_LIVE = "SELECT DISTINCT l_partkey AS entity_id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49 UNION SELECT 10000000+s_suppkey FROM supplier"


def _graph(spark, sf):
    inputs.view(spark, sf, "rel_v").createOrReplaceTempView("rel_v")
    entities = inputs.view(spark, sf, "entities_v")
    rel = spark.table("rel_v").select("source_id", "target_id", "type", "description", "weight")
    inputs.table(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    inputs.table(spark, sf, "supplier").createOrReplaceTempView("supplier")
    links = spark.sql(
        "SELECT l_orderkey*10+l_linenumber AS text_unit_id, l_partkey AS entity_id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49 "
        "UNION ALL SELECT s_suppkey, 10000000+s_suppkey FROM supplier"
    )
    claims = spark.sql("SELECT l_orderkey*10+l_linenumber AS claim_id, l_partkey AS subject_id, 10000000+l_suppkey AS object_id, l_returnflag AS description FROM lineitem")
    return mt.EntityGraph(entities, rel, claims, links)


@register(
    "sweep_entities",
    with_views("entities_v", **{"live": _LIVE}) + "SELECT entity_id, title, type FROM entities_v JOIN live USING (entity_id)",
)
def sweep_entities(spark, sf):
    return mt.sweep_orphans(_graph(spark, sf)).entities.select("entity_id", "title", "type")


@register(
    "sweep_relationships",
    with_views("rel_v", **{"live": _LIVE})
    + "SELECT source_id, target_id, type, description, weight FROM rel_v WHERE source_id IN (SELECT entity_id FROM live) AND target_id IN (SELECT entity_id FROM live)",
)
def sweep_relationships(spark, sf):
    return mt.sweep_orphans(_graph(spark, sf)).relationships


@register(
    "sweep_claims",
    with_views(**{"live": _LIVE})
    + "SELECT l_orderkey*10+l_linenumber AS claim_id, l_partkey AS subject_id FROM lineitem WHERE l_partkey IN (SELECT entity_id FROM live)",
)
def sweep_claims(spark, sf):
    return mt.sweep_orphans(_graph(spark, sf)).claims.select("claim_id", "subject_id")


@register(
    "prune_reports",
    """SELECT c_nationkey AS level, c_custkey AS cluster, c_mktsegment AS title FROM customer
       WHERE (c_nationkey, c_custkey) IN (SELECT c_nationkey, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')""",
)
def prune_reports(spark, sf):
    """Reports of customers; a cluster exists while it has an urgent finished order."""
    c, o = inputs.table(spark, sf, "customer"), inputs.table(spark, sf, "orders")
    reports = c.select(F.col("c_nationkey").alias("level"), F.col("c_custkey").alias("cluster"), F.col("c_mktsegment").alias("title"))
    current = o.where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("level"), F.col("c_custkey").alias("cluster"))
    return mt.prune_reports(current, reports)


@register(
    "reindex_report",
    with_views("pages_v", "stored_v", "entities_v", "rel_v", **_UNITS, **{"live": _LIVE})
    + """SELECT count(*) FILTER (change='added') AS text_units_added, count(*) FILTER (change='updated') AS text_units_updated,
         count(*) FILTER (change='deleted') AS text_units_deleted, (SELECT count(*) FROM entities_v) AS entities_upserted,
         (SELECT count(*) FROM entities_v WHERE entity_id NOT IN (SELECT entity_id FROM live)) AS entities_deleted,
         (SELECT count(*) FROM rel_v) AS relationships_upserted, (SELECT count(*) FROM lineitem) AS claims_upserted,
         (SELECT count(*) FROM udiff WHERE change IN ('added','updated')) AS completions FROM udiff""",
)
def reindex_report(spark, sf):
    g = _graph(spark, sf)
    gone = g.entities.join(mt.sweep_orphans(g).entities.select("entity_id"), "entity_id", "left_anti")
    diff = cut(_unit_diff(spark, sf))
    return mt.reindex_report(diff, g.entities, gone, g.relationships, g.claims, diff.where("change in ('added','updated')"))

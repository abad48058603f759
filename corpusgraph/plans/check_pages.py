"""Check queries: page parsing, links, lint, listings, upsert, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import links as lk, lint as ln, maintain as mt, pages as pg
from . import inputs
from .catalog import pages, register, with_views

NOW = "2024-02-01T00:00:00+00:00"
LINK_RX = r"\[\[([^\]|#]+)(?:[|#]([^\]]*))?\]\]"
STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"

L = {
    "links": f"""
      SELECT page_path, title, pos, trim(regexp_extract(raw, '{LINK_RX}', 1)) AS target,
             lower(trim(regexp_extract(raw, '{LINK_RX}', 1))) AS key, trim(regexp_extract(raw, '{LINK_RX}', 2)) AS alias
      FROM (SELECT page_path, title, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS pos FROM (
        SELECT page_path, title, regexp_extract_all(body, '{LINK_RX}') AS l FROM pages_v) x) y""",
    "ord": """SELECT page_path, title, lower(title) AS key, concat(CASE split_part(page_path, '/', 2) WHEN 'sources' THEN '0'
              WHEN 'entities' THEN '1' WHEN 'concepts' THEN '2' WHEN 'sessions' THEN '3' ELSE '4' END, page_path) AS o FROM pages_v""",
    "tix": "SELECT key, max_by(page_path, o) AS target_path, max_by(title, o) AS target_title FROM ord GROUP BY key",
    "dang": "SELECT * FROM links l WHERE NOT EXISTS (SELECT 1 FROM ord o WHERE o.key = l.key)",
}


def _pl(spark, sf):
    p = pages(spark, sf)
    return p, lk.extract_links(p)


_PARSED = {
    "cutup": """
      SELECT page_path, doc_id, text, starts_with(text, '---') AND len(string_split(text, '---')) >= 3 AS has,
        regexp_extract(text, '(?s)^---(.*?)---(.*)$', 1) AS fm,
        regexp_replace(regexp_extract(text, '(?s)^---(.*?)---(.*)$', 2), '^\\n+', '') AS rest FROM page_files_v""",
    "parsed": """
      SELECT page_path, CASE WHEN has THEN rest ELSE text END AS body, CASE WHEN has THEN fm ELSE '' END AS fm FROM cutup""",
    "fields": """
      SELECT page_path, body,
        nullif(trim(list_extract(regexp_extract_all(fm, '(?m)^title:(.*)$', 1), -1)), '') AS t_fm,
        trim(list_extract(regexp_extract_all(fm, '(?m)^type:(.*)$', 1), -1)) AS k_fm,
        trim(list_extract(regexp_extract_all(fm, '(?m)^tags:(.*)$', 1), -1)) AS g_fm,
        coalesce(trim(list_extract(regexp_extract_all(fm, '(?m)^source_hash:(.*)$', 1), -1)), '') AS source_hash,
        nullif(trim(regexp_extract(body, '(?m)^\\s*# (.*\\S.*)$', 1)), '') AS h1 FROM parsed""",
}


@register(
    "parse_pages",
    with_views("page_files_v", **_PARSED)
    + """SELECT page_path, body, source_hash,
         coalesce(t_fm, h1, array_to_string(list_transform(regexp_extract_all(lower(replace(replace(regexp_extract(page_path, '([^/]*)\\.md$', 1),
            '-', ' '), '_', ' ')), '\\p{L}+|\\P{L}+'), lambda x: upper(x[1]) || x[2:]), '')) AS title,
         coalesce(nullif(k_fm, ''), CASE split_part(page_path, '/', 2) WHEN 'sources' THEN 'source' WHEN 'entities' THEN 'entity'
            WHEN 'concepts' THEN 'concept' ELSE 'session' END) AS page_type,
         CASE WHEN g_fm IS NULL THEN '' WHEN starts_with(g_fm, '[') THEN array_to_string(list_filter(list_transform(
            string_split(g_fm[2:-2], ','), lambda x: trim(x)), lambda x: x <> ''), '|') ELSE g_fm END AS tags
         FROM fields""",
)
def parse_pages(spark, sf):
    p = pg.parse_pages(inputs.view(spark, sf, "page_files_v").select("page_path", "text"))
    return p.select(
        "page_path", "body", F.coalesce(F.col("frontmatter")["source_hash"], F.lit("")).alias("source_hash"), "title", "page_type",
        F.array_join("tags", "|").alias("tags"),
    )


@register(
    "slug_paths",
    """SELECT doc_id, concat('wiki/concepts/', CASE WHEN s = '' THEN 'page' ELSE s END, '.md') AS page_path FROM (
       SELECT doc_id, regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents) x""",
)
def slug_paths(spark, sf):
    d = inputs.table(spark, sf, "documents")
    return d.select("doc_id", pg.page_path(F.lit("concept"), F.col("text")).alias("page_path"))


@register(
    "extract_links",
    with_views("pages_v", **L) + "SELECT page_path, title, pos, target, key, alias FROM links",
)
def extract_links(spark, sf):
    return _pl(spark, sf)[1].drop("raw")


@register(
    "page_edges",
    with_views("pages_v", **L)
    + "SELECT DISTINCT page_path AS source, target_path AS target FROM links JOIN tix USING (key) WHERE page_path <> target_path",
)
def page_edges(spark, sf):
    return lk.page_edges(*_pl(spark, sf))


@register(
    "backlink_counts",
    with_views("pages_v", **L) + "SELECT key, count(*) AS backlink_count FROM links WHERE key <> lower(title) GROUP BY key",
)
def backlink_counts(spark, sf):
    return lk.backlink_counts(_pl(spark, sf)[1])


@register(
    "backlinks",
    with_views("pages_v", **L)
    + """SELECT o.page_path, b.source_title, t.target_path AS source_path FROM ord o
         JOIN (SELECT DISTINCT key, title AS source_title FROM links WHERE key <> lower(title)) b USING (key)
         LEFT JOIN tix t ON t.key = lower(b.source_title)""",
)
def backlinks(spark, sf):
    return lk.backlinks(*_pl(spark, sf))


_LIST = """SELECT p.page_path, p.title, p.page_type, p.tag AS tags, len(regexp_extract_all(p.body, '""" + LINK_RX + """')) AS link_count,
           coalesce(b.n, 0) AS backlink_count FROM pages_v p
           LEFT JOIN (SELECT key, count(*) AS n FROM links WHERE key <> lower(title) GROUP BY key) b ON b.key = lower(p.title)"""


@register("page_list", with_views("pages_v", **L) + _LIST)
def page_list(spark, sf):
    return lk.page_list(*_pl(spark, sf)).withColumn("tags", F.array_join("tags", "|"))


@register("page_list_filtered", with_views("pages_v", **L) + _LIST + " WHERE contains(lower(p.title), 'fr') OR contains(lower(p.tag), 'fr')")
def page_list_filtered(spark, sf):
    return lk.page_list(*_pl(spark, sf), text_filter="fr").withColumn("tags", F.array_join("tags", "|"))


@register(
    "page_outbound",
    with_views("pages_v", **L) + "SELECT page_path, pos, target, target_path FROM links LEFT JOIN tix USING (key)",
)
def page_outbound(spark, sf):
    return lk.outbound(*_pl(spark, sf))


@register(
    "page_detail_backlinks",
    with_views("pages_v", **L)
    + """SELECT b.title, t.target_path AS path FROM (SELECT DISTINCT title FROM links WHERE key = 'doc 10' AND key <> lower(title)) b
         LEFT JOIN tix t ON t.key = lower(b.title)""",
)
def page_detail_backlinks(spark, sf):
    return lk.page_detail(*_pl(spark, sf), "wiki/concepts/doc-10.md").backlinks


_ORPHANS = f"""SELECT page_path, title FROM ord o WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.key = o.key AND lower(l.title) <> l.key)
   AND title IN (SELECT title FROM (SELECT p.title, max_by(len(regexp_extract_all(p.body, '{LINK_RX}')), o.o) AS n
                 FROM pages_v p JOIN ord o USING (page_path) GROUP BY p.title) x WHERE n = 0)"""
_THIN = f"""SELECT page_path, title, length({STRIP.format(c='body')}) AS char_count FROM pages_v
   WHERE tag = 'needs-compile' OR (tag <> 'stub' AND length({STRIP.format(c='body')}) < 80)"""
_STALE = """SELECT s.page_path, CASE WHEN p.page_path IS NULL THEN 'missing_on_disk' ELSE 'content_changed' END AS reason
   FROM stored_v s LEFT JOIN pages_v p USING (page_path) WHERE p.page_path IS NULL OR sha256(p.body) <> sha256(s.body)"""


@register("lint_orphans", with_views("pages_v", **L) + _ORPHANS)
def lint_orphans(spark, sf):
    return ln.lint_orphans(*_pl(spark, sf))


@register("lint_dangling", with_views("pages_v", **L) + "SELECT page_path, title, pos, target FROM dang")
def lint_dangling(spark, sf):
    return ln.lint_dangling(*_pl(spark, sf))


@register("lint_thin", with_views("pages_v", **L) + _THIN)
def lint_thin(spark, sf):
    return ln.lint_thin(pages(spark, sf))


def stored_index(spark, sf):
    return mt.page_index(inputs.view(spark, sf, "stored_v"), NOW)


@register("lint_stale", with_views("pages_v", "stored_v") + _STALE)
def lint_stale(spark, sf):
    return ln.lint_stale(pages(spark, sf), stored_index(spark, sf))


_LINT = f"""SELECT 'orphan' AS kind, page_path, NULL AS detail FROM ({_ORPHANS}) a
   UNION ALL SELECT 'dangling', page_path, target FROM dang
   UNION ALL SELECT 'thin', page_path, char_count::VARCHAR FROM ({_THIN}) b
   UNION ALL SELECT 'stale', page_path, reason FROM ({_STALE}) c"""


@register("lint", with_views("pages_v", "stored_v", **L) + _LINT)
def lint(spark, sf):
    return ln.lint(*_pl(spark, sf), stored_index(spark, sf))


@register("lint_summary", with_views("pages_v", "stored_v", **L) + f"SELECT kind, count(*) AS n FROM ({_LINT}) x GROUP BY kind")
def lint_summary(spark, sf):
    return ln.lint_summary(ln.lint(*_pl(spark, sf), stored_index(spark, sf)))


@register(
    "make_stubs",
    with_views("pages_v", **L)
    + """SELECT concat('wiki/concepts/', regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '.md') AS page_path, 'concept' AS page_type, title,
         concat('Stub page — created automatically because it was referenced via [[', title, ']] but did not yet exist.', chr(10)) AS body, 'stub' AS tags
         FROM (SELECT d.key, arg_min(d.target, concat(o.o, lpad(d.pos::VARCHAR, 9, '0'))) AS title FROM dang d JOIN ord o USING (page_path) GROUP BY d.key) x""",
)
def make_stubs(spark, sf):
    return lk.make_stubs(*_pl(spark, sf)).drop("source_hash").withColumn("tags", F.array_join("tags", "|"))


@register(
    "catalogue",
    with_views("pages_v", **L,
        pairs="""SELECT DISTINCT f.t AS to_title, l.title AS backlink FROM links l
                 JOIN (SELECT key, min_by(title, o) AS t FROM ord GROUP BY key) f USING (key) WHERE l.title <> f.t""")
    + f"SELECT '{NOW}' AS snapshot_at, p.page_path, p.title, x.backlink FROM pages_v p LEFT JOIN pairs x ON x.to_title = p.title",
)
def catalogue(spark, sf):
    return lk.catalogue(*_pl(spark, sf), NOW)


_ESC = "replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@register(
    "render_links",
    with_views("pages_v", **L,
        anchors=f"""SELECT page_path, list(CASE WHEN target_path IS NULL THEN concat('<span class="wikilink dangling" title="page not found: ', {_ESC.format(c='target')}, '">', a, '</span>')
                     ELSE concat('<a class="wikilink" href="/#/page?path=', target_path, '">', a, '</a>') END ORDER BY pos) AS anchors FROM (
                     SELECT *, {_ESC.format(c="CASE WHEN alias = '' THEN target ELSE alias END")} AS a FROM links LEFT JOIN tix USING (key)) x GROUP BY page_path""",
        segs=f"""SELECT page_path, list_transform(string_split(regexp_replace(body, '{LINK_RX}', chr(1), 'g'), chr(1)), lambda t: {_ESC.format(c='t')}) AS s FROM pages_v""")
    + """SELECT page_path, array_to_string(list_transform(range(1, len(s)+1), lambda i: concat(s[i], coalesce(anchors[i], ''))), '') AS html
         FROM segs LEFT JOIN anchors USING (page_path)""",
)
def render_links(spark, sf):
    return lk.render_links(*_pl(spark, sf))


# Stored pages with their compile hash; one in seven was edited by hand since.
def _existing(spark, sf):
    s = inputs.view(spark, sf, "stored_v")
    return s.select(
        "page_path", "title", "page_type", F.array(F.lit("old")).alias("tags"),
        F.create_map(
            F.lit("created"), F.lit("2023-01-01"), F.lit("tags"), F.lit("[old]"), F.lit("source_hash"), F.lit("abc"),
            F.lit("compiled_hash"), F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")), 256),
        ).alias("frontmatter"),
        "body",
    )


_UPSERT = {
    "existing": """SELECT page_path, body, sha256(CASE WHEN doc_id%7=0 THEN concat(body, '!') ELSE body END) AS ch FROM stored_v""",
    "prop": "SELECT page_path, title, page_type, tag, body AS nb, sha256(body) AS nh FROM pages_v",
    "j": """SELECT p.*, e.body AS ob, CASE WHEN e.page_path IS NULL THEN 'created' WHEN sha256(e.body) <> e.ch THEN 'merged' ELSE 'updated' END AS action
            FROM prop p LEFT JOIN existing e USING (page_path)""",
}


@register(
    "upsert_pages",
    with_views("pages_v", "stored_v", **_UPSERT)
    + f"""SELECT page_path, action, CASE WHEN action = 'created' THEN '{NOW}' ELSE '2023-01-01' END AS created, '{NOW}' AS updated,
          CASE WHEN action = 'created' THEN '' ELSE 'abc' END AS source_hash,
          CASE WHEN action = 'merged' THEN '[old]' ELSE concat('[', tag, ']') END AS tags,
          CASE WHEN action = 'merged' THEN concat(regexp_replace(ob, '\\n+$', ''), chr(10), chr(10), chr(10),
             '> [!merge] Compile on {NOW} proposed an update to this page, but it was edited since the last compile, so the proposed content was not applied automatically (proposed hash: ',
             substr(nh, 1, 12), ').', chr(10)) ELSE nb END AS body FROM j""",
)
def upsert_pages(spark, sf):
    proposed = pages(spark, sf).select(
        "page_path", "page_type", "title", "body", "tags", F.lit(None).cast("string").alias("source_hash")
    )
    w = pg.upsert_pages(_existing(spark, sf), proposed, NOW)
    fm = F.col("frontmatter")
    return w.select(
        "page_path", "action", fm["created"].alias("created"), fm["updated"].alias("updated"), fm["source_hash"].alias("source_hash"),
        fm["tags"].alias("tags"), "body",
    )


@register("lint_fix")
def lint_fix(spark, sf):
    p, l = _pl(spark, sf)
    return ln.lint_fix(p, l, stored_index(spark, sf), NOW).index


def _answers(spark, sf):
    """Model answers built from documents: bare, fenced and prose-wrapped JSON, some broken."""
    d = inputs.table(spark, sf, "documents")
    obj = F.to_json(
        F.struct(
            F.array(
                F.struct(F.lit("source").alias("page_type"), F.concat(F.lit("Source "), "doc_id").alias("title"), F.col("text").alias("body"), F.array("lang").alias("tags")),
                F.struct(F.lit("concept").alias("page_type"), F.concat(F.lit("Topic "), "lang").alias("title"), F.lit("See [[Source]] {x}").alias("body"), F.array().cast("array<string>").alias("tags")),
            ).alias("pages"),
            F.array(F.concat(F.lit("differs in "), "source")).alias("contradictions"),
        )
    )
    kind = F.col("doc_id") % 4
    text = (
        F.when(kind == 0, obj).when(kind == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Here you go: "), obj, F.lit(" Done."))).otherwise(F.lit("no object here"))
    )
    return d.select(F.sha2(F.col("doc_id").cast("string"), 256).alias("source_hash"), text.alias("response"))


@register(
    "parse_compiled",
    """SELECT sha256(doc_id::VARCHAR) AS source_hash, 0 AS ordinal, concat('wiki/sources/source-', doc_id, '.md') AS page_path, 'source' AS page_type,
              concat('Source ', doc_id) AS title, text AS body, lang AS tags FROM documents WHERE doc_id % 4 <> 3
       UNION ALL SELECT sha256(doc_id::VARCHAR), 1, concat('wiki/concepts/topic-', lang, '.md'), 'concept', concat('Topic ', lang),
              'See [[Source]] {x}', '' FROM documents WHERE doc_id % 4 <> 3""",
)
def parse_compiled(spark, sf):
    p, _, _ = pg.parse_compiled(_answers(spark, sf))
    return p.withColumn("tags", F.array_join("tags", "|"))


@register(
    "parse_compiled_errors",
    "SELECT sha256(doc_id::VARCHAR) AS source_hash, 'no JSON object in answer' AS error FROM documents WHERE doc_id % 4 = 3",
)
def parse_compiled_errors(spark, sf):
    return pg.parse_compiled(_answers(spark, sf))[2]


@register(
    "compile_prompts",
    with_views("pages_v",
        digest="SELECT string_agg(concat('- ', title), chr(10) ORDER BY lower(title)) AS d FROM (SELECT DISTINCT title FROM pages_v) t")
    + """SELECT sha256(text) AS source_hash, 0 AS part, doc_id,
         sha256(concat('## Existing pages', chr(10), chr(10), d, chr(10), chr(10), '## Source', chr(10), chr(10), '- original_name: ', doc_id, chr(10),
           '- content_hash: ', sha256(text), chr(10), '- kind: document', chr(10), '- mime: text/plain', chr(10), chr(10), '```markdown', chr(10),
           substr(text, 1, 12000), CASE WHEN length(text) > 12000 THEN concat(chr(10), chr(10), '[... truncated for length ...]', chr(10)) ELSE '' END,
           chr(10), '```', chr(10))) AS user_hash FROM documents, digest""",
)
def compile_prompts(spark, sf):
    d = inputs.table(spark, sf, "documents")
    sources = d.select(
        F.sha2("text", 256).alias("content_hash"), F.col("doc_id").cast("string").alias("original_name"),
        F.lit("document").alias("kind"), F.lit("text/plain").alias("mime"), F.col("text").alias("parsed_markdown"),
    )
    p = pg.compile_prompt_hashes(sources, pages(spark, sf))
    return p.select("source_hash", "part", F.col("original_name").cast("long").alias("doc_id"), "user_hash")

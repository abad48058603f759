"""Check queries: file typing, content dedup, ledgers, logs, HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import cut
from ..sources import files as fl, html as hm, ledger as lg
from . import inputs
from .catalog import register, with_views

NOW = "2024-02-01T00:00:00+00:00"
KIND = """CASE WHEN e IN ('.pdf','.docx','.pptx','.xlsx','.html','.htm','.md','.txt','.rtf','.odt') THEN 'document'
  WHEN e IN ('.png','.jpg','.jpeg','.webp','.tiff','.tif','.gif','.bmp') THEN 'image' ELSE 'artifact' END"""

F_ = {
    "typed": f"""SELECT *, {KIND} AS kind, sha256(content) AS h FROM (
        SELECT *, lower(regexp_extract(original_name, '\\.[^.]+$')) AS e, regexp_extract(original_name, '\\.[^.]+$') AS ext FROM files_v) x""",
    "parsed": """SELECT *, CASE WHEN e = '.md' THEN content WHEN kind = 'artifact' OR e = '.txt' THEN concat('# ', original_name, chr(10), chr(10), '```',
        CASE e WHEN '.json' THEN 'json' WHEN '.csv' THEN 'csv' WHEN '.txt' THEN 'text' ELSE '' END, chr(10), content, chr(10), '```', chr(10)) END AS md FROM typed""",
    "ledger": """SELECT h AS content_hash, min(original_name) AS original_name, concat('raw/', h, '.old') AS raw_path, 'document' AS kind, '2024-01-01' AS ingested_at
        FROM typed WHERE lang = 'de' GROUP BY h""",
    "win": "SELECT h, min(original_name) AS winner FROM parsed WHERE md IS NOT NULL GROUP BY h",
    "dec": f"""SELECT p.*, l.raw_path AS lp, w.winner, CASE WHEN l.content_hash IS NOT NULL THEN 'skipped' WHEN p.original_name = w.winner THEN 'ingested'
        WHEN p.original_name > w.winner THEN 'skipped' ELSE 'error' END AS status
        FROM parsed p LEFT JOIN ledger l ON l.content_hash = p.h LEFT JOIN win w ON w.h = p.h""",
    "ing": "SELECT h AS content_hash, original_name, concat('raw/', h, ext) AS raw_path, kind, '" + NOW + "' AS ingested_at, md FROM dec WHERE status = 'ingested'",
}


def _files(spark, sf):
    return inputs.view(spark, sf, "files_v").withColumn("content", F.encode("content", "UTF-8"))


def _ledger(spark, sf):
    """A ledger that already knows the contents of the German files."""
    old = _files(spark, sf).where("lang = 'de'").select(F.sha2("content", 256).alias("content_hash"), "original_name")
    return old.groupBy("content_hash").agg(F.min("original_name").alias("original_name")).select(
        "content_hash", "original_name", F.concat(F.lit("raw/"), "content_hash", F.lit(".old")).alias("raw_path"),
        F.lit("document").alias("kind"), F.lit("2024-01-01").alias("ingested_at"),
    )


def _ingest(spark, sf):
    return lg.ingest(_files(spark, sf).select("original_name", "content"), _ledger(spark, sf), NOW)


@register("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf):
    return inputs.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@register(
    "classify",
    with_views("files_v", **F_)
    + """SELECT original_name, kind, CASE e WHEN '.pdf' THEN 'application/pdf' WHEN '.md' THEN 'text/markdown' WHEN '.png' THEN 'image/png'
         WHEN '.json' THEN 'application/json' WHEN '.html' THEN 'text/html' WHEN '.csv' THEN 'text/csv' WHEN '.txt' THEN 'text/plain'
         ELSE 'application/octet-stream' END AS mime FROM typed""",
)
def classify(spark, sf):
    return fl.classify(_files(spark, sf).select("original_name")).select("original_name", "kind", "mime")


@register("to_markdown", with_views("files_v", **F_) + "SELECT original_name, md AS parsed_markdown FROM parsed WHERE md IS NOT NULL")
def to_markdown(spark, sf):
    return fl.split_errors(fl.to_markdown(_files(spark, sf)))[0].select("original_name", "parsed_markdown")


@register(
    "parse_errors",
    with_views("files_v", **F_) + "SELECT original_name, concat('no parser for ', kind, ' ', e) AS error FROM parsed WHERE md IS NULL",
)
def parse_errors(spark, sf):
    return fl.split_errors(fl.to_markdown(_files(spark, sf)))[1]


@register("ingest_new", with_views("files_v", **F_) + "SELECT original_name, content_hash, raw_path, kind, md AS parsed_markdown FROM ing")
def ingest_new(spark, sf):
    return _ingest(spark, sf).ingested.select("original_name", "content_hash", "raw_path", "kind", "parsed_markdown")


@register(
    "ingest_skipped",
    with_views("files_v", **F_)
    + """SELECT original_name, h AS content_hash, coalesce(lp, concat('raw/', h, regexp_extract(winner, '\\.[^.]+$'))) AS existing_raw_path,
         true AS remove_source FROM dec WHERE status = 'skipped'""",
)
def ingest_skipped(spark, sf):
    return _ingest(spark, sf).skipped


@register(
    "ingest_errors",
    with_views("files_v", **F_) + "SELECT original_name, concat('no parser for ', kind, ' ', e) AS message FROM dec WHERE status = 'error'",
)
def ingest_errors(spark, sf):
    return _ingest(spark, sf).errors


@register(
    "merge_ledger",
    with_views("files_v", **F_)
    + """SELECT h AS content_hash, max(original_name) AS original_name, concat('raw/', h, '.new') AS raw_path, 'document' AS kind, '2024-03-01' AS ingested_at
         FROM typed WHERE lang IN ('de', 'fr') GROUP BY h
         UNION ALL SELECT * FROM ledger l WHERE content_hash NOT IN (SELECT h FROM typed WHERE lang IN ('de', 'fr'))""",
)
def merge_ledger(spark, sf):
    """Files of an earlier and of a later run, keyed by content."""
    new = _files(spark, sf).where("lang IN ('de', 'fr')").select(
        F.sha2("content", 256).alias("content_hash"), "original_name", F.lit("document").alias("kind"), F.lit("2024-03-01").alias("ingested_at")
    ).withColumn("raw_path", F.concat(F.lit("raw/"), "content_hash", F.lit(".new")))
    return lg.merge_ledger(_ledger(spark, sf), new)


@register(
    "pending",
    with_views("files_v", **F_)
    + """SELECT l.content_hash, l.original_name, p.md AS parsed_markdown FROM ledger l JOIN (SELECT h, min(md) AS md FROM parsed WHERE md IS NOT NULL GROUP BY h) p ON p.h = l.content_hash
         WHERE l.content_hash NOT IN (SELECT sha256(text) FROM documents WHERE n_chars > 2000)""",
)
def pending(spark, sf):
    compiled = inputs.table(spark, sf, "documents").where("n_chars > 2000").select(F.sha2("text", 256).alias("content_hash"))
    good = fl.split_errors(fl.to_markdown(_files(spark, sf)))[0]
    staged = good.groupBy(F.sha2("content", 256).alias("content_hash")).agg(F.min("parsed_markdown").alias("parsed_markdown"))
    return lg.pending(_ledger(spark, sf), compiled, staged).select("content_hash", "original_name", "parsed_markdown")


@register(
    "log_rows",
    with_views("files_v", **F_)
    + f"""SELECT original_name, status, concat('- {NOW} ', CASE status WHEN 'ingested' THEN concat('INGESTED ', original_name, ' (', substr(h,1,12), ') kind=', kind)
          WHEN 'skipped' THEN concat('SKIPPED (duplicate) ', original_name, ' (', substr(h,1,12), ')')
          ELSE concat('ERROR ', original_name, ': no parser for ', kind, ' ', e) END) AS line FROM dec""",
)
def log_rows(spark, sf):
    return lg.log_rows(_ingest(spark, sf), NOW).drop("at")


# Events as job progress: one job per user, one file per event id bucket.
_EVENTS = """SELECT concat('job-', user_id) AS job_id, event_id AS seq, concat('file-', event_id % 7) AS file,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'compiling' WHEN 'view' THEN 'ingested' WHEN 'purchase' THEN 'done' ELSE 'queued' END AS status,
  event_type AS message FROM events"""


@register(
    "job_report",
    f"""WITH e AS ({_EVENTS}), j AS (SELECT max_by(job_id, seq) AS job_id FROM e), l AS (SELECT e.* FROM e JOIN j USING (job_id)),
    f AS (SELECT job_id, file, max_by(status, seq) AS s FROM l WHERE status IN ('queued','compiling','done','error') GROUP BY ALL)
    SELECT job_id, count(*) FILTER (status = 'ingested') AS ingested, count(*) FILTER (status = 'skipped') AS skipped,
      count(*) FILTER (status = 'done') AS compiled, count(*) FILTER (status = 'error') AS errors,
      (SELECT count(*) FROM f WHERE s IN ('queued','compiling')) = 0 AS done FROM l GROUP BY job_id""",
)
def job_report(spark, sf):
    inputs.table(spark, sf, "events").createOrReplaceTempView("events")
    return lg.job_report(spark.sql(_EVENTS))[0]


@register(
    "job_files",
    f"""WITH e AS ({_EVENTS}), j AS (SELECT max_by(job_id, seq) AS job_id FROM e)
    SELECT job_id, file, max_by(status, seq) AS status, max_by(message, seq) AS message FROM e JOIN j USING (job_id)
    WHERE status IN ('queued','compiling','done','error') GROUP BY ALL""",
)
def job_files(spark, sf):
    inputs.table(spark, sf, "events").createOrReplaceTempView("events")
    return lg.job_report(spark.sql(_EVENTS))[1]


@register(
    "html_title_anchors",
    """SELECT page_id, url, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title,
       len(regexp_extract_all(html, '(?i)<a\\s[^>]*href=')) AS anchors FROM pages""",
)
def html_title_anchors(spark, sf):
    p = inputs.table(spark, sf, "pages")
    return p.select("page_id", "url", hm.html_title(F.col("html")).alias("title"), hm.html_anchor_count(F.col("html")).alias("anchors"))


@register("html_to_markdown")
def html_to_markdown(spark, sf):
    return hm.html_to_markdown(inputs.table(spark, sf, "pages"))


@register(
    "raw_sources",
    """SELECT concat('raw/', sha256(doc_id::VARCHAR), '.md') AS page_path, concat('n', doc_id) AS title, 'source' AS page_type, text AS body
       FROM documents WHERE lang <> 'es'""",
)
def raw_sources(spark, sf):
    """Ledger rows with absolute, relative and doubly prefixed paths; the Spanish raw files are gone."""
    d = inputs.table(spark, sf, "documents")
    h = F.sha2(F.col("doc_id").cast("string"), 256)
    rel = F.concat(F.lit("raw/"), h, F.lit(".md"))
    ledger = d.select(
        h.alias("content_hash"), F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("original_name"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/data/vault/"), rel)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("vault/"), rel))
        .otherwise(rel).alias("raw_path"),
    )
    raw = d.where("lang <> 'es'").select(rel.alias("rel_path"), F.encode("text", "UTF-8").alias("content"))
    return lg.raw_sources(ledger, raw, "/data/vault").drop("tags", "frontmatter")


@register(
    "collect_tree",
    """WITH f AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'specs' WHEN 1 THEN 'memory' ELSE '.recent' END AS top, concat('a', doc_id % 5, '/d', doc_id, '.md') AS rest FROM documents),
       r AS (SELECT * FROM f WHERE top = '.recent' ORDER BY doc_id DESC LIMIT 20),
       n AS (SELECT concat(top, '__', replace(rest, '/', '__')) AS original_name FROM f WHERE top <> '.recent' UNION ALL SELECT concat('recent__', replace(rest, '/', '__')) FROM r)
       SELECT original_name FROM n WHERE original_name NOT LIKE 'specs\\_\\_a0%' ESCAPE '\\'""",
)
def collect_tree(spark, sf):
    d = inputs.table(spark, sf, "documents")
    top = F.when(F.col("doc_id") % 3 == 0, "specs").when(F.col("doc_id") % 3 == 1, "memory").otherwise(".recent")
    rest = F.concat(F.lit("a"), (F.col("doc_id") % 5).cast("string"), F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".md"))
    files = d.select(F.concat(top, F.lit("/"), rest).alias("rel_path"), F.col("doc_id").alias("mtime"))
    staged = files.where("rel_path like 'specs/a0/%'").select(F.replace(F.replace("rel_path", F.lit("specs/"), F.lit("specs__")), F.lit("/"), F.lit("__")).alias("original_name"))
    return fl.collect_tree(files, ("specs", "memory"), ".recent", staged)[0].select("original_name")

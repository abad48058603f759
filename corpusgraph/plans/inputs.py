"""Inputs derived from the supplied tables, as SQL that Spark and DuckDB both read.

Every statement runs over whole tables.  ``{text}`` and ``{sha}`` stand for the two
spellings that differ between the engines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

PAGES_V = """
SELECT
  concat('wiki/', CASE doc_id%4 WHEN 0 THEN 'sources' WHEN 1 THEN 'entities'
         WHEN 2 THEN 'concepts' ELSE 'sessions' END, '/doc-', doc_id, '.md') AS page_path,
  concat('Doc ', doc_id) AS title,
  CASE doc_id%4 WHEN 0 THEN 'source' WHEN 1 THEN 'entity' WHEN 2 THEN 'concept' ELSE 'session' END AS page_type,
  CASE WHEN doc_id%19=0 THEN 'needs-compile' WHEN doc_id%17=0 THEN 'stub' ELSE lang END AS tag,
  concat('# Doc ', doc_id, chr(10), chr(10),
    replace(text, chr(10), concat(chr(10), chr(10))),
    CASE WHEN doc_id%5<>0 AND k1%15<>0
         THEN concat(chr(10),chr(10),'## Links',chr(10),chr(10),'[[Doc ',k1,']]') ELSE '' END,
    CASE WHEN doc_id%5<>0 AND k2%15<>0 THEN concat(' [[doc ',k2,'|see also]]') ELSE '' END,
    CASE WHEN doc_id%11=0 THEN concat(' [[Missing ',doc_id%3,'#top]]') ELSE '' END) AS body,
  doc_id
FROM (SELECT d.*, (doc_id*7+3) % (SELECT count(*) FROM documents) AS k1,
                  (doc_id*13+1) % (SELECT count(*) FROM documents) AS k2 FROM documents d) k
"""

# The same pages as files: frontmatter with a list, a scalar or no tags, some without any
# frontmatter or heading, a repeated key.
PAGE_FILES_V = f"""
SELECT page_path, doc_id,
  CASE WHEN doc_id%9=0 THEN body
       WHEN doc_id%9=1 THEN concat('---', chr(10), 'title: Named ', doc_id, chr(10), 'tags: ', tag, chr(10), '---', chr(10), chr(10), body)
       WHEN doc_id%9=2 THEN concat('---', chr(10), 'type: ', page_type, chr(10), 'type: note', chr(10), 'tags: [', tag, ', x, ]', chr(10),
                                   '---', chr(10), chr(10), substr(body, 3))
       ELSE concat('---', chr(10), 'type: ', page_type, chr(10), 'source_hash: {{sha}}(body{{bits}})', chr(10),
                   'tags: [', tag, ']', chr(10), '---', chr(10), body) END AS text
FROM ({PAGES_V}) p
"""

FILES_V = """
SELECT concat('f', lpad(CAST(doc_id AS {text}),7,'0'),
  CASE doc_id%8 WHEN 0 THEN '.PDF' WHEN 1 THEN '.md' WHEN 2 THEN '.png' WHEN 3 THEN '.json'
       WHEN 4 THEN '.xyz' WHEN 5 THEN '.html' WHEN 6 THEN '.csv' ELSE '.txt' END) AS original_name,
  text AS content, doc_id, lang
FROM documents
"""

# A stored index of an earlier state of the pages.
STORED_V = f"""
SELECT page_path, title, page_type, CASE WHEN doc_id%7=0 THEN concat(body, ' edited') ELSE body END AS body, doc_id
FROM ({PAGES_V}) p WHERE doc_id%10<>9
UNION ALL
SELECT concat('wiki/concepts/gone-', doc_id, '.md'), concat('Gone ', doc_id), 'concept', body, doc_id
FROM ({PAGES_V}) p WHERE doc_id%50=0
"""

REL_V = """
SELECT 10000000+l_suppkey AS source_id, l_partkey AS target_id, 'related' AS type,
       concat(l_returnflag,l_linestatus) AS description, CAST(l_quantity AS DOUBLE) AS weight, l_orderkey, l_linenumber
FROM lineitem
UNION ALL SELECT 10000000+s_suppkey, 20000000+s_nationkey, 'related','', CAST(10.0 AS DOUBLE), 0, s_suppkey FROM supplier
UNION ALL SELECT 20000000+n_nationkey, 30000000+n_regionkey, 'related','in region', CAST(5.0 AS DOUBLE), 0, n_nationkey FROM nation
"""

ENTITIES_V = """
SELECT p_partkey AS entity_id, upper(p_name) AS title, 'CONCEPT' AS type, p_type AS description FROM part
UNION ALL SELECT 10000000+s_suppkey, upper(s_name), 'ORGANIZATION', concat('supplier of nation ', s_nationkey) FROM supplier
UNION ALL SELECT 20000000+n_nationkey, upper(n_name), 'LOCATION', concat('nation ', lower(n_name)) FROM nation
UNION ALL SELECT 30000000+r_regionkey, upper(r_name), 'LOCATION', concat('region ', lower(r_name)) FROM region
"""

QUESTIONS_V = "SELECT item_id AS question_id, text FROM benchmark"

REDACT_V = """
SELECT doc_id, concat(text,
  CASE WHEN doc_id%3=0 THEN concat(' mail user',doc_id,'@example.com key sk-', substr({sha}(text{bits}),1,24)) ELSE '' END,
  CASE WHEN doc_id%4=0 THEN concat(' AKIA', upper(substr({sha}(text{bits}),1,16))) ELSE '' END) AS text
FROM documents
"""

# Fixture completer: a pure function of a document's text, one text unit per document.
COMPLETIONS_V = """
SELECT doc_id, lang, CASE
    WHEN doc_id%19=0 THEN concat('Nothing to report about ', w[{i1}], ' today.')
    WHEN doc_id%17=0 THEN substr(answer, 1, length(answer)-20)
    WHEN doc_id%13=0 THEN concat('```', chr(10), answer, chr(10), '```')
    ELSE answer END AS response
FROM (
  SELECT doc_id, lang, w, concat(
    '("entity"<|>', w[{i1}], '<|>', CASE length(w[{i1}])%7 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORGANIZATION' WHEN 2 THEN 'LOCATION'
        WHEN 3 THEN 'EVENT' WHEN 4 THEN 'concept' WHEN 5 THEN 'OTHER' ELSE 'GIZMO' END, '<|>about ', lang,
    ')##("entity"<|>', w[{i2}], '<|>CONCEPT<|>', w[{i3}], ' of ', lang,
    ')##("relationship"<|>', w[{i1}], '<|>', w[{i2}], '<|>near ', lower(w[{i3}]), '<|>', length(w[{i2}]), ')<|COMPLETE|>') AS answer
  FROM (SELECT doc_id, lang, regexp_extract_all(text, '[A-Za-z]{{4,}}'{group}) AS w FROM documents) d
  WHERE {size}(w) >= 3
) a
"""


def _fill(sql: str, **names) -> str:
    return sql.format(**names)


_SPARK = {
    "text": "STRING", "sha": "sha2", "bits": ", 256", "group": ", 0", "size": "size", "i1": 0, "i2": 1, "i3": 2,
}
_DUCK = {"text": "VARCHAR", "sha": "sha256", "bits": "", "group": "", "size": "len", "i1": 1, "i2": 2, "i3": 3}

_RAW = {
    "pages_v": PAGES_V, "files_v": FILES_V, "stored_v": STORED_V, "rel_v": REL_V, "entities_v": ENTITIES_V,
    "questions_v": QUESTIONS_V, "redact_v": REDACT_V, "completions_v": COMPLETIONS_V,
}
_FILES_SPARK = PAGE_FILES_V.replace("{{sha}}(body{{bits}})", "', sha2(body, 256), '").replace("{sha}(body{bits})", "', sha2(body, 256), '")
_FILES_DUCK = PAGE_FILES_V.replace("{{sha}}(body{{bits}})", "', sha256(body), '").replace("{sha}(body{bits})", "', sha256(body), '")


def spark_sql(name: str) -> str:
    return _FILES_SPARK if name == "page_files_v" else _fill(_RAW[name], **_SPARK)


def duck_sql(name: str) -> str:
    return _FILES_DUCK if name == "page_files_v" else _fill(_RAW[name], **_DUCK)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table, dealt over the cores when it comes in fewer pieces than there are cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in _LARGE and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df


# Tables whose rows carry long texts or that have many rows.
_LARGE = ("documents", "pages", "lineitem", "events", "embeddings")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input; only the tables it names are registered."""
    sql = spark_sql(name)
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)

"""Check queries: spans, redaction, restoring; settle windows; folder watch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import privacy as pv
from ..session import run_folder
from ..streaming import settle as st
from . import inputs
from .catalog import register, with_views

_SK, _AKIA, _MAIL = r"\bsk-[A-Za-z0-9]{20,}\b", r"\bAKIA[0-9A-Z]{16}\b", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_HEX = r"token = .[0-9a-f]{40}."


def _patterns(spark):
    extra = spark.createDataFrame([("EMAIL_ADDRESS", _MAIL, 0.9), ("TOKEN", _HEX, 0.8)], "type string, pattern string, score double")
    return pv.secret_patterns(spark).unionByName(extra)


_COUNTS = " UNION ALL ".join(
    f"SELECT '{t}' AS type, len(regexp_extract_all(text, '{p}')) AS n FROM redact_v"
    for t, p in [("SECRET", x) for x in pv.SECRET_PATTERNS] + [("EMAIL_ADDRESS", _MAIL), ("TOKEN", _HEX)]
)


@register("span_counts", with_views("redact_v") + f"SELECT type, sum(n) AS n FROM ({_COUNTS}) x GROUP BY type")
def span_counts(spark, sf):
    return pv.count_spans(inputs.view(spark, sf, "redact_v"), _patterns(spark))


@register(
    "detect_spans",
    with_views("redact_v", c=" UNION ALL ".join(
        f"SELECT doc_id, '{t}' AS type, len(regexp_extract_all(text, '{p}')) AS spans, list_sum(list_transform(regexp_extract_all(text, '{p}'), lambda m: length(m))) AS chars FROM redact_v"
        for t, p in [("SECRET", x) for x in pv.SECRET_PATTERNS] + [("EMAIL_ADDRESS", _MAIL), ("TOKEN", _HEX)]))
    + "SELECT doc_id, type, sum(spans) AS spans, sum(chars) AS chars FROM c WHERE spans > 0 GROUP BY doc_id, type",
)
def detect_spans(spark, sf):
    s = pv.detect_spans(inputs.view(spark, sf, "redact_v"), _patterns(spark))
    return s.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("chars"))


@register(
    "redact",
    with_views("redact_v")
    + f"""SELECT doc_id, length(t) AS chars, sha256(t) AS text_hash FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{_MAIL.replace("[A-Za-z]{2,}", "com")}( key)', '[REDACTED_EMAIL_ADDRESS_1]\\1'),
          '{_SK}', '[REDACTED_SECRET_1]'), '{_AKIA}', CASE WHEN doc_id % 3 = 0 THEN '[REDACTED_SECRET_2]' ELSE '[REDACTED_SECRET_1]' END) AS t FROM redact_v) x""",
)
def redact(spark, sf):
    """The injected secrets and addresses, numbered by position."""
    docs = inputs.view(spark, sf, "redact_v")
    injected = spark.createDataFrame([("EMAIL_ADDRESS", r"\S+@example\.com(?= key sk-)", 0.9)], "type string, pattern string, score double")
    spans = pv.detect_spans(docs, pv.secret_patterns(spark).unionByName(injected))
    r = pv.redact(docs, spans)
    return r.select("doc_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_hash"))


@register("rehydrate", with_views("redact_v") + "SELECT doc_id, sha256(text) AS text_hash FROM redact_v")
def rehydrate(spark, sf):
    """Redact, restore, and get every text back."""
    docs = inputs.view(spark, sf, "redact_v")
    r = pv.redact(docs, pv.detect_spans(docs, _patterns(spark)))
    return pv.rehydrate(r).select("doc_id", F.sha2("text", 256).alias("text_hash"))


@register("rehydrate_exact", with_views("redact_v") + "SELECT doc_id, sha256(text) AS text_hash FROM redact_v")
def rehydrate_exact(spark, sf):
    docs = inputs.view(spark, sf, "redact_v")
    r = pv.redact(docs, pv.detect_spans(docs, _patterns(spark)))
    return r.select("doc_id", F.sha2(pv.rehydrate_exact(F.col("text"), F.col("token_map")), 256).alias("text_hash"))


@register("window_text", "SELECT doc_id, sha256(text) AS text_hash, length(text) AS chars FROM documents WHERE length(text) > 0")
def window_text(spark, sf):
    """Windows put together again are the text."""
    w = pv.window_text(inputs.table(spark, sf, "documents"))
    whole = w.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("offset", "chunk"))).alias("w"))
    text = F.array_join(F.transform("w", lambda x: x["chunk"]), "")
    return whole.select("doc_id", F.sha2(text, 256).alias("text_hash"), F.length(text).alias("chars"))


_SETTLE = """
  SELECT {key} AS key, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 300000000 AS end_us, count(*) AS events FROM (
    SELECT *, sum(f) OVER (PARTITION BY {key} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS w FROM (
      SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY {key} ORDER BY ts) >= INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS f FROM ({src}) s) a) b GROUP BY {key}, w"""


def _settle(spark, sf, key):
    e = inputs.table(spark, sf, "events").withColumn("key", key)
    s = st.settle(e, 300.0)
    return s.select("key", F.unix_micros("window_start").alias("start_us"), F.unix_micros("window_end").alias("end_us"), "events")


@register("settle_all", _SETTLE.format(key="k", src="SELECT ts, 'drop' AS k FROM events"))
def settle_all(spark, sf):
    return _settle(spark, sf, F.lit("drop"))


@register("settle_by_user", _SETTLE.format(key="user_id", src="SELECT ts, user_id FROM events"))
def settle_by_user(spark, sf):
    return _settle(spark, sf, F.col("user_id"))


@register("settle_stream", _SETTLE.format(key="k", src="SELECT ts, 'drop' AS k FROM events"))
def settle_stream(spark, sf):
    """The streaming form over the whole event table, run to its end.

    The watermark only closes a window once later events arrive, so one event far past
    the last is put behind the table; its own window stays open.
    """
    events = inputs.table(spark, sf, "events").select("ts", F.lit("drop").alias("key"))
    end = events.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    folder = f"{run_folder(spark)}/settle-{uuid.uuid4().hex}"
    events.unionByName(end.withColumn("key", F.lit("drop"))).repartitionByRange("ts").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("ts timestamp, key string").parquet(f"{folder}/in")
    with st.merged_before_exchange(spark):
        query = (
            st.settle_stream(stream, "5 minutes").writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
        )
    query.awaitTermination()
    out = spark.read.schema("key string, window_start timestamp, window_end timestamp, events bigint").parquet(f"{folder}/out")
    return out.select("key", F.unix_micros("window_start").alias("start_us"), F.unix_micros("window_end").alias("end_us"), "events")

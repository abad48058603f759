"""Ingest and compiled ledgers: content dedup, merge, pending work, log, job report."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from .files import classify, to_markdown

LEDGER_COLUMNS = ("content_hash", "original_name", "raw_path", "kind", "ingested_at")


class Ingest(NamedTuple):
    ingested: DataFrame
    skipped: DataFrame
    errors: DataFrame


def ingest(
    files: DataFrame, ledger: DataFrame, now: str, on_conflict: str = "skip", parsed: DataFrame | None = None
) -> Ingest:
    """Deduplicate dropped files by content against the ledger and within the batch.

    The first file of a content, by name, that can be parsed is ingested; later equal
    files are duplicates of it, earlier unparsable ones are errors.  The decision uses
    names and hashes only and finds each winner by a minimum, so a third of the files
    being copies of one costs no large group; file contents are joined once, by name.
    """
    if on_conflict not in ("skip", "keep"):
        raise ValueError(f"unknown conflict policy {on_conflict!r}")
    parsed = parsed if parsed is not None else to_markdown(files)
    hashed = parsed.withColumn("content_hash", F.sha2("content", 256))
    slim = hashed.select("original_name", "content_hash", "error")
    known = slim.join(ledger.select("content_hash", F.col("raw_path").alias("ledger_path")), "content_hash", "left")
    winners = (
        slim.where("error is null")
        .groupBy("content_hash")
        .agg(F.min("original_name").alias("winner"))
    )
    winner_path = F.concat(F.lit("raw/"), F.col("content_hash"), tx.suffix(F.col("winner")))
    decided = (
        known.join(winners, "content_hash", "left")
        .withColumn(
            "status",
            F.when(F.col("ledger_path").isNotNull(), "skipped")
            .when(F.col("original_name") == F.col("winner"), "ingested")
            .when(F.col("original_name") > F.col("winner"), "skipped")
            .otherwise("error"),
        )
        .withColumn("existing_raw_path", F.coalesce("ledger_path", winner_path))
    )
    rows = hashed.drop("content_hash", "error").join(
        decided.where("status = 'ingested'").select("original_name", "content_hash"), "original_name"
    )
    size = F.col("bytes") if "bytes" in files.columns else F.octet_length("content")
    ingested = classify(rows).select(
        "original_name",
        "content_hash",
        F.concat(F.lit("raw/"), F.col("content_hash"), tx.suffix(F.col("original_name"))).alias("raw_path"),
        "kind",
        "parsed_markdown",
        "mime",
        size.cast("long").alias("bytes"),
        F.lit(now).alias("ingested_at"),
        F.create_map(F.lit("staging_path"), F.concat(F.lit("staging/"), F.col("content_hash"), F.lit(".md"))).alias("metadata"),
    )
    skipped = decided.where("status = 'skipped'").select(
        "original_name", "content_hash", "existing_raw_path", F.lit(on_conflict == "skip").alias("remove_source")
    )
    errors = decided.where("status = 'error'").select("original_name", F.col("error").alias("message"))
    return Ingest(ingested, skipped, errors)


def merge_ledger(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """Union by hash; the incoming row wins, the newest of several."""
    cols = [c for c in LEDGER_COLUMNS if c != "content_hash"]
    both = ledger.select(*LEDGER_COLUMNS, F.lit(0).alias("incoming")).unionByName(
        new.select(*LEDGER_COLUMNS, F.lit(1).alias("incoming"))
    )
    best = F.max_by(F.struct(*cols), F.struct("incoming", "ingested_at", "original_name"))
    return both.groupBy("content_hash").agg(best.alias("r")).select("content_hash", *[f"r.{c}" for c in cols])


def raw_sources(ledger: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Ledger rows whose raw file still exists and parses, as source pages.

    ``files(rel_path, content)``.  Absolute paths are made relative to ``root``; a
    path that begins with the root's own name and is not found is retried without it.
    """
    root = root.rstrip("/")
    name = root.rsplit("/", 1)[-1]
    rel = F.regexp_replace("raw_path", F.lit("^" + _quoted(root) + "/"), F.lit(""))
    healed = F.regexp_replace(rel, F.lit("^" + _quoted(name) + "/"), F.lit(""))
    tries = F.array(F.struct(F.lit(0).alias("rank"), rel.alias("rel_path")), F.struct(F.lit(1).alias("rank"), healed.alias("rel_path")))
    found = (
        ledger.select("content_hash", "original_name", F.explode(tries).alias("t"))
        .select("content_hash", "original_name", "t.rank", "t.rel_path")
        .join(files.select("rel_path"), "rel_path")
        .groupBy("content_hash")
        .agg(F.min_by(F.struct("original_name", "rel_path"), "rank").alias("r"))
        .select("content_hash", F.coalesce("r.original_name", tx.basename(F.col("r.rel_path"))).alias("title"), "r.rel_path")
    )
    body = to_markdown(
        files.join(found, "rel_path").withColumn("original_name", tx.basename(F.col("rel_path")))
    )
    return (
        body.where("error is null")
        .select(
            F.col("rel_path").alias("page_path"),
            "title",
            F.lit("source").alias("page_type"),
            F.array().cast("array<string>").alias("tags"),
            F.create_map(F.lit("content_hash"), F.col("content_hash")).alias("frontmatter"),
            F.col("parsed_markdown").alias("body"),
        )
    )


def _quoted(text: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in text)


def pending(ledger: DataFrame, compiled: DataFrame, staged: DataFrame) -> DataFrame:
    """Ledger rows not compiled yet that still have staged text."""
    return ledger.join(compiled.select("content_hash"), "content_hash", "left_anti").join(
        staged.select("content_hash", "parsed_markdown"), "content_hash"
    )


def log_rows(result: Ingest, now: str, compiled: DataFrame | None = None) -> DataFrame:
    """One line per file, to be appended to the operation log."""

    def line(df: DataFrame, status: str, text) -> DataFrame:
        return df.select(
            F.lit(now).alias("at"), "original_name", F.lit(status).alias("status"),
            F.concat(F.lit(f"- {now} "), text).alias("line"),
        )

    short = F.substring("content_hash", 1, 12)
    name = F.col("original_name")
    out = line(result.ingested, "ingested", F.concat(F.lit("INGESTED "), name, F.lit(" ("), short, F.lit(") kind="), F.col("kind")))
    out = out.unionByName(line(result.skipped, "skipped", F.concat(F.lit("SKIPPED (duplicate) "), name, F.lit(" ("), short, F.lit(")"))))
    out = out.unionByName(line(result.errors, "error", F.concat(F.lit("ERROR "), name, F.lit(": "), F.col("message"))))
    if compiled is not None:
        out = out.unionByName(
            line(compiled, "compiled", F.concat(F.lit("COMPILED "), name, F.lit(" ("), short, F.lit(")")))
        )
    return out


def job_report(events: DataFrame, job_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts per job and newest status per file.

    ``events(job_id, seq, file, status, message)`` with status queued, compiling, done,
    error, ingested or skipped.  Without ``job_id`` the latest job is reported.
    """
    if job_id is not None:
        events = events.where(F.col("job_id") == job_id)
    else:
        latest = events.agg(F.max_by("job_id", "seq").alias("j")).scalar()
        events = events.where(F.col("job_id") == latest)
    progress = events.where(F.col("status").isin("queued", "compiling", "done", "error"))
    files = progress.groupBy("job_id", "file").agg(
        F.max_by("status", "seq").alias("status"), F.max_by("message", "seq").alias("message")
    )
    counts = events.groupBy("job_id").agg(
        F.count_if(F.col("status") == "ingested").alias("ingested"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "done").alias("compiled"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )
    open_files = files.groupBy("job_id").agg(F.count_if(F.col("status").isin("queued", "compiling")).alias("open"))
    jobs = counts.join(open_files, "job_id", "left").withColumn("done", F.coalesce("open", F.lit(0)) == 0).drop("open")
    return jobs, files

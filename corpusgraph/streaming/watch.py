"""Watching a folder: ingest every new content once, keep the indexes current.

A clock stream starts the cycles.  Each lists the folder without reading it, compares the
listing with the one stored by the cycle before, and reads only new and changed files; a
file source alone would never see a path a second time, nor miss one that went.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tx
from ..operators.maintain import PageIndex, build_index, diff_pages
from ..operators.pages import parse_pages
from ..session import cut
from ..sources.files import to_markdown, utf8
from ..sources.ledger import LEDGER_COLUMNS, ingest, log_rows
from ..sources.snapshots import BUCKET_BYTES, Snapshots
from .settle import SETTLE_SECONDS

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
LEDGER_SCHEMA = "content_hash string, original_name string, raw_path string, kind string, ingested_at string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_ledger(spark: SparkSession, state: str, before_batch: int | None = None) -> DataFrame:
    """Ledger rows written so far; ``before_batch`` leaves out that batch and later ones."""
    path = f"{state}/ledger"
    if not _exists(spark, path):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    rows = spark.read.schema(LEDGER_SCHEMA + ", batch bigint").parquet(path)
    if before_batch is not None:
        rows = rows.where(F.col("batch") < before_batch)
    return rows.select(*LEDGER_COLUMNS)


def ingest_batch(spark: SparkSession, files: DataFrame, state: str, batch: int, html: bool = False) -> DataFrame:
    """Ingest one settled batch and write its sources, ledger rows and log.

    Every table is written to the folder of its batch number, and the ledger is read
    without that number, so a batch that is run again after a failure gives the same
    result and nothing is ingested twice.
    """
    now = datetime.now(timezone.utc).isoformat()
    parsed = cut(to_markdown(files, html))
    ledger = read_ledger(spark, state, batch)
    result = ingest(parsed.drop("parsed_markdown", "error"), ledger, now, parsed=parsed)
    sources = f"{state}/sources/batch={batch}"
    result.ingested.write.mode("overwrite").parquet(sources)
    done = spark.read.parquet(sources)
    log_rows(result._replace(ingested=done), now).write.mode("overwrite").parquet(f"{state}/log/batch={batch}")
    done.select(*LEDGER_COLUMNS).write.mode("overwrite").parquet(f"{state}/ledger/batch={batch}")
    return done


LISTING_SCHEMA = "path string, length bigint, modificationTime timestamp"


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(path, length, modificationTime)`` of all files below a folder; contents are not read."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], LISTING_SCHEMA)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", "modificationTime")


def _cycles(spark: SparkSession, state: str, once: bool, interval: str, cycle: Callable[[int], None]) -> StreamingQuery:
    """Run ``cycle(batch)`` once, or again and again."""
    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    writer = clock.writeStream.foreachBatch(lambda _, batch: cycle(batch)).option("checkpointLocation", f"{state}/checkpoint")
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


class Changes:
    """What a cycle finds in a folder since the last one that took its changes."""

    def __init__(self, spark: SparkSession, folder: str, state: str, batch: int, pattern: str = "*"):
        self.spark, self.folder, self.pattern, self.stored = spark, folder, pattern, f"{state}/listing"
        self.batch = batch
        self.now = cut(list_files(spark, folder, pattern))
        before = spark.createDataFrame([], LISTING_SCHEMA)
        if _exists(spark, self.stored):
            told = spark.read.schema(LISTING_SCHEMA + ", batch bigint").parquet(self.stored).where(F.col("batch") < batch)
            # one number
            last = told.agg(F.max("batch").alias("b")).first()["b"]
            before = told.where(F.col("batch") == F.lit(last)).drop("batch") if last is not None else before
        self.changed = cut(self.now.join(before, ["path", "length", "modificationTime"], "left_anti"))
        self.gone = cut(before.select("path").join(self.now, "path", "left_anti"))
        told = self.changed.agg(F.min("modificationTime").alias("first"), F.max("modificationTime").alias("last"), F.count(F.lit(1)).alias("n")).first()
        self.first, self.last, self.any = told["first"], told["last"], bool(told["n"]) or not self.gone.isEmpty()

    def settled(self, quiet: float) -> bool:
        """Whether the newest change is ``quiet`` seconds old, so that no burst is split and no half-written file is read."""
        return self.last is None or time.time() - self.last.timestamp() >= quiet

    def files(self) -> DataFrame:
        """New and changed files with their content; older ones are skipped by the reader."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", self.pattern)
        if self.first is None:
            return self.spark.createDataFrame([], FILE_SCHEMA)
        return files.load(self.folder).where(F.col("modificationTime") >= F.lit(self.first)).join(self.changed.select("path"), "path", "left_semi")

    def taken(self) -> None:
        """Store the listing; a cycle that fails before is run again over the same changes.

        The listing before it stays for such a rerun, older ones go.
        """
        self.now.write.mode("overwrite").parquet(f"{self.stored}/batch={self.batch}")
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.stored)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        told = sorted((int(s.getPath().getName().removeprefix("batch=")), s.getPath()) for s in files.listStatus(root) if s.getPath().getName().startswith("batch="))
        for _, old in told[:-2]:
            files.delete(old, True)


def _settled_changes(spark, folder, state, batch, once, quiet, pattern="*") -> Changes | None:
    """Changes that have come to rest; a single pass waits for that, a running watch looks again in its next cycle."""
    found = Changes(spark, folder, state, batch, pattern)
    while found.any and not found.settled(quiet):
        if not once:
            return None
        time.sleep(quiet)
        found = Changes(spark, folder, state, batch, pattern)
    return found if found.any else None


def watch(
    spark: SparkSession,
    folder: str,
    state: str,
    on_batch: Callable[[DataFrame, int], None] | None = None,
    once: bool = False,
    interval: str = "2 seconds",
    html: bool = False,
    settle_seconds: float = SETTLE_SECONDS,
) -> StreamingQuery:
    """Ingest files as they appear or change in ``folder``; ``once`` runs a single pass and stops.

    A cycle starts when the folder has been quiet for ``settle_seconds``.
    ``on_batch(sources, batch)`` is called after each ingest; its failure is logged and
    does not stop the watch.  One query runs one batch at a time.
    """

    def cycle(batch: int) -> None:
        found = _settled_changes(spark, folder, state, batch, once, settle_seconds)
        if found is None:
            return
        files = (
            found.files().withColumn("original_name", tx.basename(F.col("path")))
            .where(~F.startswith("original_name", F.lit(".")))
            .select("original_name", "content", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"))
        )
        done = ingest_batch(spark, files, state, batch, html)
        found.taken()
        if on_batch is not None:
            try:
                on_batch(done, batch)
            except Exception as error:  # noqa: BLE001 - a failing follow-up must not stop the watch
                spark.createDataFrame([(batch, str(error)[:2000])], "batch bigint, message string").write.mode("append").parquet(f"{state}/failures")

    return _cycles(spark, state, once, interval, cycle)


def once_per_content(files: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Drop repeats of a content inside the stream; state is bounded by the watermark.

    Repeats over all time are caught by the ledger.
    """
    return (
        files.withColumn("content_hash", F.sha2("content", 256))
        .withWatermark("modificationTime", lateness)
        .dropDuplicatesWithinWatermark(["content_hash"])
    )


# name: (columns, the key that buckets follow)
INDEX_TABLES = {
    "index": ("page_path string, title string, page_type string, content_hash string, updated string", "page_path"),
    "postings": ("doc_id string, term string, tf bigint, tf_title bigint, dl int", "doc_id"),
    "vectors": ("doc_id string, vector array<double>", "doc_id"),
}


def index_store(spark: SparkSession, state: str, bucket_bytes: int = BUCKET_BYTES) -> Snapshots:
    return Snapshots(spark, f"{state}/index", bucket_bytes)


def read_index(spark: SparkSession, state: str) -> PageIndex | None:
    """The three index tables as of the last batch."""
    store = index_store(spark, state)
    if not store.batches():
        return None
    version = store.version()
    return PageIndex(*[version.read(name, INDEX_TABLES[name][0]) for name in PageIndex._fields])


def index_batch(
    spark: SparkSession, pages: DataFrame, state: str, batch: int, partial: bool = True, removed: DataFrame | None = None, bucket_bytes: int = BUCKET_BYTES
) -> None:
    """Index the pages of a batch whose body hash changed.

    The buckets that their paths fall into are read and written again, so a batch costs what it
    touches and not the size of the index; buckets above ``bucket_bytes`` are dealt deeper, and
    all three tables change at once.  With ``partial`` the batch holds new and changed pages only; otherwise
    it is the whole collection and pages missing from it go.  ``removed(page_path)`` names
    pages that went.  A batch that was committed before is left as it is.
    """
    store = index_store(spark, state, bucket_bytes)
    if store.committed(batch):
        return
    change = store.change(batch)
    now = datetime.now(timezone.utc).isoformat()
    pages = cut(pages)
    schema = INDEX_TABLES["index"][0]
    named = pages.select("page_path")
    if removed is not None:
        named = named.unionByName(removed.select("page_path"))
    met = change.old.touched("index", F.col("page_path"), named) if partial else None
    stored = cut(change.old.read("index", schema, met).select("page_path", "content_hash"))
    diff = cut(diff_pages(pages, stored.join(named, "page_path", "left_semi") if partial else stored))
    fresh = pages.join(diff.where("change in ('added','updated')").select("page_path"), "page_path", "left_semi")
    built = build_index(fresh, now)
    old = diff.where("change in ('updated','deleted')").select("page_path")
    if removed is not None:
        old = old.unionByName(removed.select("page_path")).distinct()
    new = diff.where("change in ('added','updated')").select("page_path")
    hit = cut(old.unionByName(new).distinct())
    for name, rows in zip(PageIndex._fields, built, strict=True):
        schema, key = INDEX_TABLES[name]
        keys = hit.withColumnRenamed("page_path", key)
        change.replace(name, schema, key, keys, lambda kept, keys=keys, key=key: kept.join(keys, key, "left_anti"), rows)
    change.commit()


def cycles_over_changes(
    spark: SparkSession, folder: str, state: str, handle: Callable[[Changes, int], None], once: bool, interval: str, quiet: float, pattern: str = "*"
) -> StreamingQuery:
    """Call ``handle(changes, batch)`` whenever the folder changed and came to rest; the changes count as taken when it returns."""

    def cycle(batch: int) -> None:
        found = _settled_changes(spark, folder, state, batch, once, quiet, pattern)
        if found is not None:
            handle(found, batch)
            found.taken()

    return _cycles(spark, state, once, interval, cycle)


def index_stream(
    spark: SparkSession, wiki: str, state: str, once: bool = False, interval: str = "2 seconds", settle_seconds: float = SETTLE_SECONDS
) -> StreamingQuery:
    """Keep the index of the page files below ``wiki``: new, changed and removed ones."""

    def page(path: str):
        return F.concat(F.lit("wiki/"), F.regexp_extract(path, r"/wiki/(.*)$", 1)).alias("page_path")

    def handle(found: Changes, batch: int) -> None:
        files = found.files().select(page("path"), utf8(F.col("content")).alias("text"))
        index_batch(spark, parse_pages(files), state, batch, removed=found.gone.select(page("path")))

    return cycles_over_changes(spark, wiki, state, handle, once, interval, settle_seconds, "*.md")

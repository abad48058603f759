"""Session settings and lineage cuts.

Loops and non-repeatable steps write their intermediate tables as Parquet under
the shared folder named by ``spark.checkpoint.dir``.  A written table survives the
loss of an executor, stops the plan from growing, and gives the optimizer real
sizes, so a join side is broadcast only when its measured size allows it.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "corpusgraph", cores: int | None = None) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for written intermediates."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


_RUN = uuid.uuid4().hex
_PREPARED: set[tuple[str, str]] = set()


def run_folder(spark: SparkSession) -> str:
    """Folder of this run's intermediates; it goes when the driver ends."""
    folder = f"{checkpoint_root(spark)}/corpusgraph/{_RUN}"
    key = (spark.sparkContext.applicationId, folder)
    if key not in _PREPARED:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _PREPARED.add(key)
    return folder


_HELD: ContextVar[list[DataFrame] | None] = ContextVar("held", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Frames that :func:`cut` writes inside go at the end, and with them the shuffle files of plans that nothing names any more.

    For the batches of a stream: what they leave would add up while the session lives.
    """
    held: list[DataFrame] = []
    token = _HELD.set(held)
    try:
        yield
    finally:
        _HELD.reset(token)
        for df in held:
            drop_cut(df)
        held.clear()
        release(spark)


def release(spark: SparkSession) -> None:
    """Spark deletes shuffle files once the driver has collected what refers to them."""
    gc.collect()
    spark._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once and return a frame that reads it back."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
    except BaseException:
        _drop(spark, path)
        raise
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusgraph_path = path
    if (held := _HELD.get()) is not None:
        held.append(out)
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete a frame made by :func:`cut` once a later one replaces it."""
    path = getattr(df, "_corpusgraph_path", None)
    if path is None:
        return
    _drop(df.sparkSession, path)


def _drop(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

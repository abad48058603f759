"""Undirected edges, salted adjacency, edges in cells and small graph lookups."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut

# Adjacency rows of one node that stay together; a larger node is salted.
HUB_ROWS = 100_000
# Adjacency rows for each partition; their number follows the graph.
TASK_ROWS = 200_000
# Edges of one cell, and those that are worth a task of their own.
CELL_ROWS = 1_000_000
SMALL_CELL_ROWS = 100_000
# A node with that many times the edges of the average node is busy.
BUSY = 4


def undirected_edges(relationships: DataFrame) -> DataFrame:
    """``(a, b, weight)`` with a < b: all types and both directions summed, self-loops dropped."""
    return (
        relationships.where(F.col("source_id") != F.col("target_id"))
        .groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"))
        .agg(F.sum("weight").alias("weight"))
    )


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of undirected edges: ``(src, dst, weight)``."""
    pair = F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))
    )
    return edges.select(F.explode(pair).alias("p"), "weight").select("p.src", "p.dst", "weight")


class Adjacency:
    """Symmetric adjacency, hash-partitioned once and reused by every round of a loop.

    A node with more than ``hub_rows`` edges is split over several salts, so that no
    partition holds a whole hub.  Node values are repeated once per salt of their
    node before they meet the edges; all other nodes have a single salt.
    There is one partition for every ``task_rows`` edges.  A graph without such nodes is
    partitioned by node alone, and values grouped by node meet it without a shuffle.
    """

    def __init__(self, sym: DataFrame, hub_rows: int = HUB_ROWS, loops: bool = False, task_rows: int = TASK_ROWS):
        spark = sym.sparkSession
        if loops:
            # an edge of weight 1 from every node to itself
            own = sym.select("src").distinct().select("src", F.col("src").alias("dst"), F.lit(1.0).alias("weight"))
            sym = sym.unionByName(own)
        base = cut(sym)
        spread = base.groupBy("src").agg(F.count(F.lit(1)).alias("n")).withColumn(
            "spread", F.ceil(F.col("n") / F.lit(hub_rows)).cast("int")
        )
        size = spread.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("spread").alias("most")).first()
        self.n_rows, self.salted = size["n"], (size["most"] or 0) > 1
        self.hubs = cut(spread.where(F.col("spread") > 1).select("src", "spread")) if self.salted else None
        self.parts = parts = max(1, -(-self.n_rows // task_rows))
        if self.salted:
            salt = F.pmod(F.xxhash64("dst"), F.coalesce("spread", F.lit(1))).cast("int")
            rows = base.join(self.hubs, "src", "left").withColumn("salt", salt).drop("spread").repartition(parts, "src", "salt")
        else:
            rows = base.repartition(parts, "src")
        self.rows = rows.persist()

    def meet(self, values: DataFrame, node: str = "node") -> DataFrame:
        """Join ``values(node, …)`` with the edges that leave each node."""
        values = values.withColumnRenamed(node, "src")
        if not self.salted:
            # hash the node values of a partition; its edges are many more and need no sort
            return values.hint("shuffle_hash").join(self.rows, "src")
        salts = F.explode(F.sequence(F.lit(0), F.coalesce("spread", F.lit(1)) - 1))
        dealt = values.join(self.hubs, "src", "left").withColumn("salt", salts).drop("spread")
        return dealt.hint("shuffle_hash").join(self.rows, ["src", "salt"]).drop("salt")

    def release(self) -> None:
        self.rows.unpersist()


class Cells:
    """Undirected edges ``(a, b, weight)``, each stored once, in the cell of the end with fewer edges.  ``b`` may be null.

    That end is the edge's ``home``.  What the far ends tell a home is reduced in its cell; a
    busy node is told once by every cell that holds its edges, not once by every edge.
    Ends that are not busy count as equal.  A busy home has only neighbours that are at
    least as busy, so it holds no more than the root of twice the number of edges, and no cell holds
    a whole hub.
    """

    def __init__(self, edges: DataFrame, cell_rows: int = CELL_ROWS):
        base = cut(edges.select("a", "b", "weight"))
        ends = base.select(F.explode(F.array("a", "b")).alias("entity_id")).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
        ends = cut(ends)
        size = ends.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("nodes")).first()
        n_edges = size["n"] // 2
        cores = edges.sparkSession.sparkContext.defaultParallelism
        self.n = max(1, -(-n_edges // cell_rows), min(cores, -(-n_edges // SMALL_CELL_ROWS)))
        busy = cut(ends.where(F.col("n") * size["nodes"] >= BUSY * size["n"]))
        degree = {e: busy.select(F.col("entity_id").alias(e), F.col("n").alias(f"n_{e}")) for e in "ab"}
        known = base.join(degree["a"], "a", "left").join(degree["b"], "b", "left")
        first = F.col("b").isNull() | (F.coalesce("n_a", F.lit(0)) <= F.coalesce("n_b", F.lit(0)))
        placed = known.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("home"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("far"), "weight")
        cell = F.pmod(F.xxhash64("home"), F.lit(self.n)).cast("int").alias("cell")
        self.rows = placed.select(cell, "home", "far", "weight").repartition(self.n, "cell").sortWithinPartitions("cell").persist()
        inside = self.rows.groupBy("cell", "home").agg(F.lit(1)).select("cell", F.col("home").alias("entity_id"))
        across = self.rows.groupBy("cell", "far").agg(F.lit(1)).select("cell", F.col("far").alias("entity_id"))
        # at most one entry per cell
        self.places = cut(inside.unionAll(across).where("entity_id is not null").groupBy("entity_id").agg(F.collect_set("cell").alias("cells")))

    def meet(self, values: DataFrame, step: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
        """``step(edges, values)`` of every cell, with the ``values(entity_id, …)`` of all nodes that have edges there."""
        dealt = values.join(self.places, "entity_id").withColumn("cell", F.explode("cells")).drop("cells")
        return self.rows.groupBy("cell").cogroup(dealt.groupBy("cell")).applyInArrow(step, schema)

    def release(self) -> None:
        self.rows.unpersist()


def neighbors(edges: DataFrame, node_id) -> DataFrame:
    """Ids one edge away from a node, whichever way the edge points."""
    other = F.when(F.col("source") == F.lit(node_id), F.col("target")).when(
        F.col("target") == F.lit(node_id), F.col("source")
    )
    return edges.select(other.alias("id")).where("id is not null").distinct()


def edges_among(relationships: DataFrame, ids: DataFrame) -> DataFrame:
    """Relationships with both ends in ``ids(entity_id)``."""
    wanted = ids.select("entity_id").distinct()
    return relationships.join(wanted.withColumnRenamed("entity_id", "source_id"), "source_id", "left_semi").join(
        wanted.withColumnRenamed("entity_id", "target_id"), "target_id", "left_semi"
    )


def edges_touching(relationships: DataFrame, ids: DataFrame) -> DataFrame:
    """Relationships with at least one end in ``ids(entity_id)``, each once."""
    wanted = ids.select("entity_id").distinct()
    by_source = relationships.join(wanted.withColumnRenamed("entity_id", "source_id"), "source_id", "left_semi")
    rest = relationships.join(wanted.withColumnRenamed("entity_id", "source_id"), "source_id", "left_anti")
    by_target = rest.join(wanted.withColumnRenamed("entity_id", "target_id"), "target_id", "left_semi")
    return by_source.unionByName(by_target)


def global_row_number(df: DataFrame, *order: str, name: str = "row") -> DataFrame:
    """Number all rows from 1 in a total order, without moving them to one task.

    Rows are ranged by the order and written; only one count per range is summed up.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range: bounded by the number of partitions
    before = counts.withColumn(
        "_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("_range", "_before")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        ranged.join(before, "_range").withColumn(name, (F.col("_before") + inside).cast("long")).drop("_range", "_before")
    )

"""Eigenvector centrality by power iteration."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..session import cut, drop_cut
from .edges import Adjacency, symmetric

# Iteration cap and stop threshold.
MAX_ITERATIONS = 500
TOLERANCE = 1e-10
STEPS_PER_PLAN = 25
# Tasks that multiply in one plan: every task reports on all steps before it in its plan.
TASKS_PER_PLAN = 32
# Edges of one task.
TASK_ROWS = 500_000


class Centrality(NamedTuple):
    scores: DataFrame
    converged: bool
    delta: float | None
    iterations: int


def eigenvector(
    edges: DataFrame,
    nodes: DataFrame,
    max_iterations: int = MAX_ITERATIONS,
    tolerance: float = TOLERANCE,
    steps_per_plan: int = STEPS_PER_PLAN,
) -> Centrality:
    """Scores scaled to a maximum of 1: ``scores(entity_id, score)``.

    Iterates on identity plus adjacency.  The vector is left unnormalised for a few
    steps, then one pass measures its length and the change of direction in the last
    step.  Isolated nodes score 0; edges to unknown nodes are ignored.
    """
    known = nodes.select("entity_id")
    inside = edges.join(known.withColumnRenamed("entity_id", "a"), "a", "left_semi").join(
        known.withColumnRenamed("entity_id", "b"), "b", "left_semi"
    )
    weighted = inside.select("a", "b", F.col("weight").cast("double").alias("weight"))
    adjacency = Adjacency(symmetric(weighted), loops=True, task_rows=TASK_ROWS)
    x = cut(adjacency.rows.select(F.col("src").alias("node")).distinct().withColumn("x", F.lit(1.0)))
    done, delta, converged = 0, None, True
    if adjacency.n_rows:
        converged = False
        while done < max_iterations and not converged:
            steps = min(steps_per_plan, max_iterations - done)
            stepped = _steps(x, adjacency, steps)
            done += steps
            size = stepped.agg(
                F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("now"),
                F.sqrt(F.sum(F.col("before") * F.col("before"))).alias("before"),
            ).first()
            x = stepped.select("node", (F.col("x") / F.lit(size["now"])).alias("x"))
            x._corpusgraph_path = stepped._corpusgraph_path
            moved = F.abs(F.col("x") / F.lit(size["now"]) - F.col("before") / F.lit(size["before"]))
            delta = stepped.agg(F.sum(moved).alias("d")).first()["d"]
            converged = delta < tolerance
    adjacency.release()
    top = x.agg(F.max("x").alias("m")).scalar()
    score = F.when(top > 0, F.greatest(F.col("x") / top, F.lit(0.0))).otherwise(F.lit(0.0))
    scores = (
        known.join(x.withColumnRenamed("node", "entity_id"), "entity_id", "left")
        .select("entity_id", F.coalesce(score, F.lit(0.0)).alias("score"))
    )
    return Centrality(scores, converged, delta, done)


def _steps(x: DataFrame, adjacency: Adjacency, steps: int) -> DataFrame:
    """Some multiplications, written; the value before the last one is kept as ``before``.

    The edge of a node to itself carries the node's own value along.  A plan holds as many
    steps as make ``TASKS_PER_PLAN`` tasks: what tasks send to the driver grows with
    the steps before theirs in a plan, so large graphs write after every step.
    """
    written, per_plan = x, max(1, TASKS_PER_PLAN // adjacency.parts)
    for i in range(steps):
        if i % per_plan and not adjacency.salted:
            # the sums come in more partitions than a small graph has, and would have its edges dealt again
            x = x.repartition(adjacency.parts, "node")
        came = adjacency.meet(x.select("node", "x"), "node")
        sums = [F.sum(F.col("x") * F.col("weight")).alias("x")]
        if i == steps - 1:
            sums.append(F.sum(F.when(F.col("src") == F.col("dst"), F.col("x"))).alias("before"))
        x = came.groupBy("dst").agg(*sums).withColumnRenamed("dst", "node")
        if i == steps - 1 or (i + 1) % per_plan == 0:
            x = cut(x)
            drop_cut(written)
            written = x
    return x

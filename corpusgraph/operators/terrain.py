"""Elevation grid over weighted points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Grid side, padding and least span.
GRID_SIZE = 48
PADDING = 20.0
MIN_SPAN = 40.0


def grid_frame(points: DataFrame, size: int = GRID_SIZE) -> DataFrame:
    """One row ``(min_x, min_z, cell)``: the square around all points."""
    box = points.agg(
        F.coalesce(F.min("x"), F.lit(-MIN_SPAN / 2)).alias("x0"), F.coalesce(F.max("x"), F.lit(MIN_SPAN / 2)).alias("x1"),
        F.coalesce(F.min("z"), F.lit(-MIN_SPAN / 2)).alias("z0"), F.coalesce(F.max("z"), F.lit(MIN_SPAN / 2)).alias("z1"),
    )
    span = F.greatest(F.lit(MIN_SPAN), F.col("x1") - F.col("x0") + 2 * PADDING, F.col("z1") - F.col("z0") + 2 * PADDING)
    return box.withColumn("span", span).select(
        ((F.col("x0") + F.col("x1")) / 2 - F.col("span") / 2).alias("min_x"),
        ((F.col("z0") + F.col("z1")) / 2 - F.col("span") / 2).alias("min_z"),
        (F.col("span") / size).alias("cell"),
    )


def _index(v: Column, size: int) -> Column:
    return F.greatest(F.least(F.floor(v), F.lit(size - 1)), F.lit(0)).cast("int")


def elevation_grid(points: DataFrame, size: int = GRID_SIZE) -> DataFrame:
    """``(row, col, height)`` of the whole grid, 0 to 1, from ``points(x, z, weight)``.

    Weights are summed per cell, averaged over the 3×3 cells around it that exist, and
    divided by the largest.  After the first sum at most ``size``² rows are left.
    """
    frame = grid_frame(points, size)
    min_x, min_z, cell = (frame.select(c).scalar() for c in ("min_x", "min_z", "cell"))
    raw = (
        points.where("weight > 0")
        .select(_index((F.col("z") - min_z) / cell, size).alias("row"), _index((F.col("x") - min_x) / cell, size).alias("col"), "weight")
        .groupBy("row", "col")
        .agg(F.sum("weight").alias("w"))
    )
    shifts = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1)]))
    spread = (
        raw.withColumn("s", shifts)
        .select((F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"), "w")
        .where(F.col("row").between(0, size - 1) & F.col("col").between(0, size - 1))
        .groupBy("row", "col")
        .agg(F.sum("w").alias("w"))
    )

    def around(c: str) -> Column:
        return F.lit(3) - (F.col(c) == 0).cast("int") - (F.col(c) == size - 1).cast("int")

    spark = points.sparkSession
    cells = spark.range(size * size).select(
        F.floor(F.col("id") / size).cast("int").alias("row"), (F.col("id") % size).cast("int").alias("col")
    )
    blurred = cells.join(spread, ["row", "col"], "left").select(
        "row", "col", (F.coalesce("w", F.lit(0.0)) / (around("row") * around("col"))).alias("h")
    )
    top = spread.select((F.col("w") / (around("row") * around("col"))).alias("h")).agg(F.max("h")).scalar()
    return blurred.select("row", "col", F.when(top > 0, F.col("h") / top).otherwise(F.lit(0.0)).alias("height"))


def sample_grid(points: DataFrame, grid: DataFrame, frame: DataFrame, size: int = GRID_SIZE) -> DataFrame:
    """Bilinear height at every ``points(id, x, z)``, clamped to the grid's edges.

    The four corner cells are looked up in one equi join against the small grid.
    """
    min_x, min_z, cell = (frame.select(c).scalar() for c in ("min_x", "min_z", "cell"))

    def position(c: str, origin: Column) -> Column:
        return F.least(F.greatest((F.col(c) - origin) / cell - 0.5, F.lit(0.0)), F.lit(float(size - 1)))

    at = points.select("id", position("x", min_x).alias("fx"), position("z", min_z).alias("fz"))
    at = at.withColumn("c0", F.floor("fx").cast("int")).withColumn("r0", F.floor("fz").cast("int"))
    tx_, tz = F.col("fx") - F.col("c0"), F.col("fz") - F.col("r0")
    c1, r1 = F.least(F.col("c0") + 1, F.lit(size - 1)), F.least(F.col("r0") + 1, F.lit(size - 1))

    def corner(row: Column, col: Column, share: Column) -> Column:
        return F.struct(row.alias("row"), col.alias("col"), share.alias("share"))

    corners = F.array(
        corner(F.col("r0"), F.col("c0"), (1 - tx_) * (1 - tz)),
        corner(F.col("r0"), c1, tx_ * (1 - tz)),
        corner(r1, F.col("c0"), (1 - tx_) * tz),
        corner(r1, c1, tx_ * tz),
    )
    return (
        at.select("id", F.explode(corners).alias("k"))
        .select("id", "k.row", "k.col", "k.share")
        .join(grid, ["row", "col"])
        .groupBy("id")
        .agg(F.sum(F.col("share") * F.col("height")).alias("height"))
    )

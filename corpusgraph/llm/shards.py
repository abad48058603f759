"""Shards by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Every shard owns ``points`` places on a ring of 60-bit numbers; a row's place is a hash of
its id, and its home is the owner of the next point clockwise.  A full shard sends its
overflow on clockwise to the next shards, so loads are bounded exactly.  All rows between
two points have the same way round the ring, so the placement is decided from one count
per arc (``shards * points`` numbers, whatever the number of rows), and every row then
needs only its rank within its arc, which a range exchange over all rows gives.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.edges import global_row_number
from ..session import cut

RING_BITS = 60
_CELLS = 256


def ring(shards: int, points: int) -> list[tuple[int, int]]:
    """The points of the ring in order: ``(place, shard)``."""
    places = [(int(hashlib.md5(f"{s}:{p}".encode()).hexdigest()[:15], 16), s) for s in range(shards) for p in range(points)]
    return sorted(places)


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Most rows of each shard: with no slack they add up to ``rows`` and differ by one at most."""
    if slack > 0:
        return [-int(-(1 + slack) * rows // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def place(counts: dict[int, int], points: list[tuple[int, int]], limits: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(arc, first rank, rows, shard, first slot)`` of all arcs.

    First every shard takes what it can of its own arcs, in the order of the ring; what is
    left over goes on to the next other shard clockwise, and so on.
    """
    ways = {}
    for arc in counts:
        seen = dict.fromkeys(points[(arc + i) % len(points)][1] for i in range(len(points)))
        ways[arc] = list(seen)
    used, taken, pieces = [0] * len(limits), dict.fromkeys(counts, 0), []
    for step in range(len(limits)):
        for arc in sorted(counts):
            shard = ways[arc][step] if step < len(ways[arc]) else None
            if shard is None:
                continue
            n = min(counts[arc] - taken[arc], limits[shard] - used[shard])
            if n > 0:
                pieces.append((arc, taken[arc], n, shard, used[shard]))
                taken[arc] += n
                used[shard] += n
    return pieces


def _arc(place_: Column, points: list[tuple[int, int]]) -> Column:
    """Number of the first point at or after a place; past the last point comes the first."""
    places, shift = [p for p, _ in points], RING_BITS - 8
    cells = [[p for p in places if p >> shift == c] for c in range(_CELLS)]
    before = [bisect_left(places, c << shift) for c in range(_CELLS)]
    inside = F.array(*[F.array(*[F.lit(p) for p in c]).cast("array<bigint>") for c in cells])
    cell = F.shiftright(place_, shift).cast("int") + 1
    ahead = F.size(F.filter(F.element_at(inside, cell), lambda p: p < place_))
    n = F.element_at(F.array(*[F.lit(b) for b in before]), cell) + ahead
    return F.pmod(n, F.lit(len(points)))


def ring_shards(docs: DataFrame, shards: int = 8, points: int = 128, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot, home_shard)``, a row for each row of ``docs``.

    ``slot`` counts a shard's rows from 0 without gaps.  A null text counts as empty, a null
    id has the place of an empty id.  Rows of one id share a home and part only when it is
    full; equal rows take neighbouring slots.  Texts of any length only give a size and a
    checksum, other columns are not read.  No rows in, no rows out.
    """
    at = ring(shards, points)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("place"),
        F.monotonically_increasing_id().alias("seq"),
    )
    rows = cut(rows.withColumn("arc", _arc(F.col("place"), at)))
    counts = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    pieces = place(counts, at, capacities(total, shards, slack))
    # an arc's rows are neighbours in the order of all rows: its first number and a rank give a number
    before, ahead = {}, 0
    for arc in sorted(counts):
        before[arc] = ahead
        ahead += counts[arc]
    spark = docs.sparkSession
    plan = spark.createDataFrame([(a, before[a] + first, n, s, slot) for a, first, n, s, slot in pieces], "of_arc int, first long, n long, shard int, slot long")
    owners = F.array(*[F.lit(s) for _, s in at])
    # ``seq`` parts rows that agree in all else, so one id or text with most rows fills many ranges
    ranked = global_row_number(rows, "arc", "place", "doc_id", "text_crc32", "size", "seq", name="number").withColumn("rank", F.col("number") - 1)
    # at most shards * arcs rows
    inside = (F.col("arc") == F.col("of_arc")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    return ranked.join(F.broadcast(plan), inside).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("rank") - F.col("first")).cast("long").alias("slot"),
        F.element_at(owners, F.col("arc") + 1).alias("home_shard"),
    )

"""Benchmark decontamination: SimHash of windows, multi-index Hamming search, exact verification.

A benchmark item is indexed by the SimHashes of all its windows of a size that follows from
its own.  Documents are fingerprinted at every eighth shingle with windows of the same
sizes.  Fingerprints within the radius share one of ``RADIUS + 1`` equal blocks, so block
tables find every one of them.  A found window is laid over the item, and the passage of
the item's size counts when its weighted shingle similarity reaches the threshold.

Window sizes: a passage of similarity 0.8 keeps an unedited run of at least ``unedited(m)``
of the item's m shingles (a changed word costs five on each side).  A run of W + 7 shingles
holds a whole window of W that begins at a multiple of eight, so W is 16 where the run has
23, 8 where it has 15, else every single shingle is looked up.
"""

from __future__ import annotations

from collections import Counter, deque
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .words import _STEP, filtered, hashed, mix, quoted, shingled

SHINGLE_WORDS = 5
THRESHOLD = 0.8
RADIUS = 3
STRIDE = 8
# Characters of benchmark text that are searched for in one pass over the documents.
PASS_CHARS = 4 << 20
_BLOCKS = RADIUS + 1
_BLOCK_BITS = 64 // _BLOCKS
_MASK = np.uint64((1 << _BLOCK_BITS) - 1)


def unedited(m: int) -> int:
    """Length of the unedited run that a passage of similarity 0.8 keeps, of ``m`` shingles."""
    edits = m // 45
    return int(0.8 * m) if not edits else (m - 5 * edits) // (edits + 1)


def window_size(m: int) -> int:
    run = unedited(m)
    return next((w for w in (16, 8) if run >= w + STRIDE - 1), 1)


def weighted_window_size(weights: np.ndarray) -> int:
    """:func:`window_size` of an item whose shingles weigh differently.

    A changed word costs the weights of the shingles that it touches.  A window size will do
    when leaving no unedited run for it costs more than similarity 0.8 allows.
    """
    m = len(weights)
    if not m or (weights == weights[0]).all():
        return window_size(m)
    total = np.concatenate([[0.0], np.cumsum(weights)]).tolist()
    allowed = total[-1] * (1 - THRESHOLD) / (1 + THRESHOLD) + 1e-9
    for w in (16, 8):
        run = w + STRIDE - 1
        if m < run:
            continue
        # cheapest[j]: edits of which the last touches the shingles up to j, with no unedited run before
        cheapest, least = [], deque()
        for j in range(m + SHINGLE_WORDS - 1):
            start, end = max(0, j - SHINGLE_WORDS + 1), min(j, m - 1)
            cost = 0.0
            if start >= run:
                while least[0] < start - run:
                    least.popleft()
                cost = cheapest[least[0]]
            cost += total[end + 1] - total[start]
            for i in range(start, min(j, m)):  # the edit before touches some of the same shingles
                cost = min(cost, cheapest[i] + total[end + 1] - total[i + 1])
            cheapest.append(cost)
            while least and cheapest[least[-1]] >= cost:
                least.pop()
            least.append(j)
        if min(cheapest[m - run :]) > allowed:
            return w
    return 1


def _fingerprints(counts: np.ndarray, size: int) -> np.ndarray:
    return np.packbits(2 * counts.astype(np.int16) > size, axis=1).view(np.uint64).ravel()


def item_windows(shingles: np.ndarray, size: int) -> np.ndarray:
    """SimHashes of all windows of an item."""
    bits = np.unpackbits(shingles.view(np.uint8)).reshape(-1, 64)
    total = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=total[1:])
    return _fingerprints(total[size:] - total[:-size], size)


def document_windows(shingles: np.ndarray, sizes: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """``(starts, SimHashes)`` by window size, at multiples of the stride (size 1: everywhere)."""
    found = {}
    n = len(shingles) // STRIDE
    if any(s > 1 for s in sizes) and n:
        bits = np.unpackbits(shingles[: n * STRIDE].view(np.uint8)).reshape(n, STRIDE, 64)
        sums = bits[:, 0].copy()
        for i in range(1, STRIDE):
            sums += bits[:, i]
        for s in sizes:
            w = s // STRIDE
            if w and n >= w:
                counts = sums[: n - w + 1].copy()
                for i in range(1, w):
                    counts += sums[i : n - w + 1 + i]
                found[s] = np.arange(len(counts)) * STRIDE, _fingerprints(counts, s)
    if 1 in sizes:
        found[1] = np.arange(len(shingles)), np.packbits(np.unpackbits(shingles.view(np.uint8))).view(np.uint64)
    return found


class HammingIndex:
    """All stored fingerprints within ``RADIUS`` bits, by tables of equal blocks."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.tables = prints, []
        for b in range(_BLOCKS):
            key = (prints >> np.uint64(b * _BLOCK_BITS)) & _MASK
            order = np.argsort(key, kind="stable")
            self.tables.append((order, np.searchsorted(key[order], np.arange((1 << _BLOCK_BITS) + 1, dtype=np.uint64))))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(place in prints, stored place)`` of every pair within the radius, once."""
        left, right = [], []
        for b, (order, starts) in enumerate(self.tables):
            key = ((prints >> np.uint64(b * _BLOCK_BITS)) & _MASK).astype(np.int64)
            counts = starts[key + 1] - starts[key]
            some = np.flatnonzero(counts)
            counts = counts[some]
            at = np.repeat(some, counts)
            inside = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
            entry = order[np.repeat(starts[key[some]], counts) + inside]
            close = np.bitwise_count(prints[at] ^ self.prints[entry]) <= RADIUS
            left.append(at[close])
            right.append(entry[close])
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
        return pairs[0], pairs[1]


class Item(NamedTuple):
    item_id: int | None
    shingles: np.ndarray
    weights: dict[int, float]


def similarity(item: Item, passage: np.ndarray) -> float:
    """Weighted multiset Jaccard similarity; a shingle weighs one over the item texts that hold it.

    A foreign shingle of the passage weighs what the item's missing shingles do on average.
    """
    a, b = Counter(item.shingles.tolist()), Counter(passage.tolist())
    both = every = lost = 0.0
    n_lost = 0
    for s, n in a.items():
        weight, there = item.weights[s], b.get(s, 0)
        both += min(n, there) * weight
        every += max(n, there) * weight
        lost += max(n - there, 0) * weight
        n_lost += max(n - there, 0)
    foreign = sum(n for s, n in b.items() if s not in a)
    if foreign:
        every += foreign * (lost / n_lost if n_lost else sum(n * item.weights[s] for s, n in a.items()) / len(item.shingles))
    return both / every


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, as :func:`shingled` hashes a text of that many words."""
    h = np.full(max(len(words) - k + 1, 0), k, np.uint64)
    for i in range(k):
        h = h * np.uint64(_STEP) + words[i : len(words) - k + 1 + i]
    return mix(h)


class BenchmarkIndex:
    """Items of one pass, ready for search in the workers.

    ``holders`` counts the item texts of the whole benchmark that hold a shingle, where there are several.
    """

    def __init__(self, rows: list[tuple[int | None, str | None]], threshold: float, holders: dict[int, int]):
        self.threshold, self.items, self.short = threshold, [], {}
        parsed = []
        for first, words, bounds in hashed(pa.array([t for _, t in rows], pa.string())):
            shingles, ends = shingled(words, bounds, SHINGLE_WORDS)
            for i in range(len(bounds) - 1):
                s = shingles[ends[i] : ends[i + 1]]
                parsed.append((rows[first + i][0], s, int(bounds[i + 1] - bounds[i])))
        entries: dict[int, list] = {}
        for item_id, s, n in parsed:
            if not n:
                continue
            item = len(self.items)
            self.items.append(Item(item_id, s, {x: 1 / holders.get(x, 1) for x in s.tolist()}))
            if n < SHINGLE_WORDS:
                self.short.setdefault(n, {}).setdefault(int(s[0]), []).append(item)
                continue
            size = weighted_window_size(np.array([1 / holders.get(x, 1) for x in s.tolist()]))
            prints = item_windows(s, size)
            entries.setdefault(size, []).append((prints, np.full(len(prints), item), np.arange(len(prints))))
        self.indexes = {}
        for size, found in entries.items():
            prints, owners, offsets = (np.concatenate(x) for x in zip(*found, strict=True))
            self.indexes[size] = HammingIndex(prints), owners, offsets

    def search(self, words: np.ndarray, bounds: np.ndarray) -> dict[int, dict[int, float]]:
        """``{row: {item: similarity}}`` of the rows of a piece that hold an item."""
        shingles, ends = shingled(words, bounds, SHINGLE_WORDS)
        places: dict[tuple[int, int], set[int]] = {}
        for size, (starts, prints) in document_windows(shingles, list(self.indexes)).items():
            index, owners, offsets = self.indexes[size]
            row = np.searchsorted(ends, starts, "right") - 1
            inside = starts + size <= ends[row + 1]
            starts, prints, row = starts[inside], prints[inside], row[inside]
            at, entry = index.near(prints)
            for r, item, start in zip(row[at].tolist(), owners[entry].tolist(), (starts[at] - offsets[entry]).tolist(), strict=True):
                places.setdefault((r, item), set()).add(start)
        found: dict[int, dict[int, float]] = {}
        for (r, item), starts in places.items():
            it, lo, hi = self.items[item], int(ends[r]), int(ends[r + 1])
            m = len(it.shingles)
            spans = {(max(lo, s), min(hi, s + m)) for s in starts}
            wide = max(lo, min(starts)), min(hi, max(starts) + m)
            if wide[1] - wide[0] <= m + m // 4:
                spans.add(wide)
            best = max(similarity(it, shingles[a:b]) for a, b in spans)
            if best >= self.threshold:
                found.setdefault(r, {})[item] = best
        for k, table in self.short.items():
            runs = _runs(words, k)
            for p in np.flatnonzero(np.isin(runs, np.fromiter(table, np.uint64, len(table)))).tolist():
                r = int(np.searchsorted(bounds, p, "right")) - 1
                if p + k <= bounds[r + 1]:
                    for item in table[int(runs[p])]:
                        found.setdefault(r, {})[item] = 1.0
        return found


def _shingle_rows(texts: DataFrame) -> DataFrame:
    """``(shingle)``: the different shingles of each text."""

    def run(batches):
        for batch in batches:
            for _, words, bounds in hashed(batch.column(0)):
                shingles, ends = shingled(words, bounds, SHINGLE_WORDS)
                for i in range(len(bounds) - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingles[ends[i] : ends[i + 1]]).view(np.int64))], ["shingle"])

    return texts.mapInArrow(run, "shingle long")


def shared_shingles(items: DataFrame) -> DataFrame:
    """``(shingle, n)`` of the shingles that several different item texts hold."""
    return _shingle_rows(items.select("text").distinct()).groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, keep: bool = False) -> DataFrame:
    """``(doc_id, item_ids, similarity)``, a row for each row of ``docs``: the items it holds, in order, and the best similarity.

    Items and their texts may repeat; each is reported.  Null and empty texts hold nothing
    and are held by nothing; an item of fewer than five words counts where its words stand in a row.  An empty benchmark leaves
    every row clean.  A benchmark beyond ``PASS_CHARS`` is searched in several passes.
    ``keep`` returns the clean rows of ``docs`` with their own columns instead.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    passes = max(1, -(-total // PASS_CHARS))
    if keep:
        out = docs.select("doc_id", "text", *[quoted(c) for c in docs.columns if c not in ("doc_id", "text")])
    else:
        out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.array().cast("array<long>").alias("item_ids"), F.lit(0.0).alias("similarity"))
    held = shared_shingles(items)
    if passes > 1:
        held = cut(held)
    for i in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i)
        # at most the shingles of one pass
        told = (held if passes == 1 else held.join(_shingle_rows(part.select("text")).distinct(), "shingle")).toArrow()
        holders = dict(zip(told.column("shingle").to_numpy().astype(np.int64).view(np.uint64).tolist(), told.column("n").to_pylist(), strict=True))
        rows = [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").toLocalIterator()]
        shared = spark.sparkContext.broadcast(BenchmarkIndex(rows, threshold, holders))
        out = filtered(out, _clean(shared)) if keep else out.mapInArrow(_told(shared), out.schema)
    return out.select(*map(quoted, docs.columns)) if keep else out.drop("text")


def _clean(shared):
    def run(batches):
        index = shared.value
        for batch in batches:
            stay = np.ones(batch.num_rows, bool)
            for first, words, bounds in hashed(batch.column(1)):
                for row in index.search(words, bounds):
                    stay[first + row] = False
            yield batch.filter(pa.array(stay))

    return run


def _told(shared):
    def run(batches):
        index = shared.value
        for batch in batches:
            ids, best = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for first, words, bounds in hashed(batch.column(1)):
                for row, found in index.search(words, bounds).items():
                    at = first + row
                    ids[at] = sorted(ids[at] + [index.items[x].item_id for x in found], key=lambda x: (x is not None, x or 0))
                    best[at] = max(best[at], *found.values())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64())), pa.array(best, pa.float64())], ["doc_id", "text", "item_ids", "similarity"])

    return run

"""Words and shingles of Arrow text columns as 64-bit hashes, whole texts, in bounded pieces.

All functions run inside Python workers.  A word is a run of bytes that are no ASCII
white space; A-Z count as a-z.  A word's hash depends on its bytes alone, so equal words
have equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Bytes of text that are hashed at once; a longer text is cut at white space.
PIECE_BYTES = 4 << 20

_SPACES = b" \t\n\x0b\x0c\r"
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(_SPACES)] = True
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _power(n: int):
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers


def _hash(data: np.ndarray, firsts: np.ndarray):
    """Hashes of the words of some bytes and the places where they begin; no word crosses ``firsts``."""
    space = _IS_SPACE[data]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = space[:-1]
    before[firsts] = True
    starts = np.flatnonzero(before & ~space)
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = space[1:]
    inner = firsts[firsts > 0]
    after[inner - 1] = True
    ends = np.flatnonzero(after & ~space) + 1
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), starts


def _slices(raw: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """One long text in pieces that end at white space (or not at all, when it has none)."""
    at = 0
    while at < len(raw):
        end = min(at + most, len(raw))
        if end < len(raw):
            gaps = np.flatnonzero(_IS_SPACE[raw[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                later = np.flatnonzero(_IS_SPACE[raw[end:]])
                end = end + int(later[0]) + 1 if len(later) else len(raw)
        yield raw[at:end]
        at = end


def hashed(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, word hashes, bounds)`` of runs of rows; row ``first + i`` has the words
    ``bounds[i]`` to ``bounds[i + 1]``.  Null texts have no words."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        last = min(last, len(texts))
        raw = data[offsets[row] : offsets[last]]
        if not len(raw):
            yield row, np.zeros(0, np.uint64), np.zeros(last - row + 1, np.int64)
        elif last == row + 1 and len(raw) > most:
            parts = [_hash(x, np.zeros(1, np.int64))[0] for x in _slices(raw, most)]
            words = np.concatenate(parts)
            yield row, words, np.array([0, len(words)], np.int64)
        else:
            inner = offsets[row : last + 1] - offsets[row]
            firsts = inner[:-1]
            words, starts = _hash(raw, firsts[firsts < len(raw)])
            yield row, words, np.searchsorted(starts, inner).astype(np.int64)
        row = last


def shingled(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word shingles and their bounds; a row with fewer words has one, of all its words."""
    counts = np.diff(bounds)
    n = len(words)
    every = np.zeros(max(n - k + 1, 0), np.uint64)
    for i in range(k):
        every = every * np.uint64(_STEP) + words[i : n - k + 1 + i] if n >= k else every
    every = mix(every)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    full = counts >= k
    if full.all():
        keep = np.ones(n, bool)
        keep[(bounds[1:, None] - 1 - np.arange(k - 1)).ravel()] = False
        return every[keep[: len(every)]], out
    hashes = np.zeros(out[-1], np.uint64)
    for i in np.flatnonzero(counts):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= k:
            hashes[out[i] : out[i + 1]] = every[a : b - k + 1]
        else:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * np.uint64(_STEP) + w
            hashes[out[i]] = mix(np.array([h], np.uint64))[0]
    return hashes, out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def crc_of(doc_id: Column) -> Column:
    """Unsigned CRC-32 of an id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def quoted(name: str) -> Column:
    """A top-level column by its very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def filtered(df: DataFrame, run: Callable) -> DataFrame:
    """``df.mapInArrow`` for a function that only drops rows, whatever the columns are called."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def parts(df: DataFrame) -> int:
    """Partitions for a hand-made exchange."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

"""Document fingerprints by one-permutation MinHash.

Every shingle is hashed once; the hash's top bits name its bin and the least hash of each
bin stays.  An empty bin takes the value of a filled one that a fixed random walk from its
own number finds first (optimal densification), so likeness stays unbiased for short
texts.  Only the low ``BITS`` bits of each bin are stored, and the chance agreement of so
few bits is taken out of the estimate.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .words import hashed, mix, shingled

SHINGLE_WORDS = 5
BINS = 128
BITS = 4
# Rows of a batch that are fingerprinted together.
SLICE_ROWS = 1024
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_BIN_SHIFT = np.uint64(64 - (BINS - 1).bit_length())


def _densify(least: np.ndarray) -> None:
    """Fill the empty bins of rows that have a filled one."""
    full = least != _EMPTY
    row, bin_ = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 0
    while len(row):
        if attempt < 16 * BINS:
            donor = (mix(bin_.astype(np.uint64) * np.uint64(0x10001) + np.uint64(attempt << 20)) % np.uint64(BINS)).astype(np.int64)
        else:
            donor = (bin_ + attempt) % BINS
        hit = full[row, donor]
        least[row[hit], bin_[hit]] = least[row[hit], donor[hit]]
        row, bin_ = row[~hit], bin_[~hit]
        attempt += 1


def fingerprints(texts: pa.Array, k: int = SHINGLE_WORDS) -> list[str]:
    """Packed fingerprints as hex; a text without words has an empty one."""
    out: list[str] = []
    for _, words, bounds in hashed(texts):
        shingles, ends = shingled(words, bounds, k)
        rows = len(ends) - 1
        least = np.full(rows * BINS, _EMPTY, np.uint64)
        owner = np.repeat(np.arange(rows), np.diff(ends))
        np.minimum.at(least, owner * BINS + (shingles >> _BIN_SHIFT).astype(np.int64), shingles)
        least = least.reshape(rows, BINS)
        _densify(least)
        low = (mix(least) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
        bits = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - BITS :].reshape(rows, -1)
        packed = np.packbits(bits, axis=1)
        some = np.diff(ends) > 0
        out += [packed[i].tobytes().hex() if some[i] else "" for i in range(rows)]
    return out


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity, 0 to 1; two empty fingerprints are alike, an empty and a filled one are not."""
    if not a or not b:
        return float(a == b)
    if a == b:
        return 1.0
    x, y = (np.unpackbits(np.frombuffer(bytes.fromhex(v), np.uint8)).reshape(BINS, BITS) for v in (a, b))
    agree = float((x == y).all(axis=1).mean())
    chance = 2.0**-BITS
    return min(1.0, max(0.0, (agree - chance) / (1 - chance)))


def edited(text: str, following: str) -> str:
    """The last half of a text's characters replaced by the first as many of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(ids: list, texts: list[str], following: list[str], prints: list[str], next_prints: list[str]) -> list[list]:
    made = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    after = fingerprints(pa.array(made, pa.large_string()))
    return [
        ids, [len(t) for t in texts], [hashlib.sha256(m.encode()).hexdigest() for m in made], prints, after,
        [likeness(a, b) for a, b in zip(prints, after, strict=True)], [likeness(a, b) for a, b in zip(prints, next_prints, strict=True)],
    ]


_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
     ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
_LONG = _ARROW.append(pa.field("part", pa.int32())).append(pa.field("role", pa.string())).append(pa.field("text", pa.large_string()))


def _neighbours(batches):
    """Rows in order, each with the next; a partition's first text and its last row are handed on."""
    part, held, began = TaskContext.get().partitionId(), None, False

    def end(role, row):
        return pa.RecordBatch.from_pydict(
            {"doc_id": [row[0]], "n_chars": [None], "edited_sha256": [None], "fingerprint": [None], "edited_fingerprint": [None], "near_edited": [None], "near_next": [None],
             "part": [part], "role": [role], "text": [row[1]]}, schema=_LONG)

    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            piece = batch.slice(at, SLICE_ROWS)
            ids, column = piece.column(0).to_pylist(), piece.column(1)
            texts = [t or "" for t in column.to_pylist()]
            rows = list(zip(ids, texts, fingerprints(column), strict=True))
            if not began:
                began = True
                yield end("first", rows[0])
            if held:
                rows.insert(0, held)
            held = rows[-1]
            if len(rows) > 1:
                own, after = rows[:-1], rows[1:]
                got = _rows([r[0] for r in own], [r[1] for r in own], [r[1] for r in after], [r[2] for r in own], [r[2] for r in after])
                n = len(own)
                columns = [pa.array(v, f.type) for v, f in zip(got, _ARROW, strict=True)]
                columns += [pa.array([part] * n, pa.int32()), pa.array(["done"] * n), pa.nulls(n, pa.large_string())]
                yield pa.RecordBatch.from_arrays(columns, schema=_LONG)
    if held:
        yield end("last", held)


def _at_ends(batches):
    for batch in batches:
        ids, texts, after = (batch.column(i).to_pylist() for i in range(3))
        if ids:
            prints, next_prints = fingerprints(batch.column(1)), fingerprints(batch.column(2))
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(_rows(ids, texts, after, prints, next_prints), _ARROW, strict=True)], schema=_ARROW)


def neighbour_report(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs(doc_id, text)``: its fingerprint, that of its edited text, and their likeness.

    The next document is the next smaller id (null ids last; equal ids by a hash of their
    texts), after the last the first; a lone row follows itself.  Null texts are empty.
    No rows in, no rows out.
    """
    spark = docs.sparkSession
    order = (F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    told = cut(ranged.mapInArrow(_neighbours, f"{_COLUMNS}, part int, role string, text string"))
    # one number per filled partition
    filled = sorted(r["part"] for r in told.where("role = 'last'").select("part").collect())
    follow = spark.createDataFrame(list(zip(filled, filled[1:] + filled[:1], strict=True)), "part int, next_part int")
    lasts = told.where("role = 'last'").select("doc_id", "text", "part").join(follow, "part")
    firsts = told.where("role = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    ends = lasts.join(firsts, "next_part").select("doc_id", "text", "following").mapInArrow(_at_ends, _COLUMNS)
    return told.where("role = 'done'").select(*[f.name for f in _ARROW]).unionByName(ends)

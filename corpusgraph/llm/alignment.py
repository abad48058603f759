"""Cross-tokenizer alignment by diagonal run skipping.

Two tokenizers cut the same bytes.  Their cuts are two rising arrays of end offsets, and a
group ends where both arrays hold an offset.  While token i of one ends with token i + shift
of the other, groups are pairs: the arrays are compared at that shift in blocks of doubling
length, and a failed block is halved until its first difference is found.  There the two arrays are
walked to the next common end, which closes an irregular group and sets the next shift.

How many documents link two ids is counted over the whole corpus; the counts of the pairs that
most links fall on come as a table of fixed size, all others by a join.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut

# Texts that are encoded together, and their bytes; a longer text goes alone.
SLICE_ROWS = 256
SLICE_BYTES = 1 << 20
# Links that are written out at once.
SLICE_LINKS = 1 << 20
# Pairs whose counts every task holds (12 bytes each); the counts of rarer ones are joined.
KNOWN_PAIRS = 1 << 19


def diagonal_groups(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Ends of the groups of two rising arrays of ends with a common last element, as numbers of tokens of each."""
    left: list[int] = []
    right: list[int] = []
    i, j, n, m = 0, 0, len(a), len(b)
    while i < n and j < m:
        if a[i] == b[j]:
            # the run of pairs on this diagonal: probe ahead in doubling blocks, then halve the failed one
            i0, j0, step = i, j, 1
            i, j = i + 1, j + 1
            while i < n and j < m and a[i] == b[j]:
                block = a[i : i + step]
                if block == b[j : j + len(block)]:
                    i, j, step = i + len(block), j + len(block), step * 2
                    continue
                low, high = 1, len(block)
                while high - low > 1:
                    middle = (low + high) // 2
                    if block[low:middle] == b[j + low : j + middle]:
                        low = middle
                    else:
                        high = middle
                i, j = i + low, j + low
                break
            if i - i0 == 1:
                left.append(i)
                right.append(j)
            else:
                left += range(i0 + 1, i + 1)
                right += range(j0 + 1, j + 1)
        else:
            x, y = a[i], b[j]
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            i, j = i + 1, j + 1
            left.append(i)
            right.append(j)
    return left, right


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


# Fixed value: how the byte-level vocabulary's tokenizer parts a text before it merges.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Blanks in a row from which on a text goes to the slower library, as the faster one's matcher would run out of stack.
_BLANK_RUN = re.compile(r"\s{1000}")


class ByteLevel:
    """The byte-level tokenizer: ids of texts, and the bytes of each id.

    Where the vocabulary numbers its tokens in the order of their merges, ids are ranks, and
    a text is encoded by them, which gives the same ids in a third of the time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # Spark fills the cores with tasks; threads of the library's own would only contend with them
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_padding()
        self.library.no_truncation()
        letters = _bytes_of_letters()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.pieces[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        made = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
        plain = self.library.get_vocab(with_added_tokens=False)
        self.ranks = None
        if made == sorted(made) and len(made) + 256 == len(plain) - sum(t.startswith("<|") for t in plain):
            import tiktoken

            ranks = {self.pieces[i]: i for t, i in plain.items() if not t.startswith("<|")}
            self.ranks = tiktoken.Encoding("ranks", pat_str=_PARTS, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list[list[int]]:
        texts = [" " + t for t in texts]
        slow = [t for t in texts if self.ranks is None or _BLANK_RUN.search(t)]
        told = {t: x.ids for t, x in zip(slow, self.library.encode_batch_fast(slow, add_special_tokens=False), strict=True)}
        return [told[t] if t in told else self.ranks.encode_ordinary(t) for t in texts] if told else [self.ranks.encode_ordinary(t) for t in texts]


class Pieces:
    """The piece tokenizer, which puts a blank before each text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        every = range(self.library.get_piece_size())
        self.pieces = [
            bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in zip(every, self.library.id_to_piece(list(every)), strict=True)
        ]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


@cache
def _tokenizers(byte_path: str, piece_path: str) -> tuple[ByteLevel, Pieces, np.ndarray, np.ndarray, list[str]]:
    first, second = ByteLevel(byte_path), Pieces(piece_path)
    sizes = [np.array([len(p) for p in t.pieces], np.int64) for t in (first, second)]
    # every id with what may follow it within a group, and at the end of its side
    words = [f"{i}{mark}" for t, marks in ((first, ",|"), (second, ",;")) for mark in marks for i in range(len(t.pieces))]
    return first, second, *sizes, words


def _spelled(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, sizes: tuple[int, int], words: list[str]) -> str:
    """Groups as text: ids joined by commas, sides parted by a bar, groups by semicolons."""
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[left - 1], last_b[right - 1] = True, True
    # a token stands behind all earlier tokens of its side and all of the other side's earlier groups, and b behind its own group's a
    group_a = np.searchsorted(left, np.arange(len(a)), "right")
    group_b = np.searchsorted(right, np.arange(len(b)), "right")
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + np.concatenate(([0], right))[group_a]] = a + last_a * sizes[0]
    codes[np.arange(len(b)) + left[group_b]] = 2 * sizes[0] + b + last_b * sizes[1]
    return "".join(map(words.__getitem__, codes.tolist()))[:-1]


def _linked(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked pairs ``a << 15 | b``-like keys (rising) and how many token pairs have each."""
    p, q = np.diff(left, prepend=0), np.diff(right, prepend=0)
    links = p * q
    total = np.cumsum(links)
    keys, counts, at = [], [], 0
    while at < len(links):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + SLICE_LINKS, "right")))
        if end == at + 1:
            # a group may have more links than fit: its distinct ids, and how often each stands
            x, nx = np.unique(a[left[at] - p[at] : left[at]], return_counts=True)
            y, ny = np.unique(b[right[at] - q[at] : right[at]], return_counts=True)
            k, c = (x[:, None] * _SHIFT + y).ravel(), (nx[:, None] * ny).ravel()
        else:
            some = slice(at, end)
            group = np.repeat(np.arange(end - at), links[some])
            place = np.arange(len(group)) - np.concatenate(([0], np.cumsum(links[some])[:-1]))[group]
            width = q[some][group]
            k = a[(left[some] - p[some])[group] + place // width] * _SHIFT + b[(right[some] - q[some])[group] + place % width]
            k, c = np.unique(k, return_counts=True)
        keys.append(k)
        counts.append(c)
        at = end
    k, c = np.concatenate(keys), np.concatenate(counts)
    if len(keys) == 1:
        return k, c
    k, where = np.unique(k, return_inverse=True)
    return k, np.bincount(where, c).astype(np.int64)


# A pair of ids is one number: the first id times this, plus the second.
_SHIFT = 1 << 20

_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    at = 0
    values = texts.to_pylist()
    while at < len(values):
        end, size = at, 0
        while end < len(values) and end - at < SLICE_ROWS and (end == at or size + len(values[end] or "") <= SLICE_BYTES):
            size += len(values[end] or "")
            end += 1
        yield [v or "" for v in values[at:end]]
        at = end


def align_text(text: str, a: list[int], b: list[int], first: ByteLevel, second: Pieces, sizes_a: np.ndarray, sizes_b: np.ndarray):
    """``(a, b, left, right)`` of a text's ids and group ends, or None where a side does not spell blank and text."""
    whole = b" " + text.encode()
    if not text or b"".join(map(first.pieces.__getitem__, a)) != whole or b"".join(map(second.pieces.__getitem__, b)) != whole:
        return None
    x, y = np.fromiter(a, np.int32, len(a)), np.fromiter(b, np.int32, len(b))
    left, right = diagonal_groups(np.cumsum(sizes_a[x]).tolist(), np.cumsum(sizes_b[y]).tolist())
    return x.astype(np.int64), y.astype(np.int64), np.fromiter(left, np.int64, len(left)), np.fromiter(right, np.int64, len(right))


def aligned(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Groups and linked id pairs of each row of ``docs(doc_id, text)``, in one pass.

    ``pairs`` are the distinct linked ids (``a * 2**20 + b``, rising), ``times`` how many token pairs link
    them.  Texts that are null or empty, or that a tokenizer changes, have no tokens and an empty hash.
    """
    schema = _arrow(_ALIGNED)

    def run(batches):
        first, second, sizes_a, sizes_b, words = _tokenizers(byte_path, piece_path)
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(1)):
                out = []
                for text, a, b in zip(texts, first.ids(texts), second.ids(texts), strict=True):
                    made = align_text(text, a, b, first, second, sizes_a, sizes_b)
                    if made is None:
                        out.append((0, 0, 0, 0, "", [], []))
                        continue
                    x, y, left, right = made
                    spelled = _spelled(x, y, left, right, (len(sizes_a), len(sizes_b)), words)
                    pairs, times = _linked(x, y, left, right)
                    out.append((len(x), len(y), len(left), int(times.sum()), hashlib.sha256(spelled.encode()).hexdigest(), pairs, times))
                ids = batch.column(0).slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), list(schema)[1:], strict=True))], schema=schema)
                at += len(texts)

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, _ALIGNED)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def pair_counts(links: DataFrame) -> DataFrame:
    """``pair, n_docs``: documents of the corpus that hold each pair, summed inside a task's batches before anything moves."""
    schema = _arrow("pair long, n long")

    def add(batches):
        keys, counts, held = [], [], 0

        def told():
            k, where = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(where, np.concatenate(counts)).astype(np.int64)

        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            if not len(flat):
                continue
            k, c = np.unique(flat, return_counts=True)
            keys, counts, held = [*keys, k], [*counts, c], held + len(k)
            if held > 1 << 21:
                k, c = told()
                if len(k) > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], schema=schema)
                    keys, counts, held = [], [], 0
                else:
                    keys, counts, held = [k], [c], len(k)
        if keys:
            k, c = told()
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], schema=schema)

    return links.select("pairs").mapInArrow(add, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n_docs"))


def alignment(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """A row for each row of ``docs(doc_id, text)``: its tokens by both tokenizers, their groups, and how usual its links are.

    ``n_best`` counts links whose pair lies in as many documents as any pair of the same first id,
    ``count_sum`` adds up those numbers over all links.  Every row is a document of its own, so rows
    that repeat an id or a text count each; ids may be null; null and empty texts, and those
    that a tokenizer does not keep, have zeros and an empty hash.  Texts of any length are aligned whole; the
    memory of a text is a few numbers a token, and a group of any size goes by its distinct ids.
    Other columns are ignored.  No rows in, no rows out.
    """
    spark = docs.sparkSession
    links = cut(aligned(docs, byte_path, piece_path).withColumn("row", F.monotonically_increasing_id()))
    counts = cut(pair_counts(links))
    first = F.floor(F.col("pair") / _SHIFT)
    # one row for each id of the first vocabulary
    best = {r["a"]: r["best"] for r in counts.groupBy(first.alias("a")).agg(F.max("n_docs").alias("best")).collect()}
    top = np.zeros(max(best, default=0) + 1, np.int64)
    top[list(best)] = list(best.values())
    most = counts.orderBy(F.desc("n_docs"), "pair").limit(KNOWN_PAIRS).toArrow()
    order = np.argsort(most.column("pair").to_numpy())
    known = most.column("pair").to_numpy()[order], most.column("n_docs").to_numpy()[order].astype(np.int32)
    shared = spark.sparkContext.broadcast((top, *known))

    def known_part(batches):
        top, pairs, counts = shared.value
        for batch in batches:
            offsets = batch.column(1).offsets.to_numpy()
            keys, times = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            place = np.searchsorted(pairs, keys)
            hit = place < len(pairs)
            hit[hit] = pairs[place[hit]] == keys[hit]
            n = np.zeros(len(keys), np.int64)
            n[hit] = counts[place[hit]]
            sums, bests = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, owner, n * times)
            np.add.at(bests, owner, times * (hit & (n == top[keys // _SHIFT])))
            rare = [], []
            for out, values in zip(rare, (keys, times), strict=True):
                edges = np.zeros(batch.num_rows + 1, np.int32)
                np.cumsum(np.bincount(owner[~hit], minlength=batch.num_rows), out=edges[1:])
                out.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(values[~hit])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bests), pa.array(sums), rare[0][0], rare[1][0]], names=["row", "n_best", "count_sum", "pairs", "times"])

    seen = cut(links.select("row", "pairs", "times").mapInArrow(known_part, "row long, n_best long, count_sum long, pairs array<long>, times array<long>"))
    rare = seen.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    tops = spark.createDataFrame([(int(a), int(n)) for a, n in best.items()], "a long, best long")
    found = rare.join(counts, "pair").join(tops, first == F.col("a"))
    joined = found.select("row", F.when(F.col("n_docs") == F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("n_docs") * F.col("times")).alias("count_sum"))
    sums = joined.unionByName(seen.select("row", "n_best", "count_sum")).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return links.drop("pairs", "times").join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

"""Byte-level BPE by segment trees over the ranks of adjacent pairs.

A tree's leaves hold the rank of the pair that begins at each place, its root the leftmost
lowest one.  A merge changes three leaves, and each is carried to the root in logarithmic
time, until the root holds no mergeable pair.  The trees of many words of similar length
stand in one array and advance together.  Words repeat, so a worker keeps the codes of
those it has met; the store is emptied when full, which costs time only.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Words whose codes a worker keeps.
STORE_WORDS = 300_000
# Texts of a batch that are cut into words together, and bytes of trees that advance together.
SLICE_ROWS, TREE_CELLS = 256, 1 << 20
_NONE = np.int64(1) << np.int64(62)
_SPACE = "\t-\r \x85\xa0  -     　"


def _more_numbers() -> str:
    """Numbers that are no decimal digits, as ranges of a character class."""
    codes = [c for c in range(sys.maxunicode + 1) if chr(c).isalnum() and not chr(c).isalpha() and not chr(c).isdecimal()]
    runs = []
    for _, run in groupby(enumerate(codes), lambda p: p[1] - p[0]):
        run = [c for _, c in run]
        runs.append(f"\\U{run[0]:08x}-\\U{run[-1]:08x}")
    return "".join(runs)


def word_pattern() -> re.Pattern:
    """Contractions, letters, numbers and other signs with one blank before them, and white space."""
    more = _more_numbers()
    letters, numbers, others = rf"[^\W\d_{more}]", rf"[\d{more}]", rf"(?:[^\w{_SPACE}]|_)"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letters}+| ?{numbers}+| ?{others}+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in vocabulary files."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Merges and token bytes of a vocabulary file (``tokenizers`` JSON, byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab, signs = told["model"]["vocab"], byte_signs()
        self.specials = {t["content"]: t["id"] for t in told["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.specials.values()])
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(signs[c] for c in token)
        for token, i in self.specials.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for sign, b in signs.items():
            self.byte_ids[b] = vocab[sign]
        merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        pairs = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.ranks = pairs[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.byte_ranks = self._looked_up(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)).reshape(256, 256)

    def _looked_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], -1)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for width, run in groupby(order, lambda i: max(2, 1 << (len(words[i]) - 1).bit_length())):
            run = list(run)
            step = max(1, TREE_CELLS // width)
            for i in range(0, len(run), step):
                piece = run[i : i + step]
                for j, ids in zip(piece, self._trees([words[j] for j in piece], width), strict=True):
                    out[j] = ids
        return out

    def _trees(self, words: list[bytes], width: int) -> list[list[int]]:
        """Merge words of up to ``width`` bytes (a power of two), one tree each."""
        n = len(words)
        sizes = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        places = np.arange(width)
        ids = np.where(places < sizes[:, None], self.byte_ids[raw], -1)
        after = np.where(places + 1 < sizes[:, None], places + 1, -1)
        before = np.broadcast_to(places - 1, (n, width)).copy()
        rank = np.full((n, width), -1, np.int64)
        rank[:, :-1] = np.where(places[1:] < sizes[:, None], self.byte_ranks[raw[:, :-1], raw[:, 1:]], -1)
        tree = np.full((n, 2 * width), _NONE, np.int64)
        tree[:, width:] = np.where(rank >= 0, rank * width + places, _NONE)
        level = width >> 1
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level >>= 1
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            best = tree[rows, 1]
            left = best % width
            right = after[rows, left]
            ids[rows, left] = made = self.merged[best // width]
            ids[rows, right] = -1
            beyond, back = after[rows, right], before[rows, left]
            after[rows, left] = beyond
            has = beyond >= 0
            before[rows[has], beyond[has]] = left[has]
            changed = np.full(len(rows), -1)
            changed[has] = self._looked_up(made[has], ids[rows[has], beyond[has]])
            self._set(tree, rows, right, np.full(len(rows), _NONE), width)
            self._set(tree, rows, left, np.where(changed >= 0, changed * width + left, _NONE), width)
            has = back >= 0
            if has.any():
                r, b = rows[has], back[has]
                rank_ = self._looked_up(ids[r, b], made[has])
                self._set(tree, r, b, np.where(rank_ >= 0, rank_ * width + b, _NONE), width)
            rows = rows[tree[rows, 1] < _NONE]
        return [row[row >= 0].tolist() for row in ids]

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, place: np.ndarray, value: np.ndarray, width: int) -> None:
        """One leaf of each row, and the nodes above it."""
        node = place + width
        tree[rows, node] = value
        node = node >> 1
        while node[0]:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.token_bytes[i] for i in ids])


class Encoder:
    """A worker's cutter and store of word codes: ``(ids as text, bytes that they decode to)``."""

    def __init__(self, codec: Codec):
        self.codec, self.words, self.store = codec, word_pattern(), {}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(codec.specials, key=len, reverse=True))) + ")") if codec.specials else None

    def cut(self, text: str) -> list[str]:
        if self.specials is None or not self.specials.search(text):
            return self.words.findall(text)
        out: list[str] = []
        for part in self.specials.split(text):
            out += [part] if part in self.codec.specials else self.words.findall(part)
        return out

    def learn(self, cut: list[list[str]]) -> dict:
        store = self.store
        if len(store) > STORE_WORDS:
            store.clear()
        new = list(set().union(*cut) - store.keys())
        plain = [w for w in new if w not in self.codec.specials]
        for w, ids in zip(plain, self.codec.merge([w.encode() for w in plain]), strict=True):
            store[w] = ",".join(map(str, ids)), self.codec.decode(ids)
        for w in set(new) & self.codec.specials.keys():
            store[w] = str(self.codec.specials[w]), self.codec.decode([self.codec.specials[w]])
        return store

    def encode(self, texts: list[str]):
        """``(ids joined by commas, decoded text)`` of each text."""
        cut = [self.cut(t) for t in texts]
        store = self.learn(cut)
        for words in cut:
            codes = [store[w] for w in words]
            yield ",".join([c[0] for c in codes]), b"".join([c[1] for c in codes]).decode("utf-8", "replace")


def round_trip(docs: DataFrame, path: str, digest: bool = True, columns: tuple[str, ...] = ()) -> DataFrame:
    """Encode and decode ``text``, a row for each row of ``docs``.

    With ``digest``: ``doc_id, n_tokens, ids_sha256, decoded_sha256``; else the given
    ``columns``, then ``ids`` and ``decoded``.  Null and empty texts have no tokens.
    ``path`` is the vocabulary file; its tables are broadcast (fixed size).
    """
    shared = docs.sparkSession.sparkContext.broadcast(Codec(path))
    keep = ("doc_id",) if digest else columns
    rows = docs.select("text", *keep) if "text" not in keep else docs.select("text", *[c for c in keep if c != "text"])

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                piece = batch.slice(at, SLICE_ROWS)
                coded = list(encoder.encode([t or "" for t in piece.column(0).to_pylist()]))
                others = [piece.column(i) for i in range(1, piece.num_columns)]
                if digest:
                    made = [
                        pa.array([ids.count(",") + 1 if ids else 0 for ids, _ in coded], pa.int64()),
                        pa.array([hashlib.sha256(ids.encode()).hexdigest() for ids, _ in coded]),
                        pa.array([hashlib.sha256(text.encode()).hexdigest() for _, text in coded]),
                    ]
                    yield pa.RecordBatch.from_arrays([*others, *made], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    ids = pa.array([[int(i) for i in ids.split(",")] if ids else [] for ids, _ in coded], pa.list_(pa.int32()))
                    made = [ids, pa.array([text for _, text in coded])]
                    yield pa.RecordBatch.from_arrays([*others, *made], [*piece.schema.names[1:], "ids", "decoded"])

    if digest:
        return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    return rows.mapInArrow(run, f"{kinds}{', ' if kinds else ''}ids array<int>, decoded string")

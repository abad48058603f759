"""Quality rules on repetition, by suffix arrays over words.

The texts of a slice stand behind one another in one array of word numbers, each with numbers of
its own and closed by one that equals nothing, so one suffix array serves them all.  It is
built by prefix doubling; the ranks of every doubling stay, and from them the longest common
prefix of neighbouring suffixes is read off, the widest step first.  An interval of
neighbours with a common prefix is a repeated substring; the deepest interval of a suffix is
the longest repeat that begins there, and the union of those spans is the union of all
maximal repeats, as every other repeat lies inside one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Words whose suffix array is built at once; a longer text has one to itself.
SLICE_WORDS = 1 << 18
LEAST_WORDS = 50
WINDOW_WORDS = 3
MOST_REPEATED_PERCENT = 50
# A repeat that counts has this many words; such repeats may cover a part of the words and none may be longer than the limit.
REPEAT_WORDS = 8
MOST_COVERED_PERCENT = 30
MOST_LONGEST = 60
_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOL = r"[#*$%&|<>]"


def suffix_array(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the common prefix of each with the one before it (0 for the first).

    Memory is four bytes a number for each doubling up to the longest repeat.
    """
    n = len(numbers)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(numbers, kind="stable")
    rank = np.zeros(n, np.int32)
    ordered = numbers[order]
    rank[order] = np.cumsum(np.concatenate(([False], ordered[1:] != ordered[:-1]))).astype(np.int32)
    ranks, width = [rank], 1
    while rank[order[-1]] < n - 1:
        after = np.full(n, -1, np.int64)
        if width < n:
            after[:-width] = rank[width:]
        key = rank.astype(np.int64) * (n + 1) + after + 1
        # only suffixes that still tie have to move
        tied = np.flatnonzero(_ties(rank[order]))
        order[tied] = order[tied][np.argsort(key[order[tied]], kind="stable")]
        ordered = key[order]
        rank = np.zeros(n, np.int32)
        rank[order] = np.cumsum(np.concatenate(([False], ordered[1:] != ordered[:-1]))).astype(np.int32)
        width *= 2
        ranks.append(rank)
    left, right = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        inside = np.flatnonzero((left < n) & (right < n))
        same = inside[ranks[level][left[inside]] == ranks[level][right[inside]]]
        common[same + 1] += 1 << level
        left[same] += 1 << level
        right[same] += 1 << level
    return order, common


def _ties(ordered: np.ndarray) -> np.ndarray:
    equal = ordered[1:] == ordered[:-1]
    out = np.zeros(len(ordered), bool)
    out[1:] |= equal
    out[:-1] |= equal
    return out


def longest_repeats(numbers: np.ndarray) -> np.ndarray:
    """Words of the longest repeated substring that begins at each place."""
    order, common = suffix_array(numbers)
    out = np.zeros(len(numbers), np.int64)
    if len(numbers):
        out[order] = np.maximum(common, np.append(common[1:], 0))
    return out


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Places inside the span of a repeat of ``least`` words or more."""
    step = np.zeros(len(longest) + 1, np.int64)
    begin = np.flatnonzero(longest >= least)
    np.add.at(step, begin, 1)
    np.add.at(step, begin + longest[begin], -1)
    return np.cumsum(step[:-1]) > 0


def _per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _split(texts: pa.Array, pattern: str) -> tuple[pa.Array, np.ndarray]:
    """Non-empty pieces of all texts in one array, and the bounds of each text's pieces."""
    lists = pc.split_pattern_regex(texts, pattern)
    pieces = lists.flatten()
    full = np.asarray(pc.not_equal(pc.binary_length(pieces), 0)) if len(pieces) else np.zeros(0, bool)
    bounds = np.zeros(len(full) + 1, np.int64)
    np.cumsum(full, out=bounds[1:])
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return pieces.filter(pa.array(full)), bounds[offsets - offsets[0]]


def _repeated_lines(texts: pa.Array) -> list[int]:
    """Lines with a word that equal an earlier line of their text."""
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    worded = np.asarray(pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]")) if len(lines) else np.zeros(0, bool)
    codes = lines.dictionary_encode().indices.to_numpy().astype(np.int64)
    keys = owner[worded] * (len(lines) + 1) + codes[worded]
    distinct = np.unique(keys) // (len(lines) + 1)
    return (np.bincount(owner[worded], minlength=len(texts)) - np.bincount(distinct, minlength=len(texts))).tolist()


def _counted(texts: pa.Array, words: pa.Array, bounds: np.ndarray, least: int) -> dict:
    """Counts of each text from its words and the suffix array of them all."""
    n = np.diff(bounds)
    rows = len(n)
    numbers = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    # a text's words have numbers of their own, and behind them stands one that occurs nowhere else
    numbers = np.unique(np.repeat(np.arange(rows), n) * (len(numbers) + 1) + numbers, return_inverse=True)[1]
    ends = bounds[1:] + np.arange(rows)
    joined = np.zeros(len(numbers) + rows, np.int64)
    inner = np.ones(len(joined), bool)
    inner[ends] = False
    joined[inner] = numbers
    joined[ends] = len(numbers) + np.arange(rows)
    longest = longest_repeats(joined)[inner]
    lengths = np.asarray(pc.utf8_length(words)).astype(np.int64)
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, np.repeat(np.arange(rows), n), longest)
    repeated, long = covered(longest, WINDOW_WORDS), covered(longest, least)
    return {
        "n_words": n, "word_chars": _per_row(lengths, bounds), "n_symbols": np.asarray(pc.count_substring_regex(texts, _SYMBOL)).astype(np.int64),
        "n_dup_lines": _repeated_lines(texts), "n_repeat_words": _per_row(repeated, bounds), "covered_words": _per_row(long, bounds), "longest_repeat": top,
    }


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def counts(texts: pa.Array, least: int = REPEAT_WORDS) -> Iterator[dict]:
    """Counts of runs of texts, in order; null texts have no words."""
    texts = texts.cast(pa.large_string())
    texts = texts.fill_null("") if texts.null_count else texts
    # a text has no more words than half its bytes
    sizes = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64)) if len(texts) else np.zeros(0, np.int64)
    at = 0
    while at < len(texts):
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + 4 * SLICE_WORDS, "right")))
        piece = texts.slice(at, end - at)
        yield _counted(piece, *_split(piece, _SPACE), least)
        at = end


def repetition(docs: DataFrame, least: int = REPEAT_WORDS, covered_percent: int = MOST_COVERED_PERCENT, most_longest: int = MOST_LONGEST) -> DataFrame:
    """Counts and verdict for each row of ``docs(doc_id, text)``, in one pass without exchange.

    ``n_repeat_words`` counts words inside three-word windows that the text holds twice;
    ``covered_words`` those inside maximal repeats of ``least`` words or more, ``longest_repeat`` the longest
    repeat in words (one copy may overlap the next).  ``base_failed``: fewer than 50 words,
    or over half of them in repeated windows.  ``kept``: not failed, at most ``covered_percent`` of the words
    covered, and no repeat above ``most_longest`` words.  Null and empty texts have no words and are not kept.  Ids may
    be null or repeat; other columns are ignored; a text of any length is judged whole (about 16
    bytes of memory per word and doubling of its longest repeat).  No rows in, no rows out.
    """
    names = ["doc_id", *_COUNTS, "base_failed", "kept"]
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_failed boolean, kept boolean"

    def judge(batches):
        for batch in batches:
            at = 0
            for told in counts(batch.column(1), least):
                n = told["n_words"]
                failed = (n < LEAST_WORDS) | (100 * told["n_repeat_words"] > MOST_REPEATED_PERCENT * n)
                kept = ~failed & (100 * told["covered_words"] <= covered_percent * n) & (told["longest_repeat"] <= most_longest)
                ids = batch.column(0).slice(at, len(n))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(told[c], pa.int64()) for c in _COUNTS), pa.array(failed), pa.array(kept)], names=names)
                at += len(n)

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(judge, schema)

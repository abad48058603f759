import collections
import random
import re

import numpy as np
import pyarrow as pa
from brute import SF

from corpusgraph.llm import queries, repetition


def repeats(w, least):
    """Places inside repeated windows of ``least`` words."""
    at = collections.defaultdict(list)
    for i in range(len(w) - least + 1):
        at[" ".join(w[i : i + least])].append(i)
    return {i + j for places in at.values() if len(places) > 1 for i in places for j in range(least)}


def longest(w):
    """Length of the longest repeat; whatever holds a long repeat holds the shorter ones."""
    low, high = 0, len(w)
    while low < high:
        n = (low + high + 1) // 2
        seen = {hash(tuple(w[i : i + n])) for i in range(len(w) - n + 1)}
        low, high = (n, high) if len(seen) < len(w) - n + 1 else (low, n - 1)
    return low


def judged(rows):
    out = []
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        again, cover, top = len(repeats(w, 3)), len(repeats(w, repetition.REPEAT_WORDS)), longest(w)
        failed = len(w) < 50 or 100 * again > 50 * len(w)
        kept = not failed and 100 * cover <= repetition.MOST_COVERED_PERCENT * len(w) and top <= repetition.MOST_LONGEST
        out.append((doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), again, cover, top, failed, kept))
    return sorted(out, key=repr)


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(200):
        t = [rng.randrange(rng.randrange(1, 5)) for _ in range(rng.randrange(50))]
        order, common = repetition.suffix_array(np.array(t, np.int64))
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        for i in range(1, len(t)):
            a, b, n = t[order[i - 1] :], t[order[i] :], 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            assert n == common[i]


def test_slices_do_not_matter(monkeypatch):
    rng = random.Random(4)
    texts = pa.array([None if i % 9 == 0 else " ".join(rng.choice("abc") for _ in range(rng.randrange(80))) for i in range(60)], pa.string())
    whole = [np.concatenate([np.asarray(d[c]) for d in repetition.counts(texts)]).tolist() for c in repetition._COUNTS]
    monkeypatch.setattr(repetition, "SLICE_WORDS", 16)
    assert whole == [np.concatenate([np.asarray(d[c]) for d in repetition.counts(texts)]).tolist() for c in repetition._COUNTS]


def test_brute_force(spark, edge_docs, edge_rows, no_docs):
    passage = [f"w{i}" for i in range(70)]
    rng = random.Random(8)
    fill = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    rows = [
        (1, " ".join([*passage, *fill(200), *passage])), (2, " ".join([*passage[:40], *fill(200), *passage[:40]])), (3, " ".join((fill(9) * 2) + fill(30))),
        (4, "one two\n one two\none two\n\n \none two \x0b x"), (5, "same " * 300), (6, " ".join(fill(49))), (7, " ".join(fill(50))), (None, "\x1f\x85\xa0 é| <>"), (8, "\n\n"),
        (9, "\n".join(" ".join(fill(12)) for _ in range(4)) * 2), (9, None),
    ]
    got = repetition.repetition(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == judged(rows)
    verdict = {r["doc_id"]: r["kept"] for r in got}
    assert [verdict[i] for i in (1, 2, 5, 6, 7)] == [False, True, False, False, True]
    # the longest of these texts is left to the counts below, as its brute force takes minutes
    small = [r for r in edge_rows if r[0] != 9006]
    edge = repetition.repetition(edge_docs).collect()
    assert sorted((tuple(r) for r in edge if r["doc_id"] != 9006), key=repr) == judged(small)
    words = re.findall(r"[^\x20\x09-\x0D]+", next(t for d, t in edge_rows if d == 9006))
    long = next(r for r in edge if r["doc_id"] == 9006)
    assert (long["n_words"], long["n_repeat_words"], long["covered_words"]) == (len(words), len(repeats(words, 3)), len(repeats(words, repetition.REPEAT_WORDS)))
    assert repetition.repetition(no_docs).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [(r["doc_id"], r["n_words"], r["n_repeat_words"], r["covered_words"], r["long_repeat"], r["kept"]) for r in queries.op12_repetition(spark, SF).collect()]
    assert sorted(got) == sorted((r[0], r[1], r[5], r[6], r[7] > repetition.MOST_LONGEST, r[9]) for r in judged(rows))

import bisect
import collections
import hashlib
import random

import pytest
from brute import SF

from corpusgraph.llm import alignment, queries


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.ByteLevel(queries.vocabulary()), alignment.Pieces(queries.pieces())


def grouped(a, b, size_a, size_b):
    """Groups by the set of common ends."""
    ends = [[0], [0]]
    for out, ids, sizes in ((ends[0], a, size_a), (ends[1], b, size_b)):
        for t in ids:
            out.append(out[-1] + len(sizes[t]))
    common = sorted(set(ends[0][1:]) & set(ends[1][1:]))
    out = [([], []) for _ in common]
    for side, (ids, held) in enumerate(((a, ends[0]), (b, ends[1]))):
        for t, e in zip(ids, held[1:], strict=True):
            out[bisect.bisect_left(common, e)][side].append(t)
    return out


def report(rows, first, second):
    made, docs = [], collections.Counter()
    for doc_id, text in rows:
        text = text or ""
        a, b = first.library.encode(" " + text, add_special_tokens=False).ids, second.library.encode(text)
        whole = (" " + text).encode()
        if not text or b"".join(first.pieces[t] for t in a) != whole or b"".join(second.pieces[t] for t in b) != whole:
            made.append((doc_id, [], [], []))
            continue
        groups = grouped(a, b, first.pieces, second.pieces)
        made.append((doc_id, a, b, groups))
        docs.update({(x, y) for p, q in groups for x in p for y in q})
    best = {}
    for (x, _), n in docs.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for doc_id, a, b, groups in made:
        links = [(x, y) for p, q in groups for x in p for y in q]
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(docs[x] == best[x[0]] for x in links), sum(docs[x] for x in links),
                    hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_ids_are_those_of_the_library(tokenizers):
    """The faster way gives the library's ids; texts that it cannot take go to the library."""
    first = tokenizers[0]
    rng = random.Random(11)
    signs = [*" \n\t\x0b\x1c\x1d\x85\xa0\u180e\u200b\u2028\u3000'", "'s", "'LL", "Ⅷ", "²", "é", "́", "🎉", "日本", "ab", "1", "_", "<|endoftext|>", "the ", "ſ"]
    every = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)] + texts() + [" " * 5000 + "x", "x" * 5000, "\n \n" * 900]
    assert first.ranks is not None
    assert first.ids(every) == [x.ids for x in first.library.encode_batch([" " + t for t in every], add_special_tokens=False)]


def test_groups_are_the_common_ends():
    rng = random.Random(1)
    for _ in range(2000):
        n = rng.randrange(1, 80)
        a, b = (sorted({*rng.sample(range(1, n + 1), rng.randrange(1, n + 1)), n}) for _ in range(2))
        left, right = alignment.diagonal_groups(a, b)
        common = sorted(set(a) & set(b))
        assert [a[i - 1] for i in left] == common == [b[j - 1] for j in right]
    assert alignment.diagonal_groups(list(range(1, 5000)), list(range(1, 5000))) == (list(range(1, 5000)),) * 2


def test_query(spark, tokenizers):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    df = queries.op13_alignment(spark, SF)
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got(df) == report(rows, *tokenizers)


def texts():
    rng = random.Random(3)
    signs = list("abAB the's 're  \n\t.,!?_012²½Ⅷ一二éñ́‍🎉▁") + ["<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", " the", "ing", "\r\n"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(300)]


@pytest.mark.parametrize("known", [alignment.KNOWN_PAIRS, 40, 0])
def test_odd_texts(spark, tokenizers, no_docs, monkeypatch, known):
    """Whatever the tasks know of the counts, the joined rest makes the sums whole; long groups go by distinct ids."""
    monkeypatch.setattr(alignment, "KNOWN_PAIRS", known)
    monkeypatch.setattr(alignment, "SLICE_LINKS", 30)
    rows = [(None if i % 50 == 0 else i // 2, t) for i, t in enumerate([None, "", " ", "▁", "\0", *texts(), "日本語" * 40, "x" * 5000, "same", "same"])]
    df = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], "doc_id long, text string, row string, pairs int, pair int").repartition(4)
    assert got(alignment.alignment(df, queries.vocabulary(), queries.pieces())) == report(rows, *tokenizers)
    assert alignment.alignment(no_docs, queries.vocabulary(), queries.pieces()).count() == 0

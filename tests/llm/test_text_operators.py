import collections
import hashlib
import math
import random
import re
import time

import pytest
from brute import SF, crc, fold, secret_spans
from pyspark.sql import functions as F

from corpusgraph.llm import bpe, classlm, licenses, queries, secrets, toxicity
from corpusgraph.llm.words import crc_of


def ordered(rows):
    return sorted(rows, key=repr)


def test_licenses_match_brute_force(edge_docs, edge_rows, no_docs):
    want = []
    for d, t in edge_rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
        at = sorted((i, label) for p, label in licenses.BASE.items() for n in [len(p.split())] for i in range(len(w)) if w[i : i + n] == p.split())
        want.append((d, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    got = licenses.licenses(edge_docs).collect()
    assert ordered((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == ordered(want)
    told = next(r for r in got if r["doc_id"] == 9009)
    assert told["labels"] == "apache-2.0,cc-by,cc-by-nc,gpl,gpl-2.0-only,mit" and told["score"] > 0.9 and told["freedom"] == 0.3
    assert all(r["score"] == 0 and r["labels"] == "" for r in got if r["doc_id"] in (9001, 9002, 9003))
    assert licenses.licenses(no_docs).count() == 0


@pytest.mark.parametrize(
    ("text", "labels", "freedom"),
    [
        ("MIT", {"mit"}, 1.0), ("GPL-3.0-only OR MIT", {"gpl-3.0-only", "mit"}, 1.0), ("GPL-3.0-only AND MIT", {"gpl-3.0-only", "mit"}, 0.3),
        ("MIT OR GPL-2.0-only AND AGPL-3.0", {"mit", "gpl-2.0-only", "agpl-3.0"}, 1.0), ("(MIT OR GPL-2.0-only) AND AGPL-3.0", {"mit", "gpl-2.0-only", "agpl-3.0"}, 0.2),
        ("GPL-2.0-only WITH Classpath-exception-2.0", {"gpl-2.0-only"}, 0.5), ("mit or (bsd) and isc trailing words", {"mit", "bsd", "isc"}, 1.0),
        ("MIT or see the file", {"mit"}, 1.0), ("Apache-2.0. Other words", {"apache-2.0"}, 1.0), ("LicenseRef-My.Own-1 AND 0BSD", {"licenseref-my.own-1", "0bsd"}, 0.4),
        ("LGPL-2.1-or-later with some-exception or GPL-2.0+", {"lgpl-2.1-or-later", "gpl-2.0+"}, 0.8),
    ],
)
def test_expressions(text, labels, freedom):
    value = licenses.evaluate(text)
    assert value.labels == labels and value.freedom == pytest.approx(freedom)


def test_broken_expressions():
    assert all(licenses.evaluate(x) is None for x in ("", "OR", "MIT OR", "(MIT", "MIT AND )", "()", "see the file", "(MIT or see the file)", "with care"))


def test_notices_of_a_long_text_take_linear_time():
    phrases = licenses.automaton()

    def took(n):
        text = "under the MIT License or CC BY, ".lower() * n
        start = time.perf_counter()
        found = licenses.read_notice(text, phrases)
        assert len(found.places) == 2 * n and found.places[-2] == (7 * n - 5, "mit")
        return time.perf_counter() - start

    took(100)
    assert took(80_000) < 12 * took(20_000) + 0.2


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_matches_the_library(edge_docs, edge_rows, no_docs, library):
    want = []
    for d, t in edge_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = bpe.round_trip(edge_docs, queries.vocabulary())
    assert ordered(tuple(r) for r in got.collect()) == ordered(want)
    assert bpe.round_trip(no_docs, queries.vocabulary()).count() == 0
    full = bpe.round_trip(edge_docs, queries.vocabulary(), digest=False, columns=("doc_id", "score")).collect()
    assert all(r["score"] == "s" and len(r["ids"]) == len(library.encode(r["decoded"], add_special_tokens=False).ids) for r in full)


def test_bpe_fuzz(library):
    rng = random.Random(7)
    signs = list("abAB the's 're  \n\t\x0b\x1d\x85\xa0　.,!?_012²½Ⅷ一二éñ́‍🎉") + ["<|endoftext|>", " the", "ing", "\r\n"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(500)] + ["a" * 3000, " " * 100, "é" * 501]
    encoder = bpe.Encoder(bpe.Codec(queries.vocabulary()))
    for text, (ids, decoded) in zip(texts, encoder.encode(texts), strict=True):
        assert ids == ",".join(map(str, library.encode(text, add_special_tokens=False).ids)) and decoded == text


def test_class_model(spark, edge_docs, edge_rows, no_docs):
    held = crc_of(edge_docs["doc_id"]) % 10 == 0
    model, counts = classlm.fit(edge_docs, ~held)
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    c = collections.Counter(w for d, t in edge_rows if crc(d) % 10 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    assert model.n == n
    want = [(d, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 4)) for d, t in edge_rows]
    got = classlm.scored(edge_docs, model, counts).collect()
    assert ordered((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == ordered(want)
    assert all(r["score"] < 0 for r in got)
    assert (10**model.steps).sum(axis=1) == pytest.approx(1)
    empty, none = classlm.fit(no_docs, crc_of(no_docs["doc_id"]) % 10 != 0)
    assert empty.n == 0 and classlm.scored(no_docs, empty, none).count() == 0
    assert all(r["score"] <= 1e-9 and r["n_known"] == 0 for r in classlm.scored(edge_docs, empty, none).collect())


def test_classes_raise_held_out_likelihood(spark):
    rows = queries.op3_classlm(spark, SF).where("held_out").collect()
    mean = lambda f: sum(r[f] for r in rows) / sum(r["n_tokens"] for r in rows)
    assert rows and mean("score") > mean("base_score") + 0.05


def test_exchange_finds_planted_classes():
    import numpy as np

    rng = np.random.default_rng(1)
    member = np.arange(40) % 2
    counts = np.zeros((41, 41))
    for a in range(40):
        for b in range(40):
            counts[a, b] = rng.poisson(30 if member[a] != member[b] else 1)
    found = classlm.exchange(counts, classes=9)[:40]
    assert all(len(set(member[found == c])) <= 1 for c in range(8))


def test_every_training_word_has_a_class_of_its_neighbours(spark, edge_docs, edge_rows, monkeypatch):
    """Words that are no symbols are clustered too; scores equal a plain class model, whether a word travels or is joined."""
    import numpy as np

    for name, few in (("LEAST_SYMBOLS", 30), ("LEAST_CLASSES", 8), ("CLASS_SYMBOLS", 1), ("LOCAL_WORDS", 60), ("FLUSH_NEIGHBOURS", 500), ("FLUSH_WORDS", 400), ("PIECE_TEXTS", 7)):
        monkeypatch.setattr(classlm, name, few)
    held = crc_of(edge_docs["doc_id"]) % 10 == 0
    model, counts = classlm.fit(edge_docs, ~held)
    told = {r["word"].encode(): (r["c"], r["class"]) for r in counts.collect()}
    texts = [classlm.words_of(t) for d, t in edge_rows if crc(d) % 10]
    own, end = set(model.lexicon.words[: model.lexicon.own]), len(model.steps) - 1
    assert set(told) == {w for t in texts for w in t} and len(own) < len(model.lexicon.words) < len(told)

    def unmet(w):
        return int(model.class_of[model.lexicon.own + classlm.ending(w)])

    def class_of(w):
        return told[w][1] if w in told else unmet(w)

    # transitions with the classes found
    between = np.zeros((end + 1, end + 1))
    for t in texts:
        of = [end, *map(class_of, t), end]
        np.add.at(between, (of[:-1], of[1:]), 1)
    often = (between.sum(axis=0) + 1) / (between.sum() + end + 1)
    steps = np.log10((between + often) / (between.sum(axis=1, keepdims=True) + 1))
    assert model.steps == pytest.approx(steps)
    tokens, kinds = collections.Counter(), collections.Counter(c for _, c in told.values())
    for n, c in told.values():
        tokens[c] += n
    want = []
    for d, t in edge_rows:
        words = classlm.words_of(t)
        of = [end, *map(class_of, words), end]
        emitted = sum(math.log10((told.get(w, (0,))[0] + 0.1) / (tokens[class_of(w)] + 0.1 * (kinds[class_of(w)] + 1))) for w in words)
        want.append((d, len(words) + 1, round(emitted + float(steps[of[:-1], of[1:]].sum()), 3)))
    assert ordered((r["doc_id"], r["n_tokens"], round(r["score"], 3)) for r in classlm.scored(edge_docs, model, counts).collect()) == ordered(want)

    # every other word: the best class by its neighbours' classes, one by one
    symbol = lambda w: int(model.class_of[model.lexicon.words.index(w)]) if w in own else unmet(w)
    start = np.zeros_like(between)
    beside: dict = {}
    for t in texts:
        of = [end, *map(symbol, t), end]
        np.add.at(start, (of[:-1], of[1:]), 1)
        for i, w in enumerate(t):
            beside.setdefault(w, collections.Counter()).update([of[i], end + 1 + of[i + 2]])
    f = lambda x: x * math.log(x) if x > 0 else 0.0
    rows, cols = start.sum(axis=1), start.sum(axis=0)
    for w in sorted(set(told) - own)[::7]:
        gains, a, n = [], symbol(w), told[w][0]
        for c in range(end):
            sign = -1 if c == a else 1
            gain = sum(sign * (f(x + sign * m) - f(x)) for k, m in beside[w].items() for x in [start[k, c] if k <= end else start[c, k - end - 1]])
            gains.append(gain - sum(sign * (f(x + sign * n) - f(x)) for x in (rows[c], cols[c])))
        assert gains[told[w][1]] >= max(gains) - 1e-6


def test_words_of_one_ending_part_by_their_neighbours(spark, monkeypatch):
    """Rare words that end alike, half of them among one kind of words, half among another."""
    monkeypatch.setattr(classlm, "LEAST_SYMBOLS", 20)
    monkeypatch.setattr(classlm, "LEAST_CLASSES", 6)
    monkeypatch.setattr(classlm, "CLASS_SYMBOLS", 1)
    rng = random.Random(5)
    rows = []
    for i in range(600):
        kind = "ab"[i % 2]
        often = lambda: f"{kind}{rng.randrange(6)}"  # noqa: B023, E731
        rows.append((i, " ".join(f"{often()} rare{kind}{rng.randrange(40)}zz {often()}" for _ in range(4))))
    model, counts = classlm.fit(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True))
    of = {r["word"]: r["class"] for r in counts.collect() if r["word"].encode() not in model.lexicon.words[: model.lexicon.own]}
    kinds = [{c for w, c in of.items() if w[4] == kind} for kind in "ab"]
    assert all(kinds) and not kinds[0] & kinds[1]


def toxic_tables(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(900):
        w = [rng.choice(vocabulary) for _ in range(40)]
        bad = i % 6 == 0
        if bad:
            w[rng.randrange(40)] = rng.choice(["grumbo", "zlokan" + rng.choice("xyzuvw"), "zlokan" + rng.choice("klmn"), "vilefoo"])
        docs.append((i, " ".join(w)))
        labels.append((i, None if i % 50 == 7 else int(bad)))
    docs += [(5000 + i, " ".join(["grumbo", *vocabulary[:30]])) for i in range(3)] + [(6000, None), (None, "grumbo"), (6001, "")]
    labels += [(None, 1), (0, 0), (0, 1), (77777, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), {i for i in range(900) if i % 6 == 0}


def test_toxicity_learns_words_and_beginnings(spark):
    docs, labels, bad = toxic_tables(spark)
    model = toxicity.train(docs, labels, crc_of(labels["doc_id"]) % 4 != 2)
    assert any(e.startswith("zloka") and e.endswith("*") for e in model.lexicon) and "grumbo" in {e.rstrip("*") for e in model.lexicon} | {"grumbo"}
    got = toxicity.scored(docs, model).collect()
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and crc(r["doc_id"]) % 4 == 2]
    hit = {r["doc_id"] for r in held if r["score"] >= toxicity.REJECT}
    truth = {r["doc_id"] for r in held} & bad
    assert len(hit & truth) >= 0.95 * len(truth) and len(hit - truth) <= 2
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] < toxicity.REJECT for r in got if r["doc_id"] in (6000, 6001)) and all(r["score"] >= toxicity.REJECT for r in got if r["doc_id"] in (5000, None))
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["score"] < toxicity.REJECT for r in got)


def test_toxicity_without_labels(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for docs, labels in ((edge_docs, none), (no_docs, none), (edge_docs, spark.createDataFrame([(9004, 1)], "doc_id long, toxic int"))):
        model = toxicity.train(docs, labels, crc_of(labels["doc_id"]) % 4 >= 0)
        assert toxicity.accepted(docs, model).columns == docs.columns
        assert toxicity.scored(docs, model).count() == docs.count()


def test_lexicon_matches_brute_force(spark):
    """Counts of both classes, the rare clean ones too, and the exact binomial tail."""
    rng = random.Random(8)
    pool = [f"w{i}x" for i in range(60)]
    texts = [(" ".join(rng.choices(pool, k=12)) + (f" {rng.choice(['grumbo', 'zlokan'])}" if i % 4 == 0 and rng.random() < 0.9 else " rare" if rng.random() < 0.01 else ""), int(i % 4 == 0)) for i in range(400)]
    texts += [(None, 0), ("", 1), ("rare rare", 1), ("rare", 1), ("rare", 1)]
    sample = spark.createDataFrame(texts, "text string, toxic int")
    counts = [collections.Counter(), collections.Counter()]
    for t, y in texts:
        counts[y].update({e for w in toxicity.words_of(t or "") for e in toxicity.entries(w)})
    want = {e: (n, counts[0][e]) for e, n in counts[1].items() if n >= toxicity.LEAST_TEXTS}
    assert {r["entry"]: (r["n_toxic"], r["n_clean"]) for r in toxicity._counted(sample).collect()} == want
    n_toxic = sum(y for _, y in texts)
    share = n_toxic / len(texts)
    exact = lambda t, n: sum(math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(t, n + 1))
    good = {e for e, (t, c) in want.items() if (t + 0.5) / (t + c + 1) >= toxicity.PRECISION and exact(t, t + c) * len(want) <= toxicity.CHANCE}
    lexicon = toxicity._lexicon(sample, n_toxic, len(texts) - n_toxic)
    assert {"grumbo", "zlokan"} & good and set(lexicon) <= good and sorted(lexicon.values()) == list(range(len(lexicon)))
    assert {w for w in ("grumbo", "zlokan") for e in lexicon if w.startswith(e.strip("*")) or w.endswith(e.strip("*"))} == {"grumbo", "zlokan"}


def test_only_near_copies_count_once_in_the_fit(spark):
    words = [f"k{i}" for i in range(200)]
    half = " ".join(words[:100] + [f"z{i}" for i in range(100)])
    rows = [(i, " ".join(words), 1) for i in range(5)] + [(10, half, 1), (11, None, 1), (12, "", 1), (13, " ".join(words), 0)]
    near = toxicity._minima(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    keys = {r["doc_id"]: tuple(r["near"]) for r in near.collect()}
    assert len({keys[i] for i in (0, 1, 2, 3, 4, 13)}) == 1 and keys[10] != keys[0] and keys[11] == keys[12] == (0,) * toxicity.MINIMA


def test_label_model_discounts_correlated_voters():
    import numpy as np

    rng = np.random.default_rng(5)
    y = rng.random(4000) < 0.2
    good = (y & (rng.random(4000) < 0.7)) | (rng.random(4000) < 0.02)
    noise = rng.random(4000) < 0.3
    post, accuracy, discount = toxicity.label_model(np.stack([good, noise, noise], axis=1), y ^ (rng.random(4000) < 0.05))
    assert accuracy[0] > 0.8 and accuracy[1] < 0.4 and discount[0] > 0.9 and discount[1] < 0.6
    assert ((post > 0.5) == y).mean() > 0.93


def test_secrets_match_brute_force(edge_docs, edge_rows, no_docs):
    want = [(d, *n, h) for d, t in edge_rows for n, h in [secret_spans(t)]]
    got = secrets.digest(secrets.secret_report(edge_docs)).collect()
    assert ordered((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == ordered(want)
    assert secrets.digest(secrets.secret_report(no_docs)).count() == 0


def test_secret_ownership(spark):
    texts = ["token: aaaabbbbcccc", "x password=hunter2hunter2 y", "k sk-abcdefghijklmnopqrstuvwx", "https://me:hidden@host/ eyJabcdefgh.abcdefghij.abcdefghij"]
    rows = [(i, texts[0], f"s{i}") for i in range(4)] + [(10, texts[1], "s0"), (11, texts[1], "s0"), (12, texts[2], None), (13, texts[3], "s9")]
    got = {r["doc_id"]: r for r in secrets.digest(secrets.secret_report(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert (got[0]["n_copied"], got[0]["n_owner_specific"]) == (1, 0) and (got[10]["n_copied"], got[10]["n_owner_specific"]) == (0, 1)
    assert got[12]["n_owner_specific"] == 0 and got[13]["n_owner_specific"] == 0  # an example, an ordinary word and a token of letters in order
    assert got[12]["spans"] == "provider:2:29" and got[13]["spans"] == "url_login:0:18,jwt:24:57" and got[13]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_repositories_and_liveness_decide_ownership(spark):
    drawn = "Zk3vQ9xLw2Tb7Hn5"
    rows = [(i, f"token={drawn}", "s0") for i in range(25)]
    rows += [(100, "secret: p7Xw0Rk2Vt9Mz4Qs", "s0"), (101, "secret: exampleRk2Vt9Mz4", "s0"), (102, "secret: aaaaaaaaaaaaaaaa", "s0"), (103, "é " + "ab01" * 50_000, "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    few = {r["doc_id"]: (r["n_copied"], r["n_owner_specific"]) for r in secrets.digest(secrets.secret_report(docs)).collect()}
    # one owner, but many repositories
    assert few[0] == (1, 0) and few[100] == (0, 1) and few[101] == few[102] == few[103] == (0, 0)
    more = {r["doc_id"]: (r["n_copied"], r["n_owner_specific"]) for r in secrets.digest(secrets.secret_report(docs, copied_repositories=26)).collect()}
    assert more[0] == (0, 1)
    counts = {(r["n_repositories"], r["n_owners"]) for r in secrets.secret_report(docs).selectExpr("inline(spans)").collect()}
    assert counts == {(25, 1), (1, 1)}


def test_native_plans_have_no_python(spark):
    for name in ("op7_secrets", "op9_shards"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)

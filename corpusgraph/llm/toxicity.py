"""Toxicity by weak supervision.

Many voters look at a text: lexicon entries (words, word beginnings and endings that
labelled toxic texts hold far more often than chance allows) and fixed patterns.  A
generative label model estimates by EM how often each voter fires on toxic and on clean
texts and how voters are correlated given the class; correlated voters share their weight.
A linear classifier is then trained on the model's posterior labels and scores all texts.

Fitting uses at most ``FIT_ROWS`` labelled rows, those with the smallest hash of their id.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from .words import filtered, hashed, mix, shingled

# Documented bound of the fit: labelled rows.  Twice as many are drawn, since near copies among them count once.
FIT_ROWS = 20_000
# Toxic texts that a lexicon candidate occurs in; least hashes that near copies agree on.
LEAST_TEXTS, MINIMA = 3, 3
# An entry stays when its share of toxic texts is this unlikely by chance over all candidates, and it is mostly toxic.
CHANCE, PRECISION = 0.05, 0.6
AFFIXES = (4, 5, 6)
ROUNDS, RIDGE = 25, 0.05
REJECT = 0.3
# Words whose voters a worker remembers; the store is emptied when full.
STORE_WORDS = 400_000

# Patterns of hostile writing.
PATTERNS = {
    "shouting": re.compile(r"[^\W\d_a-z]{3,}!!(?:\s+\S*!!){4}"),
    "second_person": re.compile(r"\b(?:you are|you're|du bist|tu es|eres) (?:an? |un |una |une |ein |eine )?\w+[.!]", re.I),
    "threat": re.compile(r"\b(?:kill|hurt|hate) (?:you|them|him|her)\b", re.I),
}
_FOLD = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> set[bytes]:
    return set(text.lower().encode("utf-8", "replace").translate(_FOLD).split())


def entries(word: bytes) -> list[str]:
    """Lexicon entries that a word belongs to: itself, its beginnings ``ab*`` and endings ``*yz``."""
    w = word.decode("utf-8", "replace")
    return [w, *(w[:n] + "*" for n in AFFIXES if len(w) > n), *("*" + w[-n:] for n in AFFIXES if len(w) > n)]


class Model(NamedTuple):
    lexicon: dict[str, int]
    patterns: tuple[str, ...]
    weights: np.ndarray
    bias: float
    accuracy: np.ndarray  # of each voter, from the label model


class Voters:
    """Which voters fire on a text; remembers words."""

    def __init__(self, lexicon: dict[str, int], patterns: tuple[str, ...]):
        self.lexicon, self.store = lexicon, {}
        self.patterns = [PATTERNS[p] for p in patterns]

    def fire(self, text: str) -> list[int]:
        store, fired = self.store, set()
        for w in words_of(text):
            votes = store.get(w)
            if votes is None:
                if len(store) > STORE_WORDS:
                    store.clear()
                votes = store[w] = tuple(self.lexicon[e] for e in entries(w) if e in self.lexicon)
            if votes:
                fired.update(votes)
        n = len(self.lexicon)
        fired.update(n + i for i, p in enumerate(self.patterns) if p.search(text))
        return sorted(fired)


def _tail(hits: int, n: int, share: float) -> float:
    """Chance of ``hits`` or more of ``n`` at a given share."""
    if hits <= n * share:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share) for k in range(hits, n + 1)]
    top = max(logs)
    return math.exp(top) * sum(math.exp(x - top) for x in logs)


def significant(toxic: int, clean: int, share: float, tested: int) -> float | None:
    """How likely ``toxic`` of the texts with an entry are so by chance, or None if that is not rare over all tested entries."""
    chance = _tail(toxic, toxic + clean, share)
    return chance if (toxic + 0.5) / (toxic + clean + 1) >= PRECISION and chance * tested <= CHANCE else None


def choose(found: list[tuple[str, int, float]]) -> dict[str, int]:
    """The lexicon: significant entries ``(entry, toxic texts, chance)``, best first, without those that a chosen entry covers."""
    chosen: dict[str, int] = {}
    covers: set[tuple[str, int]] = set()
    heads, tails = set(), set()
    for _, _, e, t in sorted((chance, -len(e), e, t) for e, t, chance in found):
        stem = e.strip("*")
        covered = any(stem[:n] in heads or stem[-n:] in tails for n in AFFIXES)
        # an entry that only restates what a chosen one says, on the same texts
        if covered or (stem[:4], t) in covers or (stem[-4:], t) in covers:
            continue
        covers |= {(stem[:4], t), (stem[-4:], t)}
        if e[-1] == "*":
            heads.add(stem)
        elif e[0] == "*":
            tails.add(stem)
        chosen[e] = len(chosen)
    return chosen


def label_model(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(posterior, accuracy, discount)`` of binary votes (texts by voters) with given labels as one more, fallible voter.

    EM over a two-class model in which each voter fires at its own rate in each class.
    After every step the correlation of voters within the classes is estimated from their
    residuals, and a voter's evidence is divided by its total correlation with the others.
    """
    n, m = votes.shape
    x = votes.astype(np.float64)
    post = np.clip(labels.astype(np.float64), 0.02, 0.98)
    discount = np.ones(m)
    given = labels.astype(bool)
    for _ in range(ROUNDS):
        total = post.sum()
        prior = np.clip(total / n, 1e-4, 1 - 1e-4)
        on = (post @ x + 0.5) / (total + 1)
        off = ((1 - post) @ x + 0.05) / (n - total + 1)
        hit = np.clip((post @ given) / total, 0.55, 0.98)
        miss = np.clip(((1 - post) @ given) / (n - total), 0.001, 0.3)
        residual = x - post[:, None] * on - (1 - post[:, None]) * off
        spread = residual.T @ residual
        scale = np.sqrt(np.maximum(np.diag(spread), 1e-9))
        together = np.maximum(spread / np.outer(scale, scale), 0)
        np.fill_diagonal(together, 0)
        together[together < 0.1] = 0
        discount = 1 / (1 + together.sum(axis=1))
        odds = math.log(prior / (1 - prior)) + np.where(given, math.log(hit / miss), math.log((1 - hit) / (1 - miss)))
        fires = np.log(on / off) * discount
        rests = np.log((1 - on) / (1 - off)) * discount
        odds = odds + x @ fires + (1 - x) @ rests
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - post).max() < 1e-4:
            post = new
            break
        post = new
    fired = x.sum(axis=0)
    accuracy = np.where(fired > 0, (post @ x) / np.maximum(fired, 1), 0.5)
    return post, accuracy, discount


def linear(x: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft targets by Newton steps."""
    design = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    w = np.zeros(design.shape[1])
    ridge = np.full(len(w), RIDGE)
    ridge[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (p - target) + ridge * w
        bend = (design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _counted(sample: DataFrame) -> DataFrame:
    """``(entry, n_toxic, n_clean)``: in how many sampled texts of each class an entry of ``LEAST_TEXTS`` toxic ones occurs."""

    def run(batches):
        seen: tuple[Counter, Counter] = Counter(), Counter()
        store: dict = {}

        def told():
            for toxic, counts in enumerate(seen):
                rows = list(counts.items())
                counts.clear()
                for i in range(0, len(rows), 50_000):
                    piece = rows[i : i + 50_000]
                    flags = pa.array(np.full(len(piece), toxic, np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in piece]), flags, pa.array([n for _, n in piece], pa.int64())], ["entry", "toxic", "n"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: set = set()
                for w in words_of(text or ""):
                    got = store.get(w)
                    if got is None:
                        got = store[w] = tuple(entries(w))
                    found.update(got)
                seen[bool(toxic)].update(found)
            if len(store) > STORE_WORDS:
                store.clear()
                yield from told()
        yield from told()

    each = sample.select("text", "toxic").mapInArrow(run, "entry string, toxic int, n long")
    of = lambda toxic: F.coalesce(F.sum(F.when(F.col("toxic") == toxic, F.col("n"))), F.lit(0))
    return each.groupBy("entry").agg(of(1).alias("n_toxic"), of(0).alias("n_clean")).where(F.col("n_toxic") >= LEAST_TEXTS)


def _lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> dict[str, int]:
    """Every candidate goes through the test where it lies; the significant ones of at most ``FIT_ROWS`` texts come to the driver."""
    counts = cut(_counted(sample))
    tested, share = counts.count(), n_toxic / (n_toxic + n_clean)

    def run(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            good = [(e, t, chance) for e, t, c in rows if (chance := significant(t, c, share, tested)) is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in good], pa.string()), pa.array([g[1] for g in good], pa.int64()), pa.array([g[2] for g in good], pa.float64())], ["entry", "n", "chance"]
            )

    return choose([tuple(r) for r in counts.mapInArrow(run, "entry string, n long, chance double").collect()])


def _minima(texts: DataFrame) -> DataFrame:
    """Adds ``near``: the least hashes of a text's shingles under ``MINIMA`` permutations, which near copies mostly share."""
    seeds = mix(np.arange(1, MINIMA + 1, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            least = []
            for _, words, bounds in hashed(batch.column(1)):
                s, ends = shingled(words, bounds, 5)
                for a, b in zip(ends, ends[1:], strict=False):
                    least.append([int(mix(s[a:b] ^ x).min().view(np.int64)) for x in seeds] if b > a else [0] * MINIMA)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.list_(pa.int64()))], ["doc_id", "text", "toxic", "near"])

    return texts.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, text string, toxic int, near array<long>")


def train(docs: DataFrame, labels: DataFrame, learnable: Column, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on labelled rows of ``docs(doc_id, text)`` where ``learnable`` (of ``doc_id``) holds.

    Null labels and ids are left out, repeated ones count once (toxic wins).  Of copies and near
    copies with one label the first in the order of the draw counts; ``fit_rows`` holds after that.
    Texts are read whole.  Without a toxic and a clean row the model knows only the patterns.
    """
    chosen = (
        labels.where(learnable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * fit_rows)
    )
    # at most 2 * fit_rows small rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id")
    drawn = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", F.xxhash64("text").alias("t"), F.monotonically_increasing_id().alias("seq"))
    near = cut(_minima(texts).withColumn("drawn", drawn))
    # texts stay where they are: at most fit_rows places come together
    firsts = near.groupBy("near", "toxic").agg(F.min("drawn").alias("drawn")).orderBy("drawn").limit(fit_rows).select("drawn")
    sample = cut(near.join(F.broadcast(firsts), "drawn", "left_semi").select("text", "toxic"))
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    patterns = tuple(PATTERNS)
    if not n_toxic or not n_clean:
        return Model({}, patterns, np.ones(len(patterns)), -3.0, np.full(len(patterns), 0.5))
    lexicon = _lexicon(sample, n_toxic, n_clean)
    m = len(lexicon) + len(patterns)

    def run(batches):
        voters = Voters(lexicon, patterns)
        for batch in batches:
            fired = [voters.fire(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(fired, pa.list_(pa.int32())), batch.column(1)], ["fired", "toxic"])

    # one row per pattern of votes and label: at most fit_rows
    rows = sample.mapInArrow(run, "fired array<int>, toxic int").groupBy("fired", "toxic").count().orderBy("toxic", "fired").collect()
    votes = np.zeros((sum(r["count"] for r in rows), m), bool)
    given = np.zeros(len(votes), bool)
    at = 0
    for r in rows:
        votes[at : at + r["count"], r["fired"]] = True
        given[at : at + r["count"]] = r["toxic"]
        at += r["count"]
    post, accuracy, _ = label_model(votes, given)
    weights, bias = linear(votes, post)
    return Model(lexicon, patterns, weights, bias, accuracy)


def _scores(model: Model, texts: list[str | None], voters: Voters) -> list[float]:
    out = []
    for t in texts:
        odds = model.bias + float(sum(model.weights[i] for i in voters.fire(t or "")))
        out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return out


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of every row; a null or empty text gets the score of silence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        voters = Voters(m.lexicon, m.patterns)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(m, batch.column(1).to_pylist(), voters), pa.float64())], ["doc_id", "score"])

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """Rows of ``docs`` below the rejecting score, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        m = shared.value
        voters = Voters(m.lexicon, m.patterns)
        for batch in batches:
            stay = [s < reject for s in _scores(m, batch.column(place).to_pylist(), voters)]
            yield batch.filter(pa.array(stay, pa.bool_()))

    return filtered(docs, run)

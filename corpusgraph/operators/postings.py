"""Full-text index tables and BM25 ranking over a table of questions.

BM25 after Robertson and Zaragoza (2009), k1 = 1.2, b = 0.75.  Ranking works on a
whole table of questions: question terms meet the postings once, however many
questions there are.  Bounds of each term's contribution (Turtle and Flood, 1995) leave
documents out that match frequent words alone.  The per-question top-k is a ``row_number``
filter, which Spark pushes below the shuffle, so no pair of question and document moves
unless it is among the best of its part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import text as tx
from ..functions.porter import porter_stem
from ..session import cut

K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6
SCORE_DECIMALS = 6
# Sums that differ by less may round to one score, where the id decides.
ROUNDING = 1e-6
# Levels of impact per unit; a power of two, so that edges are exact.
LEVELS = 32
# Question terms whose weights all tasks hold at once.
BLOCK_TERMS = 200_000


@F.pandas_udf(T.StringType())
def _stem(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        codes, uniques = pd.factorize(s)
        stems = pd.Series([porter_stem(u) for u in uniques], dtype=object)
        yield stems.take(codes).reset_index(drop=True)


def build_postings(docs: DataFrame, analyzer: str = "plain") -> DataFrame:
    """``docs(doc_id, title, body)`` to ``postings(doc_id, term, tf, tf_title, dl)``.

    ``analyzer`` is ``plain`` (folded words) or ``porter`` (folded and stemmed).
    Documents are dealt by id before they are cut into words: texts are smaller than their postings, and
    counting then needs no exchange; only counts by stem need one.
    """
    both = docs.select("doc_id", "title", "body").repartition("doc_id").select(
        "doc_id",
        tx.tokens(F.coalesce("title", F.lit(""))).alias("t"),
        tx.tokens(F.coalesce("body", F.lit(""))).alias("b"),
    ).select("doc_id", F.size("t").alias("nt"), (F.size("t") + F.size("b")).alias("dl"), F.concat("t", "b").alias("all"))
    # the outer form keeps the optimizer from adding a size filter that tokenises again
    flat = both.select("doc_id", "nt", "dl", F.posexplode_outer("all").alias("pos", "term")).where("term is not null")
    counted = flat.groupBy("doc_id", "term").agg(
        F.count(F.lit(1)).alias("tf"),
        F.sum((F.col("pos") < F.col("nt")).cast("long")).alias("tf_title"),
        F.first("dl").alias("dl"),
    )
    if analyzer == "plain":
        return counted
    if analyzer != "porter":
        raise ValueError(f"unknown analyzer {analyzer!r}")
    # Stemming runs on the counted pairs, once per distinct word and batch; the
    # stems are memoised in the worker, so no join on a frequent word is needed.
    return (
        counted.withColumn("term", _stem("term"))
        .groupBy("doc_id", "term")
        .agg(F.sum("tf").alias("tf"), F.sum("tf_title").alias("tf_title"), F.first("dl").alias("dl"))
    )


def term_stats(postings: DataFrame) -> DataFrame:
    """Document frequency per term."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: number of documents and mean length, empty documents included."""
    words = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n")).scalar()
    n = F.count(F.lit(1))
    return docs.agg(n.alias("n_docs")).select("n_docs", (words / F.greatest("n_docs", F.lit(1))).alias("avgdl"))


def query_terms(questions: DataFrame, analyzer: str = "plain", mode: str = "ascii") -> DataFrame:
    """``questions(question_id, text)`` to ``(question_id, term, qtf)``.

    ``ascii`` cuts at every character outside ``[A-Za-z0-9_]``, so a non-ASCII
    letter splits a word; ``unicode`` uses the document analyzer instead.
    A repeated word counts as often as it is written.
    """
    if mode == "ascii":
        runs = F.regexp_extract_all("text", F.lit(tx.QUERY_TERM_PATTERN), F.lit(0))
        # an underscore is a separator to the document analyzer
        runs = F.flatten(F.transform(runs, lambda r: tx.tokens(r)))
    else:
        runs = tx.tokens(F.col("text"))
    out = questions.select("question_id", F.explode_outer(runs).alias("term")).where("term is not null")
    if analyzer == "porter":
        out = out.withColumn("term", _stem("term"))
    return out.groupBy("question_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(IDF_FLOOR))


def impact(stats: DataFrame) -> Column:
    """What a posting adds to a score per unit of its term's weight: grows with ``tf``, shrinks with length."""
    tf = F.col("tf").cast("double")
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / stats.select("avgdl").scalar()))


def term_bounds(postings: DataFrame, k: int) -> DataFrame:
    """``(term, df, most, kth)`` of ``postings(term, impact)``: largest impact, and one that ``k`` postings reach (null below ``k``).

    Impacts are counted by level before anything moves; the lower edge of a level is the bound.
    """
    levels = postings.groupBy("term", F.floor(F.col("impact") * LEVELS).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.max("impact").alias("most"))
    higher = Window.partitionBy("term").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    reached = F.when(F.col("so_far") >= k, F.col("level") / LEVELS)
    return levels.withColumn("so_far", F.sum("n").over(higher)).groupBy("term").agg(F.sum("n").alias("df"), F.max("most").alias("most"), F.max(reached).alias("kth"))


def term_weights(terms: DataFrame, bounds: DataFrame, n_docs: Column) -> DataFrame:
    """Weights of question terms, and which of them a document must hold to rank.

    ``k`` documents score at least ``floor``: the best product of a term's weight and its
    impact that ``k`` postings reach.  Terms are taken from the least possible contribution on; while even
    all of them together stay below the floor they are not ``essential``, and a document
    that matches nothing else is out.  ``rest`` is the most that those terms can add.
    """
    w = F.col("qtf") * idf(n_docs, F.col("df"))
    by_question = Window.partitionBy("question_id")
    rising = by_question.orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    essential = F.coalesce(F.col("so_far") + ROUNDING >= F.col("floor"), F.lit(True))
    return (
        terms.join(bounds, "term")
        .select("question_id", "term", w.alias("w"), (w * F.col("most")).alias("bound"), (w * F.col("kth")).alias("held"))
        .withColumn("floor", F.max("held").over(by_question))
        .withColumn("so_far", F.sum("bound").over(rising))
        .withColumn("essential", essential)
        .withColumn("rest", F.coalesce(F.sum(F.when(~F.col("essential"), F.col("bound"))).over(by_question), F.lit(0.0)))
        .select("question_id", "term", "w", "floor", "essential", "rest")
    )


def top_k(scores: DataFrame, k: int, by: str = "score", key: str = "question_id", tie: str = "doc_id") -> DataFrame:
    """Best ``k`` rows per key, ties by ``tie`` ascending, with their rank from 1."""
    w = Window.partitionBy(key).orderBy(F.desc(by), F.asc(tie))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25(
    questions: DataFrame,
    postings: DataFrame,
    stats: DataFrame,
    k: int = 20,
    analyzer: str = "plain",
    mode: str = "ascii",
) -> DataFrame:
    """``(question_id, doc_id, score, rank)``; a question without terms has no rows.

    Postings of wanted terms are dealt by document once, however many questions there
    are; scores are summed, and the best ``k`` of each part found, where the postings lie.  Only
    documents with an essential term are scored, and of those only the ones that could
    still reach the floor meet the other terms.  Weights of at most ``BLOCK_TERMS`` question
    terms are shipped to all tasks at a time.
    """
    terms = cut(query_terms(questions, analyzer, mode))
    wanted = terms.select("term").distinct()
    matching = postings.join(wanted, "term", "left_semi").select("doc_id", "term", impact(stats).alias("impact"))
    dealt = matching.repartition("doc_id")
    weights = cut(term_weights(terms, term_bounds(matching, k), stats.select("n_docs").scalar()))
    return best_documents(dealt, weights, k)


def best_documents(dealt: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """``(question_id, doc_id, score, rank)`` of ``dealt(doc_id, term, impact)``, dealt by document, under :func:`term_weights`."""
    blocks = -(-weights.count() // BLOCK_TERMS) or 1
    tops = [_block_top(dealt, weights.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == i), k) for i in range(blocks)]
    return reduce(DataFrame.unionByName, tops)


def _block_top(dealt: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    key = ["question_id", "doc_id"]
    must = F.broadcast(weights.where("essential").drop("essential"))
    may = F.broadcast(weights.where(~F.col("essential")).select("question_id", "term", "w"))
    part = F.sum(F.col("w") * F.col("impact")).alias("part")
    seen = dealt.join(must, "term").groupBy(*key).agg(part, F.first("rest").alias("rest"), F.first("floor").alias("floor"))
    open_ = seen.where(F.coalesce(F.col("part") + F.col("rest") + ROUNDING >= F.col("floor"), F.lit(True))).select(*key, "part")
    more = open_.select(*key).join(dealt, "doc_id").join(may, ["question_id", "term"]).select(*key, (F.col("w") * F.col("impact")).alias("part"))
    scores = open_.unionByName(more).groupBy(*key).agg(F.round(F.sum("part"), SCORE_DECIMALS).alias("score"))
    return top_k(scores, k)


SNIPPET_TOKENS = 12
SNIPPET_FALLBACK = 160


def fallback_snippet(body: Column, width: int = SNIPPET_FALLBACK) -> Column:
    """First characters of the stripped body, with dots when cut."""
    b = tx.strip(body)
    return F.concat(F.substring(b, 1, width), F.when(F.length(b) > width, F.lit("...")).otherwise(F.lit("")))


def snippets(hits: DataFrame, docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Mark the matched words inside the densest window of about twelve words.

    ``hits(question_id, doc_id, …)`` are already top-k rows, so only those bodies
    are scanned; the word window is evaluated inside the row.
    """
    wanted = terms.groupBy("question_id").agg(F.collect_set("term").alias("terms"))
    body = F.coalesce("body", F.lit(""))
    piece = r"[\p{L}\p{N}]+[^\p{L}\p{N}]*"
    df = (
        hits.join(docs.select("doc_id", "body"), "doc_id")
        .join(wanted, "question_id", "left")
        .withColumn("pieces", F.regexp_extract_all(body, F.lit(piece), F.lit(0)))
        .withColumn(
            "flags",
            F.transform(
                "pieces",
                lambda p: F.coalesce(
                    F.array_contains("terms", tx.fold(F.regexp_extract(p, tx.WORD_PATTERN, 0))), F.lit(False)
                ).cast("int"),
            ),
        )
        .withColumn("n", F.size("pieces"))
    )
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - SNIPPET_TOKENS, F.lit(0)))
    scored = F.transform(
        starts,
        lambda i: F.struct(
            F.aggregate(F.slice("flags", i + 1, SNIPPET_TOKENS), F.lit(0), lambda a, x: a + x).alias("hits"),
            (-i).alias("neg"),
        ),
    )
    df = df.withColumn("best", F.array_max(scored)).withColumn("start", -F.col("best.neg"))
    window = F.arrays_zip(
        F.slice("pieces", F.col("start") + 1, SNIPPET_TOKENS).alias("p"),
        F.slice("flags", F.col("start") + 1, SNIPPET_TOKENS).alias("f"),
    )
    marked = F.array_join(
        F.transform(
            window,
            lambda z: F.when(
                z["f"] == 1, F.regexp_replace(z["p"], r"^([\p{L}\p{N}]+)", "<mark>$1</mark>")
            ).otherwise(z["p"]),
        ),
        "",
    )
    full = F.concat(
        F.when(F.col("start") > 0, F.lit("...")).otherwise(F.lit("")),
        F.regexp_replace(marked, r"(?U)\s+$", ""),
        F.when(F.col("start") + SNIPPET_TOKENS < F.col("n"), F.lit("...")).otherwise(F.lit("")),
    )
    has_match = (F.col("n") > 0) & (F.col("best.hits") > 0)
    return df.withColumn(
        "snippet", F.when(has_match, full).otherwise(fallback_snippet(body))
    ).select(*hits.columns, "snippet")

"""Registered queries of this subpackage, their SQL counterparts, and the pipeline's query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, bpe, classlm, conversations, decontam, fingerprints, jaccard, licenses, linedup, repetition, secrets, shards, toxicity
from .words import crc_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@_query
def op7_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.digest(secrets.secret_report(_table(spark, sf, "documents")))


@_query
def op9_shards(spark: SparkSession, sf: str) -> DataFrame:
    placed = shards.ring_shards(_table(spark, sf, "documents"), shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard"
    )


@_query
def op10_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.jaccard_groups(_table(spark, sf, "documents"), k=4, percent=85)


ORACLES["op10_jaccard"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
), r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.y) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.x = w.doc_id GROUP BY w.doc_id, n.n
"""


@_query
def op6_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = decontam.contaminated(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return found.select("doc_id", F.size("item_ids").cast("long").alias("n_items"), "item_ids", "similarity", (F.size("item_ids") > 0).alias("contaminated"))


@_query
def op8_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.neighbour_report(_table(spark, sf, "documents"))


@_query
def op1_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.licenses(_table(spark, sf, "documents"))


def vocabulary() -> str:
    """The vocabulary file of the byte-level BPE queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query
def op2_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf, "documents"), vocabulary())


def _learnable():
    return crc_of(F.col("doc_id")) % 4 != 2


@_query
def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = _table(spark, sf, "documents"), _table(spark, sf, "labels")
    model = toxicity.train(docs, labels, _learnable())
    return toxicity.scored(docs, model).select(
        "doc_id", (~_learnable()).alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted")
    )


@_query
def op3_classlm(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    held_out = crc_of(F.col("doc_id")) % 10 == 0
    model, told = classlm.fit_and_score(docs, ~held_out)
    return told.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


@_query
def op5_lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = linedup.hashed_text(_table(spark, sf, "documents").select("doc_id", "text"))
    told = linedup.line_classes(docs, least=1, share=linedup.WORD_SHARE)
    return told.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: ~x["first"])).cast("long").alias("n_repeated"),
        F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + x["n_links"]).alias("n_links"),
        F.transform("lines", lambda x: x["first_doc"]).alias("first_docs"),
    )


@_query
def op11_conversations(spark: SparkSession, sf: str) -> DataFrame:
    report = conversations.repair_report(conversations.damaged(_table(spark, sf, "conversations")), copies="copies")
    return report.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _cheapest(options: list[tuple[str, int, str, str]]) -> str:
    """SQL of the least key of some ways on: (condition, cost, letters, key of the rest)."""
    # a key is nine digits of cost and the audit, so keys compare as texts
    one = "CASE WHEN {} THEN lpad(CAST(CAST({}[1:9] AS BIGINT) + {} AS VARCHAR), 9, '0') || '{}' || {}[10:] END"
    return f"least({', '.join(one.format(when, rest, cost, letters, rest) for when, cost, letters, rest in options)})"


def _repair_steps() -> tuple[str, str]:
    """SQL columns of the best ways on from each state through a row, and with messages inserted before it."""
    need, fine = {"0": "u", "1": "u", "2": "a", "3": "u"}, "f IN ('', 't')"
    through, before = [], []
    for state, want in need.items():
        options = [("true", 4, "D", f"k{state}")]
        for extra, mark in ((0, ""), (3, "t")):
            to = "3" if want == "a" else "2"
            options += [(f"f = '{mark}' AND role[1:1] = '{want}'", extra, "K", f"k{to}"), (f"f = '{mark}'", 3 + extra, "R", f"k{to}")]
            if state == "0":
                options.append((f"f = '{mark}' AND role[1:1] = 's'", extra, "K", "k1"))
        through.append(f"{_cheapest(options)} AS e{state}")
        once, twice = ("3", "2") if want == "a" else ("2", "3")
        before.append(f"{_cheapest([('true', 0, '', f'e{state}'), ('true', 3, 'I', f'e{once}'), ('true', 6, 'II', f'e{twice}')])} AS k{state}")
    return ", ".join(through), ", ".join(before)


_THROUGH, _BEFORE = _repair_steps()
ORACLES["op11_conversations"] = rf"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations
), c AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 20 AS kind FROM d
), m AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM c, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS u(copy)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS l FROM m
), r AS (
  SELECT *, lead(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS after,
    CASE WHEN l = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN l NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f FROM o
), s AS (
  SELECT conv_id, n AS i, '000000000' AS k0, '000000006II' AS k1, '000000003I' AS k2, '000000000' AS k3 FROM r WHERE i = 1
  UNION ALL
  SELECT conv_id, i - 1, {_BEFORE} FROM (SELECT s.conv_id, s.i, {_THROUGH} FROM s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i) AS e
), a AS (SELECT conv_id, CAST(k0[1:9] AS BIGINT) AS cost, k0[10:] AS audit FROM s WHERE i = 0),
t AS (
  SELECT conv_id, p, audit[p:p] AS edit, length(replace(audit[1:p], 'I', '')) AS i, length(replace(audit[1:p], 'D', '')) AS place
  FROM a, unnest(range(1, length(audit) + 1)) AS u(p)
), w AS (
  SELECT t.*, r.role, r.text, max(CASE WHEN edit = 'K' AND place = 1 AND r.role[1:1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY t.conv_id) AS shift
  FROM t LEFT JOIN r ON edit <> 'I' AND r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.i = t.i
), h AS (
  SELECT conv_id, string_agg(CASE edit WHEN 'K' THEN role ELSE CASE (place - shift) % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END
    || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS said
  FROM w WHERE edit <> 'D' GROUP BY conv_id
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
    count(*) FILTER (f = 't') AS truncated, count(*) FILTER (after IS NOT NULL AND concat(role[1:1], after) NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id
)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM q.conv_id
  LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM q.conv_id
"""


@_query
def op12_repetition(spark: SparkSession, sf: str) -> DataFrame:
    told = repetition.repetition(_table(spark, sf, "documents"))
    return told.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words",
        (F.col("longest_repeat") > repetition.MOST_LONGEST).alias("long_repeat"),
    )


def _windows(n: int) -> str:
    """SQL of the words of each document that lie in windows of ``n`` words found twice in it."""
    return f"""SELECT doc_id, count(DISTINCT p) AS n FROM (
      SELECT doc_id, unnest(range(i, i + {n})) AS p FROM (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS times FROM (
          SELECT doc_id, i, array_to_string(words[i:i + {n - 1}], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - {n - 2})) AS i FROM w WHERE len(words) >= {n})))
      WHERE times > 1) GROUP BY doc_id"""


# a repeat of n words or more covers just the repeated windows of n words
ORACLES["op12_repetition"] = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), r AS ({_windows(repetition.WINDOW_WORDS)}), c AS ({_windows(repetition.REPEAT_WORDS)}), l AS ({_windows(repetition.MOST_LONGEST + 1)}),
d AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), t AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(d.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    coalesce(c.n, 0) AS covered_words, l.n IS NOT NULL AS long_repeat
  FROM w LEFT JOIN d USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)
), f AS (SELECT *, n_words < {repetition.LEAST_WORDS} OR 100 * n_repeat_words > {repetition.MOST_REPEATED_PERCENT} * n_words AS base_failed FROM t)
SELECT *, NOT base_failed AND 100 * covered_words <= {repetition.MOST_COVERED_PERCENT} * n_words AND NOT long_repeat AS kept FROM f
"""


def pieces() -> str:
    """The model file of the piece tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@_query
def op13_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.alignment(_table(spark, sf, "documents"), vocabulary(), pieces())

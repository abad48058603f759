"""Substring search by grams, and reports ranked by it, against plain loops."""

import random

from corpusgraph.operators.substrings import holders
from corpusgraph.plans import answer as an


def test_holders_match_plain_search(spark):
    rng = random.Random(5)
    letters = "abcé𝒳 界"
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(60)))) for i in range(150)]
    texts += [(900, ""), (901, None), (902, "ab" * 20_000 + "zebra"), (903, "a"), (904, "𝒳é")]
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(120)} | {"zebra", "𝒳é", "nowhere", "a", "", "éé"}
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = [tuple(r) for r in holders(spark.createDataFrame([(w,) for w in words] * 2, "term string"), docs).collect()]
    want = {(i, w) for i, t in texts for w in words if t is not None and w and w in t}
    assert len(got) == len(want) and set(got) == want
    assert holders(spark.createDataFrame([], "term string"), docs).count() == 0
    assert holders(spark.createDataFrame([("a",)], "term string"), docs.limit(0)).count() == 0


def test_lexical_reports_match_plain_ranking(spark):
    rng = random.Random(6)
    pool = ["solar", "sol", "ring", "string", "of", "a", "Überblick", "trade", "zone", "x9"]
    reports = [(i % 3, i, " ".join(rng.sample(pool, rng.randrange(1, 4))), " ".join(rng.choice(pool) for _ in range(rng.randrange(6))) or None) for i in range(60)]
    asked = [(q, " ".join(rng.choice([*pool, "nothing", "RING"]) for _ in range(rng.randrange(7)))) for q in range(40)]
    table = spark.createDataFrame(reports, "level int, cluster long, title string, summary string")
    questions = spark.createDataFrame(asked, "question_id long, text string")
    ranked = an.top_reports(questions, an.Graph(*[None] * 7)._replace(reports=table), 4)
    got = {(r["question_id"], r["rank"]): (r["level"], r["cluster"]) for r in ranked.collect()}
    want = {}
    for q, text in asked:
        words = set(text.lower().split())
        order = sorted((-sum(w in f"{t} {s or ''}".lower() for w in words), level, cluster) for level, cluster, t, s in reports)
        want.update({(q, n + 1): order[n][1:] for n in range(4)})
    assert got == want
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


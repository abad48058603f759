import math
import random

from pyspark.sql import functions as F

from corpusgraph.operators import centrality as ce, communities as cm, components as co, edges as ed, traverse as tv, views as vw

REL = "source_id bigint, target_id bigint, type string, description string, weight double"


def rel(spark, *rows):
    return spark.createDataFrame([(a, b, "related", "", float(w)) for a, b, w in rows], REL)


def ids(spark, *n):
    return spark.createDataFrame([(i,) for i in n], "entity_id bigint")


def seeds(spark, *rows):
    return spark.createDataFrame([(1, e, float(v)) for e, v in rows], "question_id bigint, entity_id bigint, value double")


def test_k_hop_on_a_chain(spark):
    r, e = rel(spark, (1, 2, 1), (2, 3, 1), (3, 4, 1)), ids(spark, 1, 2, 3, 4)
    for hops, want in ((0, {1}), (1, {1, 2}), (2, {1, 2, 3}), (3, {1, 2, 3, 4}), (10, {1, 2, 3, 4})):
        got = tv.k_hop(r, e, seeds(spark, (1, 1), (77, 1)), hops).collect()
        assert {x["entity_id"] for x in got} == want
        assert all(x["hop"] == x["entity_id"] - 1 for x in got)


def test_activation_ranks_the_connected_answer_over_a_distractor(spark):
    r = rel(spark, (1, 2, 10), (2, 3, 10))
    got = {x["entity_id"]: x["activation"] for x in tv.spread(r, seeds(spark, (9, 0.05), (1, 1.0)), 0.9, 0.01).collect()}
    assert got[3] > got[9]


def test_activation_stops_below_the_threshold(spark):
    r = rel(spark, (1, 2, 1), (2, 3, 1))
    got = {x["entity_id"] for x in tv.spread(r, seeds(spark, (1, 1.0)), 0.1, 0.05).collect()}
    assert got == {1, 2}


def test_activation_equals_walking_all_paths(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(12), rng.randrange(12), rng.randrange(1, 9)) for _ in range(25)]
    top, decay, threshold, hops = max(w for *_, w in edges), 0.8, 0.05, 4
    best = {}
    todo = [(0, 1.0, 0), (5, 0.4, 0)]
    while todo:
        node, value, hop = todo.pop()
        best[node] = max(best.get(node, 0), value)
        if hop < hops:
            for a, b, w in edges:
                if node in (a, b):
                    v = value * decay * (w / top)
                    if v >= threshold:
                        todo.append((b if node == a else a, v, hop + 1))
    got = tv.spread(rel(spark, *edges), seeds(spark, (0, 1.0), (5, 0.4)), decay, threshold, hops).collect()
    assert {x["entity_id"]: round(x["activation"], 6) for x in got} == {k: round(v, 6) for k, v in best.items() if v >= threshold}


def test_undirected_edges_sum_types_and_directions(spark):
    r = spark.createDataFrame(
        [(1, 2, "related", "", 3.0), (1, 2, "mentions", "", 2.0), (2, 1, "cites", "", 1.0), (1, 1, "related", "", 5.0)], REL
    )
    assert [tuple(x) for x in ed.undirected_edges(r).collect()] == [(1, 2, 6.0)]


def test_hub_salting_gives_the_same_sums(spark):
    e = spark.createDataFrame([(0, i, 1.0) for i in range(1, 60)], "a bigint, b bigint, weight double")
    values = spark.createDataFrame([(i, float(i)) for i in range(60)], "node bigint, x double")
    sums = []
    for hub_rows in (1000, 7):
        adj = ed.Adjacency(ed.symmetric(e), hub_rows=hub_rows)
        assert adj.salted == (hub_rows == 7)
        rows = adj.meet(values).groupBy("dst").agg(F.sum("x").alias("x"), F.count("*").alias("n")).collect()
        sums.append(sorted(tuple(r) for r in rows))
        adj.release()
    assert sums[0] == sums[1]


def test_two_planted_clusters_come_apart(spark):
    e = spark.createDataFrame(
        [(1, 2, 8.0), (2, 3, 8.0), (1, 3, 8.0), (4, 5, 8.0), (5, 6, 8.0), (4, 6, 8.0), (3, 4, 0.1)], "a bigint, b bigint, weight double"
    )
    rows = cm.communities(e, ids(spark, 1, 2, 3, 4, 5, 6, 7)).collect()
    top = {r["entity_id"]: r["cluster"] for r in rows if r["level"] == 0}
    assert len(top) == 7
    assert top[1] == top[2] == top[3] and top[4] == top[5] == top[6]
    assert len({top[1], top[4], top[7]}) == 3


def test_communities_invariants(spark):
    rng = random.Random(5)
    pairs = set()
    for block in range(4):
        for _ in range(240):
            a, b = rng.randrange(60) + 100 * block, rng.randrange(60) + 100 * block
            if a != b:
                pairs.add((min(a, b), max(a, b)))
    for _ in range(12):
        a, b = rng.randrange(4) * 100 + rng.randrange(60), rng.randrange(4) * 100 + rng.randrange(60)
        if a != b:
            pairs.add((min(a, b), max(a, b)))
    e = spark.createDataFrame([(a, b, 1.0) for a, b in sorted(pairs)], "a bigint, b bigint, weight double")
    nodes = sorted({x for p in pairs for x in p})
    first = sorted(tuple(r) for r in cm.communities(e, ids(spark, *nodes), 25).collect())
    again = sorted(tuple(r) for r in cm.communities(e.repartition(5), ids(spark, *nodes), 25).collect())
    key = lambda rows: sorted((r[0], r[1], -1 if r[2] is None else r[2], r[3]) for r in rows)
    assert key(first) == key(again)
    level0 = [r for r in first if r[0] == 0]
    assert sorted(r[3] for r in level0) == nodes
    cluster_of = {(r[0], r[3]): r[1] for r in first}
    for level, _, parent, node in first:
        if level:
            assert parent == cluster_of[(level - 1, node)]
    members = {}
    for r in first:
        members.setdefault((r[0], r[1]), set()).add(r[3])
    for group in members.values():
        seen, todo = set(), [min(group)]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [b if n == a else a for a, b in pairs if n in (a, b) and a in group and b in group]
        assert seen == group


def test_star_centrality_has_the_closed_form(spark):
    n = 400
    e = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("weight"))
    c = ce.eigenvector(e, ids(spark, *range(n + 1), 9999), tolerance=1e-8)
    got = {r["entity_id"]: r["score"] for r in c.scores.collect()}
    assert c.converged and got[0] == 1.0 and got[9999] == 0.0
    assert abs(got[1] - 1 / math.sqrt(n)) < 1e-4


def test_triangle_is_equal_and_cap_is_reported(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (3, 50, 1.0)], "a bigint, b bigint, weight double")
    got = {r["entity_id"]: r["score"] for r in ce.eigenvector(e, ids(spark, 1, 2, 3)).scores.collect()}
    assert all(abs(v - 1) < 1e-6 for v in got.values())
    path = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "a bigint, b bigint, weight double")
    assert not ce.eigenvector(path, ids(spark, 1, 2, 3), max_iterations=2).converged


def test_plans_stay_short_on_many_tasks(spark, monkeypatch):
    """Tasks report on every step before theirs in a plan: with many tasks each step is a plan of its own, with the same scores."""
    e = spark.createDataFrame([(i, (i * 7 + 3) % 40 + 40, float(i % 5 + 1)) for i in range(40)] + [(1, 2, 3.0), (2, 5, 1.0)], "a bigint, b bigint, weight double")
    plans = []
    written = ce.cut
    monkeypatch.setattr(ce, "cut", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString().count("Join Inner")) or written(df))
    scores = []
    for rows in (ce.TASK_ROWS, 5):
        plans.clear()
        monkeypatch.setattr(ce, "TASK_ROWS", rows)
        c = ce.eigenvector(e, ids(spark, *range(80)), max_iterations=7, steps_per_plan=5)
        scores.append({r["entity_id"]: r["score"] for r in c.scores.collect()})
        assert max(plans) == (5 if rows > 5 else 1) and sum(plans) == 7
    assert all(abs(v - scores[1][k]) < 1e-12 for k, v in scores[0].items())


def test_no_edges_scores_zero(spark):
    e = spark.createDataFrame([], "a bigint, b bigint, weight double")
    c = ce.eigenvector(e, ids(spark, 1, 2))
    assert c.converged and {r["score"] for r in c.scores.collect()} == {0.0}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(80) if i != 40], "source string, target string")
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(82)], "id string")
    got = {r["id"]: r["root"] for r in co.components(nodes, edges).collect()}
    assert {got[f"n{i:03d}"] for i in range(41)} == {"n000"}
    assert {got[f"n{i:03d}"] for i in range(41, 81)} == {"n041"}
    assert got["n081"] == "n081"


def test_global_row_number_is_dense_and_ordered(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(10**6)).alias("v"), "id").repartition(7)
    rows = sorted(ed.global_row_number(df, "v", "id").collect(), key=lambda r: r["row"])
    assert [r["row"] for r in rows] == list(range(1, 1001))
    assert [(r["v"], r["id"]) for r in rows] == sorted((r["v"], r["id"]) for r in rows)


def test_node_size_uses_own_degree_over_edge_counts(spark):
    nodes = spark.createDataFrame([("a", 9), ("b", None), ("c", None)], "id string, degree int")
    edges = spark.createDataFrame([("a", "b")], "source string, target string")
    got = {r["id"]: round(r["size"], 6) for r in vw.viz_nodes(nodes, edges).collect()}
    assert got == {"a": round(0.6 + 3 * 2.6, 6), "b": 3.2, "c": 0.6}


def test_identity_merges_only_proven_unique_titles(spark):
    node = "id string, label string, type string, kind string"
    pages = spark.createDataFrame(
        [("p1", "Ada", "entity", "page"), ("p2", "Twin", "entity", "page"), ("p3", "twin", "entity", "page"), ("p4", "Solo", "entity", "page"), ("p5", "Other", "entity", "page")], node
    )
    ents = spark.createDataFrame(
        [("entity:1", "ADA", "PERSON", "entity", 3, 7), ("entity:2", "TWIN", "PERSON", "entity", 1, 7), ("entity:4", "SOLO", "PERSON", "entity", 1, 8), ("entity:5", "OTHER", "PERSON", "entity", 1, 8)],
        node + ", degree int, community int",
    )
    pe = spark.createDataFrame([("p1", "p4"), ("p1", "p5")], "source string, target string")
    ee = spark.createDataFrame([("entity:1", "entity:4", "related", 2.0), ("entity:1", "entity:5", "related", 1.0)], "source string, target string, type string, weight double")
    hashes = spark.createDataFrame([("p1", "h1"), ("p2", "h2"), ("p4", "h4"), ("p5", "h9")], "id string, source_hash string")
    stems = spark.createDataFrame([("entity:1", "h1"), ("entity:2", "h2"), ("entity:4", "h4"), ("entity:5", "h5")], "id string, stem string")
    nodes, edges = vw.merge_identity(pages, pe, ents, ee, hashes, stems)
    twins = {r["id"]: r["entity_twin"] for r in nodes.collect()}
    assert twins["p1"] == "entity:1" and twins["p4"] == "entity:4"
    assert twins["p2"] is None and twins["p5"] is None
    assert {"entity:2", "entity:5"} <= set(twins) and "entity:1" not in twins
    assert {(r["source"], r["target"], r["type"]) for r in edges.collect()} == {("p1", "p4", "related"), ("p1", "entity:5", "related"), ("p1", "p5", None)}

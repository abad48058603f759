"""Plain versions of the operators that bound what moves: ranking, traversal, descriptions."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F, types as T

from corpusgraph.operators import merge as mg, postings as ps, privacy as pv, traverse as tv, vectors as vx
from corpusgraph.operators.edges import Cells


def ranked(docs, questions, k):
    """BM25 by its formula; rounded scores, ties by id."""
    words = {d: (t + " " + b).lower().split() for d, t, b in docs}
    n, avg = len(words), sum(map(len, words.values())) / max(len(words), 1)
    out = []
    for q, text in questions:
        terms = text.lower().split()
        scores = {}
        for t in terms:
            df = sum(t in w for w in words.values())
            weight = max(math.log((n - df + 0.5) / (df + 0.5)), ps.IDF_FLOOR) if df else 0
            for d, w in words.items():
                tf = w.count(t)
                if tf:
                    scores[d] = scores.get(d, 0.0) + weight * tf * (ps.K1 + 1) / (tf + ps.K1 * (1 - ps.B + ps.B * len(w) / avg))
        best = sorted(((-round(s, ps.SCORE_DECIMALS), d) for d, s in scores.items()))[:k]
        out += [(q, d, -s, i + 1) for i, (s, d) in enumerate(best)]
    return out


@pytest.mark.parametrize(("k", "block"), [(1, 200_000), (5, 200_000), (5, 7), (500, 200_000)])
def test_ranking_leaves_out_nothing(spark, monkeypatch, k, block):
    """Frequent and rare words, ties, repeated words, questions without any match, few documents for ``k``; many blocks."""
    monkeypatch.setattr(ps, "BLOCK_TERMS", block)
    rng = random.Random(k)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 200}"
    docs = [(i, word(), " ".join(word() for _ in range(rng.randrange(1, 40)))) for i in range(150)]
    questions = [(i, " ".join(word() for _ in range(rng.randrange(1, 9)))) for i in range(25)] + [(97, "w1 w1 w1"), (98, "absent"), (99, "")]
    df = spark.createDataFrame(docs, "doc_id long, title string, body string")
    postings = ps.build_postings(df)
    got = ps.bm25(spark.createDataFrame(questions, "question_id long, text string"), postings, ps.corpus_stats(df, postings), k)
    rows = sorted((r["question_id"], r["rank"], r["doc_id"], round(r["score"], 5)) for r in got.collect())
    assert rows == sorted((q, n, d, round(s, 5)) for q, d, s, n in ranked(docs, questions, k))


def test_frequent_words_alone_make_no_candidates(spark):
    """A word of every document is not essential beside a rare one."""
    docs = spark.createDataFrame([(i, "", "the " + ("rare " if i < 9 else "") + f"x{i}") for i in range(300)], "doc_id long, title string, body string")
    postings = ps.build_postings(docs)
    stats = ps.corpus_stats(docs, postings)
    matching = postings.select("doc_id", "term", ps.impact(stats).alias("impact"))
    terms = ps.query_terms(spark.createDataFrame([(1, "the rare"), (2, "the"), (3, "the x1")], "question_id long, text string"))
    told = ps.term_weights(terms, ps.term_bounds(matching, 5), stats.select("n_docs").scalar())
    essential = {(r["question_id"], r["term"]): r["essential"] for r in told.collect()}
    assert essential == {(1, "the"): False, (1, "rare"): True, (2, "the"): True, (3, "the"): True, (3, "x1"): True}


def test_pairs_do_not_move_before_the_best_are_cut(spark):
    """Scores are summed, and the best found, where the postings of a document lie."""
    docs = spark.createDataFrame([(i, "", f"a{i % 3} b{i}") for i in range(30)], "doc_id long, title string, body string")
    postings = ps.build_postings(docs)
    out = ps.bm25(spark.createDataFrame([(1, "a1 b2")], "question_id long, text string"), postings, ps.corpus_stats(docs, postings), 3)
    lines = out._jdf.queryExecution().executedPlan().toString().split("\n")
    cut_at = next(i for i, x in enumerate(lines) if "WindowGroupLimit" in x and "Partial" in x)
    moved = [x for x in lines[cut_at:] if " Exchange " in x]
    assert "hashpartitioning(doc_id" in moved[0] and "REPARTITION_BY_COL" in moved[0]
    assert [x.count("question_id") for x in lines[:cut_at] if " Exchange " in x] == [1] and "CartesianProduct" not in "".join(lines)


def graph(rng, n, m):
    return [(rng.randrange(n), rng.randrange(n), float(rng.randrange(1, 10))) for _ in range(m)]


def neighbours(edges):
    out = {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            out.setdefault(x, {})
            out[x][y] = max(w, out[x].get(y, 0.0))
    return out


def test_many_questions_walk_together(spark):
    """More questions than a bitmap or a row holds, some with unknown or repeated seeds."""
    rng = random.Random(6)
    edges, questions = graph(rng, 60, 90), 150
    seeds = [(q, rng.randrange(70), rng.choice([0.01, 0.4, 1.0])) for q in range(questions) for _ in range(rng.randrange(1, 4))]
    rel = spark.createDataFrame(edges, "source_id long, target_id long, weight double")
    ents = spark.range(60).withColumnRenamed("id", "entity_id")
    df = spark.createDataFrame(seeds, "question_id long, entity_id long, value double")
    near, top = neighbours(edges), max(w for _, _, w in edges)
    hops, active = set(), {}
    for q in range(questions):
        at = {e: 0 for x, e, _ in seeds if x == q and e < 60}
        for h in range(1, 4):
            for e in [e for e, v in at.items() if v == h - 1]:
                for x in near.get(e, {}):
                    at.setdefault(x, h)
        hops |= {(q, e, h) for e, h in at.items()}
        best = {}
        frontier = [(e, v) for x, e, v in seeds if x == q]
        for e, v in frontier:
            best[e] = max(best.get(e, 0.0), v)
        for _ in range(tv.MAX_HOPS):
            moved = [(x, v * tv.DECAY * (w / top)) for e, v in frontier for x, w in near.get(e, {}).items()]
            frontier = [(e, v) for e, v in moved if v >= tv.THRESHOLD]
            for e, v in frontier:
                best[e] = max(best.get(e, 0.0), v)
        active |= {(q, e): v for e, v in best.items() if v >= tv.THRESHOLD}
    assert {tuple(r) for r in tv.k_hop(rel, ents, df, 3).select("question_id", "entity_id", "hop").collect()} == hops
    got = {(r["question_id"], r["entity_id"]): r["activation"] for r in tv.spread(rel, df).collect()}
    assert got == pytest.approx(active, abs=1e-8)
    none = df.limit(0)
    assert tv.k_hop(rel, ents, none).count() == 0 and tv.spread(rel, none).count() == 0


def walked(edges, seeds):
    """Largest value per entity over all walks of ``MAX_HOPS`` edges."""
    near, top = neighbours(edges), max(w for *_, w in edges)
    best, frontier = {}, list(seeds)
    for _ in range(tv.MAX_HOPS + 1):
        for e, v in frontier:
            best[e] = max(best.get(e, 0.0), v)
        moved = [(x, v * tv.DECAY * (w / top)) for e, v in frontier for x, w in near.get(e, {}).items() if e]
        frontier = [(e, v) for e, v in moved if v >= tv.THRESHOLD]
    return {e: v for e, v in best.items() if v >= tv.THRESHOLD}


def test_values_meet_in_cells(spark, monkeypatch):
    """Text ids, loops, missing weights and ends, cells of five edges and slices of three give what walking gives."""
    monkeypatch.setattr(tv, "Cells", lambda edges: Cells(edges, cell_rows=5))
    monkeypatch.setattr(tv, "SLICE_EDGES", 3)
    rng = random.Random(12)
    edges = [(f"n{a}", f"n{b}", w) for a, b, w in graph(rng, 25, 50)] + [("n1", "n1", 9.0), (None, "n3", 9.0), ("n4", None, 9.0)]
    given = [*edges, ("n1", "n2", None), (None, None, 1.0)]
    rel = spark.createDataFrame(given, "source_id string, target_id string, weight double")
    seeds = [(q, f"n{rng.randrange(27)}", rng.choice([0.01, 0.06, 0.5, 1.0])) for q in range(20) for _ in range(2)]
    df = spark.createDataFrame(seeds, "question_id long, entity_id string, value double")
    got = {(r["question_id"], r["entity_id"]): r["activation"] for r in tv.spread(rel, df).collect()}
    want = {(q, e): v for q in range(20) for e, v in walked(edges, [(e, v) for x, e, v in seeds if x == q]).items()}
    assert any(e is None for _, e in want) and got == pytest.approx(want, abs=1e-8)
    assert tv.spread(rel, df).count() == len(want)


def test_edges_tell_a_node_once_per_cell(spark):
    """Edges lie where their end with few edges lives: that end is told once, a busy one once per cell, whatever its edges."""
    rng = random.Random(13)
    edges = [(hub, 100 + leaf, float(rng.randrange(40, 51))) for leaf in range(400) for hub in rng.sample(range(10), 5)]
    cells = Cells(spark.createDataFrame(edges, "a long, b long, weight double"), cell_rows=250)
    assert cells.n == 8 and cells.rows.count() == len(edges) and cells.rows.where("home < 100").count() == 0
    values = spark.createDataFrame([(e, 0, *[1.0] * tv.QUESTION_COLUMNS) for e in {x for a, b, _ in edges for x in (a, b)}],
                                   ", ".join(["entity_id long, block long", *[f"f{i} double" for i in range(tv.QUESTION_COLUMNS)]]))
    schema = T.StructType.fromDDL(", ".join(["entity_id long, block long", *[f"m{i} double" for i in range(tv.QUESTION_COLUMNS)]]))
    told = Counter(r["entity_id"] for r in cells.meet(values, tv._step(schema, 0.6, 0.05, 50.0), schema).collect())
    cells.release()
    assert all(told[100 + leaf] == 1 for leaf in range(400)) and max(told.values()) <= cells.n


def folded(texts):
    acc = ""
    for t in texts:
        if acc == "":
            acc = t
        elif t not in ("", acc):
            acc = f"{acc} {t}"
    return acc


def test_descriptions_of_hot_entities(spark):
    """A third of all mentions name one entity in alternating texts, among them some that equal what was gathered."""
    rng = random.Random(9)
    rows = []
    for i in range(1500):
        kind = rng.randrange(3)
        title = "HOT" if kind == 0 else f"T{rng.randrange(3 if kind == 1 else 300)}"
        text = rng.choice(["a", "b", "a b", "", None, "a b a", "long text"]) if kind else rng.choice(["a", "b"]) if i > 40 else rng.choice(["a", "a b", "b"])
        rows.append((title, "OTHER", text, f"p{i // 10:04d}", i % 10, 0))
    df = spark.createDataFrame(rows, "title string, type string, description string, page_path string, chunk_index int, ordinal int")
    want = {}
    for title, _, text, *_ in rows:
        want.setdefault(title, []).append(text or "")
    got = {r["title"]: r["description"] for r in mg.merge_entities(df.repartition(6)).collect()}
    assert got == {t: folded(x) for t, x in want.items()}


@pytest.mark.parametrize(
    ("pattern", "literal"),
    [
        (r"\bsk-[A-Za-z0-9]{20,}\b", "sk-"), (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "PRIVATE KEY-----"), (r"\bgh[pousr]_[a-z]+", "gh"), (r"[a-z]+", ""), (r"(?i)abc", ""),
        (r"a|b", ""), (r"x(?:abc)?yz", "yz"), (r"(ab)+cde", "cde"), (r"(abcd)+c", "abcd"), (r"a(b(c))d", "abcd"), (r"(?:foo|bar)qux", "qux"), (r"ab*cd", "cd"), (r"q(?=never)xyz", "xyz"),
        (r"x(?i:abcdef)yz", "yz"),
    ],
)
def test_literals_that_a_match_must_hold(pattern, literal):
    assert pv.required_literal(pattern) == literal


def test_twenty_thousand_patterns(spark, monkeypatch):
    """No refusal, all matches, and only patterns whose literal stands in a text are compiled."""
    monkeypatch.setattr(pv, "BLOCK_PATTERNS", 7000)
    table = [(f"K{i % 5}", rf"\bkey{i}-[a-z]+", 0.5) for i in range(20_000)] + [("ANY", r"\d{7}", 0.4), ("I", r"(?i)secret\w", 0.3)]
    patterns = spark.createDataFrame(table, "type string, pattern string, score double")
    texts = [(1, "has key17-abc and key19999-z, key17- and xkey5-a"), (2, "1234567 SECRETs"), (3, None), (4, ""), (5, "key17-q key17-r key1999-s")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((r["doc_id"], r["type"], r["start"], r["end"]) for r in pv.detect_spans(df, patterns).collect())
    hit = [(t, re.compile(p)) for t, p, _ in table if p in {rf"\bkey{i}-[a-z]+" for i in (1, 5, 7, 17, 19, 199, 1999, 19999)} or t in ("ANY", "I")]
    assert got == sorted((d, t, m.start(), m.end()) for d, x in texts for t, p in hit for m in p.finditer(x or ""))
    counts = {r["type"]: r["n"] for r in pv.count_spans(df, patterns).collect()}
    assert counts == {"K2": 3, "K4": 2, "K0": 0, "K1": 0, "K3": 0, "ANY": 1, "I": 1}
    known = pv.PatternSet(table)
    known.spans(texts[0][1])
    assert len(known.compiled) <= 2 + 2 * len(re.findall(r"key\d+", texts[0][1])) + 8


def test_windows_of_a_long_text(spark):
    """Ten million characters: every window's place is the sum of those before it."""
    text = ("word " * 399 + "last\n") * 5000
    df = spark.createDataFrame([(1, text), (2, ""), (3, "short")], "doc_id long, text string")
    rows = sorted((r["doc_id"], r["offset"], r["chunk"]) for r in pv.window_text(df).collect())
    at = 0
    for doc, offset, chunk in rows:
        if doc == 1:
            assert offset == at and text[at : at + len(chunk)] == chunk
            at += len(chunk)
    assert at == len(text) and rows[-1] == (3, 0, "short")


def test_units_of_a_hub(spark):
    """Every question names a hub with thousands of units; each gets the first of all its entities'."""
    rng = random.Random(12)
    links = [(u, 1) for u in range(3000)] + [(rng.randrange(3000), e) for e in range(2, 40) for _ in range(30)]
    units = [(u, f"p{rng.randrange(50):02d}", u, f"t{u}") for u in range(3000)]
    wanted = [(q, e) for q in range(20) for e in (1, rng.randrange(2, 40), rng.randrange(2, 40))]
    got = mg.units_for_entities(
        spark.createDataFrame(wanted, "question_id long, entity_id long"), spark.createDataFrame(links, "text_unit_id long, entity_id long"),
        spark.createDataFrame(units, "text_unit_id long, page_path string, chunk_index int, text string"), 5,
    )
    place = {u: (p, c, u, t) for u, p, c, t in units}
    of = {}
    for u, e in links:
        of.setdefault(e, set()).add(u)
    for q in range(20):
        mine = sorted(place[u] for u in {u for x, e in wanted if x == q for u in of[e]})[:5]
        told = sorted((r["nth"], r["page_path"], r["chunk_index"], r["text_unit_id"], r["text"]) for r in got.where(F.col("question_id") == q).collect()) if q < 3 else None
        assert told is None or told == [(i + 1, *m) for i, m in enumerate(mine)]


def test_hash_embedding_moves_nothing(spark):
    """Every text becomes its vector where it lies, with the counts of ``hash_buckets``; repeated ids keep texts apart."""
    texts = [(i, " ".join(f"w{(i * j) % 17}Ä" for j in range(i % 40))) for i in range(1200)] + [(-1, None), (-2, ""), (-3, "a b\tA"), (-3, "c")]
    df = spark.createDataFrame(texts, "id long, text string")
    made = vx.hash_embed(df, "id", "text")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    counts = {}
    for r in vx.hash_buckets(df.where("id > -3"), "id", "text").collect():
        counts.setdefault(r["id"], [0] * vx.DIM)[r["bucket"]] = r["value"]
    rows = made.collect()
    assert len(rows) == len(texts) and len({tuple(r["vector"]) for r in rows if r["id"] == -3}) == 2
    for r in rows:
        if r["id"] > -3:
            want = counts.get(r["id"], [0] * vx.DIM)
            size = sum(x * x for x in want) ** 0.5
            assert r["vector"] == [x / size if size else 0.0 for x in want]


def test_prompts_are_made_once(spark):
    """A completer's misses and the answers read one table of prompts."""
    from corpusgraph.operators.completions import complete, with_cache_key

    made = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            made.add(len(b))
            yield b

    def answer(batches):
        for b in batches:
            yield b[["cache_key"]].assign(response="yes")

    prompts = with_cache_key(spark.range(7).selectExpr("id", "'s' AS system", "CAST(id AS STRING) AS user").mapInPandas(told, "id long, system string, user string"))
    done = complete(prompts, spark.createDataFrame([], "cache_key string, response string"), answer)
    assert sorted((r["id"], r["response"]) for r in done.answered.collect()) == [(i, "yes") for i in range(7)]
    assert made.value == 7


def test_first_rows_of_many_keys(spark):
    """More keys than a bitmap has places, rows that several entities share: each key gets its own first rows once, and shared ones move once."""
    rng = random.Random(5)
    own = [(e, r, f"d{r}") for e in range(30) for r in rng.sample(range(200), 12)]
    named = [(q, e) for q in range(150) for e in rng.sample(range(30), 4)]
    got = mg.first_named(
        spark.createDataFrame(named, "question_id long, entity_id long"), spark.createDataFrame(own, "entity_id long, row_id long, text string"), ("row_id",), 7
    ).collect()
    told = {}
    for r in got:
        told.setdefault(r["question_id"], []).append((r["nth"], r["row_id"], r["text"]))
    for q in range(150):
        mine = sorted({(r, t) for x, e in named if x == q for y, r, t in own if y == e})[:7]
        assert sorted(told[q]) == [(i + 1, *m) for i, m in enumerate(mine)]


def test_parts_of_report_prompts_match_sql(spark):
    """Communities of several parts: SQL and prompts deal every line to the same one."""
    from compare import bag, connect
    from corpusgraph.plans import check_graph as cg
    from corpusgraph.plans.catalog import with_views

    sf = "/root/testdata/sf0.001"
    got = cg._report_prompts(spark, sf, 40).select("level", "cluster", "part", F.col("user").alias("usr"))
    want = connect(sf).execute(with_views("rel_v", "entities_v", **cg.report_ctes(40)) + "SELECT level, cluster, part, usr FROM rprompts")
    rows = [tuple(r) for r in got.collect()]
    assert max(r[2] for r in rows) > 0
    assert bag(got.columns, rows) == bag([d[0] for d in want.description], want.fetchall())


def _modularity(edges, comm):
    m = sum(w for _, _, w in edges)
    inside = sum(w for a, b, w in edges if comm[a] == comm[b])
    strength = {}
    for a, b, w in edges:
        strength[comm[a]] = strength.get(comm[a], 0.0) + w
        strength[comm[b]] = strength.get(comm[b], 0.0) + w
    return inside / m - sum(k * k for k in strength.values()) / (4 * m * m)


def test_local_moving_rests_after_few_rounds(spark, monkeypatch):
    """A graph of one task rests in one round; several tasks and split hubs end within a bounded loss."""
    import random

    from corpusgraph.operators import communities as cm
    from corpusgraph.operators.edges import Adjacency

    draw = random.Random(5)
    ends = [(a, a % 10 + 10 * draw.randrange(12)) for a in range(120) for _ in range(4)] + [(draw.randrange(120), draw.randrange(120)) for _ in range(30)]
    edges = sorted((a, b, 1.0) for a, b in {(min(p), max(p)) for p in ends if p[0] != p[1]} | {(0, i) for i in range(1, 25)})
    strength = {i: 0.0 for i in range(120)}
    for a, b, w in edges:
        strength[a] += w
        strength[b] += w
    frame = spark.createDataFrame(edges, "a long, b long, weight double")
    nodes = spark.createDataFrame([(i, k, sum(strength.values())) for i, k in strength.items()], "node long, k double, m2 double")
    written, plain = [], cm.cut
    monkeypatch.setattr(cm, "cut", lambda df: written.append(1) or plain(df))
    got = []
    for sizes in ({}, {"task_rows": 200, "hub_rows": 20}):
        adjacency = Adjacency(cm._sym(frame, nodes), **sizes)
        assert (adjacency.parts, adjacency.salted) == ((5, True) if sizes else (1, False))
        written.clear()
        rows = cm._move(nodes, adjacency).collect()
        adjacency.release()
        assert len(written) <= (40 if sizes else 2)
        assert sorted(r["node"] for r in rows) == list(range(120))
        got.append(_modularity(edges, {r["node"]: r["comm"] for r in rows}))
    assert got[0] > 0.5 and got[1] > 0.8 * got[0]


def test_whole_texts_become_objects_in_small_pieces(spark):
    """However many texts a batch holds, few are Python objects at once."""
    import pyarrow as pa

    from corpusgraph.functions.pieces import PIECE_ROWS
    from corpusgraph.operators.pages import json_object
    from corpusgraph.operators.privacy import _restore_udf

    texts = pa.array([None, "none", '{"a": 1}'] * 1000)
    found = list(json_object.func(iter([texts])))
    assert max(map(len, found)) <= PIECE_ROWS
    assert pa.concat_arrays(found).to_pylist() == [None, None, '{"a": 1}'] * 1000
    told = pa.array(["see [REDACTED_A_1]"] * 300), pa.array([["[REDACTED_A_1]"]] * 300), pa.array([["x"]] * 300)
    restored = list(_restore_udf.func(iter([told])))
    assert max(map(len, restored)) <= PIECE_ROWS
    assert pa.concat_arrays(restored).to_pylist() == ["see x"] * 300


def test_sessions_merge_before_they_are_dealt_by_key(spark, folder):
    """One key with all events costs its task bursts, not events; the session keeps its settings."""
    from corpusgraph.streaming import settle as st

    rows = [("k", 10 * i + j) for i in range(40) for j in range(5)] + [("k", 10_000)]
    events = spark.createDataFrame(rows, "key string, s long").selectExpr("key", "timestamp_seconds(s) AS ts")
    events.repartitionByRange(4, "ts").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("key string, ts timestamp").parquet(f"{folder}/in")
    name = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    before = spark.conf.get(name)
    with st.merged_before_exchange(spark):
        query = (
            st.settle_stream(stream, "2 seconds").writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start(f"{folder}/out")
        )
    assert spark.conf.get(name) == before
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    assert plan.count("MergingSessions") >= 2
    found = spark.read.parquet(f"{folder}/out").collect()
    assert len(found) == 40 and {r["events"] for r in found} == {5}


def test_cleared_links_cut_stored_units_once(spark, monkeypatch):
    from corpusgraph.plans import check_maintain as cmn

    calls, plain = [], cmn.ck.chunk
    monkeypatch.setattr(cmn.ck, "chunk", lambda docs: calls.append(1) or plain(docs))
    assert cmn.cleared_links(spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 2


def test_postings_are_counted_where_texts_were_dealt(spark):
    """The only exchange of plain postings moves texts."""
    from corpusgraph.operators import postings as ps

    docs = spark.createDataFrame([(1, "Cats", "running cats run"), (2, None, "dog")], "doc_id long, title string, body string")
    found = ps.build_postings(docs, analyzer="porter")
    plan = ps.build_postings(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "REPARTITION_BY_COL" in plan
    assert sorted((r["doc_id"], r["term"], r["tf"], r["tf_title"], r["dl"]) for r in found.collect()) == [(1, "cat", 2, 1, 4), (1, "run", 2, 0, 4), (2, "dog", 1, 0, 1)]


def test_report_prompts_of_any_size_are_whole(spark, monkeypatch):
    """One prompt for each community: beyond a million lines too, and from many pieces as from one."""
    from compare import bag, connect
    from corpusgraph.operators import reports
    from corpusgraph.plans import check_graph as cg
    from corpusgraph.plans.catalog import with_views

    n = 1_000_001
    members = spark.range(n).select(F.lit(0).alias("level"), F.lit(3).cast("long").alias("cluster"), F.col("id").alias("entity_id"))
    named = spark.range(n).selectExpr("id AS entity_id", "concat('T', id) AS title", "'X' AS type", "'' AS description")
    none = spark.createDataFrame([], "source_id long, target_id long, type string, description string, weight double")
    made = reports.report_prompts(members, named, none, cg.REPORT_LINES).select("parts", F.length("user").alias("n"), F.sha2("user", 256).alias("h")).collect()
    text = "Community level 0, cluster 3.\n\nMember entities:\n" + "\n".join(f"- T{i} (X): " for i in range(n))
    text += "\n\nRelationships:\n(no relationships within this community)\n\nWrite the community report now, as the single JSON object described above.\n"
    assert [tuple(r) for r in made] == [(1, len(text), hashlib.sha256(text.encode()).hexdigest())]

    monkeypatch.setattr(reports, "PIECE_LINES", 7)
    sf = "/root/testdata/sf0.001"
    got = cg._report_prompts(spark, sf).select("level", "cluster", F.col("user").alias("usr"))
    want = connect(sf).execute(with_views("rel_v", "entities_v", **cg.REPORT) + "SELECT level, cluster, usr FROM rprompts")
    assert bag(got.columns, [tuple(r) for r in got.collect()]) == bag([d[0] for d in want.description], want.fetchall())


def test_a_large_graph_rests_in_one_task(spark):
    """A graph of more than 200,000 edges in both directions is moved by one task, and no node gains by another move."""
    import numpy as np
    from corpusgraph.operators import communities as cm
    from corpusgraph.operators.edges import Adjacency

    rng = np.random.default_rng(3)
    n, m = 2_000, 120_000
    pairs = np.unique(np.sort(np.where(rng.random((m, 1)) < 0.7, rng.integers(0, n // 10, (m, 2)) * 10 + rng.integers(0, 10, (m, 1)), rng.integers(0, n, (m, 2))), axis=1), axis=0)
    pairs = pairs[pairs[:, 0] < pairs[:, 1]]
    edges = spark.createDataFrame([(int(a), int(b), 1.0) for a, b in pairs], "a long, b long, weight double")
    degree = np.bincount(pairs.ravel(), minlength=n).astype(float)
    nodes = spark.createDataFrame([(i, float(degree[i]), float(degree.sum())) for i in range(n)], "node long, k double, m2 double")
    adjacency = Adjacency(cm._sym(edges, nodes), task_rows=cm.TASK_ROWS)
    assert adjacency.n_rows > 200_000 and adjacency.parts == 1
    of = np.zeros(n, int)
    for r in cm._move(nodes, adjacency).collect():
        of[r["node"]] = r["comm"]
    adjacency.release()
    pull = np.zeros((n, n))
    np.add.at(pull, (np.append(pairs[:, 0], pairs[:, 1]), of[np.append(pairs[:, 1], pairs[:, 0])]), 1.0)
    totals = np.bincount(of, degree, n)
    gains = pull - degree[:, None] * totals / degree.sum()
    stay = gains[np.arange(n), of] + degree * degree / degree.sum()
    gains[np.arange(n), of] = -np.inf
    gains[pull == 0] = -np.inf
    assert len(set(of)) < n / 10 and (gains.max(axis=1) <= stay + 1e-6).all()

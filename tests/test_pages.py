from pyspark.sql import functions as F

from corpusgraph.functions import text as tx
from corpusgraph.functions.porter import porter_stem
from corpusgraph.operators import hybrid, links as lk, lint as ln, maintain as mt, pages as pg, postings as ps, vectors as vx
from corpusgraph.plans import answer as an

NOW = "2024-05-01T00:00:00+00:00"


def page_frame(spark, *rows):
    """(path, title, body, tags)"""
    return spark.createDataFrame(
        [(p, t, "concept", tags, {}, b) for p, t, b, tags in rows],
        "page_path string, title string, page_type string, tags array<string>, frontmatter map<string,string>, body string",
    )


def test_titles_fall_back(spark):
    files = spark.createDataFrame(
        [
            ("wiki/concepts/a.md", "---\ntitle: Given\ntags: [x, , y]\n---\n\n# Head\n"),
            ("wiki/concepts/b.md", "intro\n # Head two \n"),
            ("wiki/sessions/o'neil-3d_map.md", "no heading"),
            ("wiki/entities/c.md", "---\nbroken"),
            ("wiki/entities/d.md", "---\ntype: note\ntype: source\ntags: solo\n---\n\n\nbody --- more"),
        ],
        "page_path string, text string",
    )
    got = {r["page_path"]: r for r in pg.parse_pages(files).collect()}
    assert got["wiki/concepts/a.md"]["title"] == "Given" and got["wiki/concepts/a.md"]["tags"] == ["x", "y"]
    assert got["wiki/concepts/b.md"]["title"] == "Head two"
    assert got["wiki/sessions/o'neil-3d_map.md"]["title"] == "O'Neil 3D Map"
    assert got["wiki/sessions/o'neil-3d_map.md"]["page_type"] == "session"
    assert got["wiki/entities/c.md"]["body"] == "---\nbroken"
    d = got["wiki/entities/d.md"]
    assert d["page_type"] == "source" and d["tags"] == ["solo"] and d["body"] == "body --- more"


def test_lint_duplicates_and_orphans(spark):
    p = page_frame(
        spark,
        ("wiki/sources/a.md", "Same", "links [[Other]] " + "x" * 100, []),
        ("wiki/concepts/a.md", "Same", "silent " + "x" * 100, []),
        ("wiki/concepts/b.md", "Other", "self [[other]]" + "x" * 100, []),
        ("wiki/concepts/c.md", "Dang", "to [[nowhere|x]] and [[Nowhere#h]]", []),
        ("wiki/concepts/d.md", "Alone", "short", ["stub"]),
        ("wiki/concepts/e.md", "Todo", "y" * 200, ["needs-compile"]),
    )
    l = lk.extract_links(p)
    # the last page titled Same is silent, so both pages of the title count as silent
    assert {r["page_path"] for r in ln.lint_orphans(p, l).collect()} == {
        "wiki/sources/a.md", "wiki/concepts/a.md", "wiki/concepts/d.md", "wiki/concepts/e.md",
    }
    assert [r["target"] for r in ln.lint_dangling(p, l).orderBy("pos").collect()] == ["nowhere", "Nowhere"]
    assert {r["page_path"] for r in ln.lint_thin(p).collect()} == {"wiki/concepts/c.md", "wiki/concepts/e.md"}
    stubs = lk.make_stubs(p, l).collect()
    assert [(s["title"], s["page_path"]) for s in stubs] == [("nowhere", "wiki/concepts/nowhere.md")]
    fixed = ln.lint_fix(p, l, mt.page_index(p, NOW), NOW)
    assert ln.lint_dangling(fixed.pages, lk.extract_links(fixed.pages)).count() == 0
    assert fixed.index.count() == 7


def test_upsert_keeps_human_edits(spark):
    old = page_frame(spark, ("wiki/concepts/a.md", "A", "# A\n\nbody", ["t"]), ("wiki/concepts/b.md", "B", "# B\n\nhand edit", ["t"]))
    fm = F.create_map(F.lit("compiled_hash"), F.when(F.col("title") == "A", F.sha2("body", 256)).otherwise(F.lit("other")), F.lit("created"), F.lit("2020"), F.lit("source_hash"), F.lit("s"))
    new = spark.createDataFrame(
        [(f"wiki/concepts/{x}.md", "concept", x.upper(), "text", None, None) for x in "abc"],
        "page_path string, page_type string, title string, body string, tags array<string>, source_hash string",
    )
    got = {r["title"]: r for r in pg.upsert_pages(old.withColumn("frontmatter", fm), new, NOW).collect()}
    assert [got[t]["action"] for t in "ABC"] == ["updated", "merged", "created"]
    assert got["A"]["body"] == "# A\n\ntext" and got["A"]["frontmatter"]["created"] == "2020" and got["A"]["frontmatter"]["source_hash"] == "s"
    assert got["B"]["body"].startswith("# B\n\nhand edit\n") and "[!merge]" in got["B"]["body"]
    again = pg.parse_pages(spark.createDataFrame([(got["C"]["page_path"], got["C"]["text"])], "page_path string, text string")).first()
    assert again["body"] == got["C"]["body"] and again["title"] == "C"


def test_rendered_links_are_escaped(spark):
    p = page_frame(spark, ("wiki/concepts/a b.md", "A", "<i> [[Missing|<b>]] [[a#x & y]] end", []))
    html = lk.render_links(p, lk.extract_links(p)).first()["html"]
    assert html == (
        '&lt;i&gt; <span class="wikilink dangling" title="page not found: Missing">&lt;b&gt;</span> '
        '<a class="wikilink" href="/#/page?path=wiki/concepts/a%20b.md">x &amp; y</a> end'
    )
    shown = spark.range(1).select(lk.render_snippet(F.lit("<mark>a</mark> <u>")).alias("s")).first()["s"]
    assert shown == "<mark>a</mark> &lt;u&gt;"


RETRIEVAL = (
    ("wiki/concepts/hybrid.md", "Hybrid Retrieval", "Hybrid retrieval blends lexical and vector scores. See [[Wikilink Graph]].", []),
    ("wiki/concepts/graph.md", "Wikilink Graph", "Pages and their connections.", []),
    ("wiki/concepts/garden.md", "Gardening Tips", "Water tomatoes in the morning.", []),
)


def test_hybrid_search_and_expansion(spark):
    p = page_frame(spark, *RETRIEVAL)
    idx = mt.build_index(p, NOW)
    stats = ps.corpus_stats(mt.index_docs(p), idx.postings)
    q = spark.createDataFrame([(1, "hybrid retrieval vector"), (2, "???"), (3, "zebra")], "question_id bigint, text string")
    qv = vx.hash_embed(q, "question_id", "text")
    hits = hybrid.hybrid_search(q, idx.postings, stats, qv, idx.vectors, 8)
    got = {}
    for r in hits.orderBy("question_id", "rank").collect():
        got.setdefault(r["question_id"], []).append(r["doc_id"])
    assert got[1] == ["wiki/concepts/hybrid.md"]
    assert len(got[2]) == 3 and len(got[3]) == 3  # nothing matched: every page is scored by vector
    links = lk.extract_links(p).select(F.col("page_path").alias("doc_id"), "pos", "key")
    titles = lk.title_index(p).select("key", F.col("page_path").alias("doc_id"))
    more = {(r["doc_id"], r["tier"]) for r in hybrid.expand_links(hits, links, titles, 8).where("question_id = 1").collect()}
    assert more == {("wiki/concepts/hybrid.md", "hybrid"), ("wiki/concepts/graph.md", "expanded")}
    plain = hybrid.hybrid_search(q, idx.postings, stats, None, None, 8).collect()
    assert {(r["question_id"], r["tier"]) for r in plain} == {(1, "bm25")}


def test_snippet_marks_the_match(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen Zebra, end"), (2, "plain")], "doc_id bigint, body string")
    hits = spark.createDataFrame([(1, 1), (1, 2)], "question_id bigint, doc_id bigint")
    terms = spark.createDataFrame([(1, "zebra")], "question_id bigint, term string")
    got = {r["doc_id"]: r["snippet"] for r in ps.snippets(hits, docs, terms).collect()}
    assert "<mark>Zebra</mark>," in got[1] and got[1].startswith("...") and got[2] == "plain"


def test_nearest_blocks_equal_broadcast_and_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    q = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(30)]
    d = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)] + [(900, [0.0] * 8)]
    qs = spark.createDataFrame(q, "question_id bigint, vector array<double>")
    ds = spark.createDataFrame(d, "doc_id bigint, vector array<double>").repartition(5)
    want = set()
    for i, v in q:
        s = sorted(((-round(float(np.dot(v, w) / (np.linalg.norm(v) * (np.linalg.norm(w) or 1))), 6), j) for j, w in d))[:7]
        want |= {(i, j, -x) for x, j in s}
    for block in (1024, 7):
        got = {(r["question_id"], r["doc_id"], r["cosine"]) for r in vx.nearest(qs, ds, 7, query_block=block).collect()}
        assert got == want


def test_nearest_sends_no_vector_once_a_block(spark):
    """Vectors are packed once: no exchange lies above the crossing of blocks but that of the best."""
    rows = [(f"v{i}", [float(i), 1.0]) for i in range(40)]
    ds = spark.createDataFrame(rows, "doc_id string, vector array<double>")
    near = vx.nearest(ds.withColumnRenamed("doc_id", "question_id"), ds, 2, query_block=3)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" in plan and "Generate" not in plan and "Repartition" not in plan
    assert near.count() == 80 and near.where("question_id = 'v0' AND rank = 1").first()["doc_id"] == "v0"


def test_porter_examples():
    # pairs printed in the 1980 paper
    for word, stem in {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing",
        "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat",
        "triplicate": "triplic", "hopeful": "hope", "adjustment": "adjust", "probate": "probat", "controll": "control", "generalizations": "gener",
    }.items():
        assert porter_stem(word) == stem


def test_porter_index_matches_inflections(spark):
    docs = spark.createDataFrame([(1, "", "connected connections"), (2, "", "unrelated")], "doc_id bigint, title string, body string")
    p = ps.build_postings(docs, "porter")
    q = spark.createDataFrame([(1, "connecting")], "question_id bigint, text string")
    assert [r["doc_id"] for r in ps.bm25(q, p, ps.corpus_stats(docs, p), 5, "porter").collect()] == [1]


def test_ascii_terms_split_at_other_letters(spark):
    q = spark.createDataFrame([(1, "café snake_case")], "question_id bigint, text string")
    assert {r["term"] for r in ps.query_terms(q).collect()} == {"caf", "snake", "case"}
    assert {r["term"] for r in ps.query_terms(q, mode="unicode").collect()} == {"cafe", "snake", "case"}


def test_embedder_change_rebuilds(spark):
    p = page_frame(spark, *RETRIEVAL)
    meta = spark.createDataFrame([("embedder_id", "Hash:64")], "key string, value string")
    stored = mt.build_index(p, "then", dim=64)
    same, _ = mt.index_or_rebuild(p, stored, meta, "Hash:64", "now")
    assert {r["updated"] for r in same.index.collect()} == {"then"}
    new, meta2 = mt.index_or_rebuild(p, stored, meta, "Hash:8", "now", dim=8)
    assert {r["updated"] for r in new.index.collect()} == {"now"} and len(new.vectors.first()["vector"]) == 8
    assert meta2.where("key = 'embedder_id'").first()["value"] == "Hash:8"
    kept, _ = mt.index_or_rebuild(p, stored, meta, "Hash:8", "now", read_only=True)
    assert {r["updated"] for r in kept.index.collect()} == {"then"}


def test_bucketed_update_replaces_only_touched_buckets(spark, folder):
    from corpusgraph.sources.snapshots import Snapshots

    store, schema = Snapshots(spark, f"{folder}/t", 4000), "id long, v string"
    first = store.change(0)
    first.replace("t", schema, "id", spark.range(5000), lambda rows: rows, spark.range(5000).select("id", F.lit("old").alias("v")))
    before = first.commit().of("t")
    touched = spark.range(5)
    second = store.change(1)
    second.replace("t", schema, "id", touched, lambda rows: rows.join(touched, "id", "left_anti"), spark.range(2, 5).select("id", F.lit("new").alias("v")))
    after = second.commit()
    got = {r["id"]: r["v"] for r in store.version().read("t", schema).collect()}
    assert set(got) == set(range(2, 5000)) and [got[i] for i in (2, 3, 4, 5)] == ["new", "new", "new", "old"]
    same = {b.path for b in before} & {b.path for b in after.of("t")}
    assert len(before) > 5 and len(before) - 5 <= len(same) < len(before)


def test_snapshot_pointer_flips(spark, folder):
    comm = spark.createDataFrame([(0, 1, 5)], "level int, cluster int, entity_id int")
    reports = spark.createDataFrame([(0, 1, "keep"), (0, 2, "stale")], "level int, cluster int, title string")
    mt.replace_communities(spark, folder, comm, reports)
    c, r = mt.current_snapshot(spark, folder)
    assert c.count() == 1 and [x["title"] for x in r.collect()] == ["keep"]


def test_modes_resolve(spark):
    q = spark.createDataFrame([(1, "Give an Overview", "auto"), (2, "who", "auto"), (3, "x", None), (4, "x", "drift")], "question_id int, text string, mode string")
    assert [r["resolved"] for r in an.resolve_mode(q, True).orderBy("question_id").collect()] == ["global", "local", "legacy", "drift"]
    assert [r["resolved"] for r in an.resolve_mode(q.where("mode = 'auto'"), False).collect()] == ["legacy", "legacy"]
    try:
        an.resolve_mode(q.withColumn("mode", F.lit("odd")), True).collect()
    except Exception:
        return
    raise AssertionError("an unknown mode must fail")


def test_compile_prompt_parts_keep_every_title(spark):
    titles = spark.createDataFrame([(f"Title {i}",) for i in range(100)], "title string")
    whole = pg.title_digest(titles).collect()
    parts = pg.title_digest(titles, digest_chars=200).collect()
    assert len(whole) == 1 and len(parts) > 3
    assert sorted(x for p in parts for x in p["digest"].split("\n")) == sorted(whole[0]["digest"].split("\n"))


def test_hash_embedding_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(1, "  "), (2, "a b")], "id bigint, text string")
    got = {r["id"]: r["vector"] for r in vx.hash_embed(df, "id", "text").collect()}
    assert got[1] == [0.0] * 64 and abs(sum(x * x for x in got[2]) - 1) < 1e-9


def test_title_case(spark):
    assert spark.range(1).select(tx.title_case(F.lit("o'neil 3d-MAP x")).alias("t")).first()["t"] == "O'Neil 3D-Map X"


def test_hashes_of_compile_prompts(spark):
    """Hashes carried on from each part's titles are those of the whole prompts; no titles, long and missing sources included."""
    titles = spark.createDataFrame([(f"Titel {i} \u00e4",) for i in range(100)], "title string")
    rows = [(f"h{i}", f"n{i}", "document", "text/plain", t) for i, t in enumerate(["a", "", None, "\u00e4" * 12_001, "b" * 12_000] * 5)]
    sources = spark.createDataFrame(rows, "content_hash string, original_name string, kind string, mime string, parsed_markdown string")
    for known, chars in ((titles, 200), (titles, 1 << 20), (titles.limit(0), 200)):
        whole = pg.compile_prompts(sources, known, digest_chars=chars)
        want = {(r["source_hash"], r["part"]): r["h"] for r in whole.select("source_hash", "part", F.sha2("user", 256).alias("h")).collect()}
        got = pg.compile_prompt_hashes(sources, known, chars).collect()
        assert len(got) == len(want) and {(r["source_hash"], r["part"]): r["user_hash"] for r in got} == want

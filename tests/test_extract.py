from pyspark.sql import functions as F

from corpusgraph.operators import chunk as ck, completions as cp, extract as ex, maintain as mt, merge as mg, privacy as pv, records as rc


def parse(text):
    return [tuple(r) for r in rc.parse_answer(text)]


GOOD = '("entity"<|>ADA<|>PERSON<|>wrote notes)##("relationship"<|>ADA<|>ENGINE<|>worked on<|>9)<|COMPLETE|>'


def test_records_well_formed_and_fenced():
    want = [("entity", "ADA", "PERSON", "wrote notes"), ("relationship", "ADA", "ENGINE", "worked on", "9")]
    assert parse(GOOD) == want
    assert parse(f"```text\n{GOOD}\n```") == want
    assert parse(GOOD + "## (ignored<|>x)") == want


def test_records_salvage():
    assert parse('("entity"<|>A<|>PERSON<|>cut off') == [("entity", "A", "PERSON", "cut off")]
    assert parse('("entity"<|>A<|>PERSON<|>see (x ## y) there)##("entity"<|>B<|>EVENT<|>d)') == [
        ("entity", "A", "PERSON", "see (x ## y) there"), ("entity", "B", "EVENT", "d"),
    ]
    assert parse('("entity"<|>A<|>PERSON<|>d)\n("entity"<|>B<|>EVENT<|>e)') == [("entity", "A", "PERSON", "d"), ("entity", "B", "EVENT", "e")]
    assert parse("just prose") == [] and parse("") == [] and parse(None) == []


def test_title_variants_share_a_key(spark):
    rows = ["Priya Anand", " priya  anand ", "Priya\nAnand", "PRIYA ANAND<|>7", "Apollo 11"]
    df = spark.createDataFrame([(r,) for r in rows], "t string").select(rc.normalize_title(F.col("t")).alias("t"))
    assert [r["t"] for r in df.collect()] == ["PRIYA ANAND"] * 4 + ["APOLLO 11"]


def test_unknown_types_and_statuses(spark):
    df = spark.createDataFrame([("gizmo", "maybe"), (" person ", "true")], "t string, s string")
    got = [tuple(r) for r in df.select(rc.normalize_type(F.col("t")), rc.normalize_status(F.col("s"))).collect()]
    assert got == [("OTHER", "SUSPECTED"), ("PERSON", "TRUE")]


def chunks(spark, body):
    df = spark.createDataFrame([("p", body)], "page_path string, body string")
    return [r["text"] for r in ck.chunk(df).orderBy("chunk_index").collect()]


def test_chunk_headings_paragraphs_and_oversize(spark):
    assert chunks(spark, "intro\n\n# A\none\n## B\ntwo") == ["intro", "# A\none", "## B\ntwo"]
    p = "x" * 390
    assert chunks(spark, f"# T\n\n{p}\n\n{p}\n\n{p}") == [f"# T\n\n{p}\n\n{p}", p]
    long = "y" * 2000
    assert long in chunks(spark, f"small\n\n{long}\n\nsmall")
    assert chunks(spark, "  \n ") == []


def test_chunk_packs_like_a_plain_loop(spark):
    import random

    rng = random.Random(1)
    for _ in range(5):
        paragraphs = ["w" * rng.randrange(1, 500) for _ in range(30)]
        want, cur = [], ""
        for p in paragraphs:
            if cur and len(cur) + len(p) + 2 > 800:
                want.append(cur)
                cur = p
            else:
                cur = f"{cur}\n\n{p}" if cur else p
        want.append(cur)
        assert chunks(spark, "\n\n".join(paragraphs)) == want


def test_empty_heading_does_not_hide_the_next(spark):
    # a heading without text right before another one: both start a section here
    assert chunks(spark, "# \n# B\ntext") == ["#", "# B\ntext"]


def completer(table, seen=None):
    def run(batches):
        for b in batches:
            yield b[["cache_key"]].assign(response=[next((v for k, v in table.items() if k in u), "<|COMPLETE|>") for u in b["user"]])

    return run


def cache(spark):
    return spark.createDataFrame([], "cache_key string, response string")


def test_completion_once_per_key_and_then_from_the_cache(spark):
    prompts = cp.with_cache_key(spark.createDataFrame([(1, "s", "a"), (2, "s", "a"), (3, "s", "b")], "id int, system string, user string"))
    done = cp.complete(prompts, cache(spark), completer({"a": "A", "b": "B"}))
    assert {r["id"]: r["response"] for r in done.answered.collect()} == {1: "A", 2: "A", 3: "B"}
    assert cp.completion_counts(done).first().asDict() == {"prompts": 3, "hits": 1, "completions": 2}
    again = cp.complete(prompts, done.cache, completer({}))
    assert again.misses.count() == 0 and all(r["hit"] for r in again.answered.collect())


def test_repair_and_gleaning_rounds(spark):
    units = spark.createDataFrame([(1, "alpha text"), (2, "beta text"), (3, "gamma text")], "text_unit_id bigint, text string")
    table = {
        "could not be parsed": '("entity"<|>FIXED<|>PERSON<|>repaired)',
        "previous output:\n(\"entity\"<|>ALPHA": '("entity"<|>MORE<|>EVENT<|>gleaned)##("entity"<|>ALPHA<|>PERSON<|>repeat)',
        "previous output": "<|COMPLETE|>",
        "alpha": '("entity"<|>ALPHA<|>PERSON<|>first)',
        "beta": "prose only",
    }
    out = ex.extract_graph(units, cache(spark), completer(table))
    got = {(r["text_unit_id"], r["title"], r["description"]) for r in out.entities.collect()}
    assert got == {(1, "ALPHA", "first"), (1, "MORE", "gleaned"), (2, "FIXED", "repaired"), (3, "FIXED", "repaired")}
    # three first answers, two repairs, three gleanings; an end mark alone is not repaired in a gleaning
    assert out.calls.count() == 8
    again = ex.extract_graph(units, out.cache, completer({}))
    assert again.calls.count() == 0
    assert {(r["text_unit_id"], r["title"], r["description"]) for r in again.entities.collect()} == got


def test_merge_descriptions_is_an_ordered_fold(spark):
    cases = [["a", "a", "b", "a", "a b a", "", "a b a"], ["", "x", "", "x", "x"], ["", ""], ["q", "q q", "q"]]
    rows = [(f"T{c}", "PERSON", d, f"p{i // 2}", i % 2, 0) for c, ds in enumerate(cases) for i, d in enumerate(ds)]
    df = spark.createDataFrame(rows, "title string, type string, description string, page_path string, chunk_index int, ordinal int")
    got = {r["title"]: r["description"] for r in mg.merge_entities(df.repartition(6)).collect()}
    for c, ds in enumerate(cases):
        cur = ""
        for d in ds:
            cur = d if cur == "" else cur if d in ("", cur) else f"{cur} {d}"
        assert got[f"T{c}"] == cur


def test_merge_relationships_max_weight_last_text(spark):
    rows = [(1, 2, "old", 3.0, "p", 0, 0), (1, 2, "new", 1.0, "p", 0, 1), (1, 2, "", 2.0, "p", 1, 0)]
    df = spark.createDataFrame(rows, "source_id bigint, target_id bigint, description string, weight double, page_path string, chunk_index int, ordinal int")
    assert [tuple(r) for r in mg.merge_relationships(df).collect()] == [(1, 2, "related", "new", 3.0)]


def test_degree_counts_a_loop_once(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "source_id bigint, target_id bigint")
    assert {r["entity_id"]: r["degree"] for r in mg.degree(df).collect()} == {1: 2, 2: 1}


def test_graph_build_is_incremental(spark):
    docs = spark.createDataFrame([("a.md", "alpha one"), ("b.md", "beta two")], "page_path string, body string")
    table = {
        "previous output": "<|COMPLETE|>",
        "Known entities": '("claim"<|>ALPHA<|>NONE<|>fact<|>TRUE<|>NONE<|>NONE<|>said)',
        "alpha": '("entity"<|>ALPHA<|>PERSON<|>d)##("entity"<|>ONE<|>CONCEPT<|>e)##("relationship"<|>ALPHA<|>ONE<|>r<|>5)',
    }
    units = ck.chunk(docs)
    g = ex.extract_graph(units, cache(spark), completer(table))
    c = ex.extract_claims(units, g.entities, g.cache, completer(table))
    assert g.entities.count() == 2 and g.relationships.count() == 1 and c.claims.count() == 1
    changed = docs.where("page_path = 'b.md'")
    diff = mt.diff_text_units(ck.chunk(changed), units)
    assert {(r["page_path"], r["change"]) for r in diff.collect()} == {("a.md", "deleted"), ("b.md", "unchanged")}


def test_redaction_stays_on_through_the_rounds(spark):
    units = spark.createDataFrame([(1, "write to ada@example.org about sk-" + "a1" * 12)], "text_unit_id bigint, text string")
    patterns = pv.secret_patterns(spark).unionByName(
        spark.createDataFrame([("EMAIL_ADDRESS", r"\S+@\S+\.org", 0.9)], "type string, pattern string, score double")
    )

    def check(batches):
        for b in batches:
            out = []
            for user in b["user"]:
                assert "ada@" not in user and "sk-a1" not in user
                out.append('("entity"<|>REDACTED EMAIL ADDRESS 1<|>PERSON<|>uses [REDACTED_SECRET_1])' if "previous output" not in user else "<|COMPLETE|>")
            yield b[["cache_key"]].assign(response=out)

    got = ex.extract_graph(units, cache(spark), check, patterns=patterns, redact=True)
    row = got.entities.first()
    assert row["title"] == "ADA@EXAMPLE.ORG" and row["description"] == "uses sk-" + "a1" * 12
    try:
        ex.extract_graph(units, cache(spark), check, redact=True)
    except ValueError:
        return
    raise AssertionError("redaction without patterns must fail")


def test_redact_numbers_overlaps_and_round_trip(spark):
    docs = spark.createDataFrame([(1, "Ann ann@x.org and bob@x.org"), (2, "nothing")], "doc_id bigint, text string")
    spans = spark.createDataFrame(
        [(1, "EMAIL", 4, 13, 0.9), (1, "EMAIL", 18, 27, 0.9), (1, "URL", 8, 13, 0.5), (1, "PERSON", 0, 3, 0.8)],
        "doc_id bigint, type string, start int, end int, score double",
    )
    r = pv.redact(docs, spans)
    got = {x["doc_id"]: (x["text"], x["token_map"]) for x in r.collect()}
    assert got[1][0] == "[REDACTED_PERSON_1] [REDACTED_EMAIL_1] and [REDACTED_EMAIL_2]"
    assert got[2] == ("nothing", {})
    assert {x["text"] for x in pv.rehydrate(r).collect()} == {"Ann ann@x.org and bob@x.org", "nothing"}


def test_rehydrate_mangled_tokens():
    m = {"[REDACTED_US_DRIVER_LICENSE_1]": "X99", "[REDACTED_PERSON_1]": "Ann"}
    restore = lambda t: pv._restore(t, list(m), list(m.values()))
    assert restore("REDACTED_PERSON_1 here") == "Ann here"
    assert restore("REDACTED US DRIVER LICENSE 1is") == "X99is"
    assert restore("[REDACTED_OTHER_4]") == "[REDACTED_OTHER_4]"


def test_windows_cut_at_blanks(spark):
    texts = ["word " * 1200 + "z" * 3000, "é" * 2500, "é𝒳" * 1251, "line\n" * 600 + "q" * 2499, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    parts = pv.window_text(docs, 2500).orderBy("doc_id", "offset").collect()
    for i, text in enumerate(texts):
        own = [(r["offset"], r["chunk"]) for r in parts if r["doc_id"] == i]
        assert "".join(c for _, c in own) == (text or "") and all(len(c) <= 2500 for _, c in own)
        assert all(text[o : o + len(c)] == c for o, c in own)
    assert all(c.endswith(" ") for c in [r["chunk"] for r in parts if r["doc_id"] == 0][:2])
    assert [r["chunk"] for r in parts if r["doc_id"] == 3][0].endswith("\n")


def test_claim_prompts_hide_restored_titles(spark):
    key = "sk-" + "aB3x" * 6
    units = spark.createDataFrame([(1, f"the key {key} belongs to ops"), (2, "Bob  Stone met BOB STONE and bob stone")], "text_unit_id bigint, text string")
    entities = spark.createDataFrame([(1, 0, key.upper(), "OTHER"), (2, 0, "BOB STONE", "PERSON")], "text_unit_id bigint, ordinal bigint, title string, type string")
    patterns = pv.secret_patterns(spark).unionByName(spark.createDataFrame([("PERSON", r"Bob\s+Stone", 0.9)], "type string, pattern string, score double"))
    asked = []

    def answer(batches):
        for b in batches:
            for user in b["user"]:
                assert key.lower() not in user.lower() and "bob stone" not in " ".join(user.lower().split())
            yield b[["cache_key"]].assign(response=['("claim"<|>[REDACTED_SECRET_1]<|>NONE<|>X<|>TRUE<|>NONE<|>NONE<|>about [REDACTED_SECRET_1])' for _ in b["user"]])

    got = ex.extract_claims(units, entities, cache(spark), answer, patterns=patterns, redact=True)
    rows = got.claims.collect()
    assert not asked and [(r["subject"], r["description"]) for r in rows] == [(key.upper(), f"about {key}")]

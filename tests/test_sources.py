import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusgraph.operators import pages as pg
from corpusgraph.sources import files as fl, html as hm, ledger as lg
from corpusgraph.streaming import settle as st, watch as wt


def drop(folder, **named):
    os.makedirs(folder, exist_ok=True)
    for name, content in named.items():
        with open(os.path.join(folder, name.replace("__", ".")), "wb") as f:
            f.write(content)


def empty_ledger(spark):
    return spark.createDataFrame([], wt.LEDGER_SCHEMA)


def test_kinds_and_mime(spark):
    df = spark.createDataFrame([(n,) for n in ("report.PDF", "screenshot.png", "data.json", "x.unknown", "a.tar.gz", ".hidden", "plain")], "original_name string")
    got = {r["original_name"]: (r["kind"], r["mime"]) for r in fl.classify(df).collect()}
    assert got["report.PDF"] == ("document", "application/pdf") and got["screenshot.png"] == ("image", "image/png")
    assert got["data.json"] == ("artifact", "application/json") and got["x.unknown"] == ("artifact", "application/octet-stream")
    assert got["a.tar.gz"][1] == "application/x-tar" and got["plain"][0] == "artifact"


def test_ingest_first_parsable_name_wins(spark, folder):
    drop(f"{folder}/drop", a__md=b"same", b__md=b"same", c__pdf=b"lonely", **{"0a__pdf": b"same"}, z__txt=b"caf\xe9\r\nx")
    files = fl.read_drop(spark, f"{folder}/drop")
    r = lg.ingest(files, empty_ledger(spark), "now")
    assert {x["original_name"] for x in r.ingested.collect()} == {"a.md", "z.txt"}
    assert {(x["original_name"], x["existing_raw_path"].split(".")[-1]) for x in r.skipped.collect()} == {("b.md", "md")}
    assert {x["original_name"] for x in r.errors.collect()} == {"0a.pdf", "c.pdf"}
    text = r.ingested.where("original_name = 'z.txt'").first()["parsed_markdown"]
    assert text == "# z.txt\n\n```text\ncaf�\nx\n```\n"
    ledger = lg.merge_ledger(empty_ledger(spark), r.ingested)
    again = lg.ingest(files, ledger, "later", on_conflict="keep")
    assert again.ingested.count() == 0 and {x["original_name"] for x in again.skipped.collect()} == {"a.md", "0a.pdf", "b.md", "z.txt"}
    assert not again.skipped.first()["remove_source"]


def test_html_is_read_as_text():
    page = "<html><head><title>T</title><style>x{}</style></head><body><nav><a href='/n'>n</a></nav><!-- c --><h2>Head &amp; more</h2><p>One <b>two</b> <a href='/l'>link</a>.</p><ul><li>a</li><li>b</li></ul><script>bad()</script></body></html>"
    assert hm.markdown_of(page) == "## Head & more\n\nOne two [link](/l).\n\n- a\n- b"


def test_job_report_latest_job(spark):
    rows = [("j1", 1, "a", "done", None), ("j2", 2, "a", "queued", None), ("j2", 3, "a", "compiling", None), ("j2", 4, "b", "error", "boom"), ("j2", 5, "a", "ingested", None)]
    jobs, files = lg.job_report(spark.createDataFrame(rows, "job_id string, seq int, file string, status string, message string"))
    j = jobs.first()
    assert (j["job_id"], j["ingested"], j["errors"], j["done"]) == ("j2", 1, 1, False)
    assert {(f["file"], f["status"]) for f in files.collect()} == {("a", "compiling"), ("b", "error")}


def test_settle_fires_once_per_burst(spark):
    t0 = datetime(2024, 1, 1, 0, 59, 59)
    at = lambda s: t0 + timedelta(seconds=s)
    rows = [("one", at(0)), ("burst", at(0)), ("burst", at(1)), ("burst", at(2)), ("two", at(0)), ("two", at(0.5)), ("two", at(2)), ("two", at(9))]
    got = st.settle(spark.createDataFrame(rows, "key string, ts timestamp"), 1.5).groupBy("key").agg(F.count("*").alias("n"), F.sum("events").alias("e"))
    assert {r["key"]: (r["n"], r["e"]) for r in got.collect()} == {"one": (1, 1), "burst": (1, 3), "two": (3, 4)}


def test_watch_ingests_each_content_once(spark, folder):
    inbox, state = f"{folder}/drop", f"{folder}/state"
    calls = []

    def follow_up(done, batch):
        calls.append((batch, done.count()))
        raise RuntimeError("compile is down")

    drop(inbox, a__md=b"alpha", b__md=b"beta")
    wt.watch(spark, inbox, state, follow_up, once=True).awaitTermination()
    drop(inbox, c__md=b"alpha", d__md=b"delta")
    wt.watch(spark, inbox, state, follow_up, once=True).awaitTermination()
    names = {r["original_name"] for r in wt.read_ledger(spark, state).collect()}
    assert names == {"a.md", "b.md", "d.md"}
    assert [n for _, n in calls] == [2, 1]
    assert spark.read.parquet(f"{state}/failures").count() == 2
    log = {(r["original_name"], r["status"]) for r in spark.read.parquet(f"{state}/log").collect()}
    assert ("c.md", "skipped") in log and ("d.md", "ingested") in log


def test_index_stream_follows_edits_and_deletions(spark, folder):
    wiki, state = f"{folder}/wiki/concepts", f"{folder}/state"
    index = lambda: wt.index_stream(spark, f"{folder}/wiki", state, once=True).awaitTermination()
    drop(wiki, a__md=b"# A\n\nold words", b__md=b"# B\n\nsteady", d__md=b"# D\n\ndoomed")
    index()
    first = {r["page_path"]: r["content_hash"] for r in wt.read_index(spark, state).index.collect()}
    drop(wiki, a__md=b"# A\n\nedited words", c__md=b"# C\n\nfresh")
    os.remove(f"{wiki}/d.md")
    index()
    second = wt.read_index(spark, state)
    rows = {r["page_path"]: r["content_hash"] for r in second.index.collect()}
    assert set(rows) == {f"wiki/concepts/{x}.md" for x in "abc"}
    assert rows["wiki/concepts/a.md"] != first["wiki/concepts/a.md"] and rows["wiki/concepts/b.md"] == first["wiki/concepts/b.md"]
    terms = {(r["doc_id"][-4], r["term"]) for r in second.postings.collect()}
    assert {("a", "edited"), ("b", "steady"), ("c", "fresh")} <= terms and not {("a", "old"), ("d", "doomed")} & terms
    assert {r["doc_id"][-4] for r in second.vectors.select("doc_id").collect()} == {"a", "b", "c"}
    index()  # nothing changed: nothing is written
    assert wt.read_index(spark, state).postings.count() == second.postings.count()


def test_watch_sees_a_name_again(spark, folder):
    inbox, state = f"{folder}/drop", f"{folder}/state"
    for text in (b"one", b"two!", b"two!"):
        drop(inbox, a__md=text)
        wt.watch(spark, inbox, state, once=True, settle_seconds=0.2).awaitTermination()
    assert wt.read_ledger(spark, state).count() == 2


def test_half_written_burst_waits(spark, folder):
    drop(f"{folder}/drop", a__md=b"one")
    found = wt.Changes(spark, f"{folder}/drop", f"{folder}/state", 0)
    assert found.any and not found.settled(3600) and found.settled(0)


def test_index_batch_of_a_whole_collection(spark, folder):
    state = f"{folder}/state"
    pages = lambda *rows: pg.parse_pages(spark.createDataFrame([(f"wiki/concepts/{n}.md", t) for n, t in rows], "page_path string, text string"))
    wt.index_batch(spark, pages(("a", "# A\n\nold words"), ("b", "# B\n\nsteady"), ("c", "# C\n\nfresh")), state, 0)
    # a whole collection without b, and with a changed
    frame = pg.parse_pages(spark.createDataFrame([("wiki/concepts/a.md", "# A\n\nnew words"), ("wiki/concepts/c.md", "# C\n\nfresh")], "page_path string, text string"))
    for _ in range(2):  # running a batch again changes nothing
        wt.index_batch(spark, frame, state, 7, partial=False)
        third = wt.read_index(spark, state)
        assert {r["page_path"] for r in third.index.collect()} == {"wiki/concepts/a.md", "wiki/concepts/c.md"}
        terms = {(r["doc_id"][-4], r["term"]) for r in third.postings.collect()}
        assert ("a", "new") in terms and ("a", "old") not in terms and not any(d == "b" for d, _ in terms)
        assert third.vectors.count() == 2


def test_index_keeps_its_state_while_buckets_split(spark, folder):
    from corpusgraph.operators import maintain as mt

    state = f"{folder}/state"
    text = lambda i, word: (f"wiki/p{i:03}.md", f"# Page {i}\n\n{word} " + " ".join(f"w{(i * 37 + j * j * 11) % 5003}" for j in range(80)))
    frame = lambda rows: pg.parse_pages(spark.createDataFrame(rows, "page_path string, text string"))
    now = {i: text(i, "old") for i in range(40)}
    wt.index_batch(spark, frame(list(now.values())), state, 0, bucket_bytes=1 << 40)
    assert len(wt.index_store(spark, state).version().of("postings")) == 1
    # the next batch finds its only bucket too large
    fresh = {i: text(i, "new") for i in (3, 4, 50, 51)}
    now.update(fresh)
    gone = spark.createDataFrame([(now.pop(i)[0],) for i in (7, 8)] + [("wiki/never.md",)], "page_path string")
    wt.index_batch(spark, frame(list(fresh.values())), state, 1, removed=gone, bucket_bytes=8000)
    split = {b.path for b in wt.index_store(spark, state).version().of("postings")}
    assert len(split) > 3
    now[9] = text(9, "newest")
    wt.index_batch(spark, frame([now[9]]), state, 2, bucket_bytes=8000)
    assert len(split & {b.path for b in wt.index_store(spark, state).version().of("postings")}) == len(split) - 1
    got, want = wt.read_index(spark, state), mt.build_index(frame(list(now.values())), "then")
    for a, b in zip(got, want, strict=True):
        columns = [c for c in b.columns if c != "updated"]
        rows = lambda df: sorted(map(repr, df.select(*columns).collect()))
        assert rows(a) == rows(b)
    for a, b in zip(got, want, strict=True):
        assert [(f.name, f.dataType) for f in a.schema] == [(f.name, f.dataType) for f in b.schema]

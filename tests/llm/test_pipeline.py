import hashlib

from brute import SF, groups, leaks

import corpus_pipeline
from corpusgraph.llm import linedup, toxicity
from corpusgraph.session import cut


def test_stages_one_by_one(spark, library_ids):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = cut(stage(spark, docs, SF))
        kept[name] = (before.collect(), docs.collect())
        assert name == "encoding" or docs.columns == columns
    before, after = kept["toxicity"]
    left = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    assert len(left & clean) <= max(1, len(toxic) // 5)
    before, after = kept["line_dedup"]
    lines = [x for r in after for x in r["text"].split("\n") if len(x) >= linedup.LEAST_CHARS]
    assert len(lines) == len(set(lines)) and len(after) <= len(before)
    before, after = kept["near_copies"]
    ids, sizes = groups([(r["doc_id"], r["text"]) for r in before], 5, 80)
    assert {r["doc_id"] for r in after} == {i for i in ids}
    before, after = kept["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = leaks([(r["doc_id"], r["text"]) for r in before], items)
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r, x in zip(before, found, strict=True) if not x}
    before, after = kept["encoding"]
    texts = {r["doc_id"]: r["text"] for r in before}
    assert len(after) == len(before)
    for r in after:
        assert r["ids"] == library_ids(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_stages_take_odd_tables(spark, edge_docs, no_docs, folder):
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{folder}/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").limit(0).write.parquet(f"{folder}/benchmark.parquet")
    for docs in (no_docs, edge_docs):
        for name, stage in corpus_pipeline.STAGES:
            made = cut(stage(spark, docs, folder))
            assert name == "encoding" or made.columns == docs.columns
            assert (made.count() > 0) == (docs.count() > 0)
            docs = made if name != "encoding" else docs


def test_stages_keep_columns_of_any_name_and_type(spark, folder):
    """Dots and blanks in names, maps, missing usual columns, rows that differ in other columns only."""
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{folder}/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").limit(0).write.parquet(f"{folder}/benchmark.parquet")
    line = "a line of some ten words that stands twice in all\n"
    rows = [(i % 5, line + f"and words of its own {i // 2} " + " ".join(f"w{i // 2}{j}" for j in range(30)), {"k": i}, f"x{i}", None) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` map<string,int>, `c d` string, `row` array<map<string,int>>")
    for name, stage in corpus_pipeline.STAGES:
        made = cut(stage(spark, docs, folder))
        assert name == "encoding" or (made.columns == docs.columns and made.count())
        docs = made
    assert docs.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and docs.count()


def test_names_and_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_copies", "decontamination", "encoding"]
    assert corpus_pipeline.ORACLE_SQL is None and corpus_pipeline.run(spark, SF).columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"]
    assert toxicity.REJECT == 0.3

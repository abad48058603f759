"""Plan shape: no pair joins, no needless exchange, column pruning, pushed top-k."""

import pytest

from corpusgraph.plans import all_queries, inputs

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["page_edges", "backlinks", "lint", "undirected_edges", "merge_entities", "merge_relationships", "diff_pages", "ingest_new", "bm25_top20",
     "hybrid_search", "expand_links", "spread", "gather_context", "merge_identity_edges", "report_prompts", "settle_all"],
)
def test_no_pair_joins(spark, name):
    text = plan(all_queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_chunking_needs_no_exchange(spark):
    from corpusgraph.operators.chunk import chunk

    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("cast(doc_id as string) as page_path", "text as body")
    text = plan(chunk(docs))
    assert "Exchange" not in text and "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_top_k_is_cut_before_the_shuffle(spark):
    text = plan(all_queries()["bm25_top20"](spark, SF))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_edges_read_three_columns(spark):
    from corpusgraph.operators.edges import undirected_edges

    lines = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_suppkey as source_id", "l_partkey as target_id", "l_quantity as weight", "l_tax")
    text = plan(undirected_edges(lines))
    assert "l_tax" not in text.split("ReadSchema")[1].split("\n")[0] and "partial_sum" in text


def test_derived_inputs_name_only_their_tables():
    assert "lineitem" not in inputs.spark_sql("pages_v") and "documents" in inputs.spark_sql("pages_v")

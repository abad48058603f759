"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES
(comma-separated names, default the list below).  Every query is run to its end with
its whole result written to a sink that discards it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusgraph.plans import all_queries  # noqa: E402
from corpusgraph.session import local_session  # noqa: E402

HEADLINE = (
    "postings_plain", "bm25_top20", "hash_buckets_documents", "hybrid_search", "nearest_embeddings", "page_edges", "lint",
    "chunk", "parse_records", "merge_entities", "merge_order_lines", "undirected_edges", "k_hop", "spread", "components",
    "eigenvector_orders", "ingest_new", "html_to_markdown", "rehydrate", "settle_all",
)


def centrality_graph(spark, sf_dir):
    """10,000 nodes and 20,000 edges drawn from the order lines, the one size with a published time."""
    from pyspark.sql import functions as F

    from corpusgraph.operators.centrality import eigenvector

    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    a, b = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(10_000)), F.pmod(F.xxhash64("l_partkey", "l_extendedprice"), F.lit(10_000))
    edges = (
        lines.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
        .orderBy(F.xxhash64("a", "b")).limit(20_000).withColumn("weight", F.lit(1.0))
    )
    nodes = spark.range(10_000).withColumnRenamed("id", "entity_id")
    return eigenvector(edges, nodes, max_iterations=500, tolerance=1e-10).scores


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or [*HEADLINE, "eigenvector_10k_500_steps"]
    spark = local_session("bench")
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    queries = {**all_queries(), "eigenvector_10k_500_steps": centrality_graph}
    times = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()

"""Incremental upkeep of the page index, text units and the entity graph."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut
from .postings import build_postings
from .vectors import DIM, embed


def page_index(pages: DataFrame, now: str) -> DataFrame:
    """Index rows of pages: ``(page_path, title, page_type, content_hash, updated)``."""
    return pages.select(
        "page_path", "title", "page_type", F.sha2("body", 256).alias("content_hash"), F.lit(now).alias("updated")
    )


def diff_pages(current: DataFrame, index: DataFrame) -> DataFrame:
    """``(page_path, change)``: added, updated, unchanged or deleted, by body hash."""
    now = current.select("page_path", F.sha2("body", 256).alias("new_hash"))
    old = index.select("page_path", F.col("content_hash").alias("old_hash"))
    change = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("new_hash") != F.col("old_hash"), "updated")
        .otherwise("unchanged")
    )
    return now.join(old, "page_path", "full_outer").select("page_path", change.alias("change"))


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


class PageIndex(NamedTuple):
    index: DataFrame
    postings: DataFrame
    vectors: DataFrame


def index_docs(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_path").alias("doc_id"), "title", "body")


def build_index(pages: DataFrame, now: str, analyzer: str = "plain", embedder=None, dim: int = DIM) -> PageIndex:
    text = pages.select(F.col("page_path").alias("doc_id"), F.concat_ws("\n", "title", "body").alias("text"))
    return PageIndex(
        page_index(pages, now),
        build_postings(index_docs(pages), analyzer),
        embed(text, "doc_id", "text", embedder, dim),
    )


def apply_page_diff(
    pages: DataFrame, stored: PageIndex, now: str, analyzer: str = "plain", embedder=None, dim: int = DIM
) -> PageIndex:
    """New index tables; only added and updated pages are tokenised and embedded again."""
    diff = cut(diff_pages(pages, stored.index).where("change <> 'unchanged'"))
    fresh = pages.join(diff.where("change in ('added','updated')").select("page_path"), "page_path", "left_semi")
    part = build_index(fresh, now, analyzer, embedder, dim)
    gone = diff.select("page_path")
    gone_docs = gone.withColumnRenamed("page_path", "doc_id")
    return PageIndex(
        stored.index.join(gone, "page_path", "left_anti").unionByName(part.index),
        stored.postings.join(gone_docs, "doc_id", "left_anti").unionByName(part.postings),
        stored.vectors.join(gone_docs, "doc_id", "left_anti").unionByName(part.vectors),
    )


def index_or_rebuild(
    pages: DataFrame,
    stored: PageIndex | None,
    meta: DataFrame,
    embedder_id: str,
    now: str,
    read_only: bool = False,
    **kwargs,
) -> tuple[PageIndex, DataFrame]:
    """Apply the diff, or rebuild everything when the embedder's identity changed.

    ``meta(key, value)`` holds ``embedder_id``.  A read-only call never rebuilds.
    """
    row = meta.where("key = 'embedder_id'").select("value").first()
    current = row["value"] if row else None
    new_meta = meta.where("key <> 'embedder_id'").unionByName(
        meta.sparkSession.createDataFrame([("embedder_id", embedder_id)], "key string, value string")
    )
    if read_only and stored is not None:
        return stored, meta
    if stored is None or current != embedder_id:
        return build_index(pages, now, **kwargs), new_meta
    return apply_page_diff(pages, stored, now, **kwargs), new_meta


def diff_text_units(current: DataFrame, stored: DataFrame) -> DataFrame:
    """``(page_path, chunk_index, change)`` by chunk hash; a missing page deletes all its chunks."""
    new = current.select("page_path", "chunk_index", F.col("content_hash").alias("new_hash"))
    old = stored.select("page_path", "chunk_index", F.col("content_hash").alias("old_hash"))
    change = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("new_hash") != F.col("old_hash"), "updated")
        .otherwise("unchanged")
    )
    return new.join(old, ["page_path", "chunk_index"], "full_outer").select("page_path", "chunk_index", change.alias("change"))


def clear_text_units(links: DataFrame, claims: DataFrame, units: DataFrame, diff: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop entity links and claims of changed and deleted units."""
    keys = diff.where("change in ('updated','deleted')").select("page_path", "chunk_index")
    ids = units.join(keys, ["page_path", "chunk_index"], "left_semi").select("text_unit_id")
    return links.join(ids, "text_unit_id", "left_anti"), claims.join(ids, "text_unit_id", "left_anti")


class EntityGraph(NamedTuple):
    entities: DataFrame
    relationships: DataFrame
    claims: DataFrame
    text_unit_entities: DataFrame


def sweep_orphans(graph: EntityGraph) -> EntityGraph:
    """Drop entities without a text unit and their claims, then edges with a missing end."""
    live = graph.text_unit_entities.select("entity_id").distinct()
    entities = graph.entities.join(live, "entity_id", "left_semi")
    ids = entities.select("entity_id")
    claims = graph.claims.join(ids.withColumnRenamed("entity_id", "subject_id"), "subject_id", "left_semi")
    relationships = graph.relationships.join(
        ids.withColumnRenamed("entity_id", "source_id"), "source_id", "left_semi"
    ).join(ids.withColumnRenamed("entity_id", "target_id"), "target_id", "left_semi")
    return EntityGraph(entities, relationships, claims, graph.text_unit_entities)


def sweep_dependents(entities: DataFrame, table: DataFrame, key: str = "entity_id") -> DataFrame:
    """Rows of a vector or postings table whose entity survived."""
    return table.join(entities.select(F.col("entity_id").alias(key)), key, "left_semi")


def prune_reports(communities: DataFrame, reports: DataFrame) -> DataFrame:
    """Reports whose (level, cluster) still exists."""
    return reports.join(communities.select("level", "cluster").distinct(), ["level", "cluster"], "left_semi")


def replace_communities(spark: SparkSession, root: str, communities: DataFrame, reports: DataFrame) -> str:
    """Write both tables to a new snapshot folder, then flip the pointer to it.

    Readers see the old pair or the new pair, never a mixture.
    """
    version = uuid.uuid4().hex
    folder = f"{root.rstrip('/')}/{version}"
    communities.write.parquet(f"{folder}/communities")
    prune_reports(spark.read.parquet(f"{folder}/communities"), reports).write.parquet(f"{folder}/reports")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").parquet(
        f"{root.rstrip('/')}/current"
    )
    return folder


def current_snapshot(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    version = spark.read.parquet(f"{root.rstrip('/')}/current").first()["version"]
    folder = f"{root.rstrip('/')}/{version}"
    return spark.read.parquet(f"{folder}/communities"), spark.read.parquet(f"{folder}/reports")


def reindex_report(
    unit_diff: DataFrame,
    entities: DataFrame,
    deleted_entities: DataFrame,
    relationships: DataFrame,
    claims: DataFrame,
    misses: DataFrame,
) -> DataFrame:
    """The eight counters of one graph reindex, as one row."""
    changes = unit_diff.agg(
        F.count_if(F.col("change") == "added").alias("text_units_added"),
        F.count_if(F.col("change") == "updated").alias("text_units_updated"),
        F.count_if(F.col("change") == "deleted").alias("text_units_deleted"),
    )

    def total(df: DataFrame):
        return df.agg(F.count(F.lit(1)).alias("n")).scalar()

    return changes.select(
        "*",
        total(entities).alias("entities_upserted"),
        total(deleted_entities).alias("entities_deleted"),
        total(relationships).alias("relationships_upserted"),
        total(claims).alias("claims_upserted"),
        total(misses).alias("completions"),
    )

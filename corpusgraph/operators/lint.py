"""Link-graph health checks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from .links import count_links, dangling, make_stubs, page_order

# Fixed value: pages shorter than this are thin.
THIN_MIN_CHARS = 80


def lint_orphans(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages that link to nothing, not even to a missing page, and that nobody else links to.

    What a page links to is looked up by exact title, so the last page of a title decides.
    """
    silent = (
        pages.groupBy("title")
        .agg(F.max_by(count_links(F.col("body")), page_order(F.col("page_path"))).alias("n"))
        .where(F.col("n") == 0)
        .select("title")
    )
    linked = links.where(F.col("key") != F.lower("title")).select("key").distinct()
    return (
        pages.select("page_path", "title")
        .join(silent, "title", "left_semi")
        .withColumn("key", F.lower("title"))
        .join(linked, "key", "left_anti")
        .select("page_path", "title")
    )


def lint_dangling(pages: DataFrame, links: DataFrame) -> DataFrame:
    return dangling(pages, links).select("page_path", "title", "pos", "target")


def lint_thin(pages: DataFrame, min_chars: int = THIN_MIN_CHARS) -> DataFrame:
    """``needs-compile`` pages always, ``stub`` pages never, others when short."""
    chars = F.length(tx.strip(F.col("body")))
    thin = (
        F.when(F.array_contains("tags", "needs-compile"), F.lit(True))
        .when(F.array_contains("tags", "stub"), F.lit(False))
        .otherwise(chars < min_chars)
    )
    return pages.where(thin).select("page_path", "title", chars.alias("char_count"))


def lint_stale(pages: DataFrame, index: DataFrame) -> DataFrame:
    """Index rows whose page is gone or whose body hash differs; new pages are not stale."""
    current = pages.select("page_path", F.sha2("body", 256).alias("h"))
    return (
        index.select("page_path", "content_hash")
        .join(current, "page_path", "left")
        .where(F.col("h").isNull() | (F.col("h") != F.col("content_hash")))
        .select(
            "page_path",
            F.when(F.col("h").isNull(), F.lit("missing_on_disk")).otherwise(F.lit("content_changed")).alias("reason"),
        )
    )


def lint(pages: DataFrame, links: DataFrame, index: DataFrame, min_chars: int = THIN_MIN_CHARS) -> DataFrame:
    """All findings: ``(kind, page_path, detail)``; no row means healthy."""
    none = F.lit(None).cast("string")
    return (
        lint_orphans(pages, links).select(F.lit("orphan").alias("kind"), "page_path", none.alias("detail"))
        .unionByName(lint_dangling(pages, links).select(F.lit("dangling").alias("kind"), "page_path", F.col("target").alias("detail")))
        .unionByName(
            lint_thin(pages, min_chars).select(F.lit("thin").alias("kind"), "page_path", F.col("char_count").cast("string").alias("detail"))
        )
        .unionByName(lint_stale(pages, index).select(F.lit("stale").alias("kind"), "page_path", F.col("reason").alias("detail")))
    )


def lint_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


class LintFix(NamedTuple):
    pages: DataFrame
    index: DataFrame
    report: DataFrame


def lint_fix(pages: DataFrame, links: DataFrame, index: DataFrame, now: str) -> LintFix:
    """Create stubs for missing targets and refresh the index; report orphans and thin pages."""
    from .maintain import page_index
    from .pages import upsert_pages

    proposed = make_stubs(pages, links)
    written = upsert_pages(pages, proposed, now)
    kept = pages.join(written.select("page_path"), "page_path", "left_anti").select(
        "page_path", "title", "page_type", "tags", "frontmatter", "body"
    )
    fixed = kept.unionByName(written.select("page_path", "title", "page_type", "tags", "frontmatter", "body"))
    report = lint(pages, links, index).where(F.col("kind").isin("orphan", "thin"))
    return LintFix(fixed, page_index(fixed, now), report)

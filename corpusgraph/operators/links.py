"""Wiki links between pages: extraction, edges, backlinks, listings, stubs, rendering."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx


def page_order(path: Column) -> Column:
    """Collection order of a page: directory rank, then path.

    Fixed values: sources, entities, concepts, sessions come in this order.
    """
    folder = F.element_at(F.split(path, "/"), -2)
    rank = (
        F.when(folder == "sources", "0").when(folder == "entities", "1").when(folder == "concepts", "2")
        .when(folder == "sessions", "3").otherwise("4")
    )
    return F.concat(rank, path)


def count_links(body: Column) -> Column:
    return F.size(F.regexp_extract_all(body, F.lit(tx.LINK_PATTERN), F.lit(0)))


def extract_links(pages: DataFrame) -> DataFrame:
    """One row per link occurrence: ``(page_path, title, pos, target, key, alias)``.

    ``pos`` counts from 0 in body order; ``key`` is the lower-cased target; the text
    after ``|`` or ``#`` is the alias, empty when there is none.
    """
    found = pages.select(
        "page_path",
        "title",
        F.posexplode_outer(F.regexp_extract_all("body", F.lit(tx.LINK_PATTERN), F.lit(0))).alias("pos", "raw"),
    ).where("raw is not null")
    target = tx.strip(F.regexp_extract("raw", tx.LINK_PATTERN, 1))
    return found.select(
        "page_path",
        "title",
        "pos",
        target.alias("target"),
        F.lower(target).alias("key"),
        tx.strip(F.regexp_extract("raw", tx.LINK_PATTERN, 2)).alias("alias"),
        "raw",
    )


def title_index(pages: DataFrame) -> DataFrame:
    """``(key, page_path, title)``: lower-cased title to the last page that bears it."""
    return (
        pages.groupBy(F.lower("title").alias("key"))
        .agg(F.max_by(F.struct("page_path", "title"), page_order(F.col("page_path"))).alias("p"))
        .select("key", "p.page_path", "p.title")
    )


def page_edges(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct resolved links between two different pages: ``(source, target)``.

    Repeats are dropped before the join; a key names one page, so none come back.
    """
    titles = title_index(pages).select("key", F.col("page_path").alias("target"))
    return (
        links.select(F.col("page_path").alias("source"), "key")
        .distinct()
        .join(titles, "key")
        .where(F.col("source") != F.col("target"))
        .select("source", "target")
    )


def _inbound(links: DataFrame) -> DataFrame:
    """Links that leave their own title: ``(key, title)`` with repeats."""
    return links.where(F.col("key") != F.lower("title")).select("key", "title")


def backlink_counts(links: DataFrame) -> DataFrame:
    """Occurrences per target title, repeats counted."""
    return _inbound(links).groupBy("key").agg(F.count(F.lit(1)).alias("backlink_count"))


def backlinks(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct linking titles per page, one row each, with their page when it exists.

    Rows rather than arrays, so a page that a third of the corpus links to stays
    spread over tasks.
    """
    titles = title_index(pages)
    return (
        pages.select("page_path", F.lower("title").alias("key"))
        .join(_inbound(links).distinct().withColumnRenamed("title", "source_title"), "key")
        .withColumn("source_key", F.lower("source_title"))
        .join(titles.select(F.col("key").alias("source_key"), F.col("page_path").alias("source_path")), "source_key", "left")
        .select("page_path", "source_title", "source_path")
    )


def page_list(pages: DataFrame, links: DataFrame, text_filter: str | None = None) -> DataFrame:
    """Listing ordered by lower-cased title, with link and backlink counts."""
    df = pages
    if text_filter:
        needle = F.lit(text_filter.lower())
        in_tags = F.exists("tags", lambda t: F.contains(F.lower(t), needle))
        df = df.where(F.contains(F.lower("title"), needle) | in_tags)
    return (
        df.select("page_path", "title", "page_type", "tags", count_links(F.col("body")).alias("link_count"))
        .withColumn("key", F.lower("title"))
        .join(backlink_counts(links), "key", "left")
        .withColumn("backlink_count", F.coalesce("backlink_count", F.lit(0)))
        .orderBy("key", "page_path")
        .drop("key")
    )


def outbound(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Every link occurrence with its page, or null when it dangles."""
    titles = title_index(pages).select("key", F.col("page_path").alias("target_path"))
    return links.join(titles, "key", "left").select("page_path", "pos", "target", "target_path")


class PageDetail(NamedTuple):
    page: DataFrame
    outbound: DataFrame
    backlinks: DataFrame


def page_detail(pages: DataFrame, links: DataFrame, path: str) -> PageDetail:
    """One page with its outgoing links and distinct backlinks."""
    page = pages.where(F.col("page_path") == path)
    out = outbound(pages, links.where(F.col("page_path") == path))
    mine = page.select(F.lower("title").alias("key"))
    inbound = _inbound(links).join(mine, "key", "left_semi").select("title").distinct()
    titles = title_index(pages)
    back = (
        inbound.withColumn("key", F.lower("title"))
        .join(titles.select("key", "page_path"), "key", "left")
        .select("title", F.col("page_path").alias("path"))
        .orderBy("title")
    )
    return PageDetail(page, out.orderBy("pos"), back)


def dangling(pages: DataFrame, links: DataFrame) -> DataFrame:
    """One row per occurrence whose target is no page title."""
    titles = pages.select(F.lower("title").alias("key")).distinct()
    return links.join(titles, "key", "left_anti").select("page_path", "title", "pos", "target", "key")


def make_stubs(pages: DataFrame, links: DataFrame) -> DataFrame:
    """One proposed concept page per missing target, in the first spelling seen."""
    order = F.struct(page_order(F.col("page_path")), F.col("pos"))
    firsts = dangling(pages, links).groupBy("key").agg(F.min_by("target", order).alias("title"))
    note = F.concat(
        F.lit("Stub page — created automatically because it was referenced via [["),
        F.col("title"),
        F.lit("]] but did not yet exist.\n"),
    )
    return firsts.select(
        F.concat(F.lit("wiki/concepts/"), tx.slug(F.col("title")), F.lit(".md")).alias("page_path"),
        F.lit("concept").alias("page_type"),
        "title",
        note.alias("body"),
        F.array(F.lit("stub")).alias("tags"),
        F.lit(None).cast("string").alias("source_hash"),
    )


def catalogue(pages: DataFrame, links: DataFrame, now: str) -> DataFrame:
    """Snapshot rows ``(snapshot_at, page_path, title, backlink)``.

    One row per page and distinct backlink other than itself; a page without any has
    one row with a null backlink.  When titles differ only in case, a link belongs
    to the first.  Append each snapshot to the catalogue table.
    """
    firsts = pages.groupBy(F.lower("title").alias("key")).agg(
        F.min_by("title", page_order(F.col("page_path"))).alias("to_title")
    )
    pairs = (
        links.select("key", F.col("title").alias("backlink"))
        .distinct()
        .join(firsts, "key")
        .where(F.col("backlink") != F.col("to_title"))
        .select("to_title", "backlink")
    )
    return (
        pages.select("page_path", "title")
        .join(pairs, F.col("title") == F.col("to_title"), "left")
        .select(F.lit(now).alias("snapshot_at"), "page_path", "title", "backlink")
    )


def catalogue_lines(snapshot: DataFrame) -> DataFrame:
    """Text lines of a snapshot, one per page and backlink, in listing order."""
    shown = F.when(F.col("backlink").isNull(), F.lit("(none)")).otherwise(
        F.concat(F.lit("[["), F.col("backlink"), F.lit("]]"))
    )
    line = F.concat(F.lit("- [["), F.col("title"), F.lit("]] (`"), F.col("page_path"), F.lit("`) — backlinks: "), shown)
    return snapshot.orderBy(F.lower("title"), "page_path", F.lower("backlink")).select(line.alias("line"))


def render_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """``(page_path, html)``: links become anchors or dangling spans, other text is escaped.

    Links of one page are bounded by its body, so they are gathered per page.
    """
    titles = title_index(pages).select("key", F.col("page_path").alias("target_path"))
    shown = tx.escape_html(F.when(F.col("alias") == "", F.col("target")).otherwise(F.col("alias")))
    anchor = F.when(
        F.col("target_path").isNull(),
        F.concat(
            F.lit('<span class="wikilink dangling" title="page not found: '),
            tx.escape_html(F.col("target")),
            F.lit('">'),
            shown,
            F.lit("</span>"),
        ),
    ).otherwise(
        F.concat(
            F.lit('<a class="wikilink" href="/#/page?path='), tx.quote_path(F.col("target_path")), F.lit('">'), shown, F.lit("</a>")
        )
    )
    anchors = (
        links.join(titles, "key", "left")
        .withColumn("anchor", anchor)
        .groupBy("page_path")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "anchor"))).alias("a"))
        .select("page_path", F.transform("a", lambda s: s["anchor"]).alias("anchors"))
    )
    segments = F.transform(F.split("body", tx.LINK_PATTERN), tx.escape_html)
    return (
        pages.select("page_path", "body")
        .join(anchors, "page_path", "left")
        .select(
            "page_path",
            F.array_join(
                F.flatten(
                    F.zip_with(
                        segments,
                        F.coalesce("anchors", F.array().cast("array<string>")),
                        lambda t, a: F.array(t, F.coalesce(a, F.lit(""))),
                    )
                ),
                "",
            ).alias("html"),
        )
    )


def render_snippet(snippet: Column) -> Column:
    """Escape a snippet but keep its ``<mark>`` tags."""
    c = tx.escape_html(snippet)
    c = F.replace(c, F.lit("&lt;mark&gt;"), F.lit("<mark>"))
    return F.replace(c, F.lit("&lt;/mark&gt;"), F.lit("</mark>"))

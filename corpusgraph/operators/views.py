"""Node enrichment and graph views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from .records import normalize_title

# Node size range, view cap, tier labels.
MIN_SIZE, MAX_SIZE = 0.6, 3.2
VIEW_CAP = 1500
TIER_LABELS = ("Basin", "Lowland", "Midland", "Highland", "Peak")
NO_CENTRALITY = 0.1


def enrich_nodes(communities: DataFrame, degrees: DataFrame, scores: DataFrame) -> DataFrame:
    """Finest community, its level, both centralities and the ancestors of every clustered entity.

    ``communities(level, cluster, entity_id)``, ``degrees(entity_id, degree)``,
    ``scores(entity_id, score)``.  Levels per entity are few, so the ancestor map is small.
    """
    finest = communities.groupBy("entity_id").agg(
        F.max("level").alias("level"),
        F.max_by("cluster", "level").alias("community"),
        F.map_from_entries(F.collect_list(F.struct("level", "cluster"))).alias("all_levels"),
    )
    with_degree = finest.join(degrees, "entity_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    top = finest.select("entity_id").join(degrees, "entity_id").agg(F.max("degree").alias("m")).scalar()
    return with_degree.join(scores, "entity_id", "left").select(
        "entity_id",
        "community",
        "level",
        F.struct(
            F.when(top > 0, F.round(F.col("degree") / top, 6)).otherwise(F.lit(0.0)).alias("degree"),
            F.round(F.coalesce("score", F.lit(0.0)), 6).alias("eigenvector"),
        ).alias("centrality"),
        F.map_filter("all_levels", lambda k, v: k != F.col("level")).alias("parent_community"),
    )


def edge_counts(edges: DataFrame) -> DataFrame:
    """``(id, n)``: edges per end; a self-loop counts twice."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def viz_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Add ``size``: 0.6 + 2.6 · √(degree / largest edge count).

    A node's own degree is used when it has one, else its edge count; the largest is
    over edge counts and at least 1.
    """
    counts = edge_counts(edges)
    top = F.greatest(F.coalesce(nodes.select("id").join(counts, "id").agg(F.max("n").alias("m")).scalar(), F.lit(1)), F.lit(1))
    own = F.coalesce("degree", "n", F.lit(0)) if "degree" in nodes.columns else F.coalesce("n", F.lit(0))
    return (
        nodes.join(counts, "id", "left")
        .withColumn("degree", own)
        .withColumn("size", F.lit(MIN_SIZE) + F.sqrt(F.col("degree") / top) * (MAX_SIZE - MIN_SIZE))
        .drop("n")
    )


def visible_graph(
    nodes: DataFrame,
    edges: DataFrame,
    cap: int = VIEW_CAP,
    expanded: DataFrame | None = None,
    types: tuple[str, ...] = (),
    communities: tuple[int, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """The ``cap`` nodes of highest degree, the expanded ones and their neighbours, then the filters."""
    base = nodes.orderBy(F.desc("degree"), "id").limit(cap).select("id")
    if expanded is not None:
        ids = expanded.select("id")
        out = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))
        back = edges.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id"))
        base = base.unionByName(ids).unionByName(out).unionByName(back).distinct()
    shown = nodes.join(base, "id", "left_semi")
    if types:
        shown = shown.where(F.col("type").isin(*types))
    if communities:
        shown = shown.where(F.col("community").isin(*communities))
    ids = shown.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(
        ids.withColumnRenamed("id", "target"), "target", "left_semi"
    )
    return shown, kept


def by_community(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups ``(community, members)`` and their ordered member rows ``(community, id)``."""
    groups = nodes.groupBy("community").agg(F.count(F.lit(1)).alias("members")).orderBy("community")
    return groups, nodes.select("community", "id").orderBy("community", "id")


def by_level(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups ``(level, community, members, parent_community)`` and member rows.

    A missing level is 0; the ancestor map is that of the first member, by id, that has one.
    """
    n = nodes.withColumn("level", F.coalesce("level", F.lit(0)))
    has = F.col("parent_community").isNotNull() & (F.size("parent_community") > 0)
    # a map cannot be compared but can be carried by min_by
    first = F.min_by(F.when(has, F.map_entries("parent_community")), F.when(has, F.col("id")))
    groups = n.groupBy("level", "community").agg(
        F.count(F.lit(1)).alias("members"), F.map_from_entries(first).alias("parent_community")
    )
    return groups.orderBy("level", "community"), n.select("level", "community", "id").orderBy("level", "community", "id")


def elevation_tier(value: Column) -> Column:
    clamped = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
    return F.least(F.floor(clamped * 5), F.lit(4)).cast("int")


def by_tier(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tiers ``(tier, label, members, elevation)``, highest first, and member rows."""
    value = F.coalesce("centrality", F.lit(NO_CENTRALITY))
    tiered = nodes.select("id", value.alias("elevation")).withColumn("tier", elevation_tier(F.col("elevation")))
    label = F.element_at(F.array(*[F.lit(x) for x in TIER_LABELS]), F.col("tier") + 1)
    groups = (
        tiered.groupBy("tier")
        .agg(F.count(F.lit(1)).alias("members"), F.avg("elevation").alias("elevation"))
        .select("tier", label.alias("label"), "members", "elevation")
        .orderBy(F.desc("tier"))
    )
    return groups, tiered.select("tier", "id").orderBy(F.desc("tier"), "id")


def page_nodes(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("page_path").alias("id"), F.col("title").alias("label"), F.col("page_type").alias("type"), F.lit("page").alias("kind")
    )


def entity_nodes(entities: DataFrame, enrichment: DataFrame | None = None) -> DataFrame:
    named = F.concat(F.lit("entity:"), F.col("entity_id").cast("string"))
    nodes = entities if enrichment is None else entities.join(enrichment, "entity_id", "left")
    extra = [] if enrichment is None else [c for c in enrichment.columns if c != "entity_id"]
    return nodes.select(
        named.alias("id"), F.col("title").alias("label"), "type", F.lit("entity").alias("kind"), "degree", *extra, "entity_id"
    )


def entity_edges(relationships: DataFrame) -> DataFrame:
    def named(c):
        return F.concat(F.lit("entity:"), F.col(c).cast("string"))

    return relationships.select(
        named("source_id").alias("source"), named("target_id").alias("target"), "type", F.col("weight").cast("double").alias("weight"),
        "source_id", "target_id",
    )


def graph_view(
    mode: str,
    pages: DataFrame | None = None,
    page_edges: DataFrame | None = None,
    entities: DataFrame | None = None,
    relationships: DataFrame | None = None,
    enrichment: DataFrame | None = None,
    identity: tuple[DataFrame, DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the ``wikilinks``, ``entities`` or ``both`` view.

    ``both`` takes ``identity = (page_hashes, entity_stems)`` and merges a page with the
    entity it stands for (:func:`merge_identity`).
    """
    if mode not in ("wikilinks", "entities", "both"):
        raise ValueError(f"unknown view {mode!r}")
    if mode == "wikilinks":
        return page_nodes(pages).drop("kind").orderBy("id"), page_edges.orderBy("source", "target")
    e_nodes, e_edges = entity_nodes(entities, enrichment), entity_edges(relationships)
    if mode == "entities":
        return (
            e_nodes.orderBy("entity_id").drop("entity_id"),
            e_edges.orderBy("source_id", "target_id", "type").drop("source_id", "target_id"),
        )
    hashes, stems = identity
    return merge_identity(
        page_nodes(pages), page_edges, e_nodes.drop("entity_id"), e_edges.drop("source_id", "target_id"), hashes, stems
    )


def identity_pairs(pages: DataFrame, entities: DataFrame, page_hashes: DataFrame, entity_stems: DataFrame) -> DataFrame:
    """``(page_id, entity_id)`` that are the same thing.

    Titles must match one to one after normalising, and the page's source hash must be
    the stem of a document the entity was extracted from.  ``page_hashes(id,
    source_hash)``, ``entity_stems(id, stem)``.
    """

    def unique(nodes: DataFrame, name: str) -> DataFrame:
        keyed = nodes.select(normalize_title(F.col("label")).alias("key"), F.col("id"))
        return (
            keyed.where("key <> ''").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias(name)).where("n = 1").drop("n")
        )

    proven = entity_stems.select(F.col("id").alias("entity_id"), F.col("stem").alias("source_hash")).distinct()
    return (
        unique(pages, "page_id")
        .join(unique(entities, "entity_id"), "key")
        .join(page_hashes.select(F.col("id").alias("page_id"), "source_hash").where("source_hash <> ''"), "page_id")
        .join(proven, ["entity_id", "source_hash"], "left_semi")
        .select("page_id", "entity_id")
    )


def merge_identity(
    pages: DataFrame,
    page_edges: DataFrame,
    entities: DataFrame,
    entity_edges_: DataFrame,
    page_hashes: DataFrame,
    entity_stems: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Union of both graphs with page-backed entities merged into their page.

    The page's id, label, type and kind stay; the entity's extra columns except its
    degree come along with its id as ``entity_twin``.  Edges move to the page; edges that
    become loops go; a page edge equal to a moved edge gives way to it.
    """
    pairs = identity_pairs(pages, entities, page_hashes, entity_stems)
    extras = [c for c in entities.columns if c not in ("id", "label", "type", "kind", "degree")]
    carried = entities.select(F.col("id").alias("entity_id"), *extras).join(pairs, "entity_id")
    merged_pages = (
        pages.join(carried.withColumnRenamed("page_id", "id"), "id", "left")
        .withColumnRenamed("entity_id", "entity_twin")
    )
    others = entities.join(pairs.select(F.col("entity_id").alias("id")), "id", "left_anti")
    nodes = merged_pages.unionByName(others, allowMissingColumns=True)

    moved = entity_edges_
    for end in ("source", "target"):
        to = pairs.select(F.col("entity_id").alias(end), F.col("page_id").alias("_to"))
        moved = moved.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    moved = moved.where("source <> target")
    kept = page_edges.join(moved.select("source", "target").distinct(), ["source", "target"], "left_anti")
    return nodes, kept.unionByName(moved, allowMissingColumns=True)


def page_source_hashes(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_path").alias("id"), F.col("frontmatter")["source_hash"].alias("source_hash")).where(
        "source_hash is not null"
    )


def entity_source_stems(sources: DataFrame) -> DataFrame:
    """``(entity_id, page_path)`` provenance to ``(id, stem)``."""
    return sources.select(
        F.concat(F.lit("entity:"), F.col("entity_id").cast("string")).alias("id"), tx.stem(F.col("page_path")).alias("stem")
    ).distinct()

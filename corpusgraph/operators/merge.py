"""Merging mentions into entities, relationships, provenance, degree and vectors.

The total order of mentions is ``(page_path, chunk_index, ordinal)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut
from .traverse import QUESTION_BITS, numbered_off, set_bits
from .vectors import DIM, embed

ORDER = ("page_path", "chunk_index", "ordinal")


def entity_id(title: Column, type_: Column) -> Column:
    return F.xxhash64(title, type_)


def _ranges(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Number contiguous ranges of the total order, so that one entity spreads over tasks."""
    return df.repartitionByRange(*order).withColumn("range", F.spark_partition_id())


def merge_entities(mentions: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """``(entity_id, title, type, description)`` from ``mentions(title, type, description, *order)``.

    The description is an ordered fold: an empty one takes the new text; an empty new
    text, or one equal to everything gathered so far, changes nothing; any other is
    appended after a blank.  Runs of equal text are first counted inside contiguous
    ranges of the order and the fold then walks runs, which gives the same string: a
    run on top of its own text is absorbed, any other run is appended whole.

    Only a description that is no longer than an entity's longest text can absorb.  A run
    that is not absorbed adds two characters or more, and of two runs in a range one is not,
    so so many runs settle the matter; behind them nothing is absorbed any more and the
    runs of each range join to one piece, in parallel.  An entity with a third
    of all mentions is thus reduced in every range, and only pieces meet.
    """
    used = mentions.select("title", "type", "description", *order)
    ranged = cut(_ranges(used, order))
    spoken = ranged.where(F.coalesce("description", F.lit("")) != "")
    key = ["title", "type"]
    w = Window.partitionBy(*key, "range").orderBy(*order)
    runs = (
        spoken.withColumn("prev", F.lag("description").over(w))
        .withColumn("new_run", (F.col("prev").isNull() | (F.col("prev") != F.col("description"))).cast("int"))
        .withColumn("run", F.sum("new_run").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*key, "range", "run")
        .agg(F.first("description").alias("text"), F.count(F.lit(1)).cast("int").alias("times"))
    )
    # one row for each entity and range
    counts = cut(runs.groupBy(*key, "range").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("longest")))
    earlier = Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key)
    bounds = counts.select(
        *key, "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        (F.max("longest").over(whole) + F.count(F.lit(1)).over(whole) + 2).alias("settled"), F.sum("n").over(whole).alias("runs"),
    )
    many = cut(bounds.where(F.col("runs") > F.col("settled")).drop("runs"))
    placed = runs.join(many, [*key, "range"], "left").withColumn("late", F.coalesce(F.col("before") + F.col("run") > F.col("settled"), F.lit(False)))
    folded = F.aggregate(
        F.array_sort(F.collect_list(F.struct("range", "run", "text", "times"))),
        F.lit(""),
        lambda acc, r: F.when((acc == "") | (acc == r["text"]), r["text"]).otherwise(
            F.concat(acc, F.repeat(F.concat(F.lit(" "), r["text"]), r["times"]))
        ),
    )
    heads = placed.where(~F.col("late")).groupBy(*key).agg(folded.alias("head"))
    piece = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "text", "times"))), lambda r: F.repeat(F.concat(F.lit(" "), r["text"]), r["times"])), "")
    pieces = placed.where("late").groupBy(*key, "range").agg(piece.alias("piece"))
    tails = pieces.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "piece"))), lambda p: p["piece"]), "").alias("tail"))
    texts = heads.join(tails, key, "left").select(*key, F.concat("head", F.coalesce("tail", F.lit(""))).alias("description"))
    return (
        ranged.select(*key).distinct()
        .join(texts, key, "left")
        .select(
            entity_id(F.col("title"), F.col("type")).alias("entity_id"),
            "title",
            "type",
            F.coalesce("description", F.lit("")).alias("description"),
        )
    )


def resolve_relationships(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Endpoints looked up among the entities of the same unit; unresolved ones drop out.

    A title under two types in one unit means the last of them.
    """
    ids = (
        entities.groupBy("text_unit_id", "title")
        .agg(F.max_by("type", "ordinal").alias("type"))
        .select("text_unit_id", "title", entity_id(F.col("title"), F.col("type")).alias("id"))
    )
    src = ids.select("text_unit_id", F.col("title").alias("source"), F.col("id").alias("source_id"))
    dst = ids.select("text_unit_id", F.col("title").alias("target"), F.col("id").alias("target_id"))
    return relationships.join(src, ["text_unit_id", "source"]).join(dst, ["text_unit_id", "target"])


def merge_relationships(mentions: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """``(source_id, target_id, type, description, weight)``: strongest weight, last non-empty text."""
    last = F.max_by(
        F.when(F.col("description") != "", F.col("description")),
        F.when(F.col("description") != "", F.struct(*order)),
    )
    kind = F.col("type") if "type" in mentions.columns else F.lit("related")
    return (
        mentions.withColumn("type", kind)
        .groupBy("source_id", "target_id", "type")
        .agg(F.coalesce(last, F.lit("")).alias("description"), F.max("weight").alias("weight"))
    )


def text_unit_entities(mentions: DataFrame) -> DataFrame:
    """Distinct ``(text_unit_id, entity_id)``."""
    return mentions.select("text_unit_id", entity_id(F.col("title"), F.col("type")).alias("entity_id")).distinct()


def entity_sources(links: DataFrame, units: DataFrame) -> DataFrame:
    """Distinct ``(entity_id, page_path)``: the documents an entity was found in, one row each."""
    return links.join(units.select("text_unit_id", "page_path"), "text_unit_id").select("entity_id", "page_path").distinct()


def first_named(named: DataFrame, own: DataFrame, order: tuple[str, ...], limit: int, key: str = "question_id") -> DataFrame:
    """``(key, …, nth)``: per key, the first ``limit`` distinct rows of ``own(entity_id, …)`` that its entities have.

    ``named(key, entity_id)``.  Keys meet the rows as bitmaps, one for every ``QUESTION_BITS`` of them, so a
    row that many entities of a key share moves once; keys part again where the first of each part are taken.
    """
    columns = [c for c in own.columns if c != "entity_id"]
    numbered = numbered_off(named, QUESTION_BITS, key)
    bits = named.join(numbered, key).groupBy("entity_id", "block").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits"))
    rows = own.join(bits, "entity_id").groupBy("block", *columns).agg(F.bit_or("bits").alias("bits"))
    nth = F.row_number().over(Window.partitionBy("block", "place").orderBy(*order))
    first = rows.select("block", *columns, set_bits(F.col("bits")).alias("place")).withColumn("nth", nth).where(F.col("nth") <= limit)
    return first.join(numbered, ["block", "place"]).select(key, *columns, "nth")


def units_for_entities(wanted: DataFrame, links: DataFrame, units: DataFrame, limit: int = 20, key: str = "question_id") -> DataFrame:
    """Per key, the first ``limit`` distinct units of its entities, by page and chunk.

    Of an entity's units only its own first ``limit`` can be among them, so a hub brings no more
    than any other entity to the keys that name it; texts are fetched for the chosen units alone.
    """
    order = ("page_path", "chunk_index")
    named = wanted.select(key, "entity_id").distinct()
    places = units.select("text_unit_id", *order)
    own = (
        links.select("entity_id", "text_unit_id").join(named.select("entity_id").distinct(), "entity_id", "left_semi").distinct()
        .join(places, "text_unit_id")
        .withColumn("nth", F.row_number().over(Window.partitionBy("entity_id").orderBy(*order)))
        .where(F.col("nth") <= limit).drop("nth")
    )
    chosen = first_named(named, own, order, limit, key)
    return chosen.join(units.select("text_unit_id", "text"), "text_unit_id")


def degree(relationships: DataFrame) -> DataFrame:
    """``(entity_id, degree)``: relationships at either end; a self-loop counts once."""
    ends = F.array_distinct(F.array("source_id", "target_id"))
    return relationships.select(F.explode(ends).alias("entity_id")).groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("degree")
    )


def with_degree(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    return entities.drop("degree").join(degree(relationships), "entity_id", "left").withColumn(
        "degree", F.coalesce("degree", F.lit(0))
    )


def report_id(level: Column, cluster: Column) -> Column:
    return F.xxhash64(level, cluster)


def embed_graph(
    entities: DataFrame, units: DataFrame, reports: DataFrame | None = None, embedder=None, dim: int = DIM
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Vectors of entities (title and description), units (text) and reports (title and summary)."""
    e = embed(
        entities.select("entity_id", F.concat_ws("\n", "title", "description").alias("text")), "entity_id", "text", embedder, dim
    )
    u = embed(units.select("text_unit_id", "text"), "text_unit_id", "text", embedder, dim)
    r = None
    if reports is not None:
        r = embed(reports.select(report_id(F.col("level"), F.col("cluster")).alias("report_id"), F.concat_ws("\n", "title", "summary").alias("text")), "report_id", "text", embedder, dim)
    return e, u, r

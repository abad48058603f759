"""Community reports: prompts, parsing, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..session import cut
from .completions import Completer, complete, with_cache_key

# Defaults of an unreadable report.
DEFAULT_TITLE = "Untitled community"
DEFAULT_RATING = 5.0
# Lines of one prompt; a larger community gets several prompts, each with its part.
PART_LINES = 5_000
# Lines that are joined to one piece before the pieces of a whole community meet.
PIECE_LINES = 50_000

_SYSTEM = (
    "Write a report on one cluster of a knowledge graph from its member entities and their relationships. "
    'Answer only with one JSON object {"title": short title, "summary": 1-3 sentences, "rating": 0-10}.'
)


def number_text(c: Column) -> Column:
    """A double as text, with one decimal when it is whole."""
    d = c.cast("double")
    whole = d == F.floor(d)
    return F.when(whole, F.concat(d.cast("bigint").cast("string"), F.lit(".0"))).otherwise(d.cast("string"))


def _rows_of_parts(lines: DataFrame, part_lines: int) -> DataFrame:
    """Lines dealt by hash over as many parts as their community needs."""
    parts = lines.groupBy("level", "cluster").agg(F.ceil(F.count(F.lit(1)) / F.lit(part_lines)).cast("int").alias("parts"))
    place = F.conv(F.substring(F.md5(F.concat_ws("|", "block", "k1", "k2", "k3")), 1, 8), 16, 10).cast("long")
    # few rows, so that the lines need not move to meet them
    dealt = lines.join(cut(parts), ["level", "cluster"]).withColumn("part", F.pmod(place, F.col("parts")).cast("int"))
    return dealt.groupBy("level", "cluster", "parts", "part").agg(
        F.array_sort(F.collect_list(F.struct("block", "k1", "k2", "k3", "line"))).alias("rows")
    )


def _rows_of_whole(lines: DataFrame) -> DataFrame:
    """All lines of each community, joined to pieces inside ranges of their order, so that only pieces meet."""
    lines = cut(lines)
    order = ("level", "cluster", "block", "k1", "k2", "k3")
    ranged = lines.repartitionByRange(max(1, -(-lines.count() // PIECE_LINES)), *order).withColumn("range", F.spark_partition_id())
    piece = F.array_sort(F.collect_list(F.struct("k1", "k2", "k3", "line")))
    pieces = ranged.groupBy("level", "cluster", "block", "range").agg(F.array_join(F.transform(piece, lambda r: r["line"]), "\n").alias("line"))
    return pieces.groupBy("level", "cluster").agg(F.array_sort(F.collect_list(F.struct("block", "range", "line"))).alias("rows")).select(
        "level", "cluster", F.lit(1).alias("parts"), F.lit(0).alias("part"), "rows"
    )


def report_prompts(
    communities: DataFrame, entities: DataFrame, relationships: DataFrame, part_lines: int | None = PART_LINES
) -> DataFrame:
    """``(level, cluster, part, parts, system, user)``: member lines and inner relationship lines.

    A community within ``part_lines`` lines has one prompt.  A larger one is dealt by
    hash (the first eight digits of the MD5 of a line's key) over as many parts as it needs, so
    no group is larger than a part and no member is left out.  Without ``part_lines`` every
    community has one prompt, whatever its size.
    """
    members = communities.select("level", "cluster", "entity_id")
    member_rows = members.join(entities, "entity_id").select(
        "level", "cluster", F.lit(0).alias("block"), F.col("entity_id").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit("").alias("k3"),
        F.concat(F.lit("- "), F.col("title"), F.lit(" ("), F.col("type"), F.lit("): "), F.col("description")).alias("line"),
    )
    src = members.select("level", "cluster", F.col("entity_id").alias("source_id"))
    dst = members.select("level", "cluster", F.col("entity_id").alias("target_id"))
    inner = relationships.join(src, "source_id").join(dst, ["level", "cluster", "target_id"])
    edge_rows = inner.select(
        "level", "cluster", F.lit(1).alias("block"), F.col("source_id").alias("k1"), F.col("target_id").alias("k2"), F.col("type").alias("k3"),
        F.concat(
            F.lit("- "), F.col("source_id").cast("string"), F.lit(" -> "), F.col("target_id").cast("string"), F.lit(" ("), F.col("type"),
            F.lit("): "), F.col("description"), F.lit(" [weight "), number_text(F.col("weight")), F.lit("]"),
        ).alias("line"),
    )
    lines = member_rows.unionByName(edge_rows)
    grouped = _rows_of_whole(lines) if part_lines is None else _rows_of_parts(lines, part_lines)

    def block(n: int, empty: str) -> Column:
        text = F.array_join(F.transform(F.filter("rows", lambda r: r["block"] == n), lambda r: r["line"]), "\n")
        return F.when(text == "", F.lit(empty)).otherwise(text)

    user = F.concat(
        F.lit("Community level "), F.col("level").cast("string"), F.lit(", cluster "), F.col("cluster").cast("string"), F.lit(".\n\nMember entities:\n"),
        block(0, "(no member entities)"), F.lit("\n\nRelationships:\n"), block(1, "(no relationships within this community)"),
        F.lit("\n\nWrite the community report now, as the single JSON object described above.\n"),
    )
    return grouped.select("level", "cluster", "part", "parts", F.lit(_SYSTEM).alias("system"), user.alias("user"))


def outer_object(c: Column) -> Column:
    """Text from the first ``{`` to the last ``}``; empty when there is none."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def parse_report(response: Column) -> Column:
    """``struct<title, summary, rating>`` of an answer; never fails."""
    v = F.try_parse_json(outer_object(F.coalesce(response, F.lit(""))))
    title = tx.strip(F.try_variant_get(v, "$.title", "string"))
    summary = tx.strip(F.try_variant_get(v, "$.summary", "string"))
    rating = F.try_variant_get(v, "$.rating", "string").try_cast("double")
    return F.struct(
        F.when(F.coalesce(title, F.lit("")) == "", F.lit(DEFAULT_TITLE)).otherwise(title).alias("title"),
        F.coalesce(summary, F.lit("")).alias("summary"),
        F.coalesce(rating, F.lit(DEFAULT_RATING)).alias("rating"),
    )


def parse_reports(answers: DataFrame) -> DataFrame:
    """``answers(level, cluster, response, …)`` to reports.

    The parts of a large community are put together: first title, summaries in order,
    highest rating.
    """
    has_part = "part" in answers.columns
    rows = answers.withColumn("r", parse_report(F.col("response"))).withColumn("part", F.col("part") if has_part else F.lit(0))
    one = rows.groupBy("level", "cluster").agg(
        F.min_by("r.title", "part").alias("title"),
        F.array_sort(F.collect_list(F.struct("part", F.col("r.summary").alias("s"), "response"))).alias("p"),
        F.max("r.rating").alias("rating"),
    )
    return one.select(
        "level",
        "cluster",
        "title",
        F.array_join(F.filter(F.transform("p", lambda x: x["s"]), lambda s: s != ""), " ").alias("summary"),
        F.array_join(F.transform("p", lambda x: x["response"]), "\n").alias("full_content"),
        "rating",
    )


def upsert_reports(
    communities: DataFrame,
    entities: DataFrame,
    relationships: DataFrame,
    stored: DataFrame | None,
    cache: DataFrame,
    completer: Completer | None = None,
    model: str = "mock",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reports of all current communities over the stored ones, the new cache, and the misses.

    An unchanged community has an unchanged prompt and costs no completion.
    """
    done = complete(with_cache_key(report_prompts(communities, entities, relationships), model), cache, completer)
    new = parse_reports(done.answered.where("response is not null"))
    if stored is not None:
        rest = stored.join(new.select("level", "cluster"), ["level", "cluster"], "left_anti")
        new = rest.select(*new.columns).unionByName(new)
    return new, done.cache, done.misses


def list_reports(reports: DataFrame, level: int | None = None) -> DataFrame:
    chosen = reports if level is None else reports.where(F.col("level") == level)
    return chosen.orderBy("level", "cluster")

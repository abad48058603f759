"""Registry of the check queries and the helpers they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Add a query; ``oracle`` is the same result as SQL for the comparison engine."""

    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def with_views(*names: str, **ctes: str) -> str:
    """A ``WITH`` clause over derived inputs and further named statements, in order."""
    parts = [f"{n} AS ({inputs.duck_sql(n)})" for n in names]
    parts += [f"{n} AS ({sql})" for n, sql in ctes.items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.view(spark, sf, "pages_v").select(
        "page_path", "title", "page_type", F.array("tag").alias("tags"),
        F.create_map().cast("map<string,string>").alias("frontmatter"), "body",
    )


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.view(spark, sf, "pages_v").select("doc_id", "title", "body")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.view(spark, sf, "questions_v")

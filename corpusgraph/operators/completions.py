"""Model calls as joins between prompt tables and completion tables.

The library never calls a model.  A *completer* is a ``mapInPandas`` function from
``(cache_key, system, user)`` to ``(cache_key, response)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut

Completer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

# Fixed value: version folded into every cache key.
CACHE_VERSION = "2"


def cache_key(system: Column, user: Column, model: str) -> Column:
    return F.sha2(F.concat_ws(chr(0), F.lit(CACHE_VERSION), system, user, F.lit(model)), 256)


def with_cache_key(prompts: DataFrame, model: str = "mock") -> DataFrame:
    return prompts.withColumn("cache_key", cache_key(F.col("system"), F.col("user"), model))


class Completion(NamedTuple):
    answered: DataFrame
    cache: DataFrame
    misses: DataFrame


def complete(prompts: DataFrame, cache: DataFrame, completer: Completer | None = None) -> Completion:
    """Read-through join of ``prompts`` with ``cache(cache_key, response)``.

    Missing keys are completed once each and written before use, because a completion
    must not be repeated when a task is.  ``answered`` has ``response`` and ``hit``;
    without a completer, unanswered prompts keep a null response.  With one, prompts are
    made once: the misses and the answers both read them.
    """
    if completer is not None:
        prompts = cut(prompts)
    misses = (
        prompts.select("cache_key", "system", "user")
        .join(cache.select("cache_key"), "cache_key", "left_anti")
        .dropDuplicates(["cache_key"])
    )
    known = cache.select("cache_key", "response", F.lit(True).alias("hit"))
    new_cache = cache.select("cache_key", "response")
    if completer is not None:
        fresh = cut(misses.mapInPandas(completer, "cache_key string, response string"))
        known = known.unionByName(fresh.withColumn("hit", F.lit(False)))
        new_cache = new_cache.unionByName(fresh)
        misses = fresh
    answered = prompts.join(known, "cache_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return Completion(answered, new_cache, misses)


def completion_counts(done: Completion) -> DataFrame:
    """One row: prompts, hits, and completions made (each missing key once)."""
    calls = done.misses.agg(F.count(F.lit(1)).alias("n")).scalar()
    return done.answered.agg(F.count(F.lit(1)).alias("prompts")).select(
        "prompts", (F.col("prompts") - calls).alias("hits"), calls.alias("completions")
    )

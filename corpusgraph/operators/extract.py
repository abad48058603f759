"""Extraction stages: records with repair and gleaning, entities, relationships, claims.

A turn is one text unit.  With privacy patterns, everything sent out and cached is
redacted text, repair and gleaning prompts included; only final fields are restored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from ..session import cut
from .completions import Completer, complete, with_cache_key
from .privacy import redact_turns, rehydrate_column
from .records import (
    COMPLETE,
    REPAIR_SYSTEM,
    claims_prompts,
    extract_prompts,
    gleaning_user,
    none_if_blank,
    normalize_status,
    normalize_title,
    normalize_type,
    parsed_records,
    repair_user,
)

_NO_MAP = "map<string,string>"


class Extraction(NamedTuple):
    entities: DataFrame
    relationships: DataFrame
    cache: DataFrame
    calls: DataFrame


class Claims(NamedTuple):
    claims: DataFrame
    cache: DataFrame
    calls: DataFrame


def _ask(prompts: DataFrame, cache: DataFrame, completer, model: str, may_be_done: bool = False):
    """One completion round plus one repair round for answers without any record.

    With ``may_be_done`` an answer that is only the end mark is final and not repaired.

    Returns ``(text_unit_id, response, records)`` rows, the new cache and the misses.
    """
    done = complete(with_cache_key(prompts, model), cache, completer)
    first = cut(
        done.answered.select("text_unit_id", "response", parsed_records("response").alias("records"))
    )
    said = tx.strip(F.coalesce("response", F.lit("")))
    broken = first.where((F.size("records") == 0) & ~said.isin("", *([COMPLETE] if may_be_done else [])))
    again = complete(
        with_cache_key(
            broken.select("text_unit_id", F.lit(REPAIR_SYSTEM).alias("system"), repair_user(F.col("response")).alias("user")), model
        ),
        done.cache,
        completer,
    )
    repaired = again.answered.select("text_unit_id", parsed_records("response").alias("fixed"))
    out = first.join(repaired, "text_unit_id", "left").select(
        "text_unit_id",
        "response",
        F.when(F.size("records") > 0, F.col("records")).otherwise(
            F.coalesce("fixed", F.array().cast("array<array<string>>"))
        ).alias("records"),
    )
    misses = done.misses.select("cache_key").unionByName(again.misses.select("cache_key")) if completer else None
    return out, again.cache, misses


def extract_records(
    units: DataFrame,
    cache: DataFrame,
    completer: Completer | None = None,
    max_gleanings: int = 1,
    model: str = "mock",
    patterns: DataFrame | None = None,
    redact: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(text_unit_id, ordinal, kind, fields, turn_map)`` over all rounds of every unit."""
    turns = _turns(extract_prompts(units.select("text_unit_id", "text")), patterns, redact)
    out, cache, misses = _ask(turns.select("text_unit_id", "system", "user"), cache, completer, model)
    all_calls = [misses]
    rounds = [out.select("text_unit_id", F.lit(0).alias("round"), "records")]
    open_turns = out.where("response is not null").select("text_unit_id", F.col("response").alias("previous"))
    for n in range(1, max_gleanings + 1):
        prompts = turns.join(open_turns, "text_unit_id").select(
            "text_unit_id", "system", gleaning_user(F.col("user"), F.col("previous")).alias("user")
        )
        out, cache, misses = _ask(prompts, cache, completer, model, may_be_done=True)
        all_calls.append(misses)
        answer = tx.strip(F.coalesce("response", F.lit("")))
        kept = cut(out.where((answer != "") & (answer != COMPLETE) & (F.size("records") > 0)))
        rounds.append(kept.select("text_unit_id", F.lit(n).alias("round"), "records"))
        open_turns = kept.select("text_unit_id", F.col("response").alias("previous"))
    everything = rounds[0]
    for r in rounds[1:]:
        everything = everything.unionByName(r)
    flat = (
        everything.select("text_unit_id", "round", F.posexplode("records").alias("pos", "fields"))
        .join(turns.select("text_unit_id", "turn_map"), "text_unit_id")
        .select(
            "text_unit_id",
            (F.col("round").cast("long") * 1_000_000 + F.col("pos")).alias("ordinal"),
            F.lower(F.col("fields")[0]).alias("kind"),
            "fields",
            "turn_map",
        )
    )
    calls = [c for c in all_calls if c is not None]
    call_table = calls[0] if calls else cache.select("cache_key").limit(0)
    for c in calls[1:]:
        call_table = call_table.unionByName(c)
    return flat, cache, call_table


def _turns(prompts: DataFrame, patterns: DataFrame | None, redact: bool) -> DataFrame:
    if not redact:
        return prompts.select("text_unit_id", "system", "user", F.create_map().cast(_NO_MAP).alias("turn_map"))
    if patterns is None:
        raise ValueError("redaction is wanted but no pattern table was given")
    safe = redact_turns(prompts.select("text_unit_id", F.col("user").alias("text")), patterns, "text_unit_id")
    return prompts.drop("user").join(
        safe.select("text_unit_id", F.col("text").alias("user"), "turn_map"), "text_unit_id"
    ).select("text_unit_id", "system", "user", "turn_map")


def _field(i: int) -> Column:
    return F.try_element_at("fields", F.lit(i + 1))


def _restored(i: int, redact: bool) -> Column:
    return rehydrate_column(_field(i), F.col("turn_map")) if redact else _field(i)


def entity_mentions(records: DataFrame, redact: bool = False) -> DataFrame:
    """First mention of each (title, type) per unit: ``(text_unit_id, ordinal, title, type, description)``."""
    rows = (
        records.where((F.col("kind") == "entity") & (F.size("fields") >= 4))
        .select(
            "text_unit_id",
            "ordinal",
            normalize_title(_restored(1, redact)).alias("title"),
            normalize_type(_field(2)).alias("type"),
            _restored(3, redact).alias("description"),
        )
        .where(F.col("title") != "")
    )
    return (
        rows.groupBy("text_unit_id", "title", "type")
        .agg(F.min("ordinal").alias("first"), F.min_by("description", "ordinal").alias("description"))
        .select("text_unit_id", F.col("first").alias("ordinal"), "title", "type", "description")
    )


def relationship_mentions(records: DataFrame, redact: bool = False) -> DataFrame:
    """``(text_unit_id, ordinal, source, target, description, weight)``; a weight that is no number is 1."""
    return (
        records.where((F.col("kind") == "relationship") & (F.size("fields") >= 4))
        .select(
            "text_unit_id",
            "ordinal",
            normalize_title(_restored(1, redact)).alias("source"),
            normalize_title(_restored(2, redact)).alias("target"),
            _restored(3, redact).alias("description"),
            F.coalesce(tx.strip(_field(4)).try_cast("double"), F.lit(1.0)).alias("weight"),
        )
        .where((F.col("source") != "") & (F.col("target") != ""))
    )


def extract_graph(
    units: DataFrame,
    cache: DataFrame,
    completer: Completer | None = None,
    max_gleanings: int = 1,
    model: str = "mock",
    patterns: DataFrame | None = None,
    redact: bool = False,
) -> Extraction:
    """Entities and relationships of every text unit."""
    records, new_cache, calls = extract_records(units, cache, completer, max_gleanings, model, patterns, redact)
    return Extraction(entity_mentions(records, redact), relationship_mentions(records, redact), new_cache, calls)


def claim_rows(records: DataFrame, entities: DataFrame, redact: bool = False) -> DataFrame:
    """Claims whose subject is an entity of the same unit; an unknown object becomes null."""
    obj = none_if_blank(_restored(2, redact))
    kind = F.upper(tx.strip(_field(3)))
    rows = records.where((F.col("kind") == "claim") & (F.size("fields") >= 2)).select(
        "text_unit_id",
        "ordinal",
        normalize_title(_restored(1, redact)).alias("subject"),
        normalize_title(obj).alias("object"),
        F.when(F.coalesce(kind, F.lit("")) == "", F.lit("OTHER")).otherwise(kind).alias("type"),
        F.coalesce(normalize_status(_field(4)), F.lit("SUSPECTED")).alias("status"),
        none_if_blank(_restored(5, redact)).alias("period_start"),
        none_if_blank(_restored(6, redact)).alias("period_end"),
        F.coalesce(_restored(7, redact), F.lit("")).alias("description"),
    )
    # the last entity of a title in the unit gives its type
    titles = entities.groupBy("text_unit_id", "title").agg(F.max_by("type", "ordinal").alias("etype"))
    subject = titles.select("text_unit_id", F.col("title").alias("subject"), F.col("etype").alias("subject_type"))
    object_ = titles.select("text_unit_id", F.col("title").alias("object"), F.col("etype").alias("object_type"))
    return (
        rows.where(F.col("subject") != "")
        .join(subject, ["text_unit_id", "subject"])
        .join(object_, ["text_unit_id", "object"], "left")
        .withColumn("object", F.when(F.col("object_type").isNotNull(), F.col("object")))
    )


def extract_claims(
    units: DataFrame,
    entities: DataFrame,
    cache: DataFrame,
    completer: Completer | None = None,
    model: str = "mock",
    patterns: DataFrame | None = None,
    redact: bool = False,
) -> Claims:
    """Claims about the entities of each unit; units without entities are not asked."""
    turns = _turns(claims_prompts(units.select("text_unit_id", "text"), entities), patterns, redact)
    out, new_cache, misses = _ask(turns.select("text_unit_id", "system", "user"), cache, completer, model)
    records = (
        out.select("text_unit_id", F.posexplode("records").alias("ordinal", "fields"))
        .join(turns.select("text_unit_id", "turn_map"), "text_unit_id")
        .withColumn("kind", F.lower(F.col("fields")[0]))
    )
    calls = misses if misses is not None else cache.select("cache_key").limit(0)
    return Claims(claim_rows(records, entities, redact), new_cache, calls)

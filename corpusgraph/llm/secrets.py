"""Secret scans with corpus-wide ownership, in DataFrame functions only.

Each kind of secret is a pattern.  A pattern's places come from the pieces between its
matches: their lengths and those of the matches add up to code-point offsets.  Only hashes
of the found values are kept, and whether the value looks live: drawn at random rather than
written as an example.  The hashes of the whole corpus are then counted by distinct
repositories and owners: a value that many of either hold is a copied example, a live-looking
one that a single owner holds in few repositories is that owner's own.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut


class Kind(NamedTuple):
    name: str
    pattern: str
    value: int  # the group that holds the secret
    least: int  # its least length
    base: bool


# Kinds in the order that breaks ties between equal starts.
KINDS = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    # a run of 16 or more is what is left of all runs once the short ones are dropped
    Kind("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Kind("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1, False),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, False),
    Kind("provider", r"(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{30,})", 0, 1, False),
    Kind("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:([^\s/:@]{3,64})@", 1, 3, False),
)
# From this many owners, or repositories, a value counts as a widely copied example.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 20
# A live-looking value has so many bits of entropy a character and no mark of an example.
LIVE_BITS = 2.8
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|redacted|change[_-]?me|your[_-]|(?:^|[_-])(?:test|fake|todo)(?:[_-]|$)|x{4}|(.)\1{5}|01234567|12345678|abcdefgh"


def looks_live(value: Column) -> Column:
    """Whether a value reads like drawn characters.  The entropy takes one count for each distinct character."""
    n = F.char_length(value)
    letters = F.filter(F.array_distinct(F.split(value, "")), lambda c: c != "")
    share = lambda c: (n - F.char_length(F.replace(value, c, F.lit("")))) / n
    bits = F.aggregate(letters, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return (bits >= LIVE_BITS) & ~value.rlike(PLACEHOLDER)


def _hits(text: Column, kind: Kind) -> Column:
    """``array<struct<kind, i, gap, n, ok, hash, live>>``: the matches of a kind, the gap being the code points before each since the last."""
    pieces = F.split(text, kind.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    order = F.lit([k.name for k in KINDS].index(kind.name))
    # a match read again by itself gives the same groups
    value = lambda p: F.regexp_extract(p["whole"], kind.pattern, kind.value) if kind.value else p["whole"]
    pairs = F.arrays_zip(F.slice(pieces, 1, F.size(whole)).alias("gap"), whole.alias("whole"))
    made = F.transform(
        pairs,
        lambda p, i: F.struct(
            order.alias("kind"), i.alias("i"), F.char_length(p["gap"]).alias("gap"), F.char_length(p["whole"]).alias("n"),
            (F.char_length(value(p) if kind.name == "assign" else p["whole"]) >= kind.least).alias("ok"),
            F.sha2(value(p).cast("binary"), 256).alias("hash"), looks_live(value(p)).alias("live"),
        ),
    )
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,n:int,ok:boolean,hash:string,live:boolean>>")
    return F.when(text.rlike(kind.pattern), made).otherwise(none)


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``rows(row_id, doc_id)``, one for each row of ``docs``, and its
    ``spans(row_id, repository, owner, kind, name, start, end, hash, live)``; offsets count code points, the end is exclusive.

    A null text is empty; null repositories and owners count as one unnamed each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = cut(
        docs.select(
            F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"),
            F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
            F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
            F.concat(*[_hits(text, k) for k in KINDS]).alias("hits"),
        )
    )
    names = F.array(*[F.lit(k.name) for k in KINDS])
    hits = found.where(F.size("hits") > 0).select("row_id", "repository", "owner", F.explode("hits").alias("h")).select("row_id", "repository", "owner", "h.*")
    upto = Window.partitionBy("row_id", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("n")).over(upto)
    spans = hits.withColumn("end", end).where("ok").select(
        "row_id", "repository", "owner", "kind", F.element_at(names, F.col("kind") + 1).alias("name"), (F.col("end") - F.col("n")).alias("start"), "end", "hash", "live"
    )
    return found.select("row_id", "doc_id"), spans


def ownership(spans: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """``(hash, n_repositories, n_owners, copied)`` over the whole corpus.

    Repeated finds are merged before the counts, so a value that sits in a third of all
    rows costs one partial row for each task and repository.
    """
    pairs = spans.groupBy("hash", "repository", "owner").agg(F.lit(1).alias("one"))
    repositories = pairs.groupBy("hash", "repository").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("one").alias("n_repositories"))
    owners = pairs.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("one").alias("n_owners"))
    copied = (F.col("n_owners") >= copied_owners) | (F.col("n_repositories") >= copied_repositories)
    return repositories.join(owners, "hash").withColumn("copied", copied)


def secret_report(
    docs: DataFrame, repository: str = "doc_id", owner: str = "source", copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES
) -> DataFrame:
    """One row per row of ``docs``: its spans in order, ``array<struct<start, kind, name, end, n_repositories, n_owners, copied, owned>>``,
    empty where there are none.

    ``copied`` values are widely spread by owners or repositories; ``owned`` ones look live and
    stay with one owner in few repositories; others are neither.  Whole texts of any length
    are read; no rows in, no rows out; equal rows have equal spans.
    """
    rows, spans = scan(docs, repository, owner)
    spans = cut(spans)
    owned = (F.col("n_owners") == 1) & ~F.col("copied") & F.col("live")
    span = F.struct("start", "kind", "name", "end", "n_repositories", "n_owners", "copied", owned.alias("owned"))
    told = spans.join(ownership(spans, copied_owners, copied_repositories), "hash").groupBy("row_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast(told.schema["spans"].dataType)
    return rows.join(told, "row_id", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def digest(report: DataFrame) -> DataFrame:
    """Counts and hashed span lists of :func:`secret_report`."""
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))))
    base = [i for i, k in enumerate(KINDS) if k.base]
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    count = lambda name: F.size(F.filter("spans", lambda s: s["name"] == name)).cast("long").alias(f"n_{name}")
    return report.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(of_base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["copied"])).cast("long").alias("n_copied"),
        F.size(F.filter("spans", lambda s: s["owned"])).cast("long").alias("n_owner_specific"),
    )

"""Page files: parsing, titles, merge-safe upsert, compile prompts and their answers."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text as tx
from ..functions.pieces import by_pieces
from ..session import cut

# Page types and their folders.
PAGE_DIRS = {"source": "sources", "entity": "entities", "concept": "concepts", "session": "sessions"}
# Fixed value: characters of a source that enter its compile prompt.
MAX_SOURCE_CHARS = 12_000
# Title text of one prompt; a longer digest is spread over several prompt rows.
DIGEST_CHARS = 4_000_000
# The frontmatter keys of a compiled page, in file order.
COMPILED_KEYS = ("type", "source_hash", "created", "updated", "tags", "compiled_hash")


def _list_items(value: Column) -> Column:
    inner = F.substring(value, 2, 1_000_000_000)
    inner = F.regexp_replace(inner, r"\]$", "")
    items = F.transform(F.split(inner, ","), tx.strip)
    return F.filter(items, lambda x: x != "")


def _is_list(value: Column) -> Column:
    return F.startswith(value, F.lit("[")) & F.endswith(value, F.lit("]"))


def frontmatter_map(block: Column) -> Column:
    """``key: value`` lines to a map; the last of equal keys wins.

    One-line lists are kept as normalised text ``[a, b]`` with empty items dropped.
    """
    usable = F.filter(tx.lines(tx.strip(block)), lambda x: F.contains(x, F.lit(":")))

    def entry(line: Column) -> Column:
        at = F.instr(line, ":")
        value = tx.strip(line.substr(at + 1, F.length(line)))
        value = F.when(
            _is_list(value), F.concat(F.lit("["), F.array_join(_list_items(value), ", "), F.lit("]"))
        ).otherwise(value)
        return F.struct(tx.strip(line.substr(F.lit(1), at - 1)).alias("key"), value.alias("value"))

    entries = F.transform(usable, entry)
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda later: later["key"] == e["key"]),
    )
    return F.map_from_entries(last)


def parse_pages(files: DataFrame) -> DataFrame:
    """``files(page_path, text)`` to ``(page_path, title, page_type, tags, frontmatter, body)``."""
    parts = files.withColumn("parts", F.split("text", "---", 3))
    has = F.startswith("text", F.lit("---")) & (F.size("parts") == 3)
    empty = F.create_map().cast("map<string,string>")
    df = parts.select(
        "page_path",
        F.when(has, frontmatter_map(F.col("parts")[1])).otherwise(empty).alias("frontmatter"),
        F.when(has, F.regexp_replace(F.col("parts")[2], r"^\n+", "")).otherwise(F.col("text")).alias("body"),
    )
    return df.select(
        "page_path",
        derive_title(F.col("frontmatter"), F.col("body"), F.col("page_path")).alias("title"),
        page_type(F.col("frontmatter"), F.col("page_path")).alias("page_type"),
        tags(F.col("frontmatter")).alias("tags"),
        "frontmatter",
        "body",
    )


def derive_title(frontmatter: Column, body: Column, path: Column) -> Column:
    """Frontmatter title, else first level-one heading, else the humanised file stem."""
    given = tx.strip(frontmatter["title"])
    given = F.when((given != "") & ~_is_list(given), given)
    heads = F.filter(
        F.transform(tx.lines(body), tx.strip), lambda x: F.startswith(x, F.lit("# ")) & (tx.strip(F.substring(x, 3, 1_000_000)) != "")
    )
    heading = tx.strip(F.substring(F.try_element_at(heads, F.lit(1)), 3, 1_000_000))
    name = tx.title_case(F.translate(tx.stem(path), "-_", "  "))
    return F.coalesce(given, heading, name)


def page_type(frontmatter: Column, path: Column) -> Column:
    folder = F.element_at(F.split(F.concat(F.lit("/"), path), "/"), -2)
    by_folder = folder
    for kind, directory in PAGE_DIRS.items():
        by_folder = F.when(folder == directory, F.lit(kind)).otherwise(by_folder)
    stated = frontmatter["type"]
    return F.when(stated != "", stated).otherwise(by_folder)


def tags(frontmatter: Column) -> Column:
    """A scalar becomes a one-item list; no key, no tags."""
    raw = frontmatter["tags"]
    none = F.array().cast("array<string>")
    return F.when(raw.isNull(), none).when(_is_list(raw), _list_items(raw)).otherwise(F.array(raw))


def page_path(kind: Column, title: Column) -> Column:
    folder = F.lit(None).cast("string")
    for k, directory in PAGE_DIRS.items():
        folder = F.when(kind == k, F.lit(directory)).otherwise(folder)
    return F.concat(F.lit("wiki/"), folder, F.lit("/"), tx.slug(title), F.lit(".md"))


def ensure_h1(title: Column, body: Column) -> Column:
    """Put ``# title`` first unless the first line already is exactly that."""
    first = tx.strip(F.element_at(tx.lines(F.regexp_replace(body, r"^\n+", "")), 1))
    head = F.concat(F.lit("# "), title)
    return F.when(first == head, body).otherwise(F.concat(head, F.lit("\n\n"), tx.lstrip(body)))


def render_page(frontmatter: Column, body: Column) -> Column:
    """File text of a page: the known keys in file order, then the others by name."""
    known = F.array(*[F.lit(k) for k in COMPILED_KEYS])
    keys = F.concat(
        F.filter(known, lambda k: F.array_contains(F.map_keys(frontmatter), k)),
        F.array_sort(F.array_except(F.map_keys(frontmatter), known)),
    )
    head = F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit(": "), frontmatter[k])), "\n")
    return F.concat(F.lit("---\n"), head, F.lit("\n---\n\n"), body)


def upsert_pages(existing: DataFrame, proposed: DataFrame, now: str) -> DataFrame:
    """Proposed pages against stored ones, never overwriting a human edit.

    ``proposed(page_path, page_type, title, body, tags, source_hash)``, one row per
    path.  ``created`` when the path is new; ``merged`` when the stored body no longer
    has its own ``compiled_hash`` (the body is kept and a note appended); ``updated``
    otherwise.  Returns the written pages with their ``action`` and file ``text``.
    """
    new = proposed.select(
        "page_path",
        "page_type",
        "title",
        ensure_h1(F.col("title"), F.col("body")).alias("new_body"),
        F.col("tags").alias("new_tags"),
        "source_hash",
    ).withColumn("new_hash", F.sha2("new_body", 256))
    old = existing.select(
        "page_path",
        F.col("body").alias("old_body"),
        F.col("frontmatter").alias("old_fm"),
        F.col("page_type").alias("old_type"),
        F.col("title").alias("old_title"),
        F.col("tags").alias("old_tags"),
        F.lit(True).alias("known"),
    )
    df = new.join(old, "page_path", "left")
    edited = F.col("old_fm")["compiled_hash"].isNotNull() & (F.sha2("old_body", 256) != F.col("old_fm")["compiled_hash"])
    action = F.when(F.col("known").isNull(), "created").when(edited, "merged").otherwise("updated")
    note = F.concat(
        F.lit(f"\n\n> [!merge] Compile on {now} proposed an update to this page, "),
        F.lit("but it was edited since the last compile, so the proposed content was not applied automatically (proposed hash: "),
        F.substring("new_hash", 1, 12),
        F.lit(").\n"),
    )
    tag_text = F.when(
        F.col("new_tags").isNotNull(), F.concat(F.lit("["), F.array_join("new_tags", ", "), F.lit("]"))
    ).otherwise(F.coalesce(F.col("old_fm")["tags"], F.lit("[]")))
    compiled = F.create_map(
        F.lit("type"), F.col("page_type"),
        F.lit("source_hash"), F.coalesce("source_hash", F.col("old_fm")["source_hash"], F.lit("")),
        F.lit("created"), F.coalesce(F.col("old_fm")["created"], F.lit(now)),
        F.lit("updated"), F.lit(now),
        F.lit("tags"), tag_text,
        F.lit("compiled_hash"), F.col("new_hash"),
    )
    bumped = F.map_concat(
        F.map_filter("old_fm", lambda k, v: k != "updated"), F.create_map(F.lit("updated"), F.lit(now))
    )
    merged = F.col("action") == "merged"
    none = F.array().cast("array<string>")
    return (
        df.withColumn("action", action)
        .select(
            "page_path",
            "action",
            "title",
            F.when(merged, F.col("old_type")).otherwise(F.col("page_type")).alias("page_type"),
            F.when(merged, F.col("old_tags")).otherwise(F.coalesce("new_tags", "old_tags", none)).alias("tags"),
            F.when(merged, bumped).otherwise(compiled).alias("frontmatter"),
            F.when(merged, F.concat(F.regexp_replace("old_body", r"\n+$", ""), F.lit("\n"), note))
            .otherwise(F.col("new_body"))
            .alias("body"),
        )
        .withColumn("text", render_page(F.col("frontmatter"), F.col("body")))
    )


_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)


def find_json_object(text: str | None) -> str | None:
    """The JSON object in a bare, fenced or prose-wrapped answer, as compact text."""
    if not text:
        return None
    fenced = _FENCE.search(text)
    body = (fenced.group(1) if fenced else text).strip()
    at = body.find("{")
    while at != -1:
        try:
            value, _ = json.JSONDecoder().raw_decode(body, at)
        except ValueError:
            return None
        return json.dumps(value, ensure_ascii=False)
    return None


json_object = by_pieces(find_json_object, T.StringType())


_COMPILED = "struct<pages:array<struct<page_type:string,title:string,body:string,tags:array<string>>>,contradictions:array<string>>"


def parse_compiled(completions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``completions(source_hash, response)`` to proposed pages, contradictions and errors."""
    read = completions.select(
        "source_hash", json_object("response").alias("obj")
    ).select("source_hash", F.from_json("obj", _COMPILED).alias("c"), F.col("obj").isNull().alias("bad"))
    rows = read.select("source_hash", F.posexplode("c.pages").alias("ordinal", "p")).select(
        "source_hash", "ordinal", "p.page_type", "p.title", "p.body",
        F.coalesce("p.tags", F.array().cast("array<string>")).alias("tags"),
    )
    good = F.col("page_type").isin(*PAGE_DIRS) & F.col("title").isNotNull() & F.col("body").isNotNull()
    pages = rows.where(good).select(
        page_path(F.col("page_type"), F.col("title")).alias("page_path"),
        "page_type", "title", "body", "tags", "source_hash", "ordinal",
    )
    contradictions = read.select("source_hash", F.explode("c.contradictions").alias("contradiction"))
    errors = (
        read.where("bad").select("source_hash", F.lit("no JSON object in answer").alias("error"))
        .unionByName(rows.where(~F.coalesce(good, F.lit(False))).select("source_hash", F.lit("incomplete page").alias("error")))
    )
    return pages, contradictions, errors


_COMPILE_SYSTEM = (
    "Turn one source document into a small set of linked Markdown pages. First list every entity, concept and "
    "claim in it; then decide which deserve a page of type source, entity, concept or session. Reuse listed titles "
    "instead of making near-duplicates, link pages as [[Title]], and report contradictions with existing pages. "
    'Answer with one JSON object {"pages": [{"page_type", "title", "tags", "body"}], "contradictions": [..]}.'
    "\n\n## Page-type contract\n\n"
)


def title_digest(titles: DataFrame, digest_chars: int = DIGEST_CHARS) -> DataFrame:
    """Distinct titles, sorted without regard to case, as prompt text: ``(part, digest)``.

    One part in the ordinary case.  When the titles exceed ``digest_chars`` they are
    spread by hash over as many parts as needed, so no list is built beyond that size
    and no title is left out.
    """
    distinct = titles.select("title").distinct()
    size = distinct.agg(F.coalesce(F.sum(F.length("title") + 3), F.lit(0)).alias("n")).scalar()
    parts = F.greatest(F.ceil(size / F.lit(digest_chars)), F.lit(1))
    return (
        distinct.withColumn("part", F.pmod(F.xxhash64("title"), parts).cast("int"))
        .groupBy("part")
        .agg(F.array_sort(F.collect_list(F.struct(F.lower("title").alias("k"), "title"))).alias("t"))
        .select("part", F.array_join(F.transform("t", lambda s: F.concat(F.lit("- "), s["title"])), "\n").alias("digest"))
    )


_EXISTING = "## Existing pages\n\n"
_NONE_YET = "(none yet)"


def _source_section() -> Column:
    """A compile prompt from the end of its titles on."""
    cut_text = F.substring("parsed_markdown", 1, MAX_SOURCE_CHARS)
    note = F.when(
        F.length("parsed_markdown") > MAX_SOURCE_CHARS, F.lit("\n\n[... truncated for length ...]\n")
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit("\n\n## Source\n\n- original_name: "), F.col("original_name"),
        F.lit("\n- content_hash: "), F.col("content_hash"),
        F.lit("\n- kind: "), F.col("kind"),
        F.lit("\n- mime: "), F.col("mime"),
        F.lit("\n\n```markdown\n"), cut_text, note, F.lit("\n```\n"),
    )


def compile_prompts(
    sources: DataFrame, titles: DataFrame, schema_text: str = "", digest_chars: int = DIGEST_CHARS
) -> DataFrame:
    """``sources(content_hash, original_name, kind, mime, parsed_markdown)`` to prompts.

    ``(source_hash, part, system, user)``; the source text is cut at 12,000 characters
    with a note, as the prompt format prescribes.
    """
    digest = title_digest(titles, digest_chars)
    n_parts = F.coalesce(digest.agg(F.max("part") + 1).scalar(), F.lit(1))
    user = F.concat(F.lit(_EXISTING), F.coalesce("digest", F.lit(_NONE_YET)), _source_section())
    return (
        sources.withColumn("part", F.explode(F.sequence(F.lit(0), (n_parts - 1).cast("int"))))
        .join(digest, "part", "left")
        .select(
            F.col("content_hash").alias("source_hash"),
            "part",
            F.lit(_COMPILE_SYSTEM + (schema_text.strip() or "(none)")).alias("system"),
            user.alias("user"),
        )
    )


def compile_prompt_hashes(sources: DataFrame, titles: DataFrame, digest_chars: int = DIGEST_CHARS) -> DataFrame:
    """``(source_hash, original_name, part, user_hash)``: SHA-256 of the user texts of :func:`compile_prompts`, none of which is built.

    All prompts of a part begin with the same titles.  Each task hashes the titles of every part once and
    carries on from there for each of its sources, so the work is titles plus sources, not their product.
    """
    digest = cut(title_digest(titles, digest_chars))
    n_parts = digest.agg(F.coalesce(F.max("part") + 1, F.lit(1)).alias("n")).first()["n"]
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = "string"
    heads = digest.select(
        F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "part", F.lit(None).cast(text).alias("source_hash"),
        F.lit(None).cast(text).alias("original_name"), F.col("digest").cast("binary").alias("body"),
    )
    tails = sources.select(
        F.pmod(F.xxhash64("content_hash", "original_name"), F.lit(tasks)).cast("int").alias("task"), F.lit(n_parts).alias("part"),
        F.col("content_hash").alias("source_hash"), "original_name", _source_section().cast("binary").alias("body"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def begun(titles: bytes):
            return hashlib.sha256(_EXISTING.encode() + titles)

        current, state = None, []
        for batch in batches:
            rows = []
            for task, part, source, name, body in zip(*[c if c.type == pa.binary() else c.to_pylist() for c in batch.columns]):
                if task != current:
                    current, state = task, [begun(_NONE_YET.encode())] * n_parts
                if part < n_parts:
                    state[part] = begun(body.as_py())
                    continue
                rest = body.as_py()
                for n, head in enumerate(state):
                    told = None
                    if rest is not None:
                        whole = head.copy()
                        whole.update(rest)
                        told = whole.hexdigest()
                    rows.append((source, name, n, told))
            columns = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.string()))], ["source_hash", "original_name", "part", "user_hash"]
            )

    # titles come before the sources that follow them
    dealt = heads.unionByName(tails).repartition("task").sortWithinPartitions("task", "part")
    return dealt.mapInArrow(run, "source_hash string, original_name string, part int, user_hash string")

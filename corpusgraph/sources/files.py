"""Dropped files: reading, typing, text conversion."""

from __future__ import annotations

import mimetypes
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as tx
from .html import html_markdown

# File kinds by suffix.
DOCUMENT_EXTENSIONS = (".pdf", ".docx", ".pptx", ".xlsx", ".html", ".htm", ".md", ".txt", ".rtf", ".odt")
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".webp", ".tiff", ".tif", ".gif", ".bmp")
# Fence language by suffix, and the document suffixes read as plain text.
FENCE_LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".json": "json", ".yaml": "yaml", ".yml": "yaml",
    ".toml": "toml", ".csv": "csv", ".log": "text", ".sh": "bash", ".sql": "sql", ".md": "markdown", ".txt": "text",
}
PASS_THROUGH = (".md", ".markdown")
PLAIN_TEXT = (".md", ".markdown", ".txt", ".text", ".rst", ".org", ".tex", ".log")

Converter = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def read_drop(spark: SparkSession, folder: str) -> DataFrame:
    """Files directly in ``folder``: ``(original_name, content, bytes, mtime)``.

    Dotfiles are left out.  Spark also hides names that start with an underscore.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(f"{folder.rstrip('/')}/*")
    return (
        raw.withColumn("original_name", tx.basename(F.col("path")))
        .where(~F.startswith("original_name", F.lit(".")))
        .select("original_name", "content", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"))
    )


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """Markdown page files below ``root/wiki``: ``(page_path, text)``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(
        f"{root.rstrip('/')}/wiki"
    )
    return raw.select(F.concat(F.lit("wiki/"), F.regexp_extract("path", r"/wiki/(.*)$", 1)).alias("page_path"), utf8(F.col("content")).alias("text"))


def utf8(content: Column) -> Column:
    """Text of UTF-8 bytes, bad sequences replaced, line ends normalised."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"\r\n?", "\n")


def kind_of(name: Column) -> Column:
    ext = F.lower(tx.suffix(name))
    return (
        F.when(ext.isin(*DOCUMENT_EXTENSIONS), "document").when(ext.isin(*IMAGE_EXTENSIONS), "image").otherwise("artifact")
    )


def mime_table(spark: SparkSession) -> DataFrame:
    """Suffix to MIME type, from the standard library's own table."""
    types = mimetypes.MimeTypes().types_map[True]
    return spark.createDataFrame(sorted(types.items()), "mime_ext string, mime string")


def classify(files: DataFrame) -> DataFrame:
    """Add ``kind`` and ``mime``; unknown suffixes are artifacts of a generic type."""
    ext = F.lower(tx.suffix(F.col("original_name")))
    # a compression suffix describes the encoding; the type is named before it
    inner = F.lower(tx.suffix(F.regexp_replace("original_name", r"(?i)\.(gz|z|bz2|xz|br)$", "")))
    packed = ext.isin(".gz", ".z", ".bz2", ".xz", ".br")
    table = F.broadcast(mime_table(files.sparkSession))  # fixed table, under 200 rows
    return (
        files.withColumn("kind", kind_of(F.col("original_name")))
        .withColumn("mime_ext", F.when(ext == ".tgz", F.lit(".tar")).when(packed, inner).otherwise(ext))
        .join(table, "mime_ext", "left")
        .withColumn("mime", F.coalesce("mime", F.lit("application/octet-stream")))
        .drop("mime_ext")
    )


def to_markdown(files: DataFrame, html: bool = False) -> DataFrame:
    """Add ``parsed_markdown`` and ``error``; a file without a parser gets an error, not a failure.

    Markdown passes through, other text is fenced under its name.  With ``html``
    set, HTML documents go through :func:`~corpusgraph.sources.html.html_markdown`.
    """
    ext = F.lower(tx.suffix(F.col("original_name")))
    kind = kind_of(F.col("original_name"))
    language = F.lit("")
    for suffix, name in FENCE_LANGUAGES.items():
        language = F.when(ext == suffix, F.lit(name)).otherwise(language)
    body = utf8(F.col("content"))
    fenced = F.concat(F.lit("# "), F.col("original_name"), F.lit("\n\n```"), language, F.lit("\n"), body, F.lit("\n```\n"))
    text = F.when(ext.isin(*PASS_THROUGH) & (kind == "document"), body).when(
        (kind == "artifact") | ext.isin(*PLAIN_TEXT), fenced
    )
    if html:
        text = F.coalesce(text, F.when(ext.isin(".html", ".htm"), html_markdown(body)))
    out = files.withColumn("parsed_markdown", text)
    return out.withColumn(
        "error", F.when(F.col("parsed_markdown").isNull(), F.concat(F.lit("no parser for "), kind, F.lit(" "), ext))
    )


def convert(files: DataFrame, converter: Converter) -> DataFrame:
    """Run a caller's ``mapInPandas`` parser over the files :func:`to_markdown` left with an error."""
    todo = files.where("error is not null")
    return files.where("error is null").unionByName(todo.mapInPandas(converter, files.schema))


def split_errors(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and error rows of a parse."""
    return parsed.where("error is null").drop("error"), parsed.where("error is not null").select("original_name", "error")


def collect_tree(
    files: DataFrame, prefixes: tuple[str, ...], recent_prefix: str, staged: DataFrame, recent_limit: int = 20
) -> tuple[DataFrame, DataFrame]:
    """Flatten several trees into one folder of names.

    ``files(rel_path, mtime, …)``.  All files below ``prefixes`` and the newest
    ``recent_limit`` below ``recent_prefix`` become ``prefix__a__b`` names; names
    already in ``staged(original_name)`` are skipped.  Also returns the folders that
    hold nothing.
    """
    label = recent_prefix.lstrip(".")
    wanted = None
    for prefix in prefixes:
        part = files.where(F.startswith("rel_path", F.lit(prefix + "/"))).withColumn("prefix", F.lit(prefix))
        wanted = part if wanted is None else wanted.unionByName(part)
    newest = (
        files.where(F.startswith("rel_path", F.lit(recent_prefix + "/")))
        .orderBy(F.desc("mtime"), "rel_path")
        .limit(recent_limit)
        .withColumn("prefix", F.lit(recent_prefix))
    )
    wanted = newest if wanted is None else wanted.unionByName(newest)
    shown = F.when(F.col("prefix") == recent_prefix, F.lit(label)).otherwise(F.col("prefix"))
    below = F.col("rel_path").substr(F.length("prefix") + 2, F.length("rel_path"))
    named = wanted.withColumn("original_name", F.concat(shown, F.lit("__"), F.replace(below, F.lit("/"), F.lit("__")))).drop("prefix")
    # one flag per root, whatever its depth
    held = files.select(*[F.max(F.startswith("rel_path", F.lit(p + "/"))).alias(f"r{i}") for i, p in enumerate((*prefixes, recent_prefix))])
    flags = held.select(F.explode(F.array(*[F.struct(F.lit(p).alias("root"), F.coalesce(f"r{i}", F.lit(False)).alias("held")) for i, p in enumerate((*prefixes, recent_prefix))])).alias("f"))
    empty = flags.where("NOT f.held").select("f.root")
    return named.join(staged.select("original_name"), "original_name", "left_anti"), empty

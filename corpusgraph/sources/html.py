"""HTML pages to Markdown text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text as tx

_SPACE = re.compile(r"\s+")
_SKIP = {"script", "style", "nav", "head", "noscript", "template"}
_BLOCK = {"p", "div", "section", "article", "ul", "ol", "table", "tr", "footer", "header", "main", "blockquote", "pre"}


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip: list[str] = []
        self.href: list[str | None] = []

    def _break(self, mark: str = "") -> None:
        self.out.append("\n\n" + mark)

    def handle_starttag(self, tag, attrs):
        if self.skip or tag in _SKIP:
            if tag in _SKIP:
                self.skip.append(tag)
            return
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self._break("#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "a":
            self.href.append(dict(attrs).get("href"))
            self.out.append("[")
        elif tag in _BLOCK:
            self._break()

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            return
        if tag == "a" and self.href:
            self.out.append(f"]({self.href.pop() or ''})")
        elif tag in _BLOCK or (len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"):
            self._break()

    def handle_data(self, data):
        if not self.skip:
            self.out.append(_SPACE.sub(" ", data))

    def text(self) -> str:
        lines = [line.strip() for line in "".join(self.out).split("\n")]
        kept = [x for i, x in enumerate(lines) if x or (i and lines[i - 1])]
        return "\n".join(kept).strip()


def markdown_of(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    return parser.text()


@F.pandas_udf(T.StringType())
def html_markdown(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(markdown_of)


def html_title(html: Column) -> Column:
    """Raw text of the title element, white space collapsed."""
    return tx.strip(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def html_anchor_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r"(?i)<a\s[^>]*href="))


def html_to_markdown(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` to ``(page_id, url, title, anchors, markdown)``."""
    return pages.select(
        "page_id",
        "url",
        html_title(F.col("html")).alias("title"),
        html_anchor_count(F.col("html")).alias("anchors"),
        html_markdown("html").alias("markdown"),
    )

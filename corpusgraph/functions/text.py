"""Text columns: trimming, lines, slugs, tokens, HTML escaping."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# The link syntax [[Target]], [[Target|alias]], [[Target#heading]].
LINK_PATTERN = r"\[\[([^\]|#]+)(?:[|#]([^\]]*))?\]\]"
# Fixed value: question terms are ASCII word runs.
QUERY_TERM_PATTERN = r"[A-Za-z0-9_]+"
WORD_PATTERN = r"[\p{L}\p{N}]+"


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of any kind (SQL ``trim`` only drops blanks)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def lines(c: Column) -> Column:
    return F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")


def words(c: Column) -> Column:
    """White-space separated words, empty ones dropped."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def title_case(c: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.expr("''"), r.substr(F.lit(2), F.length(r)))),
        "",
    )


def slug(title: Column) -> Column:
    """Lower-case ASCII slug; ``page`` when nothing is left."""
    s = F.regexp_replace(F.lower(strip(title)), "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.when(s == "", F.lit("page")).otherwise(s)


def _accent_table() -> tuple[str, str]:
    """Lower-case letters whose canonical decomposition is an ASCII letter plus marks."""
    source, target = [], []
    for cp in [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(cp)
        base = unicodedata.normalize("NFD", ch)
        stripped = "".join(x for x in base if not unicodedata.combining(x))
        if len(stripped) == 1 and stripped != ch and ch == ch.lower() and stripped.isascii():
            source.append(ch)
            target.append(stripped)
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _accent_table()


def fold(c: Column) -> Column:
    """Lower-case and drop diacritics."""
    return F.translate(F.regexp_replace(F.lower(c), r"\p{Mn}+", ""), _ACCENTED, _PLAIN)


def tokens(c: Column) -> Column:
    """Folded runs of letters and digits, in order."""
    return F.regexp_extract_all(fold(c), F.lit(WORD_PATTERN), F.lit(0))


def escape_html(c: Column) -> Column:
    """Escape the five HTML characters (fixed entity names)."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def quote_path(c: Column) -> Column:
    """Percent-encode a path for a URL, keeping its slashes."""
    c = F.url_encode(c)
    for form, plain in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        c = F.replace(c, F.lit(form), F.lit(plain))
    return c


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(name: Column) -> Column:
    """File suffix with its dot; a leading dot alone is not a suffix."""
    return F.regexp_extract(name, r"[^/.][^/]*?(\.[^./]+)$", 1)


def stem(path: Column) -> Column:
    name = basename(path)
    return name.substr(F.lit(1), F.length(name) - F.length(suffix(name)))

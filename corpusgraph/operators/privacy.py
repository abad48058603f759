"""Finding, replacing and restoring personal data and secrets."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.pieces import by_pieces

# The built-in secret patterns; they share one type.
SECRET_PATTERNS = (
    r"\bsk-[A-Za-z0-9]{20,}\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    r"\bBearer\s+[A-Za-z0-9._-]{20,}\b",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
)
SECRET_SCORE = 0.95
# Fixed value: characters per window handed to a model detector.
WINDOW_CHARS = 2500
# Patterns that one function holds.
BLOCK_PATTERNS = 10_000
# Windows whose lengths are summed up together.
RUN_WINDOWS = 256

_SPAN = "struct<type:string,start:int,end:int,score:double>"


def secret_patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [("SECRET", p, SECRET_SCORE) for p in SECRET_PATTERNS], "type string, pattern string, score double"
    )


Pattern = tuple[str, str, float]


def _pattern_blocks(patterns: DataFrame) -> list[list[Pattern]]:
    """The pattern table, which is configuration, in the blocks that are shipped one to a function."""
    rows = [(r["type"], r["pattern"], float(r["score"])) for r in patterns.select("type", "pattern", "score").toLocalIterator()]
    return [rows[i : i + BLOCK_PATTERNS] for i in range(0, len(rows), BLOCK_PATTERNS)] or [[]]


def required_literal(pattern: str) -> str:
    """The longest run of characters that every match of ``pattern`` holds; empty where none is certain."""
    from re import _constants as c, _parser

    tree = _parser.parse(pattern)
    if tree.state.flags & re.IGNORECASE:
        return ""
    runs = [""]

    def walk(items):
        for kind, what in items:
            if kind is c.LITERAL:
                runs[-1] += chr(what)
            elif kind is c.SUBPATTERN and not what[1] & re.IGNORECASE:
                walk(what[3])
            elif kind in (c.MAX_REPEAT, c.MIN_REPEAT) and what[0] > 0:
                runs.append("")
                walk(what[2])
                runs.append("")
            elif kind is not c.AT:
                runs.append("")

    walk(tree)
    return max(runs, key=len)


class PatternSet:
    """Many patterns over one text: an automaton of their literals tells which can match at all; only those are tried.

    A pattern is compiled when a text first holds its literal, so a worker knows the ones it has met.
    """

    def __init__(self, patterns: list[Pattern]):
        import ahocorasick

        self.patterns = patterns
        self.compiled: dict[int, re.Pattern] = {}
        literals: dict[str, list[int]] = {}
        for i, (_, pattern, _) in enumerate(patterns):
            literals.setdefault(required_literal(pattern), []).append(i)
        self.always = literals.pop("", [])
        self.automaton = ahocorasick.Automaton()
        for literal, owners in literals.items():
            self.automaton.add_word(literal, owners)
        self.automaton.make_automaton()

    def candidates(self, text: str) -> list[int]:
        found = set(self.always)
        if len(self.automaton):
            for _, owners in self.automaton.iter(text):
                found.update(owners)
        return sorted(found)

    def spans(self, text: str) -> list[dict]:
        out = []
        for i in self.candidates(text):
            type_, pattern, score = self.patterns[i]
            if i not in self.compiled:
                self.compiled[i] = re.compile(pattern)
            out += [{"type": type_, "start": m.start(), "end": m.end(), "score": score} for m in self.compiled[i].finditer(text) if m.end() > m.start()]
        return out


def _echoes(text: str, spans: list[dict]) -> list[dict]:
    """Places where a found value stands again in other case or spacing, as titles in prompts do.

    Their scores are negative: they rank below every match.
    """
    out = []
    for (type_, words), score in {(s["type"], tuple(text[s["start"] : s["end"]].split())): s["score"] for s in spans}.items():
        again = re.compile(r"\s+".join(map(re.escape, words)), re.IGNORECASE)
        out += [{"type": type_, "start": m.start(), "end": m.end(), "score": score - 1.0} for m in again.finditer(text)]
    known = {(s["start"], s["end"]) for s in spans}
    return [s for s in out if (s["start"], s["end"]) not in known]


def _span_udf(patterns: list[Pattern], echoes: bool = False):
    known: list[PatternSet] = []

    def find(text):
        if not text:
            return []
        if not known:
            known.append(PatternSet(patterns))
        found = known[0].spans(text)
        return found + _echoes(text, found) if echoes and found else found

    return by_pieces(find, f"array<{_SPAN}>")


def found_spans(patterns: DataFrame, text: str, echoes: bool = False) -> Column:
    """All spans of a text column, whatever the number of patterns; one pass for each ``BLOCK_PATTERNS``."""
    return F.concat(*[_span_udf(block, echoes)(text) for block in _pattern_blocks(patterns)])


def detect_spans(docs: DataFrame, patterns: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, type, start, end, score)`` of every pattern match in the whole text."""
    found = docs.select(id_col, F.explode_outer(found_spans(patterns, "text")).alias("s"))
    return found.where("s is not null").select(id_col, "s.type", "s.start", "s.end", "s.score")


def count_spans(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Matches per type: ``(type, n)``; a type without any has 0."""
    found = docs.select(F.explode_outer(found_spans(patterns, "text")).alias("s")).where("s is not null").groupBy("s.type").agg(F.count(F.lit(1)).alias("n"))
    return patterns.select("type").distinct().join(found, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


def _tiling(size: int) -> str:
    """Pattern whose matches tile a text: the rest if it fits, else up to the last blank, else up to
    the last newline, else a full window."""
    return rf"(?s).{{1,{size}}}\z|.{{1,{size - 1}}} |.{{1,{size - 1}}}\n|.{{{size}}}"


def window_text(docs: DataFrame, size: int = WINDOW_CHARS, id_col: str = "doc_id") -> DataFrame:
    """Windows of at most ``size`` characters, cut after a blank or newline where possible.

    ``(id, offset, chunk)``; the chunks of a text put together are the text.
    """
    tiles = docs.select(id_col, F.regexp_extract_all("text", F.lit(_tiling(size)), F.lit(0)).alias("tiles"))
    # lengths summed up in runs of windows, so that a place needs few additions however long the text
    lengths = F.transform("tiles", lambda c: F.char_length(c))
    counted = tiles.withColumn("sizes", lengths).withColumn(
        "runs", F.transform(F.sequence(F.lit(0), F.floor(F.size("tiles") / RUN_WINDOWS).cast("int")), lambda r: _total(F.slice("sizes", r * RUN_WINDOWS + 1, RUN_WINDOWS)))
    )
    run = lambda i: F.floor(i / RUN_WINDOWS).cast("int")
    placed = F.transform(
        "tiles",
        lambda c, i: F.struct(
            (_total(F.slice("runs", 1, run(i))) + _total(F.slice("sizes", run(i) * RUN_WINDOWS + 1, i % RUN_WINDOWS))).alias("offset"), c.alias("chunk")
        ),
    )
    return counted.select(id_col, F.explode(placed).alias("w")).select(id_col, "w.offset", "w.chunk")


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda n, x: n + x)


def remap_spans(window_spans: DataFrame) -> DataFrame:
    """Spans found in windows, moved to text positions."""
    return window_spans.withColumn("start", F.col("offset") + F.col("start")).withColumn(
        "end", F.col("offset") + F.col("end")
    ).drop("offset")


def _settle(spans) -> list[dict]:
    """Non-overlapping spans by position: higher score first, then longer, then earlier."""
    kept: list[dict] = []
    ranked = sorted(spans, key=lambda s: (-s["score"], s["start"] - s["end"], s["start"], s["type"]))
    for s in ranked:
        if all(s["end"] <= k["start"] or s["start"] >= k["end"] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s["start"])


def _replace(text: str, spans, share: bool) -> tuple[str, list[dict]]:
    """``share`` gives equal values one token; the first match also stands for its echoes."""
    out, at, counts, tokens, by_value = [], 0, {}, [], {}
    found = {}
    for s in spans if share else ():
        if s["score"] >= 0:
            value = text[s["start"] : s["end"]]
            found.setdefault((s["type"], " ".join(value.split()).casefold()), value)
    for s in _settle(spans):
        value = text[s["start"] : s["end"]]
        if share and s["score"] < 0:
            value = found[(s["type"], " ".join(value.split()).casefold())]
        token = by_value.get((s["type"], value)) if share else None
        if token is None:
            counts[s["type"]] = counts.get(s["type"], 0) + 1
            token = f"[REDACTED_{s['type']}_{counts[s['type']]}]"
            by_value[(s["type"], value)] = token
            tokens.append({"token": token, "original": value})
        out += [text[at : s["start"]], token]
        at = s["end"]
    return "".join([*out, text[at:]]), tokens


def _replace_udf(share: bool):
    def replace(text, spans):
        done, tokens = _replace(text, spans or [], share) if text is not None else (None, [])
        return {"text": done, "tokens": tokens}

    return by_pieces(replace, "struct<text:string,tokens:array<struct<token:string,original:string>>>")


def _token_map(c: Column) -> Column:
    return F.map_from_entries(c)


def redact(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, text, token_map)`` with every span replaced by ``[REDACTED_<TYPE>_<n>]``.

    Of overlapping spans the higher score wins, then the longer; numbers ascend by
    position within a type.  A text without spans is unchanged with an empty map.
    """
    gathered = spans.groupBy(id_col).agg(F.collect_list(F.struct("type", "start", "end", "score")).alias("spans"))
    done = docs.select(id_col, "text").join(gathered, id_col, "left")
    return done.select(id_col, _replace_udf(False)("text", "spans").alias("r")).select(
        id_col, F.col("r.text").alias("text"), _token_map(F.col("r.tokens")).alias("token_map")
    )


def redact_turns(turns: DataFrame, patterns: DataFrame, id_col: str) -> DataFrame:
    """Redact in place, one row per turn; equal values share a token within the turn, whatever their case."""
    found = turns.withColumn("spans", found_spans(patterns, "text", echoes=True))
    return found.select(id_col, _replace_udf(True)("text", "spans").alias("r")).select(
        id_col, F.col("r.text").alias("text"), _token_map(F.col("r.tokens")).alias("turn_map")
    )


_TOKEN = re.compile(r"\[REDACTED(?:_[A-Z0-9]+)+\]")
_BETWEEN = re.compile(r"[ _]+")


@lru_cache(maxsize=1024)
def _token_finder(keys: tuple[str, ...]) -> tuple[re.Pattern, dict[tuple[str, ...], str]]:
    """One pattern for all tokens of a map, and the token of each sequence of words.

    A token may have lost its brackets, and blanks may stand for its underscores.  Longer
    tokens are tried first, so that number 12 is not read as number 1.
    """
    shapes, owners = [], {}
    for key in sorted(keys, key=len, reverse=True):
        if _TOKEN.fullmatch(key):
            parts = key[1:-1].split("_")
            owners[tuple(parts)] = key
            shapes.append(r"\[?" + "[ _]+".join(parts) + r"\]?")
        else:
            owners[(key,)] = key
            shapes.append(re.escape(key))
    return re.compile("|".join(shapes)), owners


def _restore(text: str | None, keys, values) -> str | None:
    """Originals for tokens in one scan; a mangled form counts once, and only where the exact token is missing."""
    if text is None or keys is None or not len(keys):
        return text
    originals = dict(zip(keys, values))
    finder, owners = _token_finder(tuple(originals))
    spent: set[str] = set()

    def original(found: re.Match) -> str:
        told = found.group()
        if told in originals:
            return originals[told]
        key = owners[tuple(_BETWEEN.split(told.strip("[]")))]
        if key in spent or key in text:
            return told
        spent.add(key)
        return originals[key]

    return finder.sub(original, text)


_restore_udf = by_pieces(_restore, T.StringType())


def rehydrate_column(text: Column, token_map: Column) -> Column:
    """Put originals back: exact tokens first, then tokens whose brackets or underscores got lost."""
    return _restore_udf(text, F.map_keys(token_map), F.map_values(token_map))


def rehydrate_exact(text: Column, token_map: Column) -> Column:
    """Exact tokens only, inside the JVM."""
    return F.aggregate(F.map_entries(token_map), text, lambda acc, e: F.replace(acc, e["key"], e["value"]))


def rehydrate(df: DataFrame, map_col: str = "token_map", text_col: str = "text") -> DataFrame:
    return df.withColumn(text_col, rehydrate_column(F.col(text_col), F.col(map_col)))

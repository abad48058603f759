"""Licence scans: an Aho-Corasick automaton finds notices and identifier tags, a shunting-yard parser evaluates expressions.

Texts are cut into words (ASCII letters and digits, and everything beyond ASCII) joined by
single blanks; the automaton holds every phrase between blanks, so one pass finds all
phrases at all places.  A tag's expression is read from the text itself.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Phrases whose places are counted, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Notices that add labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc",
    "boost software license": "bsl",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "creative commons attribution": "creative-commons",
    "this is free and unencumbered software": "unlicense",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
# Words that make a notice likelier without naming a licence.
CUES = ("licensed under", "released under", "permission is hereby granted", "terms of the")
TAGS = ("spdx license identifier", "license expression")
_TAGGED = re.compile(r"(?:SPDX-License-Identifier|License-Expression)\s*[:=]\s*([A-Za-z0-9.+:()\- \t]+)", re.I | re.A)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:\-]+")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
# How freely works may be used, by the beginning of an identifier: 1 freely, 0 not.
FREEDOM = (
    ("agpl", 0.2), ("lgpl", 0.6), ("gpl", 0.3), ("mpl", 0.7), ("epl", 0.6), ("cc-by-nc", 0.1), ("cc-by-nd", 0.2), ("cc-by-sa", 0.5), ("cc-by", 0.9),
    ("cc0", 1.0), ("mit", 1.0), ("apache", 1.0), ("bsd", 1.0), ("isc", 1.0), ("bsl", 1.0), ("unlicense", 1.0), ("zlib", 1.0),
)
UNKNOWN_FREEDOM, EXCEPTION_GAIN = 0.4, 0.2
# What may stand in an expression: a known family with its version or variant, a private reference, an exception after WITH.
_IDENTIFIER = re.compile(
    r"(?:(?:agpl|lgpl|gpl|gfdl|mpl|epl|eupl|cddl|cpl|osl|afl|apache|apsl|artistic|lppl|ofl|psf|zpl|cecill|bsl|busl|ms-[pr]l|upl|w3c|ecl)"
    r"(?:-[0-9][0-9a-z.]*)?(?:-(?:only|or-later|clear|perl|clarified|no-copyleft-exception|2\.0))?"
    r"|(?:0bsd|bsd(?:-[1-4]-clause(?:-[a-z]+)*)?|(?:python|php)-[0-9.]+|mit(?:-0|-modern-variant|-cmu)?|isc|zlib|libpng|unlicense|wtfpl|ncsa|postgresql|openssl|curl|x11|ruby|vim|beerware|blueoak-1\.0\.0)"
    r"|cc0(?:-1\.0)?|cc-by(?:-n[cd]|-sa)*(?:-[0-9]\.[0-9])?"
    r"|(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+)\+?"
)
_EXCEPTION = re.compile(r"[a-z0-9.+-]*exception[a-z0-9.-]*|llgpl|additionref-[a-z0-9.-]+")

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


class Expression(NamedTuple):
    labels: frozenset[str]
    freedom: float


def _leaf(name: str) -> Expression:
    name = name.lower()
    return Expression(frozenset([name]), next((f for prefix, f in FREEDOM if name.startswith(prefix)), UNKNOWN_FREEDOM))


def _join(op: str, a: Expression, b: Expression) -> Expression:
    """OR lets the user choose, AND binds to both, WITH loosens its left side."""
    if op == "or":
        return Expression(a.labels | b.labels, max(a.freedom, b.freedom))
    if op == "and":
        return Expression(a.labels | b.labels, min(a.freedom, b.freedom))
    return Expression(a.labels, min(1.0, a.freedom + EXCEPTION_GAIN))


def evaluate(text: str) -> Expression | None:
    """Value of the licence expression that a text begins with, or None where there is none.

    Two stacks: values and waiting operators; WITH binds before AND, AND before OR.
    Operands are known identifiers, private references and, after WITH, exceptions; sentence
    points at their ends do not count.  Reading stops at the first word that cannot follow.  A
    last operator before other words is prose; what else is unfinished there is no expression.
    """
    values: list[Expression] = []
    waiting: list[str] = []

    def reduce() -> None:
        op, b, a = waiting.pop(), values.pop(), values.pop()
        values.append(_join(op, a, b))

    operand, depth = True, 0
    for token in _TOKEN.findall(text):
        word = token.lower()
        if operand:
            if token == "(":
                waiting.append(token)
                depth += 1
            elif (_EXCEPTION if waiting and waiting[-1] == "with" else _IDENTIFIER).fullmatch(word.rstrip(".:")):
                values.append(_leaf(word.rstrip(".:")))
                operand = False
            elif token != ")" and word not in _PRECEDENCE and not depth and waiting:
                waiting.pop()
                operand = False
                break
            else:
                return None
        elif token == ")":
            if not depth:
                break
            while waiting[-1] != "(":
                reduce()
            waiting.pop()
            depth -= 1
        elif word in _PRECEDENCE:
            while waiting and waiting[-1] != "(" and _PRECEDENCE[waiting[-1]] >= _PRECEDENCE[word]:
                reduce()
            waiting.append(word)
            operand = True
        else:
            break
    if operand or depth:
        return None
    while waiting:
        reduce()
    return values[0]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in (*BASE.items(), *NOTICES.items(), *((c, None) for c in CUES), *((t, None) for t in TAGS)):
        kind = "base" if phrase in BASE else "notice" if phrase in NOTICES else "cue" if phrase in CUES else "tag"
        found.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
    found.make_automaton()
    return found


class Notice(NamedTuple):
    n_words: int
    places: list[tuple[int, str]]  # word, label of every base phrase
    labels: frozenset[str]
    score: float
    freedom: float | None


def read_notice(text: str, phrases: ahocorasick.Automaton) -> Notice:
    """Everything one text says about its licence.

    ``score`` grows with the evidence: 0 without any, one half for one phrase.
    """
    words = text.encode().translate(_FOLD).split()
    # one sign for each byte, so that the automaton needs no decoding
    line = f" {b' '.join(words).decode('latin-1')} "
    starts, labels, evidence, tagged = [], set(), 0.0, False
    for end, (kind, label, size) in phrases.iter(line):
        if kind == "base":
            starts.append((end - size + 1, label))
        if label:
            labels.add(label)
        tagged |= kind == "tag"
        evidence += 0.5 if kind == "cue" else 1.0
    values = [v for m in _TAGGED.finditer(text) if (v := evaluate(m[1]))] if tagged else []
    for v in values:
        labels |= v.labels
        evidence += 2.0
    # a word's number is the number of blanks before its own
    blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32) if starts else np.zeros(0, np.int64)
    places = [(int(n), label) for n, (_, label) in zip(np.searchsorted(blanks, [at for at, _ in starts]), starts, strict=True)]
    return Notice(len(words), places, frozenset(labels), 1 - 0.5**evidence, min((v.freedom for v in values), default=None))


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
     ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("freedom", pa.float64())]
)


def licenses(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs(doc_id, text)``: base places, labels, score, and the freedom of its tagged expressions.

    Null texts are empty: no words, no labels, score 0.  Long texts are read whole, in time
    and memory proportional to their length.  Repeated rows have equal results, no rows in
    give none out.  Places are null where no base
    phrase stands; ``freedom`` is null without an expression, else the least of several.
    """

    def run(batches):
        phrases = automaton()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n = read_notice(text.as_py() or "", phrases)
                at = [p for p, _ in n.places]
                rows.append((doc_id, n.n_words, len(at), min(at, default=None), max(at, default=None),
                             ",".join(sorted({x for _, x in n.places})), ",".join(sorted(n.labels)), n.score, n.freedom))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, freedom double"
    )

"""Conversation structure repair: the cheapest edits that give ``(s?(ua)+)?``, the least audit among equals.

A path's weight is one integer.  Its high digits carry the cost; below them every row owns
a slot of ``SLOT`` digits of ``BITS`` bits: letters of messages inserted before the row, then
the letter of its own edit, filled up with zeros.  A slot ends with its row's own letter, so
two audits differ first at the same digit at which their texts do, a shorter text being
the less, and the plain minimum of integers decides cost and ties alike.

Slots have a fixed width, so a stretch of rows is a 4 x 4 table of integers (from a state, to
a state) and stretches multiply associatively.  Rows are dealt by range of (conversation,
turn): a conversation of any length is spread over many tasks, each multiplies its
stretch as a balanced tree, and only tables meet.  The repaired messages are then walked
in order, once, with memory for one batch and the audit.

Only the hash of a whole repaired conversation is sequential by its definition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from .words import parts

DELETE, INSERT, KEEP, REROLE = "DIKR"
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 4, 3, 3, 3
BITS = 4
# ASCII order is digit order; zero is left to padding.
_DIGIT = {letter: i + 1 for i, letter in enumerate(DELETE + INSERT + KEEP + REROLE)}
_LETTER = str.maketrans({str(d): letter for letter, d in _DIGIT.items()} | {"0": ""})
# More insertions in a row than the longest way between two states only add cost.
MOST_INSERTS = 2
SLOT = MOST_INSERTS + 1

START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
STATES = range(4)
# The state that a message of this initial leads to from each state, None where the grammar forbids it.
_NEXT = {
    "s": (AFTER_SYSTEM, None, None, None),
    "u": (AFTER_USER, AFTER_USER, None, AFTER_USER),
    "a": (None, None, AFTER_ASSISTANT, None),
}
_TURN_OF = ("user", "user", "assistant", "user")
_ALTERNATING = {"su", "ua", "au"}
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
SLICE_ROWS = 512

Table = list


def _inserted(state: int, n: int) -> int:
    for _ in range(n):
        state = _NEXT[_TURN_OF[state][0]][state]
    return state


def _weight(cost: int, letters: str, width: int) -> int:
    digits = 0
    for letter in letters.ljust(width, "\0"):
        digits = (digits << BITS) | _DIGIT.get(letter, 0)
    return (cost << (BITS * width)) | digits


@cache
def row_table(initial: str, fault: int) -> Table:
    """Weights of one row's slot from each state to each, None where no edit leads there."""
    out = [[None] * 4 for _ in STATES]

    def offer(a, b, cost, letters):
        if b is not None:
            w = _weight(cost, letters, SLOT)
            out[a][b] = w if out[a][b] is None else min(out[a][b], w)

    for a in STATES:
        for n in range(MOST_INSERTS + 1):
            at, paid, put = _inserted(a, n), n * INSERT_COST, INSERT * n
            offer(a, at, paid + DELETE_COST, put + DELETE)
            if fault in (FINE, TRUNCATED):
                paid += TRUNCATED_COST * (fault == TRUNCATED)
                if initial in _NEXT:
                    offer(a, _NEXT[initial][at], paid, put + KEEP)
                for role in ("user", "assistant"):
                    offer(a, _NEXT[role[0]][at], paid + REROLE_COST, put + REROLE)
    return out


@cache
def end_table() -> Table:
    """Weights of the messages inserted after the last row."""
    out = [[None] * 4 for _ in STATES]
    for a in STATES:
        for n in range(MOST_INSERTS + 1):
            b, w = _inserted(a, n), _weight(n * INSERT_COST, INSERT * n, MOST_INSERTS)
            out[a][b] = w if out[a][b] is None else min(out[a][b], w)
    return out


class Stretch:
    """A product of row tables: ``rows`` slots and a weight for each pair of states.

    A weight is held as ``cost * base ** digits + letters``; putting one behind another adds
    the costs and shifts the letters, which for integers of fixed width is one addition each.
    """

    __slots__ = ("digits", "table")

    def __init__(self, table: Table, digits: int):
        self.table, self.digits = table, digits

    def then(self, other: Stretch) -> Stretch:
        shift, here = BITS * other.digits, BITS * self.digits
        mask = (1 << shift) - 1
        right = [[None if w is None else ((w >> shift) << (here + shift)) | (w & mask) for w in row] for row in other.table]
        out = []
        for row in self.table:
            made = [None] * 4
            for m, w in enumerate(row):
                if w is None:
                    continue
                w <<= shift
                for b, v in enumerate(right[m]):
                    if v is not None and (made[b] is None or w + v < made[b]):
                        made[b] = w + v
            out.append(made)
        return Stretch(out, here // BITS + other.digits)


NOTHING = Stretch([[0 if a == b else None for b in STATES] for a in STATES], 0)


class Product:
    """Stretches multiplied in order as a balanced tree, whatever their number."""

    def __init__(self):
        self.stack: list[tuple[int, Stretch]] = []

    def add(self, stretch: Stretch) -> None:
        size = 1
        while self.stack and self.stack[-1][0] <= size:
            n, left = self.stack.pop()
            stretch, size = left.then(stretch), size + n
        self.stack.append((size, stretch))

    def value(self) -> Stretch:
        out = None
        for _, stretch in reversed(self.stack):
            out = stretch if out is None else stretch.then(out)
        return out or NOTHING


def cheapest(whole: Stretch) -> tuple[int, str]:
    """Cost and audit of the least path from nothing said to an end that the grammar allows."""
    ended = whole.then(Stretch(end_table(), MOST_INSERTS))
    best = min(w for w in (ended.table[START][START], ended.table[START][AFTER_ASSISTANT]) if w is not None)
    shift = BITS * ended.digits
    return best >> shift, format(best & ((1 << shift) - 1), "x").translate(_LETTER)


def _rows(batches, n: int) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            piece = batch.slice(at, SLICE_ROWS)
            yield from zip(*(piece.column(i).to_pylist() for i in range(n)), strict=True)


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


class _Piece:
    """What one task knows of a conversation: counts, ends, and the product of its rows."""

    def __init__(self):
        self.n = 0
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.first = self.last = self.min_turn = self.max_turn = None
        self.product = Product()

    def add(self, turn, initial: str, fault: int, seen: bool, n: int) -> None:
        """A run of ``n`` equal rows; all but the first of them were seen before."""
        if not n:
            return
        if turn is not None and turn != self.max_turn:
            self.counts["turns"] += 1
            self.min_turn, self.max_turn = turn if self.min_turn is None else self.min_turn, turn
        for i in range(n):
            now = fault if fault == BLANK else DUPLICATE if seen or i else fault
            if now:
                self.counts["duplicate" if now == DUPLICATE else "blank" if now == BLANK else "truncated"] += 1
            if self.n:
                self.counts["illegal"] += self.last + initial not in _ALTERNATING
            else:
                self.first = initial
            self.last, self.n = initial, self.n + 1
            self.product.add(Stretch(row_table(initial, now), SLOT))

    def told(self) -> dict:
        whole = self.product.value()
        cells = [None if w is None else w.to_bytes((w.bit_length() + 7) // 8, "big") for row in whole.table for w in row]
        return {"n": self.n, **self.counts, "first": self.first, "last": self.last, "min_turn": self.min_turn, "max_turn": self.max_turn, "cells": cells}

    def join(self, piece: dict) -> None:
        """Put a later piece behind this one."""
        if not piece["n"]:
            return
        for name in _COUNTS:
            self.counts[name] += piece[name]
        if self.n:
            self.counts["illegal"] += self.last + piece["first"] not in _ALTERNATING
            self.counts["turns"] -= self.max_turn is not None and self.max_turn == piece["min_turn"]
        self.first = piece["first"] if not self.n else self.first
        self.last, self.n = piece["last"], self.n + piece["n"]
        self.min_turn = piece["min_turn"] if self.min_turn is None else self.min_turn
        self.max_turn = self.max_turn if piece["max_turn"] is None else piece["max_turn"]
        cells = [None if c is None else int.from_bytes(c, "big") for c in piece["cells"]]
        self.product.add(Stretch([cells[i : i + 4] for i in range(0, 16, 4)], SLOT * piece["n"]))


_PIECE = (
    "n long, blank long, duplicate long, truncated long, illegal long, turns long, "
    "first string, last string, min_turn long, max_turn long, cells array<binary>"
)
_PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(df: DataFrame, column: str, rest: str) -> pa.Schema:
    """Arrow schema of an output led by ``column`` of ``df``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType([df.schema[column], *StructType.fromDDL(rest).fields]))


def _grouped(rows: Iterator[tuple], start, add, end, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Fold runs of rows with one leading value into one row each."""
    out, at, held = [], None, None
    for key, *row in rows:
        if held is None or key != at:
            if held is not None:
                out.append({schema.names[0]: at, **end(held)})
                # tables of long conversations are large: hand on few at a time
                if len(out) >= SLICE_ROWS:
                    yield _batch(out, schema)
                    out = []
            at, held = key, start()
        add(held, row)
    if held is not None:
        out.append({schema.names[0]: at, **end(held)})
    if out:
        yield _batch(out, schema)


def _schema_text(df: DataFrame, column: str, rest: str) -> str:
    return f"{column} {df.schema[column].dataType.simpleString()}, {rest}"


def fault_of(text: Column) -> Column:
    """Fault that a message's own text shows; repeats are found from the rows before."""
    last = F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    return F.when(last == "", BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(TRUNCATED)


def _prepared(messages: DataFrame, copies: str | None) -> DataFrame:
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    times = F.col(copies) if copies else F.lit(1)
    same = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    return messages.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), times.cast("int").alias("copies"), same.alias("same"))


def plan_repairs(messages: DataFrame, copies: str | None = None) -> DataFrame:
    """One row for each ``conv_id`` of ``messages(conv_id, turn, role, text)``: its faults, and the cheapest edits.

    Columns: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``.  Rows are
    taken by turn (null turns first, and no part of ``gaps``), those of one turn by a
    hash of role and text; equal rows are repeats of the first.  Column ``copies`` says how often a
    row stands (0: only its conversation is told).  Null roles and texts count as one blank; an
    empty role has no initial, so it can only be replaced or deleted.  A null ``conv_id`` is a
    conversation of its own.  Texts and conversations may have any length; other
    columns are ignored.  No rows in, no rows out.
    """
    rows = _prepared(messages, copies)
    # equal rows of a turn become one before anything moves
    runs = cut(
        rows.select("conv_id", F.when(F.col("copies") > 0, F.col("turn")).alias("turn"), F.when(F.col("copies") > 0, F.col("same")).alias("same"), "copies",
                    F.substring("role", 1, 1).alias("initial"), fault_of(F.col("text")).alias("fault"))
        .groupBy("conv_id", "turn", "same").agg(F.sum("copies").alias("n"), F.min("initial").alias("initial"), F.min("fault").alias("fault"))
    )
    order = F.struct(F.col("turn").isNotNull().alias("told"), "turn")
    firsts = cut(
        runs.where("n > 0").groupBy("conv_id", "same").agg(F.count("*").alias("times"), F.min(order).alias("first_at")).where("times > 1")
        .select(F.col("conv_id").alias("first_conv"), F.col("same").alias("first_same"), "first_at")
    )
    seen = runs.join(firsts, F.col("conv_id").eqNullSafe(F.col("first_conv")) & (F.col("same") == F.col("first_same")), "left").select(
        "conv_id", "turn", "initial", "fault", F.coalesce(F.col("first_at") < order, F.lit(False)).alias("seen"), "n", "same"
    )
    ranged = seen.repartitionByRange(parts(messages), "conv_id", "turn", "same").sortWithinPartitions("conv_id", "turn", "same")
    piece_schema = _arrow(messages, "conv_id", f"part int, {_PIECE}")

    def pieces(batches):
        part = TaskContext.get().partitionId()
        yield from _grouped(_rows(batches, 6), _Piece, lambda p, r: p.add(*r), lambda p: {"part": part, **p.told()}, piece_schema)

    told = ranged.mapInArrow(pieces, _schema_text(messages, "conv_id", f"part int, {_PIECE}"))
    names, plan_schema = piece_schema.names[2:], _arrow(messages, "conv_id", _PLAN)

    def planned(piece: _Piece) -> dict:
        cost, audit = cheapest(piece.product.value())
        gaps = 0 if piece.min_turn is None else piece.max_turn - piece.min_turn + 1 - piece.counts["turns"]
        return {"gaps": gaps, **{c: piece.counts[c] for c in _COUNTS[:4]}, "cost": cost, "audit": audit}

    def plans(batches):
        yield from _grouped(_rows(batches, len(names) + 2), _Piece, lambda p, r: p.join(dict(zip(names, r[1:], strict=True))), planned, plan_schema)

    met = told.repartition(parts(messages), "conv_id").sortWithinPartitions("conv_id", "part")
    return met.mapInArrow(plans, _schema_text(messages, "conv_id", _PLAN))


_EDITED = "edit string, role string, text string"


def repaired(messages: DataFrame, plans: DataFrame, copies: str | None = None) -> DataFrame:
    """The edits of ``plan_repairs`` put to work: rows ``conv_id, edit, role, text`` in order within each partition.

    A conversation lies whole in one partition and is led by a row without edit.  Deleted
    messages are told with ``edit`` D; inserted ones have empty texts.
    """
    schema = _arrow(messages, "conv_id", _EDITED)
    lead = plans.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("same"), F.lit(0).alias("copies"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    said = _prepared(messages, copies).where("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "same", "copies", "role", "text")
    met = lead.unionByName(said).repartition(parts(messages), "conv_id").sortWithinPartitions("conv_id", "kind", "turn", "same")

    def walk(batches):
        out = []
        conv, audit, at, state = None, "", 0, START

        def put(edit, role, text):
            out.append({"conv_id": conv, "edit": edit, "role": role, "text": text})

        def insert():
            nonlocal at, state
            while at < len(audit) and audit[at] == INSERT:
                role = _TURN_OF[state]
                put(INSERT, role, "")
                at, state = at + 1, _NEXT[role[0]][state]

        for key, kind, _, _, copies, role, text in _rows(batches, 7):
            if not kind:
                insert()
                conv, audit, at, state = key, text, 0, START
                put(None, None, None)
            for _ in range(copies):
                insert()
                edit, now = audit[at], role
                at += 1
                if edit != DELETE:
                    now = _TURN_OF[state] if edit == REROLE else role
                    state = _NEXT[now[0]][state]
                put(edit, now, text)
            if len(out) >= SLICE_ROWS:
                yield _batch(out, schema)
                out = []
        insert()
        if out:
            yield _batch(out, schema)

    return met.mapInArrow(walk, _schema_text(messages, "conv_id", _EDITED))


class _Digest:
    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def add(self, row) -> None:
        edit, role, text = row
        if edit in (None, DELETE):
            return
        self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any = True


def repair_report(messages: DataFrame, copies: str | None = None) -> DataFrame:
    """``plan_repairs`` with ``repaired_sha256``, the hash of the repaired ``role:text`` lines."""
    plans = cut(plan_repairs(messages, copies))
    schema = _arrow(messages, "conv_id", "repaired_sha256 string")

    def fold(batches):
        yield from _grouped(_rows(batches, 4), _Digest, _Digest.add, lambda d: {"repaired_sha256": d.sha.hexdigest()}, schema)

    hashes = repaired(messages, plans, copies).mapInArrow(fold, _schema_text(messages, "conv_id", "repaired_sha256 string"))
    named = hashes.withColumnRenamed("conv_id", "hashed_conv")
    return plans.join(named, F.col("conv_id").eqNullSafe(F.col("hashed_conv"))).drop("hashed_conv")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with a fault in every fourth row, by a checksum of conversation and turn; nulls are one blank.

    A row that is dropped stays with ``copies`` 0, one that is repeated has 2.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(F.col("role"), blank), F.coalesce(F.col("text"), blank)
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )

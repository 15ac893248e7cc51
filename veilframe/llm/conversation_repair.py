"""Conversation structure: faults of turns, and the cheapest edits that give legal roles.

The roles of a conversation must read `(s?(ua)+)?` by their initials. An error-correcting
Earley parser finds the edits: the role grammar has, beside the productions that keep a
row, weighted ones that delete it, give it another role, or insert one. The grammar is
left-linear, so each chart set holds a fixed number of items and a parse is linear in
the turns. An item's value is the minimum of (cost, audit), the audit being the edits'
initials; equal costs fall to the ASCII-least audit.

Work is dealt by conversation and streamed in turn order. Rows of a conversation are
never held together: a task keeps one letter for each row and edit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from veilframe.llm.common import cut

#: Characters that words are not made of, and ends of a finished text (fixed values).
SPACES, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
#: What edits cost, and what a truncated row costs that is not deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Pairs of adjacent initials that are legal.
LEGAL = ("su", "ua", "au")
#: Edits of an item that are joined into one string at once, and rows of a result batch.
FOLD, BATCH = 4096, 1024


# ---------------------------------------------------------------- the grammar


class Production(NamedTuple):
    """head -> body read: `body` is recognised from the first row on, then a row is read
    as an initial ('*': any row), or nothing ('')."""

    head: str
    body: str
    read: str
    edit: str
    cost: int


def _grammar() -> list[Production]:
    parts = {"u": ("asked", ("empty", "system", "answered")), "a": ("answered", ("asked",))}
    out = [Production("system", "empty", "s", "K", KEEP)]
    out += [Production(x, x, "*", "D", DELETE) for x in ("empty", "system", "asked", "answered")]
    for initial, (head, bodies) in parts.items():
        for body in bodies:
            out += [Production(head, body, initial, "K", KEEP), Production(head, body, "*", "R", REROLE), Production(head, body, "", "I", INSERT)]
    return out


GRAMMAR = _grammar()
#: What a whole conversation may be.
GOALS = ("empty", "answered")
INSERTS = {body: [p for p in GRAMMAR if p.body == body and not p.read] for body in {p.body for p in GRAMMAR}}
SCANS = [p for p in GRAMMAR if p.read]


class Value(NamedTuple):
    """The best way to an item: cost, place of its audit among those of its chart set,
    inserts since the last row, and the edits before those.

    Audits of one set without their last inserts have read the same rows, so none is the
    beginning of another, and the order of two never changes by what follows."""

    cost: int
    rank: int
    tail: str
    edits: tuple

    def order(self) -> tuple:
        return self.cost, self.rank, self.tail


def _complete(found: dict[str, Value]) -> dict[str, Value]:
    """Insert productions complete where they are predicted, until no value falls."""
    agenda = list(found)
    while agenda:
        body = agenda.pop()
        at = found[body]
        for p in INSERTS.get(body, ()):
            value = Value(at.cost + p.cost, at.rank, at.tail + p.edit, at.edits)
            if p.head not in found or value.order() < found[p.head].order():
                found[p.head] = value
                agenda.append(p.head)
    return found


def _scan(found: dict[str, Value], row: str) -> dict[str, Value]:
    """The next chart set: items over `row` (its initial; a capital: truncated; x: to be
    deleted)."""
    late = TRUNCATED if row.isupper() else 0
    best: dict[str, tuple] = {}
    for p in SCANS:
        if p.body in found and (p.edit == "D" or row != "x") and p.read in ("*", row.lower()):
            at = found[p.body]
            value = at.cost + p.cost + (late if p.edit != "D" else 0), at.rank, at.tail + p.edit, at.edits
            if p.head not in best or value[:3] < best[p.head][:3]:
                best[p.head] = value
    places = {key: k for k, key in enumerate(sorted({v[1:3] for v in best.values()}))}
    return {head: Value(cost, places[rank, piece], "", (piece, edits)) for head, (cost, rank, piece, edits) in best.items()}


def _text(edits: tuple, bases: tuple = ()) -> tuple[str, tuple]:
    """Linked edits as one string, back to one of `bases` or the beginning."""
    out = []
    while edits and not any(edits is b for b in bases):
        piece, edits = edits
        out.append(piece)
    return "".join(reversed(out)), edits


@lru_cache(1 << 14)
def parse(rows: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of rows: one letter each, the role's initial
    or `o` for any other, a capital where the text is truncated, `x` to be deleted."""
    found = _complete({"empty": Value(0, 0, "", ())})
    bases: tuple = ()
    for k, row in enumerate(rows, 1):
        found = _complete(_scan(found, row))
        if k % FOLD == 0:  # short chains: their edits become one string each
            bases, found = _fold(found, bases)
    value = min((found[x] for x in GOALS if x in found), key=Value.order)
    return value.cost, _text(value.edits)[0] + value.tail


def _fold(found: dict[str, Value], bases: tuple) -> tuple[tuple, dict[str, Value]]:
    """Each value's edits since the last fold as one string; equal histories are shared."""
    made: dict[tuple, tuple] = {}
    out = {}
    for head, v in found.items():
        text, before = _text(v.edits, bases)
        out[head] = v._replace(edits=made.setdefault((text, id(before)), (text, before)))
    return tuple(made.values()), out


# ---------------------------------------------------------------- faults


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by a hash of conversation and turn: a row is
    dropped, loses its text or its sentence ends, is repeated, or becomes the user's.

    Null roles and texts become one space, and so do null ids in the hash."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    all_ = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    said = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return all_.select("conv_id", "turn", role.alias("role"), said.alias("text"), F.explode(times).alias("_")).drop("_")


def _turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text"))


def mark_faults(turns: DataFrame) -> DataFrame:
    """turns plus `fault`, each row's first of blank, duplicate and truncated (or null),
    and `copy`, how often its conversation has had its role and text. Rows are dealt by
    conversation once; the window and the later sort need no other exchange."""
    spaces = F.lit(SPACES)
    bare = F.rtrim(F.col("text"), spaces)
    seen = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy(F.asc_nulls_first("turn")))
    fault = F.when(bare == "", "blank").when(F.col("copy") > 1, "duplicate").when(~F.right(bare, F.lit(1)).isin(*ENDS), "truncated")
    return turns.repartition("conv").withColumn("copy", seen).withColumn("fault", fault)


class _Open:
    """What is known of the conversation that is being read."""

    def __init__(self, conv):
        self.conv, self.before, self.turn, self.low, self.high, self.distinct = conv, None, None, None, None, 0
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.rows: list[str] = []
        self.illegal = 0

    def add(self, turn: int | None, initial: str, fault: str | None) -> None:
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.turn = self.high = turn
            self.distinct += 1
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        letter = initial if initial in ("s", "u", "a") else "o"
        if fault:
            self.faults[fault] += 1
            letter = letter.upper() if fault == "truncated" else "x"
        self.rows.append(letter)
        if len(self.rows) > FOLD:
            self.rows = ["".join(self.rows)]

    def result(self) -> tuple:
        rows = "".join(self.rows)
        cost, audit = parse(rows) if len(rows) < 256 else parse.__wrapped__(rows)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.conv, min(gaps, 2**63 - 1), *self.faults.values(), self.illegal, cost, audit


def _parsed(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Open | None = None
        out: list[tuple] = []
        for batch in batches:
            for conv, turn, initial, fault in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        out.append(now.result())
                    now = _Open(conv)
                now.add(turn, initial, fault)
            if len(out) >= BATCH:
                yield _batch(out, schema)
                out = []
        if now is not None:
            out.append(now.result())
        if out:
            yield _batch(out, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(**extra: pa.DataType):
    """Schema of a result: the conversation's id as it came, then `extra`."""
    return lambda kind: pa.schema([("conv", kind), *extra.items()])


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def parse_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv, gaps, blank, duplicate, truncated, illegal,
    cost, audit. `conv` is a whole number or a text.

    Null ids are one conversation; null turns come first; a null role or text counts as
    one space. Rows of one turn are taken by role and text, repeated rows are duplicates
    of the first. Roles of other initials can only be reroled or deleted. An empty table
    has no conversations; columns besides the four are not looked at."""
    whole = isinstance(rows.schema[conv].dataType, IntegralType)
    kind, name = (pa.int64(), "long") if whole else (pa.string(), "string")
    marked = mark_faults(_turns(rows.withColumn(conv, F.col(conv).cast(name)), conv, turn, role, text))
    ordered = marked.sortWithinPartitions(F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "text", "copy")
    schema = _arrow(**dict.fromkeys(COUNTS, pa.int64()), audit=pa.string())(kind)
    fields = ", ".join(f"{c} long" for c in COUNTS)
    return ordered.select("conv", "turn", F.substring("role", 1, 1).alias("initial"), "fault").mapInArrow(_parsed(schema), f"conv {name}, {fields}, audit string")


# ---------------------------------------------------------------- repair


def _edited(kind: pa.DataType):
    """Repaired rows, from each conversation's audit and, after it, its rows in order."""
    schema = _arrow(position=pa.int64(), edit=pa.string(), role=pa.string(), text=pa.string())(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, place, roles = "", 0, 0, ""
        conv = None
        out: list[tuple] = []

        def emit(edit: str, role: str | None, text: str) -> None:
            nonlocal place, roles
            wanted = "assistant" if roles == "u" else "user"
            role = role if edit == "K" else wanted
            out.append((conv, place, edit, role, text))
            place, roles = place + 1, role[:1]

        def inserts() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                emit("I", None, "")
                at += 1

        for batch in batches:
            for conv_, audit_, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if audit_ is not None:
                    conv, audit, at, place, roles = conv_, audit_, 0, 0, ""
                else:
                    if audit[at] != "D":
                        emit(audit[at], role, text)
                    at += 1
                inserts()
                if len(out) >= BATCH:
                    yield _batch(out, schema)
                    out = []
        if out:
            yield _batch(out, schema)

    return run


def repair_conversations(rows: DataFrame, parsed: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations, one row a turn: conv, position (from 0), edit (K kept,
    R given another role, I inserted with an empty text), role, text.

    `parsed` is the result of `parse_conversations` of the same rows. A conversation's
    rows stay together and in order within their partition. A conversation of which
    nothing is left has no rows. Nulls and ties are as there."""
    name = dict(parsed.dtypes)["conv"]
    name, kind = ("long", pa.int64()) if name == "bigint" else ("string", pa.string())
    turns = _turns(rows.withColumn(conv, F.col(conv).cast(name)), conv, turn, role, text)
    texts = turns.select("conv", F.lit(None).cast("string").alias("audit"), "turn", "role", "text")
    none = F.lit(None).cast("string")
    heads = parsed.select("conv", "audit", F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("text"))
    dealt = heads.union(texts).repartition("conv")
    ordered = dealt.sortWithinPartitions(F.asc_nulls_first("conv"), F.col("audit").isNull(), F.asc_nulls_first("turn"), "role", "text")
    return ordered.select("conv", "audit", "role", "text").mapInArrow(_edited(kind), f"conv {name}, position long, edit string, role string, text string")


def _digests(kind: pa.DataType):
    schema = _arrow(repaired_sha256=pa.string())(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv, out = None, None, []
        for batch in batches:
            for conv_, place, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv", "position", "role", "text")], strict=True):
                if place == 0:
                    if now is not None:
                        out.append((conv, now.hexdigest()))
                    now, conv = hashlib.sha256(), conv_
                now.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            if len(out) >= BATCH:
                yield _batch(out, schema)
                out = []
        if now is not None:
            out.append((conv, now.hexdigest()))
        if out:
            yield _batch(out, schema)

    return run


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the result of `repair_conversations`: its `role:text`
    lines, joined. The hash goes on from row to row, so no conversation is held."""
    name = "long" if dict(repaired.dtypes)["conv"] == "bigint" else "string"
    kind = pa.int64() if name == "long" else pa.string()
    return repaired.mapInArrow(_digests(kind), f"conv {name}, repaired_sha256 string")


def repair_damaged(rows: DataFrame) -> DataFrame:
    """Every conversation of `rows` after planted damage: its faults, the cheapest repair
    and a digest of it. Conversations that lost all rows have zeros, an empty audit and
    the digest of an empty text."""
    broken = damage(rows)
    parsed = cut(parse_conversations(broken), "parsed")
    hashed = digests(repair_conversations(broken, parsed))
    ids = rows.select("conv_id").distinct()
    same = lambda other: F.col("conv_id").eqNullSafe(other["conv"])
    out = ids.join(parsed, same(parsed), "left").drop("conv").join(hashed, same(hashed), "left").drop("conv")
    empty: Column = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))

"""Conversation structure repair: forward Viterbi over the rows of each conversation and four states of the grammar ``(s?(ua)+)?``.

States are: nothing yet, after the system turn, after a user turn, after an assistant turn.  A row is kept (0), gets the role that the state asks for
(3) or is deleted (4, a must for blank and repeated rows); a truncated row that stays costs 3 more.  An empty turn of the role that the state asks for
can be inserted anywhere (3).  After each row, a layer holds for each state the least (cost, audit string) that ends with that row's
edit; it is closed by up to two inserts, as more would come back to a state at a higher cost.

Audits of one layer hold the same number of edits of rows and end with one, so none begins another, and their order never changes by what is
appended.  It is carried as a rank, so nothing is copied: each layer stores a byte a state, and the audit is read back from these.  The
SHA-256 of the repaired text runs along with each of the four paths, so no text is held back.

Rows are shuffled once, by ``conv_id``, and go through in sorted order.  A conversation is one task, since a hash has to take its text in order, but
in bounded memory: four bytes a row (the audit itself takes one or more), one row's text, four hashes.

Nulls, in any column, are read as one space: such a text is blank, such a role (an empty one too) is neither s, u nor a and cannot be kept.  Rows are taken by turn, nulls first, ties by role
and text.  A null ``conv_id`` is a conversation of its own.  Repeated rows are duplicates.  Empty texts are blank, very long ones are
hashed whole.  An empty table has no result rows.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the role that an insert or a new role has in each state
ROLE = {USER: "user", ASSISTANT: "assistant"}
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
LEGAL = {"su", "ua", "au"}
CLOSINGS = {NOTHING: (NOTHING, USER, ASSISTANT), SYSTEM: (SYSTEM, USER, ASSISTANT), USER: (USER, ASSISTANT), ASSISTANT: (ASSISTANT, USER)}  # by 0, 1 and 2 inserts


class Step(NamedTuple):
    state: int  # before
    inserts: int
    edit: str
    to: int
    cost: int


def _steps(initial: str, must_go: bool, truncated: bool) -> dict[int, list[Step]]:
    """By the state that they lead to: ways over one row."""
    out: dict[int, list[Step]] = {}
    for state, closed in CLOSINGS.items():
        for inserts, at in enumerate(closed):
            ways = [(DELETE, "D", at)]
            if not must_go:
                if initial == "s" and at == NOTHING:
                    ways.append((0, "K", SYSTEM))
                elif initial == "ua"[NEXT[at] - USER]:
                    ways.append((0, "K", NEXT[at]))
                ways.append((REROLE, "R", NEXT[at]))
            for cost, edit, to in ways:
                out.setdefault(to, []).append(Step(state, inserts, edit, to, INSERT * inserts + cost + TRUNCATED * (truncated and edit != "D")))
    return out


WAYS = {(initial, go, cut): _steps(initial, go, cut) for initial in ("s", "u", "a", "") for go in (False, True) for cut in (False, True)}
CODES = {(state, inserts, edit): state * 9 + inserts * 3 + "DKR".index(edit) for state in range(4) for inserts in range(3) for edit in "DKR"}
EDITS = {code: key for key, code in CODES.items()}


class Path(NamedTuple):
    cost: int
    rank: int  # of its audit among those of the layer
    digest: object  # hash of the repaired text so far


class Repair:
    """One conversation, row by row."""

    def __init__(self):
        self.layer: dict[int, Path] = {NOTHING: Path(0, 0, hashlib.sha256())}
        self.codes = bytearray()

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        ways = WAYS[role[:1] if role[:1] in ("s", "u", "a") else "", must_go, truncated]
        best = []
        for to, steps in ways.items():
            known = [(self.layer[s.state].cost + s.cost, self.layer[s.state].rank, "I" * s.inserts + s.edit, s) for s in steps if s.state in self.layer]
            if known:
                best.append((to, min(known, key=lambda x: x[:3])))
        order = {to: i for i, (to, _) in enumerate(sorted(best, key=lambda x: x[1][1:3]))}
        codes, layer = [255] * 4, {}
        for to, (cost, _, _, s) in best:
            digest = self._appended(s.state, s.inserts)
            if s.edit != "D":
                at = CLOSINGS[s.state][s.inserts]
                digest = self._with(digest, at, role if s.edit == "K" else ROLE[NEXT[at]], text)
            codes[to] = CODES[s.state, s.inserts, s.edit]
            layer[to] = Path(cost, order[to], digest)
        self.layer = layer
        self.codes += bytes(codes)

    def _appended(self, state: int, inserts: int):
        digest = self.layer[state].digest
        for k in range(inserts):
            at = CLOSINGS[state][k]
            digest = self._with(digest, at, ROLE[NEXT[at]], "")
        return digest

    @staticmethod
    def _with(digest, state: int, role: str, text: str):
        new = digest.copy()
        new.update(("" if state == NOTHING else "\n").encode() + f"{role}:".encode())
        new.update(text.encode())
        return new

    def end(self) -> tuple[int, str, str]:
        """(cost, audit, digest of the repaired text) of the cheapest path that ends with nothing or an assistant turn."""
        ends = [(p.cost + INSERT * k, p.rank, "I" * k, state) for state, p in self.layer.items() for k, at in enumerate(CLOSINGS[state]) if at in (NOTHING, ASSISTANT)]
        cost, _, tail, state = min(ends)
        digest = self._appended(state, len(tail)).hexdigest()
        parts = [tail]
        for row in range(len(self.codes) // 4 - 1, -1, -1):
            state, inserts, edit = EDITS[self.codes[row * 4 + state]]
            parts.append("I" * inserts + edit)
        return cost, "".join(reversed(parts)), digest


class Counts:
    """What is counted of one conversation's rows."""

    def __init__(self):
        self.low = self.high = self.turn = self.initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def row(self, turn: int | None, role: str, fault: str) -> None:
        if turn is not None:
            self.turns += self.turn is None or turn != self.turn  # sorted, nulls first
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in LEGAL
        self.initial = role[:1]

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


RESULT = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, a row for each conversation."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    done: list[tuple] = []
    now, repair, counts = None, None, None
    kind = None

    def out() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        types = [kind] + [pa.int64()] * 6 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def close() -> None:
        cost, audit, digest = repair.end()
        done.append((now[0], counts.gaps, counts.blank, counts.duplicate, counts.truncated, counts.illegal, cost, audit, digest))

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for i, conv in enumerate(batch.column("conv_id").to_pylist()):
            if now is None or now[0] != conv:
                if now is not None:
                    close()
                now, repair, counts = (conv,), Repair(), Counts()
            if batch.column("gone")[i].as_py():
                continue
            turn, role, text, fault = (batch.column(c)[i].as_py() for c in ("turn", "role", "text", "fault"))
            counts.row(turn, role, fault)
            repair.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")
        if len(done) >= 4096:
            yield out()
            done = []
    if now is not None:
        close()
        yield out()


def _shown(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``gone`` (dropped rows stay as marks of their conversation): faults put in by crc32 of ``conv_id:turn``, modulo 20."""
    fault = F.crc32(F.concat(_shown("conv_id"), F.lit(":"), _shown("turn")).cast("binary")) % 20
    some = rows.select("conv_id", "turn", _shown("role").alias("role"), _shown("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") <= 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    twice = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return some.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), twice.alias("_copy")).drop("_copy")


def plain(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``gone`` (false) of rows as they are."""
    return rows.select("conv_id", "turn", _shown("role").alias("role"), _shown("text").alias("text"), F.lit(False).alias("gone"))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (of ``damaged`` or ``plain``) dealt by conversation, with the first ``fault`` of each: blank, duplicate, truncated or nothing.

    Which rows repeat is told by a row number within equal rows of a conversation, so no set of texts is held.
    """
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    again = rows.repartition("conv_id").withColumn("nth", F.row_number().over(same))
    blank = ~F.col("text").rlike("[^ \\t-\\r]")
    cut = ~F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")).rlike("[.!?]\\z")
    return again.withColumn("fault", F.when(blank, "blank").when(F.col("nth") > 1, "duplicate").when(cut, "truncated").otherwise(""))


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conversation of ``rows`` (of ``damaged`` or ``plain``): counts of faults, cost and audit of the cheapest repair, hash of what it gives."""
    common.work_dir(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = faults(rows).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "nth")
    return ordered.select("conv_id", "turn", "role", "text", "gone", "fault").mapInArrow(_repaired, RESULT.format(kind))

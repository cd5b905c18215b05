"""Conversation repair against every possible edit of short conversations, plain counts, awkward rows, one long conversation."""

import hashlib
import itertools
import random
import re
from collections import defaultdict
from zlib import crc32

import pytest

from cutloom.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile("(s?(ua)+)?")


def told(rows):
    """(role, text, fault) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def every_edit(rows, inserts=2):
    """(cost, audit, repaired) of all edits with at most so many inserts in one place, by trying them all."""
    gaps = [x for k in range(inserts + 1) for x in itertools.product(("user", "assistant"), repeat=k)]
    choices = [[("D", None, 4)] + ([] if f in ("blank", "duplicate") else [("K", r, 3 * (f == "truncated")), ("R", "user", 3 + 3 * (f == "truncated")), ("R", "assistant", 3 + 3 * (f == "truncated"))]) for r, _, f in rows]
    best = None
    for edits in itertools.product(*choices):
        for between in itertools.product(gaps, repeat=len(rows) + 1):
            cost = sum(e[2] for e in edits) + 3 * sum(map(len, between))
            if best and cost > best[0]:
                continue
            audit, said = "", []
            for i, added in enumerate(between):
                audit += "I" * len(added)
                said += [(r, "") for r in added]
                if i < len(rows):
                    audit += edits[i][0]
                    if edits[i][0] != "D":
                        said.append((edits[i][1], rows[i][1]))
            if GRAMMAR.fullmatch("".join(r[:1] or "?" for r, _ in said)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, said
    return best


def test_every_edit():
    rng = random.Random(4)
    for _ in range(60):
        rows = told([(i, rng.choice(("system", "user", "assistant", "user", "assistant", "tool", "")), rng.choice(("Yes.", "no", "", "Well!", "maybe"))) for i in range(rng.randint(0, 3))])
        repair = cr.Repair()
        for role, text, fault in rows:
            repair.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")
        cost, audit, said = every_edit(rows)
        assert repair.end() == (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())


def plainly(rows):
    """A dictionary of dictionaries: all paths over (position, state), audits as strings."""
    best = {0: (0, "", [])}

    def better(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value

    def closed(table):
        table = dict(table)
        for _ in range(3):
            for state, (cost, audit, said) in list(table.items()):
                to = cr.NEXT[state]
                better(table, to, (cost + 3, audit + "I", said + [(cr.ROLE[to], "")]))
        return table

    for role, text, fault in rows:
        new = {}
        for state, (cost, audit, said) in closed(best).items():
            better(new, state, (cost + 4, audit + "D", said))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                to = cr.NEXT[state]
                better(new, to, (cost + 3 + more, audit + "R", said + [(cr.ROLE[to], text)]))
                if role[:1] == "s" and state == 0:
                    better(new, 1, (cost + more, audit + "K", said + [(role, text)]))
                if role[:1] == "ua"[to - 2]:
                    better(new, to, (cost + more, audit + "K", said + [(role, text)]))
        best = new
    ends = [v for s, v in closed(best).items() if s in (0, 3)]
    return min(ends, key=lambda v: v[:2])


def expected(rows, damage=True):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text, h = " " if role is None else role, " " if text is None else text, crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        convs[conv] += []
        if damage:
            if h == 0:
                continue
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            role = "user" if h == 4 else role
        convs[conv] += [(turn, role, text)] * (2 if damage and h == 3 else 1)
    out = set()
    for conv, some in convs.items():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        marks = told(some)
        turns = [t for t, _, _ in some if t is not None]
        cost, audit, said = plainly(marks)
        n = [sum(f == x for _, _, f in marks) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(some))
        out.add((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *n, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()))
    return out


def results(frame):
    return {tuple(r) for r in frame.collect()}


@pytest.mark.parametrize("damage", [True, False])
def test_random_conversations(spark, damage):
    rng = random.Random(8)
    rows = [(rng.choice((None, *range(40))), rng.choice((None, *range(12))), rng.choice(("system", "user", "assistant", "user", "assistant", None, "", "tool")), rng.choice((None, "", "Yes.", "no", "Ends. \n", "...", "Été", "a\tb?"))) for _ in range(400)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("fault", cr.F.lit("x")).withColumn("gone", cr.F.lit(1)).withColumn("nth", cr.F.lit(1)).withColumn("_copy", cr.F.lit(1))
    assert results(cr.repair((cr.damaged if damage else cr.plain)(frame))) == expected(rows, damage)


def test_awkward_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.repair(cr.damaged(empty)).collect() == []
    dropped = next(c for c in range(1000) if crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "gone"), (None, None, None, None), (1, 1, "user", "x" * 200_000 + "."), (1, 1, "user", "x" * 200_000 + "."), (1, 2, "assistant", "y.")]
    got = results(cr.repair(cr.damaged(spark.createDataFrame(rows, SCHEMA))))
    assert got == expected(rows)
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got


def test_one_long_conversation(spark):
    """A conversation of 20,000 rows of one role, with paths that part at the first row and never meet again."""
    rows = [(7, i, "user", f"Row {i}.") for i in range(20_001)]
    got = cr.repair(cr.plain(spark.createDataFrame(rows, SCHEMA))).first()
    assert got.cost == 3 * 10_001 and len(got.audit.replace("I", "")) == 20_001
    few = [(7, i, "user", f"Row {i}.") for i in range(41)]
    assert results(cr.repair(cr.plain(spark.createDataFrame(few, SCHEMA)))) == expected(few, damage=False)

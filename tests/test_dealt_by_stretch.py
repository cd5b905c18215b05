"""Segments and sound blocks are made where clips are dealt by stretch; only deals by number are shuffles."""

import random

from pyspark.sql import functions as F

from cutloom import plans
from cutloom.operators import audio as Au
from cutloom.operators import timeline as T

SCHEMA = "seq_id long, ord long, source_id long, src_in long, start long, stop long, rate double, track long"


def _dealt_again(frame):
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line for line in plan.splitlines() if "Join" in line or "Exchange " in line and "REPARTITION_BY_NUM" not in line]


def test_sound_blocks_are_dealt_twice(spark):
    """By sequence and by stretch; not again for marks, spans, segments and blocks."""
    clips = spark.createDataFrame([(k % 5, k // 5, 1, 0, k * 40, k * 40 + 60, 1.0, k % 3) for k in range(60)], SCHEMA).repartition(3, "seq_id")
    assert _dealt_again(T.segments(clips)) == []
    pieces = Au.block_pieces(clips, 30.0, 15.0)
    assert _dealt_again(pieces.groupBy("seq_id", "stretch", "block").agg(F.sum("n"))) == []
    assert _dealt_again(plans.QUERIES["sound_blocks"](spark, "/root/testdata/sf0.001")) == []


def test_segments_show_what_frames_show(spark):
    """Clips without length and before frame 0, long gaps, one sequence with most rows, cuts at the ends of stretches."""
    rng, rows = random.Random(5), []
    for k in range(400):
        seq, start = 7 if k % 3 else k % 9, rng.choice((rng.randrange(1500), 16 * rng.randrange(90), rng.randrange(4000, 4100)))
        rows.append((seq, k, k, rng.randrange(9), start, start + rng.choice((0, 1, 5, 16, 40, 300)), 1.0, rng.randrange(3)))
    rows += [(8, 900, 1, 0, -70, -5, 1.0, 1), (8, 901, 1, 0, -40, 3, 1.0, 2), (20, 902, 1, 0, 50, 50, 1.0, 1)]
    rows += [(None, 903, 1, 0, 0, 9, 1.0, 1)]  # as in joins, no key is no sequence
    for width in (16, 256):
        got = {}
        for r in T.segments(spark.createDataFrame(rows, SCHEMA).repartition(3), width).collect():
            assert r.a < r.b and r.a // width == (r.b - 1) // width == r.stretch
            for n in range(r.a, r.b):
                assert (r.seq_id, n) not in got
                got[r.seq_id, n] = r.ord
        for seq in {r[0] for r in rows} - {None}:
            own = [r for r in rows if r[0] == seq]
            total = max(r[5] for r in own)
            for n in range(min(0, *(r[4] for r in own), 0), total):
                on = max(((r[7], -r[1]) for r in own if r[4] <= n < r[5]), default=None)
                assert got.pop((seq, n), None) == (-on[1] if on else None)
        assert not got

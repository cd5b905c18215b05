"""Lookups against brute force with one sequence that holds most rows, clips without length among them."""

import random

import pytest
from pyspark.sql import functions as F

from cutloom.operators import curves as K
from cutloom.operators import documents as D
from cutloom.operators import edits as E
from cutloom.operators import timeline as T
from cutloom.sources import binary


@pytest.fixture(scope="module")
def hot(spark):
    rng, rows = random.Random(3), []
    for k in range(900):
        seq = 7 if k % 3 else k % 50
        start, n = rng.randrange(6000), rng.choice((0, 0, 1, 5, 40, 300))
        rows.append((seq, k, start, start + n, n, rng.randrange(1, 3)))
    return rows, spark.createDataFrame(rows, "seq_id long, ord long, start long, stop long, len long, track long").repartition(4)


def test_neighbours(hot):
    rows, clips = hot
    got = {r.ord: (r.next_start, r.prev_end) for r in T.neighbours(clips).collect()}
    for s, o, a, b, _, t in rows:
        other = [r for r in rows if r[0] == s and r[5] == t and r[1] != o]
        assert got[o] == (min((r[2] for r in other if r[2] >= b), default=None), max((r[3] for r in other if r[3] <= a), default=None))


def test_overlaps_meet_once_and_only_where_they_do(hot):
    rows, clips = hot
    moves = clips.select("seq_id", "ord", (F.col("start") + 7).alias("new_start"))
    got = {r.ord: r.ok for r in T.can_place(clips, moves).collect()}
    for s, o, a, _, n, t in rows:
        assert got[o] == (not any(r[0] == s and r[5] == t and r[1] != o and a + 7 < r[3] and r[2] < a + 7 + n for r in rows))
    left = clips.select("seq_id", F.col("ord").alias("a"), F.col("start").alias("a0"), F.col("stop").alias("a1"))
    right = clips.select("seq_id", F.col("ord").alias("b"), F.col("start").alias("b0"), F.col("stop").alias("b1"))
    pairs = sorted((r.a, r.b) for r in T.overlapping(left, right, ["seq_id"], ("a0", "a1"), ("b0", "b1")).collect())
    assert pairs == sorted((x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])


def test_snapping_looks_near_only(hot):
    rows, clips = hot
    targets = clips.select("seq_id", F.col("ord").alias("pos"), F.col("stop").alias("target"))
    got = {r.ord: (r.start, r.snapped) for r in E.snap_start(clips.select("seq_id", "ord", "len", (F.col("start") + 6).alias("new_start")), targets, 4).collect()}
    for s, o, a, _, n, _ in rows:
        best = min(((abs(r[3] - off - a - 6), r[1], side, r[3] - off) for r in rows if r[0] == s for side, off in ((0, 0), (1, n)) if abs(r[3] - off - a - 6) <= 4), default=None)
        assert got[o] == (max(best[3] if best else a + 6, 0), best is not None)
    points, marks = clips.select("seq_id", "ord", "start"), clips.select("seq_id", "stop")
    assert T.within(points, marks, ["seq_id"], "start", "stop", 4).count() < 20 * len(rows)


def test_captions_are_closed_spans(spark):
    captions = spark.createDataFrame([(1, i, i * 2.0, i * 2.0 + 2.5, f"c{i}") for i in range(500)], "seq_id long, ord long, start double, stop double, text string")
    points = spark.createDataFrame([(1, i * 0.5) for i in range(2100)], "seq_id long, t double")
    got = {r.t: r.ord for r in D.caption_at(points, captions).collect()}
    assert all(got[i * 0.5] == max((k for k in range(500) if k * 2.0 <= i * 0.5 <= k * 2.0 + 2.5), default=None) for i in range(2100))


def test_moved_keys_take_the_place(spark):
    curves = spark.createDataFrame([(1, 0, 0.0, "linear"), (1, 5, 0.5, "hold"), (1, 8, 0.8, "smooth")], "owner_id long, frame long, value double, ease string")
    moved = K.move_keys(curves, spark.createDataFrame([(1, 5, 8)], "owner_id long, frame long, to long"))
    assert sorted(map(tuple, moved.collect())) == [(1, 0, 0.0, "linear"), (1, 8, 0.5, "hold")]


def test_sequences_are_decimated_apart(spark):
    frames = spark.createDataFrame([(s, n, s * 100 + n) for s in (1, 2) for n in range(s, 10 + s)], "seq long, frame long, v long")
    got = sorted((r.seq, r.frame, r.v) for r in binary.decimated(frames, 30, 10, "seq").collect())
    assert got == [(1, 0, 101), (1, 1, 103), (1, 2, 106), (1, 3, 109), (2, 0, 202), (2, 1, 203), (2, 2, 206), (2, 3, 209)]

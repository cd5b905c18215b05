"""What edits keep, over many random sequences at once."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cutloom.functions import numeric as N
from cutloom.operators import edits as E
from cutloom.operators import timeline as T


@pytest.fixture(scope="module")
def clips(spark):
    rng, rows = random.Random(20260728), []
    for seq in range(120):
        ends = {}
        for o in range(rng.randint(1, 9)):
            lane, rate, src_in = rng.randint(1, 3), rng.choice([0.5, 1.0, 1.0, 2.0]), rng.randint(0, 20)
            n = rng.randint(1, 60)
            start = ends.get(lane, 0) + rng.choice([0, 0, 4])
            rows.append((seq, o, rng.randint(1, 4), src_in, src_in + n, rate, start, lane))
            ends[lane] = start + int(n // rate)
    frame = spark.createDataFrame(rows, "seq_id long, ord long, source_id long, src_in long, src_out long, rate double, start long, track long")
    return sized(frame).cache()


def sized(frame):
    return frame.withColumn("len", N.clip_length()).withColumn("stop", F.col("start") + F.col("len"))


def overlaps(clips):
    a, b = (clips.select("seq_id", "track", *(F.col(c).alias(f"{k}_{c}") for c in ("ord", "start", "stop"))) for k in "ab")
    return a.join(b, ["seq_id", "track"]).where("a_ord < b_ord and a_start < b_stop and b_start < a_stop and a_stop > a_start and b_stop > b_start").count()


def test_split_changes_nothing_that_shows(clips):
    points = clips.groupBy("seq_id").agg(N.div(F.max("stop"), 2).alias("n"))
    halves = sized(E.split_at(clips, points))
    renumbered = halves.withColumn("ord", F.row_number().over(Window.partitionBy("seq_id").orderBy("ord", "part")).cast("long"))
    frames = T.frames(clips)
    show = lambda c: T.locate(frames, c).select("seq_id", "n", "source_id", "source_frame")
    assert show(clips).exceptAll(show(renumbered)).count() == 0
    joined = E.join_islands(halves)
    assert joined.agg(F.sum("parts")).first()[0] == halves.count()


def test_moves_never_overlap(clips):
    assert overlaps(clips) == 0
    moves = clips.where("ord = 1").select("seq_id", "ord", (F.col("start") + 5).alias("new_start"))
    targets = clips.select("seq_id", F.col("ord").alias("pos"), F.col("stop").alias("target"))
    moved = E.move(clips, moves, targets, 3).select("seq_id", "ord", F.col("start").alias("at"))
    after = clips.join(moved, ["seq_id", "ord"], "left").withColumn("start", F.coalesce("at", "start")).withColumn("stop", F.col("start") + F.col("len"))
    assert overlaps(after) == 0


def test_close_gaps_leaves_none(clips):
    closed = E.close_gaps(clips).select("seq_id", "ord", F.col("start").alias("at"))
    after = clips.join(closed, ["seq_id", "ord"]).withColumn("start", F.col("at")).withColumn("stop", F.col("start") + F.col("len"))
    assert T.lane_gaps(after).count() == 0 and overlaps(after) == 0


def test_lanes_are_dense_and_in_order(clips):
    odd = clips.withColumn("track", F.col("track") * 3)
    both = T.compact(odd).join(odd.select("seq_id", "ord", "track"), ["seq_id", "ord"])
    per = both.groupBy("seq_id").agg(F.max("lane").alias("top"), F.count_distinct("lane").alias("n"), F.count_distinct("lane", "track").alias("pairs"))
    assert per.where("top <> n or pairs <> n").count() == 0


def test_frames_there_and_back(clips):
    rows = clips.where("len > 0").withColumn("n", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)))
    assert rows.where(N.timeline_frame(N.source_frame("n")) > F.col("n")).count() == 0
    assert rows.where((N.source_frame("n") < F.col("src_in")) | (N.source_frame("n") >= F.col("src_out"))).count() == 0


def test_free_lane_is_free(clips):
    wants = clips.groupBy("seq_id").agg(F.min("start").alias("at")).withColumn("length", F.lit(10).cast("long")).withColumn("want", F.lit(1).cast("long"))
    got = T.free_track(clips, wants)
    hit = got.join(clips, "seq_id").where("lane = track and at < stop and start < at + length")
    assert hit.count() == 0 and got.count() == wants.count()

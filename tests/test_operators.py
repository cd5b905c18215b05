"""Golden values of the operators, and properties that edits keep."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cutloom.functions import numeric as N
from cutloom.operators import analysis as A
from cutloom.operators import audio as Au
from cutloom.operators import curves as K
from cutloom.operators import documents as D
from cutloom.operators import edits as E
from cutloom.operators import media as M
from cutloom.operators import search as H
from cutloom.operators import timeline as T


def clips(spark, rows):
    """rows of (ord, src_in, src_out, rate, start, track) in sequence 1."""
    frame = spark.createDataFrame([(1, o, 7, a, b, float(r), s, t) for o, a, b, r, s, t in rows], "seq_id long, ord long, source_id long, src_in long, src_out long, rate double, start long, track long")
    return frame.withColumn("len", N.clip_length()).withColumn("stop", F.col("start") + F.col("len"))


def points(spark, *at):
    return spark.createDataFrame([(1, n) for n in at], "seq_id long, n long")


def restop(frame):
    return frame.withColumn("len", N.clip_length()).withColumn("stop", F.col("start") + F.col("len"))


def located(spark, frame, *at):
    return {r.n: (r.ord, r.source_frame) for r in T.locate(points(spark, *at), frame).collect()}


def test_split_keeps_what_shows(spark):
    whole = clips(spark, [(0, 0, 120, 1, 0, 1)])
    cut = restop(E.split_at(whole, points(spark, 40))).withColumn("ord", F.col("part").cast("long"))
    assert located(spark, cut, 39, 40, 119) == {39: (0, 39), 40: (1, 40), 119: (1, 119)}
    again = E.join_islands(cut)
    assert [tuple(r) for r in again.select("start", "src_in", "src_out", "parts").collect()] == [(0, 0, 120, 2)]


def test_split_of_a_slowed_clip_snaps_back(spark):
    slow = clips(spark, [(0, 0, 60, 0.5, 0, 1)])
    a, b = E.split_at(slow, points(spark, 41)).orderBy("part").collect()
    assert (a.src_out, b.src_in, b.start) == (20, 20, 40)


def test_ripple_and_locate_gap(spark):
    three = clips(spark, [(0, 0, 40, 1, 0, 1), (1, 40, 80, 1, 40, 1), (2, 80, 120, 1, 80, 1)])
    left = E.ripple_delete(three, spark.createDataFrame([(1, 1)], "seq_id long, ord long"))
    assert sorted((r.ord, r.start) for r in left.collect()) == [(0, 0), (2, 40)]
    assert located(spark, clips(spark, [(0, 0, 40, 1, 0, 1), (2, 80, 120, 1, 60, 1)]), 45) == {45: (None, None)}


def test_layers(spark):
    two = clips(spark, [(0, 0, 60, 1, 0, 1), (1, 0, 40, 1, 10, 2)])
    assert located(spark, two, 20, 55) == {20: (1, 10), 55: (0, 55)}


def test_move_snaps_or_is_refused(spark):
    two = clips(spark, [(0, 0, 40, 1, 0, 1), (1, 0, 40, 1, 60, 1)])
    targets = spark.createDataFrame([(1, 0, 40)], "seq_id long, pos long, target long")
    go = lambda n: E.move(two, spark.createDataFrame([(1, 1, n)], "seq_id long, ord long, new_start long"), targets, 10).first()
    assert (go(45).start, go(45).moved) == (40, True)
    assert (go(10).start, go(10).moved) == (60, False)


def test_trims(spark):
    slow = clips(spark, [(0, 0, 60, 0.5, 0, 1)])
    media = spark.createDataFrame([(7, 60)], "source_id long, nframes long")
    trim = lambda n: spark.createDataFrame([(1, 0, n)], "seq_id long, ord long, n long")
    assert tuple(E.trim_right(slow, media, trim(60)).first())[2:] == (30, 60)
    assert tuple(E.trim_left(slow, trim(20)).first())[2:] == (10, 20)


@pytest.mark.parametrize(("a", "b", "rate"), [(30, 30, 1.0), (15, 30, 0.5), (30, 15, 2.0), (30, 30.004, 1.0)])
def test_conform(spark, a, b, rate):
    assert spark.range(1).select(N.conform_rate(F.lit(float(a)), F.lit(float(b)))).first()[0] == rate


@pytest.mark.parametrize(("eases", "at", "value"), [(("linear", "linear"), 25, 0.25), (("smooth", "smooth"), 25, 0.15625), (("linear", "smooth"), 25, 0.296875), (("hold", "linear"), 99, 0.0), (("hold", "linear"), 100, 1.0), (("smooth", "linear"), 25, 0.109375), (("linear", "linear"), -5, 0.0), (("linear", "linear"), 500, 1.0)])
def test_curves(spark, eases, at, value):
    keys = spark.createDataFrame([(1, 0, 0.0, eases[0]), (1, 100, 1.0, eases[1])], "owner_id long, frame long, value double, ease string")
    got = K.value_at(spark.createDataFrame([(1, at), (2, at)], "owner_id long, frame long"), keys)
    assert {r.owner_id: r.value for r in got.collect()} == {1: pytest.approx(value), 2: None}


def test_captions_last_wins(spark):
    caps = spark.createDataFrame([(1, 0, 0.0, 1.0, "hello"), (1, 1, 0.9, 2.0, "world")], "seq_id long, ord long, start double, stop double, text string")
    at = spark.createDataFrame([(1, t) for t in (0.5, 0.95, 1.5, 9.0)], "seq_id long, t double")
    assert {r.t: r.text for r in D.caption_at(at, caps).collect()} == {0.5: "hello", 0.95: "world", 1.5: "world", 9.0: None}


def test_sound_arrays(spark):
    one = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0], [0.0, 1.0], [5.0])], "a array<double>, b array<double>, c array<double>").withColumn("three", F.lit(3)).withColumn("four", F.lit(4))
    got = one.select(Au.resample("a", 0.5).alias("x"), Au.resample_to("b", "three").alias("y"), Au.resample_to("c", "four").alias("z")).first()
    assert (got.x, got.y, got.z) == ([0.0, 2.0], [0.0, 0.5, 1.0], [5.0] * 4)


def test_timecodes(spark):
    got = [r[0] for r in spark.createDataFrame([(0,), (150,), (3665,)], "n long").select(M.timecode("n", 60)).collect()]
    assert got == ["00:00:00:00", "00:00:02:30", "00:01:01:05"]
    assert spark.range(1).select(M.timecode(F.lit(-3), 25)).first()[0] == "00:00:00:00"


def test_match_scores(spark):
    one = spark.createDataFrame([("Split at playhead", "edit", ["blade"])], "label string, category string, keywords array<string>")
    score = lambda q: one.select(H.match_score(q)).first()[0]
    assert [score(q) for q in ("split", "at play", "blade", "zzz", "sap", "")] == [4.0, 3.0, 1.5, 0.0, 0.5, 1.0]


def test_links_end_in_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long")
    got = D.link_chain(edges, spark.createDataFrame([(1,)], "node long"))
    assert sorted(r.node for r in got.collect()) == [2, 3]


def test_low_pass_keeps_constants_and_calms_flicker(spark):
    assert np.allclose(A.zero_phase(np.full(50, 3.0), 0.1), 3.0)
    n = np.arange(240)
    wobble = 0.2 * np.sin(2 * np.pi * 3 * n / 30)
    assert np.std(A.zero_phase(wobble, 2 * 0.5 / 30)[24:-24]) < np.std(wobble) / 3


def test_bundle_finds_a_known_shift(spark):
    rng = np.random.default_rng(1)
    base = rng.uniform(0, 100, (12, 2))
    rows = [(1, f, t, base[t, 0] + 3.0 * f, base[t, 1] - 2.0 * f) for f in range(4) for t in range(12)]
    frame = spark.createDataFrame(pd.DataFrame(rows, columns=["grp", "frame", "track", "x", "y"]))
    got = A.bundle_adjust(frame, "grp", rounds=40).orderBy("frame").toPandas()
    assert np.allclose(np.diff(got.tx), -3.0, atol=0.2) and np.allclose(np.diff(got.ty), 2.0, atol=0.2)


def test_nms_keeps_apart(spark):
    scored = spark.createDataFrame([(50, f, abs(f - 50) / 100) for f in range(200)], "ref long, frame long, score double")
    picks = [r.frame for r in H.suppressed(scored, 3, 30).orderBy("rank").collect()]
    assert all(abs(a - 50) >= 30 for a in picks) and all(abs(a - b) >= 30 for a in picks for b in picks if a != b)


def test_interval_join_over_many_buckets(spark):
    spans = clips(spark, [(0, 0, 5000, 1, 0, 1)])
    assert T.clips_at(points(spark, 0, 255, 256, 4999, 5000), spans).count() == 4


@pytest.mark.parametrize("forward", [False, True])
def test_asof_across_stretches(spark, forward):
    marks = spark.createDataFrame([(1, t, t * 10) for t in (5, 17, 90)] + [(None, 4, 40)], "k long, t long, v long")
    points = spark.createDataFrame([(1, t) for t in (0, 5, 6, 16, 17, 45, 89, 90, 200)] + [(2, 5), (None, 5)], "k long, t long")
    got = {(r.k, r.t): r.v for r in K.asof(points, marks, ["k"], "t", ["v"], forward, width=10).collect()}
    after = {0: 50, 5: 50, 6: 170, 16: 170, 17: 170, 45: 900, 89: 900, 90: 900, 200: None}
    before = {0: None, 5: 50, 6: 50, 16: 50, 17: 170, 45: 170, 89: 170, 90: 900, 200: 900}
    assert {t: v for (k, t), v in got.items() if k == 1} == (after if forward else before)
    assert got[2, 5] is None and got[None, 5] == (None if forward else 40)


def test_running_totals(spark):
    rows = spark.createDataFrame([(1, i, i % 7) for i in range(50)], "k long, i long, v long")
    got = M.running_total(rows, ["k"], ["i"], "v", 8).orderBy("i").collect()
    assert [r.before for r in got] == [sum(j % 7 for j in range(i)) for i in range(50)]
    assert {r.total for r in got} == {sum(j % 7 for j in range(50))}

"""Transitions at points against brute force; clips are dealt by sequence once."""

import random

import pytest

from cutloom import plans
from cutloom.operators import timeline as T


def test_transition_mix_is_dealt_once(spark):
    """The spans carry what is shown of both clips, and points meet them where they are."""
    for name in ("transition_mix", "transition_at"):
        frame = plans.QUERIES[name](spark, "/root/testdata/sf0.001")
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert [line for line in plan.splitlines() if "Join" in line or "Exchange " in line and "REPARTITION_BY_NUM" not in line] == [], name


@pytest.mark.parametrize("seed", range(2))
def test_transition_at_points(spark, seed):
    """Spans that overlap, points that repeat or lie in none, sequences without key, points of sequences without spans."""
    rng, spans, points = random.Random(seed), [], []
    for seq in (1, 2, 3, None):
        for at in rng.sample(range(300), 40):
            n = rng.choice((0, 2, 4, 12, 30))
            spans.append((seq, at, at + 1000, at + 2000, n, at - n // 2, at - n // 2 + n, at / 8))
        points += [(seq, rng.randrange(-20, 340)) for _ in range(200)]
    points += [(9, 5)]
    spans_ = spark.createDataFrame(spans, "seq_id long, at long, left_ord long, right_ord long, duration long, span_start long, span_stop long, more double").repartition(3)
    got = sorted(map(tuple, T.transition_at(spark.createDataFrame(points, "seq_id long, n long").repartition(2), spans_, "more").collect()))
    want = []
    for seq, n in {p for p in points if p[0]}:
        first = min((s for s in spans if s[0] == seq and s[5] <= n < s[6]), default=None, key=lambda s: s[1])
        if first:
            want.append((seq, n, *first[1:6], first[7]))
    assert got == sorted(want)

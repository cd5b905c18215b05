"""Robust fits: of equal hypotheses the first by ids wins, and with all matches as sample no pair is missed."""

import pytest

from cutloom.operators import motion as M
from cutloom.plans.motion import _rounded


@pytest.mark.parametrize("sample", [12, None])
def test_ties_go_to_the_lowest_ids(spark, sample):
    rows = [(k, i, 0.0, 0.0, 10.0 * (i % 2) + k, 5.0) for k in range(20) for i in range(1, 7)]  # three votes each for two shifts
    frame = spark.createDataFrame(rows, "k long, id int, x double, y double, u double, v double")
    got = {r.k: (r.n, r.tx, r.ty) for r in M.robust_fit(frame, ["k"], fewest=6, turn=False, sample=sample).collect()}
    assert got == {k: (3, 10.0 + k, 5.0) for k in range(20)}


def test_every_pair_is_tried(spark):
    """Four of sixteen matches agree, so most samples of twelve see few pairs of them, and some none that all four follow."""
    rows = [(k, i, x := float(i * 17 % 23), y := float(i * 5 % 19), x + 3, y - 2) if (i + k) % 4 == 0 else (k, i, float(i), float(i * i), 5000.0 * (i + 1) ** 2 + k, -700.0 * (i + 1) ** 3) for k in range(60) for i in range(16)]
    frame = spark.createDataFrame(rows, "k long, id int, x double, y double, u double, v double")
    got = {r.k: r.n for r in M.robust_fit(frame, ["k"], sample=None).collect()}
    assert got == {k: 4 for k in range(60)}


def test_sign_of_what_rounds_to_nothing(spark):
    frame = spark.createDataFrame([(-1e-9,), (1e-9,), (-1.26,)], "a double")
    assert sorted(str(r.a) for r in _rounded(frame, "a", places=1).collect()) == ["-0.0", "-1.3", "0.0"]

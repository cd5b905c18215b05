"""Scalar frame arithmetic as Column expressions: floor and half-even rounding, clamping, rate mapping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str | int | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def floor_long(x: Column) -> Column:
    return F.floor(x).cast("long")


def half_even(x: Column) -> Column:
    """The nearest whole number, ties to even."""
    return F.bround(x, 0).cast("long")


def clamp(x, low, high) -> Column:
    return F.least(F.greatest(col(x), col(low)), col(high))


def div(a, b) -> Column:
    """Whole-number division that truncates toward zero."""
    return F.call_function("div", col(a), col(b))


def source_length() -> Column:
    return F.col("src_out") - F.col("src_in")


def clip_length() -> Column:
    """Timeline frames a clip takes: its source frames at its rate, whole frames only."""
    return F.greatest(floor_long(source_length() / F.col("rate")), F.lit(0).cast("long"))


def timeline_frames(n_source, rate="rate") -> Column:
    return floor_long(col(n_source) / col(rate))


def source_frame(n) -> Column:
    """The source frame a clip shows at timeline frame n; a native-rate clip is never rounded."""
    offset = col(n) - F.col("start")
    return F.col("src_in") + F.when(F.col("rate") == 1.0, offset).otherwise(floor_long(offset * F.col("rate")))


def source_phase(n) -> Column:
    """How far between two source frames timeline frame n falls."""
    x = (col(n) - F.col("start")) * F.col("rate")
    return F.when(F.col("rate") == 1.0, F.lit(0.0)).otherwise(x - F.floor(x))


def timeline_frame(source) -> Column:
    return F.col("start") + timeline_frames(col(source) - F.col("src_in"))


def conform_rate(source_fps, sequence_fps) -> Column:
    """1 where the rates are within 0.01 frames a second, else their ratio."""
    a, b = col(source_fps), col(sequence_fps)
    return F.when(F.abs(a - b) <= 0.01, F.lit(1.0)).otherwise(a / b)


def hermite(t: Column, m0: Column, m1: Column) -> Column:
    """Cubic ease from 0 to 1 with slopes m0 and m1 at the ends."""
    return (t * t * t - 2 * t * t + t) * m0 + (-2 * t * t * t + 3 * t * t) + (t * t * t - t * t) * m1

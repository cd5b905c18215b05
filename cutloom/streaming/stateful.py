"""Playback-style behaviour that keeps state between events, over streams and, with the same rules, over whole tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import numeric as N

RATES = "session long, at long, rate long"
MARKS = "session long, at long, snapshot boolean"


def played_frame(base, elapsed_us, fps: float, rate, last) -> Column:
    """The frame that wall-clock playback shows: frames are dropped, not delayed; parked at either end."""
    return N.clamp(N.col(base) + N.floor_long(N.col(elapsed_us) / 1e6 * fps * N.col(rate)), 0, last)


def next_rate(rate: int, direction: int) -> int:
    """A tap of the shuttle: twice the speed, up to eight, in the same direction; single speed after a change."""
    same = rate != 0 and (rate > 0) == (direction > 0)
    return max(-8, min(8, 2 * rate)) if same else direction


def shuttle_stream(taps: DataFrame) -> DataFrame:
    """Taps (session, at, direction) of a stream to the rate after each; the state of a session is its rate."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        rate = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        out = []
        for at, direction in zip(rows["at"], rows["direction"], strict=True):
            rate = next_rate(rate, int(direction))
            out.append((key[0], at, rate))
        state.update((rate,))
        yield pd.DataFrame(out, columns=["session", "at", "rate"])

    return taps.groupBy("session").applyInPandasWithState(step, RATES, "rate long", "append", GroupStateTimeout.NoTimeout)


def shuttle(taps: DataFrame) -> DataFrame:
    """The same for a whole table: a run of taps in one direction doubles up to eight."""
    by = Window.partitionBy("session").orderBy("at")
    rows = taps.withColumn("turn", F.coalesce((F.col("direction") != F.lag("direction").over(by)).cast("long"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("turn").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("session", "run").orderBy("at"))
    return rows.withColumn("place", place).select("session", "at", (F.col("direction") * F.least(F.pow(F.lit(2.0), F.col("place") - 1), F.lit(8.0))).cast("long").alias("rate"))


def coalesced_stream(moves: DataFrame, gap_us: int = 1_500_000) -> DataFrame:
    """Slider moves (session, at) of a stream; a move more than the gap after the last snapshot, not the last move, makes one."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = sorted(int(t) for b in batches for t in b["at"])
        marks = _marks(times, last, gap_us)
        if times:
            state.update((max([t for t, m in zip(times, marks, strict=True) if m], default=last),))
        yield pd.DataFrame({"session": key[0], "at": times, "snapshot": marks})

    return moves.groupBy("session").applyInPandasWithState(step, MARKS, "last long", "append", GroupStateTimeout.NoTimeout)


def _marks(times: list[int], last: int | None, gap: int) -> list[bool]:
    out = []
    for t in times:
        out.append(last is None or t - last > gap)
        last = t if out[-1] else last
    return out


def coalesced(moves: DataFrame, gap_us: int = 1_500_000) -> DataFrame:
    """The same for a whole table: sessions in order of time go by in batches, and only the last snapshot's time is carried on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        session, last = None, None
        for rows in batches:
            marks = np.zeros(len(rows), bool)
            names, times = rows["session"].to_numpy(), rows["at"].to_numpy()
            ends = [*(np.flatnonzero(names[1:] != names[:-1]) + 1), len(rows)]
            for start, stop in zip([0, *ends[:-1]], ends, strict=True):
                if start == stop:
                    continue
                if names[start] != session:
                    session, last = names[start], None
                i = start if last is None else start + np.searchsorted(times[start:stop], last + gap_us, "right")
                while i < stop:
                    marks[i], last = True, times[i]
                    i = start + np.searchsorted(times[start:stop], last + gap_us, "right")
            yield rows.assign(snapshot=marks)

    return moves.select("session", "at").repartition("session").sortWithinPartitions("session", "at").mapInPandas(run, MARKS)


def autosaves(edits: DataFrame, every_us: int) -> DataFrame:
    """(session, slot, edits): the tick after each period in which a session was edited."""
    return edits.groupBy("session", N.floor_long(F.col("at") / every_us).alias("slot")).agg(F.count("*").alias("edits"))


def windowed(events: DataFrame, late: str, size: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window with a watermark: what arrives later than ``late`` is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide or size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")

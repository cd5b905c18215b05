"""Frames served while they are still being decoded: the nearest one now, the right one when it comes; and sound fed block by block."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import audio
from ..operators.lineage import cut
from ..operators.stretches import WIDTH, handed_over

SERVED = "session long, wanted_at long, frame long, shown long, exact boolean, final boolean"


class Server:
    """One session: the frames it holds, the last ``capacity`` that came, and the wishes that were answered with another frame.

    A wish is answered at once, by its frame if that is held, else by the nearest one (of two the lower), else by nothing.  It is answered again when its frame comes within
    ``patience`` of the wish, and is final then or when that time is over.
    """

    def __init__(self, capacity: int, patience: int):
        self.capacity, self.patience = capacity, patience
        self.held: list[int] = []
        self.waiting: list[tuple[int, int, int | None]] = []  # wanted at, frame, shown

    def expire(self, now: int) -> list[tuple]:
        over = [w for w in self.waiting if now > w[0] + self.patience]
        self.waiting = [w for w in self.waiting if now <= w[0] + self.patience]
        return [(at, frame, shown, False, True) for at, frame, shown in over]

    def came(self, at: int, frame: int) -> list[tuple]:
        out = self.expire(at)
        self.held = [f for f in self.held if f != frame][-(self.capacity - 1) :] if self.capacity > 1 else []
        self.held.append(frame)
        out += [(w, f, f, True, True) for w, f, _ in self.waiting if f == frame]
        self.waiting = [w for w in self.waiting if w[1] != frame]
        return out

    def wanted(self, at: int, frame: int) -> list[tuple]:
        out = self.expire(at)
        if frame in self.held:
            return [*out, (at, frame, frame, True, True)]
        shown = min(self.held, key=lambda f: (abs(f - frame), f), default=None)
        self.waiting.append((at, frame, shown))
        return [*out, (at, frame, shown, False, False)]

    def event(self, at: int, want: bool, frame: int) -> list[tuple]:
        return self.wanted(at, frame) if want else self.came(at, frame)

    @property
    def state(self) -> list[float]:
        flat = [x for at, f, shown in self.waiting for x in (at, f, -1 if shown is None else shown)]
        return [len(self.held), *self.held, *flat]

    @state.setter
    def state(self, v) -> None:
        n, v = int(v[0]), [int(x) for x in v[1:]]
        self.held = v[:n]
        self.waiting = [(at, f, None if s < 0 else s) for at, f, s in zip(v[n::3], v[n + 1 :: 3], v[n + 2 :: 3], strict=True)]


def served_stream(events: DataFrame, capacity: int = 120, patience: int = 2_000_000, late: str = "1 second") -> DataFrame:
    """Wishes and arrivals (session, ts, want, frame) of a stream to answers (SERVED): the nearest frame at once, corrections and ends as they come.

    For output mode ``update``; a timer by event time ends wishes that stay without their frame.  ``wanted_at`` is in microseconds.
    Events of one batch go in order of time, arrivals first; a session holds ``capacity`` frames and its open wishes.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        server = Server(capacity, patience)
        if state.exists:
            server.state = state.get[0]
        out: list[tuple] = []
        if state.hasTimedOut:
            out += server.expire(state.getCurrentWatermarkMs() * 1000 + patience + 1 if not server.waiting else min(w[0] for w in server.waiting) + patience + 1)
        else:
            rows = pd.concat(list(batches)).sort_values(["us", "want", "frame"], kind="stable")
            for at, want, frame in zip(rows["us"].tolist(), rows["want"].tolist(), rows["frame"].tolist(), strict=True):
                out += server.event(at, want, frame)
        state.update(([float(x) for x in server.state],))
        if server.waiting:
            ends = (min(w[0] for w in server.waiting) + patience) // 1000 + 1
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session": [key[0]] * len(out)} | {c: pd.array([r[i] for r in out], dtype=t) for i, (c, t) in enumerate((("wanted_at", "Int64"), ("frame", "Int64"), ("shown", "Int64"), ("exact", "boolean"), ("final", "boolean")))})

    rows = events.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("session").applyInPandasWithState(step, SERVED, "state array<double>", "update", GroupStateTimeout.EventTimeTimeout)


def served(events: DataFrame, capacity: int = 120, patience: int = 2_000_000, width: int = WIDTH) -> DataFrame:
    """What every wish of a table of events (session, at, want, frame; ``at`` unique in a session) ends with: session, wanted_at, frame, shown, exact.

    The same machine over stretches of sessions; it forgets after ``capacity`` arrivals and ``patience``.
    """
    rows = cut(events.select(F.col("session").cast("long").alias("session"), F.col("at").cast("long").alias("at"), "want", F.col("frame").cast("long").alias("frame")))

    def run(part: pd.DataFrame, state: np.ndarray | None, first: bool) -> tuple[pd.DataFrame, np.ndarray]:
        server = Server(capacity, patience)
        if state is not None:
            server.state = state
        out = [x for at, want, frame in zip(part["at"].tolist(), part["want"].tolist(), part["frame"].tolist(), strict=True) for x in server.event(at, want, frame)]
        told = {c: pd.array([r[i] for r in out], dtype=t) for i, (c, t) in enumerate((("wanted_at", "Int64"), ("frame", "Int64"), ("shown", "Int64"), ("exact", "boolean"), ("final", "boolean")))}
        return pd.DataFrame({"session": [part["session"].iloc[0]] * len(out)} | told), np.array(server.state, np.float64)

    answers = handed_over(rows, "session", "at", run, SERVED, width)
    end = F.max_by(F.struct("shown", "exact"), F.struct("exact", "final")).alias("end")
    return answers.groupBy("session", "wanted_at", "frame").agg(end).select("session", "wanted_at", "frame", "end.shown", "end.exact")


def fed_stream(ticks: DataFrame, fps: float, size: int = audio.BLOCK) -> DataFrame:
    """Ticks (session, at, playhead) of a stream to (session, at, first, jumped): the block to play next; the state of a session is its cursor."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        feeder = audio.Feeder(fps, size)
        feeder.cursor = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        out = [feeder.tick(float(p)) for p in rows["playhead"]]
        state.update((feeder.cursor,))
        yield pd.DataFrame({"session": key[0], "at": rows["at"].to_numpy(), "first": [x[0] for x in out], "jumped": [x[1] for x in out]})

    return ticks.groupBy("session").applyInPandasWithState(step, "session long, at long, first long, jumped boolean", "cursor long", "append", GroupStateTimeout.NoTimeout)

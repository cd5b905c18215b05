"""Masks both ways, sound block by block, frames served late, warps and matches: against plain loops, as tables and as streams."""

import bisect
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cutloom.operators import audio as Au
from cutloom.operators import masks as K
from cutloom.operators import pixels as P
from cutloom.streaming import serving as V


# --- masks
def carried(frames, seeds):
    """Forward from the first mark with later marks on the way, backward from the first one."""
    out = {}
    for take, fs in frames.items():
        marks = {f: m for f, m in seeds.get(take, {}).items() if f in fs}
        order = sorted(fs)
        if not marks:
            out |= {(take, f): None for f in order}
            continue
        first = min(marks)
        for run in ([f for f in order if f >= first], [f for f in reversed(order) if f <= first]):
            mask = None
            for f in run:
                mask = marks[f] if mask is None or (f in marks and f >= first) else [2 * m + fs[f] for m in mask]
                mask = [m % 1_000_003 for m in mask]
                out[take, f] = mask
    return out


def test_masks_meet_at_the_marks(spark):
    def doubling(memory, frame):
        new = [(2 * m + frame["light"]) % 1_000_003 for m in memory]
        return new, new

    rng = random.Random(1)
    frames = {t: {f: rng.randrange(100) for f in rng.sample(range(300), n)} for t, n in ((0, 250), (1, 1), (2, 40), (3, 30), (4, 20))}
    seeds = {t: {f: [rng.randrange(1000) for _ in range(3)] for f in some} for t, some in ((0, rng.sample(sorted(frames[0]), 9)), (1, list(frames[1])), (2, [max(frames[2])]), (3, [min(frames[3]), 999]), (5, [3]))}
    rows = spark.createDataFrame([(t, f, v, "x") for t, fs in frames.items() for f, v in fs.items()], "take long, frame long, light long, _x string").repartition(5)
    marks = spark.createDataFrame([(t, f, m) for t, some in seeds.items() for f, m in some.items()], "take long, frame long, mask array<long>")
    got = K.propagate(rows, marks, "take", "frame", K.Propagator(lambda mask, frame: mask, doubling))
    assert got.columns == ["take", "frame", "light", "_x", "mask"]
    assert {(r.take, r.frame): r.mask for r in got.collect()} == carried(frames, seeds)
    held = {(r.take, r.frame): r.mask for r in K.propagate(rows, marks, "take", "frame").collect()}
    last = seeds[2][max(frames[2])]
    assert all(held[2, f] == last for f in frames[2])
    assert all(r.mask is None for r in K.propagate(rows, marks.limit(0), "take", "frame").collect())


# --- sound
def cut_list(rng, n):
    clips, at = [], 0
    for ord_ in range(n):
        length = rng.randint(1, 9)
        start = max(0, at + rng.choice((0, 0, 4, -3)))
        clips.append((7, ord_, rng.randrange(3), rng.randint(0, 5), start, start + length, rng.choice((1.0, 0.5, 2.0, 1.25)), rng.randint(1, 3)))
        at = start + length
    return clips


def edges_of(fps, total):
    """The first sample of each frame."""
    return [math.ceil(n / fps * Au.RATE) for n in range(total)]


def one_shot(clips, sounds, fps, source_fps, total):
    """Sample by sample over the whole timeline."""
    edges = edges_of(fps, total)
    out = np.zeros(total, int)
    for t in range(total):
        n = bisect.bisect_right(edges, t) - 1
        here = [c for c in clips if c[4] <= n < c[5]]
        if here:
            _, _, source, src_in, start, _, rate, _ = max(here, key=lambda c: (c[7], -c[1]))
            place = int(np.floor((src_in + (t * fps / Au.RATE - start) * rate) / source_fps * Au.RATE + Au.HALF))
            if 0 <= place < len(sounds.get(source, [])):
                out[t] = sounds[source][place]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_blocks_equal_one_fill(spark, seed):
    rng = random.Random(seed)
    fps, source_fps, size = 4800, 2400, 64  # small frames: ten samples each
    clips = cut_list(rng, 14)
    sounds = {s: [rng.randint(-900, 900) for _ in range(n)] for s, n in ((0, 500), (1, 90))}  # source 2 has no sound
    table = spark.createDataFrame(clips, "seq_id long, ord long, source_id long, src_in long, start long, stop long, rate double, track long")
    chunks = spark.createDataFrame([(s, k, v[k * size : (k + 1) * size]) for s, v in sounds.items() for k in range(-(-len(v) // size))], "source_id long, chunk long, samples array<int>")
    total = -(-max(c[5] for c in clips) * 10 // size) * size
    want = one_shot(clips, sounds, fps, source_fps, total)
    pieces = Au.block_pieces(table, fps, source_fps, size)
    got = np.zeros(total, int)
    for r in Au.filled(pieces, chunks, size).collect():
        assert len(r.samples) == size
        got[r.block * size : (r.block + 1) * size] = r.samples
    assert got.tolist() == want.tolist()
    covered = {(r.block, r.first + k) for r in pieces.collect() for k in range(r.n)}
    assert covered == {(t // size, t % size) for t in range(total) if any(c[4] <= bisect.bisect_right(edges_of(fps, total), t) - 1 < c[5] for c in clips)}


def streamed(spark, tmp_path, rows, schema, transform, mode, parts=5):
    folder, out = str(tmp_path / "in"), []
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = transform(stream).writeStream.foreachBatch(lambda frame, _: out.extend(map(tuple, frame.collect()))).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    return out


def test_feed_as_table_and_stream(spark, tmp_path):
    rng = random.Random(3)
    ticks, heads = [], {0: 0.0, 1: 50.0, 2: 0.0}
    for i in range(400):
        s = rng.randrange(3)
        heads[s] = rng.uniform(0, 5000) if rng.random() < 0.05 else heads[s] + rng.uniform(2.3, 2.9)
        ticks.append((s, i, heads[s]))
    want, feeders = [], {}
    for s, i, p in ticks:
        want.append((s, i, *feeders.setdefault(s, Au.Feeder(30.0)).tick(p)))
    frame = spark.createDataFrame(ticks, "session long, at long, playhead double")
    for width in (25, 10_000):
        assert sorted(map(tuple, Au.fed(frame, "session", "at", 30.0, width=width).collect())) == sorted(want)
    assert sorted(streamed(spark, tmp_path, ticks, frame.schema, lambda s: V.fed_stream(s, 30.0), "append")) == sorted(want)
    assert 3 < sum(w[3] for w in want) < 60


# --- serving
def asks(rng, n):
    """Sessions of wishes and arrivals, a microsecond step of 40 milliseconds apart at least."""
    return [(rng.randrange(3), 1_000_000 + i * 40_000, rng.random() < 0.4, rng.randrange(20)) for i in range(n)]


def ended(events, capacity, patience):
    """What each wish ends with, by looking over all events."""
    out = []
    for s, at, want, frame in events:
        if want:
            before = [f for q, t, w, f in events if q == s and not w and t < at]
            held = list(dict.fromkeys(reversed(before)))[:capacity]
            later = any(q == s and not w and f == frame and at < t <= at + patience for q, t, w, f in events)
            exact = frame in held or later
            out.append((s, at, frame, frame if exact else min(held, key=lambda f: (abs(f - frame), f), default=None), exact))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", [30, 10_000])
def test_served_as_a_table(spark, width):
    events = asks(random.Random(4), 300)
    frame = spark.createDataFrame(events, "session long, at long, want boolean, frame long")
    assert sorted(map(tuple, V.served(frame, 4, 900_000, width).collect()), key=repr) == ended(events, 4, 900_000)


def test_served_as_a_stream(spark, tmp_path):
    """Late frames correct what was shown; a timer ends wishes whose frame never comes."""
    events = asks(random.Random(5), 150)
    events.append((9, events[-1][1] + 60_000_000, False, 0))  # time goes on
    rows = [(s, pd.Timestamp(at, unit="us").to_pydatetime(), w, f) for s, at, w, f in events]
    out = streamed(spark, tmp_path, rows, "session long, ts timestamp, want boolean, frame long", lambda s: V.served_stream(s, 4, 900_000, "0 seconds"), "update")
    want = {(s, at): (shown, exact) for s, at, _, shown, exact in ended(events, 4, 900_000)}
    answers = {}
    for s, at, _, shown, exact, final in out:
        answers.setdefault((s, at), []).append((exact, final, shown))
    assert set(answers) == set(want)
    for k, some in answers.items():
        exact, final, shown = max(some, key=lambda x: x[:2])
        assert (shown, exact) == want[k] and final
        assert len(some) <= 2 and sum(x[1] for x in some) == 1  # a stand-in and one end, or the frame at once
    assert sum(len(x) == 2 and max(x)[0] for x in answers.values()) > 5


# --- pictures
def picture(rng, w, h, frames=(0,)):
    return {f: rng.uniform(0, 1, (h, w)) for f in frames}


def table_of(spark, pictures):
    return spark.createDataFrame([(f, x, y, float(p[y, x])) for f, p in pictures.items() for y in range(p.shape[0]) for x in range(p.shape[1])], "frame long, x long, y long, v double")


def grid(frame, w, h, f=0):
    out = np.full((h, w), np.nan)
    for r in frame.where(F.col("frame") == f).collect():
        out[r.y, r.x] = r.v
    return out


def test_warp_identity_shift_quarter_turn(spark):
    p = picture(np.random.default_rng(6), 5, 4)
    maps = {"same": [1, 0, 0, 0, 1, 0, 0, 0, 1], "shift": [1, 0, 2, 0, 1, -1, 0, 0, 1], "turn": [0, 1, 0, -1, 0, 3, 0, 0, 1], "twice": [2, 0, 0, 0, 2, 0, 0, 0, 2], "half": [1, 0, 0.5, 0, 1, 0, 0, 0, 1]}
    for name, m in maps.items():
        matrices = spark.createDataFrame([(0, [float(x) for x in m])], "frame long, m array<double>")
        w, h = (4, 5) if name == "turn" else (5, 4)
        for edge in ("repeat", "empty"):
            got = grid(P.warp(table_of(spark, p), matrices, "v", 5, 4, w, h, edge), w, h)
            want = np.zeros((h, w))
            for y in range(h):
                for x in range(w):
                    u, v, d = np.array(m, float).reshape(3, 3) @ [x, y, 1]
                    u, v = u / d, v / d
                    if edge == "repeat":
                        u, v = min(max(u, 0), 4), min(max(v, 0), 3)
                    a, b = int(np.floor(u)), int(np.floor(v))
                    for i, j in ((0, 0), (1, 0), (0, 1), (1, 1)):
                        if 0 <= a + i < 5 and 0 <= b + j < 4:
                            want[y, x] += (1 - abs(u - a - i)) * (1 - abs(v - b - j)) * p[0][b + j, a + i]
            assert np.allclose(got, want, atol=1e-12), (name, edge)
    turned = grid(P.warp(table_of(spark, p), spark.createDataFrame([(0, [0.0, 1.0, 0.0, -1.0, 0.0, 3.0, 0.0, 0.0, 1.0])], "frame long, m array<double>"), "v", 5, 4, 4, 5), 4, 5)
    assert np.array_equal(turned, np.rot90(p[0], -1))


def test_windows_by_four_lookups(spark):
    p = picture(np.random.default_rng(7), 9, 7, (0, 1))
    for half in (0, 1, 3, 20):
        for r in P.window_stats(table_of(spark, p), "v", half, 9, 7).collect():
            part = p[r.frame][max(0, r.y - half) : r.y + half + 1, max(0, r.x - half) : r.x + half + 1]
            assert r.n == part.size and abs(r.mean - part.mean()) < 1e-12 and abs(r.deviation - part.std()) < 1e-7


def test_planted_shift_is_found(spark):
    rng = np.random.default_rng(8)
    p = {0: rng.uniform(0, 1, (20, 24))}
    p[1] = np.roll(p[0], (-2, 3), (0, 1)) * 0.5 + 0.2  # moved, darker
    p[2] = np.full((20, 24), 0.4)
    pairs = spark.createDataFrame([(0, 1, 1, 8, 9), (0, 1, 2, 12, 11), (0, 2, 1, 8, 9), (0, 1, 3, 1, 1)], "frame long, to_frame long, point long, x long, y long")
    scores = P.correlate(table_of(spark, p), pairs, "v", 3, 4, 24, 20)
    for r in scores.where("to_frame = 1 and point = 1").collect():
        a, b = p[0][6:13, 5:12], p[1][6 + r.dy : 13 + r.dy, 5 + r.dx : 12 + r.dx]
        assert abs(r.score - np.corrcoef(a.ravel(), b.ravel())[0, 1]) < 1e-9
    best = {(r.to_frame, r.point): r for r in P.best_matches(scores).collect()}
    assert all((best[1, k].dx, best[1, k].dy) == (3, -2) and best[1, k].score > 0.999 and best[1, k].margin > 0.3 for k in (1, 2))
    assert best[2, 1].score == 0 and (1, 3) not in best

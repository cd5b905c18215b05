"""Camera motion against plain loops: crops, robust fits, paths, tracks and the lock, with series that go over several stretches."""

import cmath
import math

import numpy as np
import pandas as pd
import pytest

from cutloom.operators import motion as M
from cutloom.operators import stretches as T


def bisected(matrices, width, height):
    """The share of a centred crop by steps of 15 % and 26 halvings of the zoom."""

    def covered(z):
        for m in matrices:
            for sx in (-1, 1):
                for sy in (-1, 1):
                    p = m @ [(width + 1) / 2 + sx * (width - 1) / (2 * z), (height + 1) / 2 + sy * (height - 1) / (2 * z), 1]
                    if not (1 <= p[0] / p[2] <= width and 1 <= p[1] / p[2] <= height):
                        return False
        return True

    low = high = 1.0
    if covered(1.0):
        return 1.0
    while not covered(high) and high < 2.5:
        high *= 1.15
    for _ in range(26):
        mid = (low + high) / 2
        low, high = (low, mid) if covered(mid) else (mid, high)
    return 1 / high


def test_crop_equals_bisection(spark):
    rng = np.random.default_rng(1)
    groups = {0: [np.eye(3)], 1: [np.diag([0.9, 0.9, 1]) + np.array([[0, 0, 30], [0, 0, 20], [0, 0, 0]])], 2: [np.array([[1, 0, 900.0], [0, 1, 0], [0, 0, 1]])]}
    for g in range(3, 40):
        size, some = rng.uniform(0.2, 3), []
        for _ in range(rng.integers(1, 6)):
            t = np.radians(rng.normal() * 4 * size)
            some.append(np.array([[np.cos(t), -np.sin(t), rng.normal() * 20 * size], [np.sin(t), np.cos(t), rng.normal() * 20 * size], [rng.normal() * 1e-4 * size, rng.normal() * 1e-4 * size, 1]]) * rng.choice([1, -1, 2]))
        groups[g] = some
    rows = [(g, m.ravel().tolist()) for g, some in groups.items() for m in some] + [(0, None), (0, [None] * 9), (99, None)]
    got = {r.g: r for r in M.border_crop(spark.createDataFrame(rows, "g long, m array<double>"), ["g"], "m", 640, 360).collect()}
    for g, some in groups.items():
        want = bisected(some, 640, 360)
        assert got[g].w == pytest.approx(want, abs=1e-6) and got[g].h == got[g].w and got[g].x == pytest.approx((1 - want) / 2, abs=1e-6)
    assert got[99].w == 1 and {round(r.w, 3) for r in got.values()} >= {1.0, 0.376}


def planted(rng, n, outliers, move, shift):
    rows = []
    for i in range(n):
        p = complex(*rng.uniform(0, 300, 2))
        q = move * p + shift + complex(*rng.normal(size=2)) * 0.05
        if rng.random() < outliers:
            q += cmath.rect(rng.uniform(15, 90), rng.uniform(0, 6))
        rows.append((i, p.real, p.imag, q.real, q.imag))
    return rows


@pytest.mark.parametrize("turn", [True, False])
def test_thirty_percent_outliers(spark, turn):
    rng = np.random.default_rng(2)
    moves, rows = {}, []
    for k in range(30):
        move = cmath.rect(rng.uniform(0.98, 1.02), rng.normal() * 0.02) if turn else 1 + 0j
        moves[k] = move, complex(*rng.normal(size=2)) * 5
        rows += [(k, *r) for r in planted(rng, 3000 if k == 0 else 50, 0.3, *moves[k])]  # one frame holds half of all rows
    rows += [(90, 0, 1.0, 1.0, 2.0, 2.0), (91, 0, None, 1.0, 1.0, 1.0)] + [(92, i, 5.0, 5.0, 7.0, 8.0) for i in range(4)]
    frame = spark.createDataFrame(rows, "k long, id long, x double, y double, u double, v double").repartition(6)
    got = {r.k: r for r in M.robust_fit(frame, ["k"], turn=turn).collect()}
    for k, (move, shift) in moves.items():
        r = got[k]
        assert abs(complex(r.a, r.b) - move) < 2e-3 and abs(complex(r.a, r.b) * 150 + complex(r.tx, r.ty) - move * 150 - shift) < 0.15
    assert 90 not in got and 91 not in got
    assert 92 not in got if turn else (got[92].tx, got[92].ty) == (2.0, 3.0)
    again = {r.k: r for r in M.robust_fit(frame.repartition(2), ["k"], turn=turn).collect()}
    assert all(again[k].n == got[k].n and abs(again[k].a - got[k].a) < 1e-12 for k in got)


@pytest.mark.parametrize("width", [3, 50, 10_000])
def test_running_product_equals_a_loop(spark, width):
    rng = np.random.default_rng(3)
    rows = [(k, 7 * i, (np.eye(3) + rng.normal(size=(3, 3)) * 0.05).ravel().tolist()) for k, n in ((0, 400), (1, 1), (2, 30), (3, 3)) for i in range(n)]
    got = T.running_product(spark.createDataFrame(rows, "k long, at long, m array<double>").repartition(5), "k", "at", "m", width).collect()
    want, last = {}, {}
    for k, at, m in rows:
        last[k] = np.reshape(m, (3, 3)) @ last.get(k, np.eye(3))
        want[k, at] = last[k].ravel()
    assert len(got) == len(rows) and all(np.allclose(r.product, want[r.k, r.at], rtol=1e-9) for r in got)


def test_hot_series_lies_in_many_stretches(spark):
    rows = spark.range(30_000).selectExpr("if(id < 10000, 0, id) AS k", "id AS at")
    spread = T.ranged(rows, "k", "at", 1000).where("k = 0").groupBy("stretch").count().collect()
    assert len(spread) >= 8 and max(r["count"] for r in spread) < 3000
    ranks = T.ranked(rows, "k", "at", 1000).where("k = 0").toPandas().sort_values("at")
    assert ranks._rank.tolist() == list(range(10_000))


@pytest.mark.parametrize(("half", "width"), [(2, 2), (3, 10), (5, 1000)])
def test_windows_in_blocks(spark, half, width):
    rng = np.random.default_rng(4)
    rows = pd.DataFrame([(k, 3 * i, float(rng.normal())) for k, n in ((0, 101), (1, 1), (2, 20)) for i in range(n)], columns=["k", "at", "v"])
    out = M.A.deoutlier(T.blocks(spark.createDataFrame(rows).repartition(4), "k", "at", half, width), ["k", "_block"], "at", "v", half, 0.5).where("_own").toPandas().sort_values(["k", "at"])
    assert len(out) == len(rows)
    for k, part in rows.groupby("k"):
        v = part.v.to_numpy()
        assert np.allclose(out[out.k == k]["median"], [np.median(v[max(0, i - half) : i + half + 1]) for i in range(len(v))])


def test_hot_keys_in_windows_and_sums(spark):
    """A third of all rows in one key: the same as for whole keys, and no task has them all."""
    rows = spark.range(30_000).selectExpr("if(id % 3 = 0, 7, id % 997) AS k", "id AS at", "cast(id * 31 % 101 AS double) AS v").repartition(6)
    mean = lambda rows, keys: rows.withColumn("m", M.A.moving("v", keys, "at", 5))
    plain, spread = (T.in_windows(rows, "k", "at", 5, mean, w).orderBy("at").toPandas() for w in (10**9, 700))
    assert np.allclose(plain.m, spread.m) and plain.k.tolist() == spread.k.tolist() and len(plain) == 30_000
    one, many = (T.running_sum(rows, "k", "at", "v", "s", w).orderBy("at").toPandas() for w in (10**9, 700))
    assert np.allclose(one.s, many.s) and list(one.columns) == list(many.columns)
    null = spark.createDataFrame([(None, i, 1.0) for i in range(50)], "k long, at long, v double")
    assert T.running_sum(null, "k", "at", "v", "s", 10**9).agg(M.F.max("s")).first()[0] == 50


def test_path_equals_a_loop(spark):
    rng = np.random.default_rng(5)
    takes, frames, matches, anchors, want = {0: 70, 1: 2, 2: 1}, [], [], [], {}
    for take, n in takes.items():
        path = (1 + 0j, 0j)
        for f in range(1, n + 1):
            frames.append((take, f))
            move, shift = cmath.rect(1 + rng.normal() * 0.002, rng.normal() * 0.004), complex(*rng.normal(size=2))
            if f > 1:
                few = f % 11 == 0  # too few matches: the path holds
                for i in range(3 if few else 24):
                    p = complex(*rng.uniform(0, 200, 2))
                    q = move * p + shift + (0 if i % 3 else 40 + 9 * i)
                    matches.append((take, f, i, p.real, p.imag, q.real, q.imag, p.real + 0.3, p.imag))
                    matches.append((take, f, 100 + i, p.real, p.imag, q.real + 3, q.imag, p.real + 5, p.imag))  # does not come back
                path = path if few else (move * path[0], move * path[1] + shift)
            off = complex(*rng.normal(size=2))
            good = f % 5 != 0
            for i in range(9):
                d = off + (0 if i % 4 else 30 + i)
                anchors.append((take, f, i, d.real, d.imag, 0.9 if good else 0.4, 0.2))
            held = path[0] * off + path[1] if good else path[1]
            want[take, f] = path[0], held + (100 if (take, f) == (0, 33) else 0)
            if (take, f) == (0, 33):  # a single wild frame, by its anchors
                wild = 100 / path[0]
                anchors[-9:] = [(take, f, i, (off + wild).real, (off + wild).imag, 0.9, 0.2) for i in range(9)]
    median = lambda v, i: float(np.median(v[max(0, i - 3) : i + 4]))
    for take, n in takes.items():
        xs, ys = ([getattr(want[take, f][1], c) for f in range(1, n + 1)] for c in ("real", "imag"))
        for f in range(1, n + 1):
            x, y = (median(v, f - 1) if abs(v[f - 1] - median(v, f - 1)) > 20 else v[f - 1] for v in (xs, ys))
            want[take, f] = want[take, f][0], complex(x, y)
    at = "take long, frame long, id long, "
    args = (spark.createDataFrame(frames, "take long, frame long"), spark.createDataFrame(matches, at + "x double, y double, u double, v double, bx double, by double"), spark.createDataFrame(anchors, at + "dx double, dy double, score double, margin double"))
    for width in (9, 10_000):
        got = {(r.take, r.frame): r for r in M.camera_path(*args, "take", "frame", width=width).collect()}
        assert set(got) == set(want)
        for k, (move, shift) in want.items():
            assert abs(complex(got[k].a, got[k].b) - move) < 1e-9 and abs(complex(got[k].tx, got[k].ty) - shift) < 1e-6


def followed(points, matches, size, respawn, fewest):
    """Frame by frame, live tracks in a dictionary."""
    where = {(k, f, p): (x, y) for k, f, p, x, y in points}
    out = []
    for take in sorted({k for k, *_ in points}):
        frames = sorted({f for k, f, *_ in points if k == take})
        live = {}
        done = []
        for f in range(frames[0], frames[-1] + 1):
            links = {}
            for k, g, a, b, dx, dy, score, margin in matches:
                if (k, g) == (take, f) and (k, f - 1, a) in where and (k, f, b) in where and score >= 0.5 and margin >= 0.08 and abs(dx) <= 8 and abs(dy) <= 8:
                    x, y = (round(v) for v in where[k, f - 1, a])
                    if x - 24 >= 1 and x + 23 <= size[0] and y - 24 >= 1 and y + 23 <= size[1]:
                        links.setdefault(b, []).append((score, -a))
            taken = {}
            for b, some in links.items():
                score, a = max(some)
                taken.setdefault(-a, []).append((score, -b))
            onward = {a: -max(some)[1] for a, some in taken.items()}
            new = {}
            for a, track in live.items():
                if a in onward:
                    track["points"].append((f, onward[a]))
                    new[onward[a]] = track
                else:
                    done.append(track)
            live = new
            for k, g, p, *_ in points:
                if (k, g) == (take, f) and p not in live:
                    live[p] = {"start": (f, p), "points": [(f, p)]}
        for track in done + list(live.values()):
            seed = next((f for f, _ in track["points"] if f == frames[0] or f % respawn == 0), None)
            kept = [x for x in track["points"] if seed is not None and x[0] >= seed]
            if len(kept) >= fewest:
                out += [(take, *track["start"], f, p) for f, p in kept]
    return sorted(out)


def test_tracks_equal_a_loop(spark):
    rng = np.random.default_rng(6)
    points, matches = [], []
    for take, n in ((0, 40), (1, 5), (2, 25)):
        for f in range(2, n + 2):
            points += [(take, f, p, float(rng.uniform(0, 640)), float(rng.uniform(20, 340))) for p in range(6)]
            matches += [(take, f, int(a), int(b), float(rng.uniform(0, 8.2)), 0.0, float(np.round(rng.uniform(0.45, 1), 1)), float(rng.uniform(0.07, 0.5))) for a, b in zip(rng.integers(0, 6, 12), rng.integers(0, 6, 12), strict=True)]
    p = spark.createDataFrame(points, "take long, frame long, point long, x double, y double")
    m = spark.createDataFrame(matches, "take long, frame long, before long, point long, dx double, dy double, score double, margin double")
    got = M.tracks(p, m, "take", (640, 360), respawn=4, fewest=2)
    want = followed(points, matches, (640, 360), 4, 2)
    assert want and sorted(tuple(r)[:5] for r in got.collect()) == want
    assert M.tracks(p, m.limit(0), "take", (640, 360)).count() == 0
    paths = M.A.bundle_adjust(got.select("take", "frame", M.F.xxhash64("track_frame", "track_point").alias("track"), "x", "y"), "take", rounds=1)  # what the fit takes
    assert set(paths.columns) == {"take", "frame", "a", "b", "tx", "ty"} and paths.count() == got.select("take", "frame").distinct().count()


def a_take(rng, n):
    rows = []
    for f in range(n):
        lost = 30 <= f % 90 < 40 or f > n - 20 or rng.random() < 0.05
        jump = 35 if f % 50 == 12 else 0
        m = cmath.rect(1 + 0.02 * math.sin(f / 20), 0.02 * math.cos(f / 15) - 0.02)
        rows.append((f, m.real, m.imag, 20 * math.sin(f / 12) + jump, 10 * math.cos(f / 9) - 10, 2 if lost else int(rng.integers(5, 100)), 0 if f > n - 20 else int(rng.integers(0, 30))))
    return rows


def looped(rows, **limits):
    lock = M.Lock(**limits)
    lock.begin(rows[0][0])
    out = [(rows[0][0], 1.0, 0.0, 0.0, 0.0, 0)]
    for f, a, b, tx, ty, n, found in rows[1:]:
        lock.step(f, None if a is None else (complex(a, b), complex(tx, ty)), n or 0, found or 0)
        out.append((f, *lock.state[:4].tolist(), lock.lost))
    return out


@pytest.mark.parametrize("width", [20, 77, 10_000])
def test_lock_equals_one_pass(spark, width):
    rng = np.random.default_rng(7)
    takes = {0: a_take(rng, 500), 1: a_take(rng, 3), 2: a_take(rng, 1), 3: a_take(rng, 90)}
    takes[3][50] = (50, None, None, None, None, None, None)
    rows = [(k, *r) for k, some in takes.items() for r in some]
    fits = spark.createDataFrame(rows, "take long, at long, a double, b double, tx double, ty double, n long, found long").repartition(5)
    got = sorted(tuple(r) for r in M.camera_lock(fits, "take", "at", width, coast=12).collect())
    assert got == [(k, *r) for k in sorted(takes) for r in looped(takes[k], coast=12)]  # to the last bit
    assert max(r[-1] for r in got) > 12 and sum(r[-1] == 0 for r in got) > 200


def test_a_lock_that_never_forgets(spark):
    """Nothing to lock on after the first frames: every stretch needs the one before, and the result is still that of one pass."""
    rows = [(0, f, 1.0, 0.0, float(3 * f), 0.0, 9 if f < 3 else 0, 0) for f in range(60)]
    fits = spark.createDataFrame(rows, "take long, at long, a double, b double, tx double, ty double, n long, found long")
    assert sorted(tuple(r) for r in M.camera_lock(fits, "take", "at", 10).collect()) == [(0, *r) for r in looped([r[1:] for r in rows])]


def test_object_lock(spark):
    rng = np.random.default_rng(8)
    lock = [(0, f, math.cos(f / 50), math.sin(f / 50), float(f), -1.0) for f in range(40)]
    offsets = [(0, f, float(rng.normal()), float(rng.normal()), 0.2 if f % 4 == 0 else 0.6) for f in range(1, 40)]
    got = M.object_lock(spark.createDataFrame(lock, "k long, at long, a double, b double, tx double, ty double"), spark.createDataFrame(offsets, "k long, at long, dx double, dy double, score double"), "k", "at", width=7)
    off = 0j
    moved = {f: complex(dx, dy) for _, f, dx, dy, s in offsets if s >= 0.35}
    want = {}
    for _, f, a, b, tx, ty in lock:
        off += moved.get(f, 0)
        want[f] = complex(tx, ty) - complex(a, b) * off
    assert all(abs(complex(r.tx, r.ty) - want[r.at]) < 1e-9 for r in got.collect()) and got.count() == 40

"""Sequential operators over groups that are spread over stretches, against plain loops over the whole group."""

import numpy as np
import pandas as pd
import pytest

from cutloom.operators import analysis as A
from cutloom.streaming import stateful as Z


def plain_low_pass(x, cutoff):
    """The difference equation sample by sample, forward and backward over the mirrored series."""
    b, a = A.low_pass_coefficients(cutoff)

    def once(x):
        z1, z2, y = (1 - b[0]) * x[0], (b[2] - a[2]) * x[0], []
        for v in x:
            y.append(b[0] * v + z1)
            z1, z2 = b[1] * v - a[1] * y[-1] + z2, b[2] * v - a[2] * y[-1]
        return np.array(y)

    pad = min(9, len(x) - 1)
    wide = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    return once(once(wide)[::-1])[::-1][pad : pad + len(x)]


@pytest.mark.parametrize("n", [3, 4, 10, 11, 127, 128, 129, 1000])
def test_blocks_equal_the_difference_equation(n):
    x = np.random.default_rng(n).normal(size=n)
    assert np.allclose(A.zero_phase(x, 0.07), plain_low_pass(x, 0.07), atol=1e-10)


@pytest.mark.parametrize("width", [7, 100, 100_000])
def test_stretches_equal_the_whole(spark, width):
    rng = np.random.default_rng(2)
    sizes = {0: 900, 1: 2, 2: 3, 3: 12, 4: 1, 5: 45}
    rows = pd.DataFrame([(k, 5 * i + k, *rng.normal(size=2)) for k, n in sizes.items() for i in range(n)], columns=["k", "at", "u", "v"])
    got = A.smoothed(spark.createDataFrame(rows), "k", "at", ["u", "v"], 1.0, 30.0, width).toPandas().sort_values(["k", "at"])
    assert got[["k", "at"]].to_numpy().tolist() == rows[["k", "at"]].to_numpy().tolist()
    for k, part in rows.groupby("k"):
        for c in ("u", "v"):
            want = plain_low_pass(part[c].to_numpy(), 2 / 30) if len(part) > 2 else part[c].to_numpy()
            assert np.allclose(got[got.k == k][f"{c}_low"], want, atol=1e-9)


def test_one_long_sparse_series(spark):
    """A third of a million rows of one key at places far apart, over many stretches of rows, beside many short ones."""
    long = spark.range(333_333).selectExpr("0L AS k", "id * 9973 AS at", "cast(id % 97 AS double) AS v")
    short = spark.range(20_000).selectExpr("1 + id % 4000 AS k", "id AS at", "cast(id % 89 AS double) AS v")
    got = A.smoothed(long.unionByName(short).repartition(8), "k", "at", ["v"], 1.0, 30.0, 30_000)
    hot = got.where("k = 0").toPandas().sort_values("at").v_low.to_numpy()
    assert got.count() == 353_333 and len(hot) == 333_333
    assert np.allclose(hot, A.zero_phase(np.arange(333_333) % 97, 2 / 30), atol=1e-6)


def test_colour_needs_24_frames(spark):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame([(k, i, *rng.uniform(1, 9, 2)) for k, n in ((0, 23), (1, 24)) for i in range(n)], columns=["k", "at", "mu", "sd"])
    got = A.color_track(spark.createDataFrame(rows), "k", "at", "mu", "sd", 0.5, 30.0).toPandas().sort_values("at")
    one = rows[rows.k == 1]
    gain = np.clip(plain_low_pass(one.sd.to_numpy(), 1 / 30) / one.sd, 0.5, 2.0)
    assert len(got) == 24 and np.allclose(got.gain, gain) and np.allclose(got.offset, plain_low_pass(one.mu.to_numpy(), 1 / 30) - one.mu * gain)


def test_snapshots_with_ties_and_one_large_session(spark):
    rng = np.random.default_rng(4)
    rows = [(k, int(t)) for k, n in ((0, 20_000), (1, 500), (2, 1)) for t in rng.integers(0, 40 * n, n)]
    got = [tuple(r) for r in Z.coalesced(spark.createDataFrame(rows, "session long, at long"), 900).collect()]
    want, last = [], {}
    for k, t in sorted(rows):
        fresh = k not in last or t - last[k] > 900
        last[k] = t if fresh else last[k]
        want.append((k, t, fresh))
    assert sorted(got) == sorted(want)


def test_bundle_equals_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    rows = []
    for f in range(6):
        turn, size = 0.02 * f, 1 + 0.01 * f
        for t in range(9):
            if (f + t) % 7:
                x, y = 10.0 * (t % 3), 10.0 * (t // 3)
                far = 20.0 if (f, t) == (3, 4) else 0.0
                rows.append((1, f, t, float(size * (np.cos(turn) * x - np.sin(turn) * y) + f + far), float(size * (np.sin(turn) * x + np.cos(turn) * y) - f + rng.normal() / 50)))
    got = A.bundle_adjust(spark.createDataFrame(rows, "grp long, frame long, track long, x double, y double"), "grp", rounds=4).orderBy("frame").toPandas()
    seen = {(f, t): complex(x, y) for _, f, t, x, y in rows}
    place = {t: np.mean([z for (_, u), z in seen.items() if u == t]) for t in range(9)}
    move = {f: (1 + 0j, 0j) for f in range(6)}
    weight = lambda f, t: min(1.0, 1.5 / max(abs(move[f][0] * place[t] + move[f][1] - seen[f, t]), 1e-300))
    for _ in range(4):
        for f in range(1, 6):
            here = [t for t in range(9) if (f, t) in seen]
            w = np.sqrt([weight(f, t) for t in here])
            m = np.array([[place[t], 1] for t in here])
            move[f] = tuple(np.linalg.lstsq(m * w[:, None], np.array([seen[f, t] for t in here]) * w, rcond=None)[0])
        for t in range(9):
            here = [(f, weight(f, t)) for f in range(6) if (f, t) in seen]
            place[t] = sum(w * np.conj(move[f][0]) * (seen[f, t] - move[f][1]) for f, w in here) / sum(w * abs(move[f][0]) ** 2 for f, w in here)
    want = np.array([(1 / r, -s / r) for r, s in (move[f] for f in range(6))])
    assert np.allclose(got.a + 1j * got.b, want[:, 0], atol=1e-8) and np.allclose(got.tx + 1j * got.ty, want[:, 1], atol=1e-7)


def _tracked(rng, frames):
    """Two takes; points of a frame that stays, some far off, some without a value, and one frame of two points."""
    base = rng.uniform(0, 100, (12, 2))
    rows = []
    for grp in (1, 2):
        for f in range(frames):
            for t in range(12 if f != 5 else 2):
                far = 30.0 if (f + t) % 9 == 0 else 0.0
                x, y = base[t] + [0.5 * f * grp + far, rng.normal() / 10]
                rows.append((grp, f, t, None if (f, t) == (7, 3) else float(x), float(y)))
    return rows


def test_bundle_in_many_blocks_equals_one(spark):
    rows = spark.createDataFrame(_tracked(np.random.default_rng(6), 40), "grp long, frame long, track long, x double, y double")
    one, many = (A.bundle_adjust(rows, "grp", rounds=3, **most).orderBy("grp", "frame").toPandas() for most in ({}, {"most": 50}))
    assert len(one) == 80 and not one.isna().any().any() and np.allclose(one, many, atol=1e-9)
    assert (one[one.frame.isin([0, 5])][["a", "b", "tx", "ty"]].to_numpy() == [1, 0, 0, 0]).all()


def test_bundle_sends_no_frames_to_the_driver(spark, monkeypatch):
    """In a round, what grows with the frames is neither broadcast nor are the points dealt again."""
    plans, cut = [], A.cut
    monkeypatch.setattr(A, "cut", lambda rows: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), cut(rows))[1])
    rows = spark.createDataFrame(_tracked(np.random.default_rng(7), 10), "grp long, frame long, track long, x double, y double")
    A.bundle_adjust(rows, "grp", rounds=3)
    last = plans[-1]
    assert "Broadcast" not in last and "InMemoryTableScan" in last
    points = last[last.index("FlatMapCoGroupsInArrow") : last.index("InMemoryTableScan")]
    assert "Exchange" not in points

"""Per-frame measurement series: outliers, smoothing, colour gains, paths, coverage; sequential filters by group."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from .lineage import SHARE, cut, discard, shares
from .stretches import ranged


def deoutlier(series: DataFrame, keys: list[str], at: str, value: str, half: int, threshold: float) -> DataFrame:
    """``fixed``: the median of the window of 2 half + 1 values where the value is further than the threshold from it, else the value."""
    by = Window.partitionBy(*keys).orderBy(at).rowsBetween(-half, half)
    median = F.expr(f"percentile({value}, 0.5)").over(by)
    return series.withColumn("median", median).withColumn("fixed", F.when(F.abs(F.col(value) - F.col("median")) > threshold, F.col("median")).otherwise(F.col(value)))


def median3(value: str, by) -> Column:
    """The middle of a value and its two neighbours; the value itself at the ends."""
    a, b, c = F.lag(value).over(by), F.col(value), F.lead(value).over(by)
    middle = F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
    return F.when(a.isNull() | c.isNull(), b).otherwise(middle)


def moving(value: str, keys: list[str], at: str, half: int, how=F.avg) -> Column:
    return how(value).over(Window.partitionBy(*keys).orderBy(at).rowsBetween(-half, half))


def gain_offset(mean, std, target_mean, target_std) -> tuple[Column, Column]:
    """The gain (clamped) and offset that take a frame's mean and deviation to their targets."""
    gain = N.clamp(N.col(target_std) / F.greatest(N.col(std), F.lit(1e-4)), 0.5, 2.0)
    return gain, N.col(target_mean) - N.col(mean) * gain


def flicker_reduction(series: DataFrame, keys: list[str], at: str, before: str, after: str) -> DataFrame:
    """Per group 1 - (mean step after) / (mean step before), between 0 and 1; 0 where nothing moves."""
    by = Window.partitionBy(*keys).orderBy(at)
    steps = series.withColumn("_b", F.abs(F.col(before) - F.lag(before).over(by))).withColumn("_a", F.abs(F.col(after) - F.lag(after).over(by)))
    return reduction(steps, keys, "_b", "_a")


def reduction(steps: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """The same from the steps themselves."""
    sums = steps.groupBy(*keys).agg(F.avg(before).alias("b"), F.avg(after).alias("a"))
    return sums.select(*keys, F.when(F.col("b") > 0, N.clamp(1 - F.col("a") / F.col("b"), 0.0, 1.0)).otherwise(F.lit(0.0)).alias("reduction"))


def decompose(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """Scale and angle in degrees of the linear part with columns (a, b) and (c, d)."""
    return F.hypot(a, b), F.degrees(F.atan2(b, a))


def low_pass_coefficients(cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Second-order Butterworth low-pass by the bilinear transform; cutoff as a share of the Nyquist rate."""
    w = np.tan(np.pi * np.clip(cutoff, 1e-3, 0.95) / 2)
    n = 1 / (1 + np.sqrt(2) * w + w * w)
    return np.array([w * w * n, 2 * w * w * n, w * w * n]), np.array([1.0, 2 * (w * w - 1) * n, (1 - np.sqrt(2) * w + w * w) * n])


def _system(cutoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The low-pass as a state: y = b[0] x + z[0] and z' = step z + enter x; with its coefficients b and a."""
    b, a = low_pass_coefficients(cutoff)
    return b, a, np.array([[-a[1], 1.0], [-a[2], 0.0]]), np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])


@cache
def _matrices(cutoff: float, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the step up to ``block``, what a block's own samples answer (transposed), and how they enter the state after it."""
    b, _, step, enter = _system(cutoff)
    reach = np.empty((block + 1, 2, 2))
    reach[0] = np.eye(2)
    for k in range(block):
        reach[k + 1] = step @ reach[k]
    impulse = np.concatenate(([b[0]], (reach[: block - 1] @ enter)[:, 0]))
    lag = np.arange(block)[:, None] - np.arange(block)[None, :]
    return reach, np.where(lag >= 0, impulse[np.abs(lag)], 0.0).T, reach[block - 1 :: -1] @ enter


def _respond(x: np.ndarray, cutoff: float, state: np.ndarray, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """What the low-pass answers from a state, and the state it ends in; blocks are matrix products, the state goes from block to block."""
    block = max(1, min(block, len(x)))
    reach, answers, entering = _matrices(cutoff, block)
    rows = np.zeros((-(-len(x) // block), block))
    rows.flat[: len(x)] = x
    y = rows @ answers
    gained = rows @ entering
    for k in range(len(rows)):
        y[k] += reach[:block, 0] @ state
        rest = len(x) - k * block
        if rest < block:  # the last block is not full: only its own samples move the state
            state = reach[rest] @ state + x[k * block :] @ entering[block - rest :]
        else:
            state = reach[block] @ state + gained[k]
    return y.ravel()[: len(x)], state


def _settled(v: float, cutoff: float) -> np.ndarray:
    """The state that a constant value leaves."""
    b, a = low_pass_coefficients(cutoff)
    return np.array([(1 - b[0]) * v, (b[2] - a[2]) * v])


def _mirrored(head: np.ndarray, tail: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nine samples before the first and after the last, mirrored through them."""
    pad = min(9, n - 1)
    return 2 * head[0] - head[pad:0:-1], 2 * tail[-1] - tail[-2 : -pad - 2 : -1]


def zero_phase(x: np.ndarray, cutoff: float) -> np.ndarray:
    """Low-passed forward and backward, odd-mirrored by nine samples at either end."""
    x = np.asarray(x, np.float64)
    if len(x) < 3:
        return x.copy()
    before, after = _mirrored(x, x, len(x))
    wide = np.concatenate((before, x, after))
    there = _respond(wide, cutoff, _settled(wide[0], cutoff))[0][::-1]
    return _respond(there, cutoff, _settled(there[0], cutoff))[0][::-1][len(before) : len(before) + len(x)]


def smoothed(series: DataFrame, key: str, at: str, columns: list[str], cutoff: float, fps: float, width: int = 200_000) -> DataFrame:
    """``<column>_low`` per group: each column through the zero-phase low-pass; groups of under three rows stay as they are.

    Groups of ``width`` rows at most are filtered whole, many of them a batch.  Longer ones are cut into stretches of rows.  The filter is linear: a stretch tells what
    it adds to the states that enter it from either side, one row a stretch; those rows are chained per group, and each stretch is then
    filtered between the states it was given.
    """
    share = 2 * cutoff / fps
    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    schema = ", ".join([f"{key} {kinds[key]}", f"{at} {kinds[at]}"] + [f"{c}_low double" for c in columns])
    rows = cut(series.select(key, at, *columns))
    long = cut(rows.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")).where(F.col("_n") > width).select("_k", F.lit(True).alias("_long")))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if len(batch):
                part = batch if rest is None else pd.concat((rest, batch))
                groups = pd.factorize(part[key], use_na_sentinel=False)[0]  # sorted: a group is one run
                last = int(np.searchsorted(groups, groups[-1]))
                rest = part.iloc[last:]
                if last:
                    yield filtered(part.iloc[:last], groups[:last])
        if rest is not None:
            yield filtered(rest, np.zeros(len(rest), np.int64))

    def filtered(part: pd.DataFrame, groups: np.ndarray) -> pd.DataFrame:
        cuts = np.flatnonzero(np.diff(groups)) + 1
        out = {c: np.concatenate([zero_phase(x, share) for x in np.split(part[c].to_numpy(np.float64), cuts)]) for c in columns}
        return part[[key, at]].assign(**{f"{c}_low": x for c, x in out.items()})

    short = lambda rows: rows.select(key, at, *columns).repartition(key).sortWithinPartitions(key, at).mapInPandas(whole, schema)
    if long.isEmpty():
        return short(rows)
    told_apart = rows.join(F.broadcast(long), F.col(key).eqNullSafe(F.col("_k")), "left")  # a row for each ``width`` rows at most
    return short(told_apart.where("_long is null")).unionByName(_by_stretches(cut(told_apart.where("_long").select(key, at, *columns)), key, at, columns, share, width, schema))


def _by_stretches(series: DataFrame, key: str, at: str, columns: list[str], share: float, width: int, schema: str) -> DataFrame:
    """``smoothed`` for long groups."""
    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    rows = cut(ranged(series, key, at, width).withColumnRenamed("stretch", "_s"))
    step = _system(share)[2]
    nothing = np.zeros(2)

    def told(stretch: pd.DataFrame) -> pd.DataFrame:
        stretch = stretch.sort_values(at)
        free = np.array([1.0, 0.0])  # what is left of each entering state, forward, as the backward filter sees it
        one, two = (_respond(np.zeros(len(stretch)), share, z)[0] for z in (free, free[::-1]))
        out = {key: stretch[key].iloc[:1], "_s": stretch["_s"].iloc[:1], "n": len(stretch), "echo": [np.concatenate([_respond(y[::-1], share, nothing)[1] for y in (one, two)])]}
        x = [stretch[c].to_numpy(np.float64) for c in columns]
        ahead = [_respond(v, share, nothing) for v in x]
        out |= {"head": [np.concatenate([v[:10] for v in x])], "tail": [np.concatenate([v[-10:] for v in x])], "left": [np.concatenate([s for _, s in ahead])]}
        return pd.DataFrame(out | {"right": [np.concatenate([_respond(y[::-1], share, nothing)[1] for y, _ in ahead])]})

    def chained(stretches: pd.DataFrame) -> pd.DataFrame:
        stretches = stretches.sort_values("_s")
        n, total, many = stretches["n"].to_numpy(), int(stretches["n"].sum()), len(stretches)
        enter = np.zeros((many, len(columns), 2, 2))  # stretch, column, from the left or the right, state
        powers = {m: np.linalg.matrix_power(step, int(m)) for m in set(n.tolist())}
        for c in range(len(columns) if total >= 3 else 0):
            part = lambda name: [v.reshape(len(columns), -1)[c] for v in stretches[name]]  # noqa: B023, E731
            before, after = _mirrored(np.concatenate(part("head")[:10]), np.concatenate(part("tail")[-10:]), total)
            state = _respond(before, share, _settled(before[0], share))[1]
            for k, added in enumerate(part("left")):
                enter[k, c, 0] = state
                state = powers[n[k]] @ state + added
            back = _respond(after, share, state)[0][::-1]
            state = _respond(back, share, _settled(back[0], share))[1]
            added = part("right")
            for k in range(many - 1, -1, -1):
                enter[k, c, 1] = state
                echo = stretches["echo"].iloc[k].reshape(2, 2).T @ enter[k, c, 0]
                state = powers[n[k]] @ state + added[k] + echo
        return pd.DataFrame({key: stretches[key], "_s": stretches["_s"], "total": total, "enter": list(enter.reshape(many, -1))})

    def run(stretch: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        stretch = stretch.sort_values(at)
        out = stretch[[key, at]].copy()
        enter = states["enter"].iloc[0].reshape(len(columns), 2, 2)
        for c, (left, right) in zip(columns, enter, strict=True):
            x = stretch[c].to_numpy(np.float64)
            out[f"{c}_low"] = x if states["total"].iloc[0] < 3 else _respond(_respond(x, share, left)[0][::-1], share, right)[0][::-1]
        return out

    doubles = ", ".join(f"{c} array<double>" for c in ("head", "tail", "left", "right", "echo"))
    parts = rows.groupBy(key, "_s").applyInPandas(told, f"{key} {kinds[key]}, _s int, n long, {doubles}")
    states = parts.groupBy(key).applyInPandas(chained, f"{key} {kinds[key]}, _s int, total long, enter array<double>")
    return rows.groupBy(key, "_s").cogroup(states.groupBy(key, "_s")).applyInPandas(run, schema)


def color_track(stats: DataFrame, key: str, at: str, mean: str, std: str, cutoff: float, fps: float, fewest: int = 24) -> DataFrame:
    """(key, at, gain, offset): what takes a frame's mean and deviation to their zero-phase smoothed targets; groups of under ``fewest`` frames have none."""
    enough = stats.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= fewest).select(key)
    rows = stats.join(enough, key)
    low = smoothed(rows, key, at, [mean, std], cutoff, fps)
    gain, offset = gain_offset(mean, std, f"{mean}_low", f"{std}_low")
    return rows.join(low, [key, at]).select(key, at, gain.alias("gain"), offset.alias("offset"))


def _row(values) -> pa.Array:
    """One list for the one row of a block."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _sums(track: pa.Array, g, h, s) -> pa.Array:
    return _row(pa.StructArray.from_arrays([track, pa.array(np.arange(len(track), dtype=np.int32)), *map(pa.array, (g, h, s.real, s.imag))], ["track", "k", "g", "h", "sx", "sy"]))


def _only(table: pa.Table, column: str) -> pa.Array:
    return table.column(column).combine_chunks().flatten()


def _points(table: pa.Table, read=_only) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which points have an x, which a y, and the points, 0 where either lacks."""
    x, y = (read(table, c) for c in "xy")
    has = [c.is_valid().to_numpy(zero_copy_only=False) for c in (x, y)]
    return *has, x.fill_null(0.0).to_numpy() + 1j * y.fill_null(0.0).to_numpy()


def _total(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, values.real, n) + 1j * np.bincount(of, values.imag, n) if np.iscomplexobj(values) else np.bincount(of, values, n)


def bundle_adjust(tracks: DataFrame, group: str, rounds: int = 25, huber: float = 1.5, most: int = SHARE) -> DataFrame:
    """Per group and frame the similarity (a, b, tx, ty) that takes tracked points (track, frame, x, y) to their common places.

    Alternates two least squares in which residuals over ``huber`` count less: each frame's similarity of the common places to its points,
    from sums per frame, and each common place from sums per track.  The first frame of a group stays as it is, frames of under
    three points stay at the identity.  What is returned are the inverses.

    Points are dealt once, into blocks of whole frames of about ``most`` points, and stay where they are.  A round sends a block the places of its tracks and
    gets one sum a track back; its frames' similarities and these sums are cut from their lineage.  Nothing is broadcast, so nothing but task ends comes to the driver.
    """
    col, kinds = F.col, dict(tracks.dtypes)
    sums_kind = f"array<struct<track:{kinds['track']},k:int,g:double,h:double,sx:double,sy:double>>"
    key = f"`{group}` {kinds[group]}, _block int"
    packed_kind = f"{key}, head {kinds['frame']}, frames array<{kinds['frame']}>, f array<int>, t array<int>, x array<double>, y array<double>, sums {sums_kind}"
    state_kind = f"{key}, first {kinds['frame']}, frames array<{kinds['frame']}>, a array<double>, b array<double>, tx array<double>, ty array<double>, sums {sums_kind}"

    def packed(rows: pa.Table) -> pa.Table:
        frame, track = (rows.column(c).combine_chunks().dictionary_encode() for c in ("frame", "track"))
        has_x, has_y, z = _points(rows, lambda table, c: table.column(c).combine_chunks())
        f, t, n = frame.indices, track.indices, len(track.dictionary)
        at = t.to_numpy()
        first = _sums(track.dictionary, _total(at, has_x * 1.0, n), _total(at, has_y * 1.0, n), _total(at, z, n))
        head = pc.min(frame.dictionary)
        own = [pa.array([v.as_py()], v.type) for v in (rows.column(group)[0], rows.column("_block")[0], head)]
        names = [group, "_block", "head", "frames", "f", "t", "x", "y", "sums"]
        return pa.Table.from_arrays([*own, *map(_row, (frame.dictionary, f, t)), *(_row(rows.column(c).combine_chunks()) for c in "xy"), first], names)

    def fitted(block: pa.Table, state: pa.Table) -> pa.Table:
        f, t = (_only(block, c).to_numpy() for c in "ft")
        has_x, has_y, z = _points(block)
        frames, (track, k, px, py) = _only(state, "frames"), _only(state, "places").flatten()
        order = np.argsort(k.to_numpy())
        there = (px.is_valid().to_numpy(zero_copy_only=False) & py.is_valid().to_numpy(zero_copy_only=False))[order]
        place = (px.fill_null(0.0).to_numpy() + 1j * py.fill_null(0.0).to_numpy())[order]
        p, known, many = place[t], has_x & has_y & there[t], len(frames)
        z = np.where(known, z, 0.0)
        a, b, tx, ty = (_only(state, c).fill_null(0.0).to_numpy() for c in ("a", "b", "tx", "ty"))
        turn, move = a + 1j * b, tx + 1j * ty

        def weights() -> np.ndarray:
            far = np.abs(turn[f] * p + move[f] - z)
            return np.where(known, np.where(far <= huber, 1.0, huber / far), 0.0)

        with np.errstate(all="ignore"):
            w = weights()
            sw, sp, sz, spp, spz = (_total(f, e, many) for e in (w, w * p, w * z, w * np.abs(p) ** 2, w * p.conj() * z))
            spread = spp - np.abs(sp) ** 2 / sw
            fixed = pc.equal(frames, state.column("first")[0]).to_numpy(zero_copy_only=False)
            keep = fixed | (np.bincount(f, minlength=many) < 3) | (spread <= 1e-12 * spp)
            new = (spz - sp.conj() * sz / sw) / spread
            turn, move = np.where(keep, turn, new), np.where(keep, move, (sz - new * sp) / sw)
            lost = ~keep & (np.bincount(f, known, many) == 0)  # no point has a value
            turn, move = np.where(lost, 0.0, turn), np.where(lost, 0.0, move)
            w = weights()
            g, s = (_total(t, e, len(place)) for e in (w * np.abs(turn[f]) ** 2, w * turn[f].conj() * (z - move[f])))
        now = [_row(pa.array(v, mask=lost)) for v in (turn.real, turn.imag, move.real, move.imag)]
        own = [state.column(c) for c in (group, "_block", "first")]
        return pa.Table.from_arrays([*own, _row(frames), *now, _sums(track.take(pa.array(order)), g, g, s)], [group, "_block", "first", "frames", "a", "b", "tx", "ty", "sums"])

    points = cut(tracks.select(group, "frame", "track", col("x").cast("double").alias("x"), col("y").cast("double").alias("y")).dropna(subset=[group, "frame", "track"]))
    many = shares(points, most)
    dealt = points.repartitionByRange(many, group, "frame").withColumn("_block", F.spark_partition_id())
    stored = cut(dealt.groupBy(group, "_block").applyInArrow(packed, packed_kind))
    discard(points)
    blocks = stored.select(col(group).alias("_g"), col("_block").alias("_b"), "f", "t", "x", "y").repartition(many, "_g", "_b").persist()
    blocks.count()  # once they lie somewhere, plans know how they are dealt
    still = lambda v: F.transform("frames", lambda _: F.lit(v))
    first = stored.groupBy(group).agg(F.min("head").alias("first"))
    state = stored.join(first, group).select(group, "_block", "first", "frames", still(1.0).alias("a"), *(still(0.0).alias(c) for c in ("b", "tx", "ty")), "sums")
    try:
        for _ in range(rounds):
            everywhere = Window.partitionBy(group, "track")
            place = [F.try_divide(F.sum(s).over(everywhere), F.sum(n).over(everywhere)).alias(c) for c, s, n in (("px", "sx", "g"), ("py", "sy", "h"))]
            places = state.select(group, "_block", F.inline("sums")).select(group, "_block", "track", "k", *place)
            sent = places.groupBy(group, "_block").agg(F.collect_list(F.struct("track", "k", "px", "py")).alias("places"))
            given = state.drop("sums").join(sent.hint("merge"), [group, "_block"]).repartition(many, group, "_block")  # to where the blocks are
            after = cut(blocks.groupBy("_g", "_b").cogroup(given.groupBy(group, "_block")).applyInArrow(fitted, state_kind))
            discard(state)
            state = after
    finally:
        blocks.unpersist()
    if rounds:
        discard(stored)
    here = state.select(group, F.inline(F.arrays_zip(*(col(c) for c in ("frames", "a", "b", "tx", "ty"))))).withColumnRenamed("frames", "frame")
    size = col("a") * col("a") + col("b") * col("b")
    back = here.select(group, "frame", (col("a") / size).alias("a"), (-col("b") / size).alias("b"), "tx", "ty")
    return back.select(group, "frame", "a", "b", (col("b") * col("ty") - col("a") * col("tx")).alias("tx"), (-col("b") * col("tx") - col("a") * col("ty")).alias("ty"))


def clamp_similarity(a: Column, b: Column, tx: Column, ty: Column, degrees: float = 0.5, zoom: float = 0.005, shift: float = 25.0) -> list[Column]:
    """A similarity step (a, b, tx, ty) held to what a hand can do between two frames: angle, zoom and length of the shift."""
    scale = N.clamp(F.hypot(a, b), 1 - zoom, 1 + zoom)
    angle = F.radians(N.clamp(F.degrees(F.atan2(b, a)), -degrees, degrees))
    length = F.hypot(tx, ty)
    keep = F.when(length > shift, shift / length).otherwise(1.0)
    return [(scale * F.cos(angle)).alias("a"), (scale * F.sin(angle)).alias("b"), (tx * keep).alias("tx"), (ty * keep).alias("ty")]

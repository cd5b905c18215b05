"""Camera motion: robust fits between frames, paths, tracks of features, the camera lock, and the crop that hides what a warp leaves open.

A similarity is (a, b, tx, ty): u = a x - b y + tx and v = b x + a y + ty.  Pixels count from 1.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from . import analysis as A
from .lineage import cut, discard
from .stretches import WIDTH, blocks, handed_over, running_product

LADDER = 1.15**7  # the first zoom over 2.5 by steps of 15 %: no crop goes further

col = F.col


# --- the crop that hides the border ----------------------------------------------------------------------------------
def _reach(m: list[Column], sx: int, sy: int, width: float, height: float) -> Column:
    """The largest share u of half a picture that a corner can lie from the middle and still be taken from inside; -1 if the middle is outside.

    The corner's place is linear in u above and below the fraction line, so every side of the picture, and the line where the depth is nothing,
    gives one linear bound.
    """
    cx, cy, hx, hy = (width + 1) / 2, (height + 1) / 2, sx * (width - 1) / 2, sy * (height - 1) / 2
    base, slope = zip(*((m[3 * i] * cx + m[3 * i + 1] * cy + m[3 * i + 2], m[3 * i] * hx + m[3 * i + 1] * hy) for i in range(3)), strict=True)
    side = F.signum(base[2])  # a matrix and its negative are one map
    bounds = []
    for line, high in ((0, width), (1, height)):
        for at, to in ((base[line] - base[2], slope[line] - slope[2]), (base[2] * high - base[line], slope[2] * high - slope[line])):
            at, to = at * side, to * side
            bounds.append(F.when(at < 0, F.lit(-1.0)).when(to < 0, -at / to).otherwise(F.lit(float("inf"))))
    at, to = base[2] * side, slope[2] * side
    depth = F.when(at <= 0, F.lit(-1.0)).when(to < 0, -at / to).otherwise(F.lit(float("inf")))
    return F.least(depth, *bounds)


def border_crop(transforms: DataFrame, keys: list[str], matrix: str, width: int, height: int) -> DataFrame:
    """(keys, x, y, w, h): the largest centred crop whose corners come from inside the picture in every frame of the group.

    ``matrix`` is a frame's 3x3 sampling matrix, row by row: any projective map.  One grouped minimum, in closed form; a crop is not under 1/1.15^7
    of the picture.  Frames that turn a corner behind the camera within that zoom bound it where the corner's depth is nothing.
    A null matrix, or one with a null, bounds nothing.
    """
    m = [F.element_at(matrix, i + 1) for i in range(9)]
    reach = F.least(*(_reach(m, sx, sy, float(width), float(height)) for sx in (-1, 1) for sy in (-1, 1)))
    whole = ~F.exists(matrix, lambda x: x.isNull()) & (F.size(matrix) == 9)
    most = transforms.groupBy(*keys).agg(F.min(F.when(whole, reach)).alias("_u"))
    share = N.clamp(F.coalesce("_u", F.lit(1.0)), 1 / LADDER, 1.0)
    off = (1 - share) / 2
    return most.select(*keys, off.alias("x"), off.alias("y"), share.alias("w"), share.alias("h"))


def scaled_to_source(matrix: str, scale: float) -> Column:
    """A 3x3 matrix that was measured on pictures ``scale`` times smaller, for the full ones: shifts grow, what divides by depth shrinks."""
    by = (1.0, 1.0, scale, 1.0, 1.0, scale, 1 / scale, 1 / scale, 1.0)
    return F.array(*(F.element_at(matrix, i + 1) * f for i, f in enumerate(by)))


# --- robust fits ------------------------------------------------------------------------------------------------------
def returning(matches: DataFrame, most: float = 0.7) -> DataFrame:
    """Matches (x, y to u, v) that come back: followed backward (bx, by) they end within ``most`` of where they began."""
    return matches.where(F.hypot(col("bx") - col("x"), col("by") - col("y")) <= most)


def _similarity(p: Column, q: Column) -> Column:
    """Of two matches the similarity that does both; null if they start at one place."""
    dx, dy, du, dv = q["x"] - p["x"], q["y"] - p["y"], q["u"] - p["u"], q["v"] - p["v"]
    size = dx * dx + dy * dy
    a, b = (dx * du + dy * dv) / size, (dx * dv - dy * du) / size
    whole = F.struct(a.alias("a"), b.alias("b"), (p["u"] - a * p["x"] + b * p["y"]).alias("tx"), (p["v"] - b * p["x"] - a * p["y"]).alias("ty"))
    return F.when(size > 1e-12, whole)


def _residual(m: Column) -> Column:
    return F.hypot(m["a"] * col("x") - m["b"] * col("y") + m["tx"] - col("u"), m["b"] * col("x") + m["a"] * col("y") + m["ty"] - col("v"))


def robust_fit(matches: DataFrame, keys: list[str], threshold: float = 2.0, fewest: int = 4, sample: int | None = 12, seed: int = 0, turn: bool = True) -> DataFrame:
    """(keys, n, a, b, tx, ty) of each group of ``matches`` (id, x, y, u, v): the least-squares similarity (a shift, without ``turn``) of the n matches that agree.

    A seeded sample of ``sample`` matches of each group is drawn by hashes of their ids (None: all of them, for groups of some dozens); each pair of it (each one, for
    shifts) is a hypothesis.  The one that most of all the group's matches follow within ``threshold`` wins, of equals the first by ids, and is fitted again to
    those.  Groups under ``fewest`` matches have no row.

    Samples are limited before their shuffle; votes and sums combine before theirs; a group's matches are joined, never gathered, so one
    group may hold very many.  ``matches`` is read three times and should be stored.  Nulls in places agree with nothing.
    """
    rows = matches.select(*keys, "id", *(col(c).cast("double").alias(c) for c in ("x", "y", "u", "v"))).where("x is not null and y is not null and u is not null and v is not null")
    drawn = rows
    if sample is not None:
        order = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), "id"), "id")
        drawn = rows.withColumn("_r", F.row_number().over(order)).where(col("_r") <= sample)
    drawn = drawn.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", "x", "y", "u", "v"))).alias("s"))
    if turn:
        pairs = F.flatten(F.transform("s", lambda p: F.transform(F.filter("s", lambda q: q["id"] > p["id"]), lambda q: _similarity(p, q))))
    else:
        pairs = F.transform("s", lambda p: F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), (p["u"] - p["x"]).alias("tx"), (p["v"] - p["y"]).alias("ty")))
    ways = cut(drawn.select(*keys, pairs.alias("ways")))
    votes = rows.join(ways, keys).select(*keys, "x", "y", "u", "v", F.posexplode("ways").alias("h", "m")).where(_residual(col("m")) <= threshold)
    most = 1_000_000  # over any number of hypotheses; votes and the order of hypotheses in one number
    best = votes.groupBy(*keys, "h").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max(col("n") * most - col("h")).alias("best"))
    chosen = ways.join(best, keys).withColumn("m", F.get("ways", F.pmod(-col("best"), F.lit(most)).cast("int"))).select(*keys, "m")
    good = rows.join(chosen, keys).withColumn("_in", _residual(col("m")) <= threshold)
    x, y, u, v = (F.when(col("_in"), col(c)) for c in ("x", "y", "u", "v"))
    sums = {"n": x * 0 + 1, "x": x, "y": y, "u": u, "v": v, "xx": x * x + y * y, "p": x * u + y * v, "q": x * v - y * u}
    s = good.groupBy(*keys).agg(F.count("*").alias("_all"), F.first("m").alias("m"), *(F.sum(e).alias(f"s{k}") for k, e in sums.items())).where(col("_all") >= fewest)
    n = col("sn")
    spread = col("sxx") - (col("sx") * col("sx") + col("sy") * col("sy")) / n
    flat = F.lit(not turn) | (spread <= 1e-12 * col("sxx"))
    a = F.when(flat, F.lit(1.0)).otherwise((col("sp") - (col("sx") * col("su") + col("sy") * col("sv")) / n) / spread)
    b = F.when(flat, F.lit(0.0)).otherwise((col("sq") - (col("sx") * col("sv") - col("sy") * col("su")) / n) / spread)
    s = s.withColumn("a", a).withColumn("b", b)
    return s.select(*keys, n.cast("long").alias("n"), "a", "b", ((col("su") - col("a") * col("sx") + col("b") * col("sy")) / n).alias("tx"), ((col("sv") - col("b") * col("sx") - col("a") * col("sy")) / n).alias("ty"))


# --- the camera's path ------------------------------------------------------------------------------------------------
def camera_path(frames: DataFrame, matches: DataFrame, anchors: DataFrame, key: str, at: str, threshold: float = 2.0, window: int = 3, outliers: tuple = (0.1, 5.0, 20.0), width: int = WIDTH, sample: int | None = 12) -> DataFrame:
    """(key, at, a, b, tx, ty): for every frame the similarity from the first frame of its take.

    ``matches`` (id, x, y, u, v, bx, by) go from the frame before to a frame; steps are fitted robustly, multiplied up along the take, and held where fewer than
    four matches return.  ``anchors`` (id, dx, dy, score, margin) are what is left between the first frame's patches and where the path so far puts
    them; where six or more are good, their robust shift corrects the frame, so nothing drifts.  At last, scale, angle in degrees and shifts that are far from the
    median of ``window`` frames either side (``outliers``) become that median.  ``sample`` is that of ``robust_fit``.
    """
    keys = [key, at]
    good = cut(returning(matches).select(*keys, "id", "x", "y", "u", "v"))
    steps = frames.select(*keys).join(robust_fit(good, keys, threshold, sample=sample), keys, "left")
    one, none = F.lit(1.0), F.lit(0.0)
    a, b, tx, ty = (F.coalesce(col(c), d) for c, d in (("a", one), ("b", none), ("tx", none), ("ty", none)))
    path = running_product(cut(steps.select(*keys, F.array(a, -b, tx, b, a, ty, none, none, one).alias("m"))), key, at, "m", width)
    path = path.select(*keys, *(F.element_at("product", i).alias(c) for c, i in (("a", 1), ("b", 4), ("tx", 3), ("ty", 6))))
    near = anchors.where("score >= 0.5 and margin >= 0.05").select(*keys, "id", none.alias("x"), none.alias("y"), col("dx").alias("u"), col("dy").alias("v"))
    shift = robust_fit(cut(near), keys, threshold, fewest=6, sample=sample, turn=False).select(*keys, col("tx").alias("dx"), col("ty").alias("dy"))
    path = path.join(shift, keys, "left").withColumn("dx", F.coalesce("dx", none)).withColumn("dy", F.coalesce("dy", none))
    scale, angle = A.decompose(col("a"), col("b"), -col("b"), col("a"))
    rows = path.select(*keys, scale.alias("scale"), angle.alias("angle"), (col("tx") + col("a") * col("dx") - col("b") * col("dy")).alias("tx"), (col("ty") + col("b") * col("dx") + col("a") * col("dy")).alias("ty"))
    rows = blocks(cut(rows), key, at, window, width)
    for value, most in (("scale", outliers[0]), ("angle", outliers[1]), ("tx", outliers[2]), ("ty", outliers[2])):
        rows = A.deoutlier(rows, [key, "_block"], at, value, window, most).drop("median").withColumnRenamed("fixed", f"{value}_")
    rows = rows.where("_own").select(*keys, *(col(f"{c}_").alias(c) for c in ("scale", "angle", "tx", "ty")))
    turned = F.radians("angle")
    return rows.select(*keys, (col("scale") * F.cos(turned)).alias("a"), (col("scale") * F.sin(turned)).alias("b"), "tx", "ty")


# --- tracks of features -----------------------------------------------------------------------------------------------
def tracks(points: DataFrame, matches: DataFrame, key: str, size: tuple[int, int], window: int = 32, radius: int = 8, score: float = 0.5, margin: float = 0.08, respawn: int = 8, fewest: int = 6) -> DataFrame:
    """(key, track_frame, track_point, frame, point, x, y): points that are followed from frame to frame, named by where each track begins.

    ``points`` (frame, point, x, y) are features; ``matches`` (frame, before, point, dx, dy, score, margin) say which feature of the frame before one is.  A match
    counts if its score and margin do, it moved by ``radius`` at most and its window could be searched.  Of several the best score stays, either way, ties to the
    lowest number.  A track starts at the take's first frame or at one of every ``respawn`` frames, so what was
    seen before its chain met such a frame is left out; tracks under ``fewest`` frames go.

    Each point is followed back to the start of its chain by pointers that double their reach every round: log2 of the longest chain equi-joins, no
    take or chain is gathered.
    """
    from .geometry import trackable

    half = (window - window % 2) // 2
    able = points.where(trackable("x", "y", *size, half, radius)).select(key, (col("frame") + 1).alias("frame"), col("point").alias("before"))
    sure = matches.where((col("score") >= score) & (col("margin") >= margin) & (F.abs("dx") <= radius) & (F.abs("dy") <= radius)).select(key, "frame", "before", "point", "score").join(able, [key, "frame", "before"])
    best = sure.groupBy(key, "frame", "point").agg(F.max(F.struct("score", (-col("before")).alias("b"))).alias("m")).select(key, "frame", "point", (-col("m.b")).alias("before"), col("m.score").alias("score"))
    best = best.groupBy(key, "frame", "before").agg(F.max(F.struct("score", (-col("point")).alias("p"))).alias("m")).select(key, "frame", (-col("m.p")).alias("point"), "before")
    placed = points.select(key, "frame", "point", "x", "y")
    now = cut(placed.join(best, [key, "frame", "point"], "left").select(key, "frame", "point", "x", "y", F.when(col("before").isNull(), col("frame")).otherwise(col("frame") - 1).alias("to_frame"), F.coalesce("before", "point").alias("to_point")))
    while True:
        there = now.select(key, col("frame").alias("to_frame"), col("point").alias("to_point"), col("to_frame").alias("on_frame"), col("to_point").alias("on_point"))
        new = cut(now.join(there, [key, "to_frame", "to_point"]).select(key, "frame", "point", "x", "y", col("on_frame").alias("to_frame"), col("on_point").alias("to_point"), (col("on_frame") != col("to_frame")).alias("moved")))
        moved = not new.where("moved").isEmpty()
        discard(now)
        now = new
        if not moved:
            break
    first = points.groupBy(key).agg(F.min("frame").alias("_first"))
    chain = [key, "to_frame", "to_point"]
    rows = now.join(first, key)
    starts = rows.where((col("frame") == col("_first")) | (col("frame") % respawn == 0)).groupBy(*chain).agg(F.min("frame").alias("_seed"))
    lasts = rows.groupBy(*chain).agg(F.max("frame").alias("_last"))
    kept = starts.join(lasts, chain).where(col("_last") - col("_seed") + 1 >= fewest).drop("_last")
    return rows.join(kept, chain).where(col("frame") >= col("_seed")).select(key, col("to_frame").alias("track_frame"), col("to_point").alias("track_point"), "frame", "point", "x", "y")


# --- the camera lock --------------------------------------------------------------------------------------------------
class Lock:
    """A virtual tripod, frame by frame: locked, or coasting at its last speed until it can lock again.

    ``move`` and ``shift`` are the similarity z -> move z + shift from the first frame, as complex numbers.
    """

    def __init__(self, search=16.0, lost=48.0, fewest=5, zoom=1.25, angle=15.0, step_shift=25.0, step_zoom=0.005, step_angle=0.5, coast=90, features=120, replenish=0.5, redetect=6):
        self.search, self.far, self.fewest, self.zoom, self.angle = search, lost, fewest, zoom, angle
        self.step_shift, self.step_zoom, self.step_angle = step_shift, step_zoom, step_angle
        self.coast, self.low, self.features, self.redetect = coast, replenish * features, features, redetect
        self.begin(0)

    def begin(self, frame: int) -> None:
        self.move, self.shift, self.speed, self.lost, self.seen = 1 + 0j, 0j, 0j, 0, frame

    def guess(self, frame: int, fit: tuple[complex, complex]) -> None:
        """As if the lock had been good all along."""
        self.begin(frame)
        self.move, self.shift = fit

    @property
    def state(self) -> np.ndarray:
        return np.array([self.move.real, self.move.imag, self.shift.real, self.shift.imag, self.speed.real, self.speed.imag, self.lost, self.seen])

    @state.setter
    def state(self, v: np.ndarray) -> None:
        self.move, self.shift, self.speed, self.lost, self.seen = complex(v[0], v[1]), complex(v[2], v[3]), complex(v[4], v[5]), int(v[6]), int(v[7])

    def _held(self, fit: tuple[complex, complex]) -> tuple[complex, complex]:
        """The lock after a step towards ``fit`` that a hand can make, within the rails; exactly ``fit`` where nothing is held back."""
        turn, step = fit[0] / self.move, (fit[1] - self.shift) / self.move
        size, angle = abs(turn), math.degrees(math.atan2(turn.imag, turn.real))
        free = abs(size - 1) <= self.step_zoom and abs(angle) <= self.step_angle and abs(step) <= self.step_shift
        move, shift = fit
        if not free:
            size, angle = min(max(size, 1 - self.step_zoom), 1 + self.step_zoom), math.radians(min(max(angle, -self.step_angle), self.step_angle))
            step *= self.step_shift / abs(step) if abs(step) > self.step_shift else 1.0
            move, shift = self.move * complex(size * math.cos(angle), size * math.sin(angle)), self.move * step + self.shift
        size, angle = abs(move), math.degrees(math.atan2(move.imag, move.real))
        if not (1 / self.zoom <= size <= self.zoom and abs(angle) <= self.angle):
            size, angle = min(max(size, 1 / self.zoom), self.zoom), math.radians(min(max(angle, -self.angle), self.angle))
            move = complex(size * math.cos(angle), size * math.sin(angle))
        return move, shift

    def step(self, frame: int, fit: tuple[complex, complex] | None, n: int, found: int) -> None:
        """One frame: the fit of n matches, if the search around where the camera should be reaches it, and how many new features could be found."""
        ahead = self.move * self.speed + self.shift
        reach = self.far if self.lost else self.search
        off = fit[1] - ahead if fit else None
        n = n if fit and max(abs(off.real), abs(off.imag)) <= reach else 0
        if n >= self.fewest:
            move, shift = self._held(fit)
            self.speed = (shift - self.shift) / self.move
            self.move, self.shift, self.lost = move, shift, 0
        else:
            self.lost += 1
            self.shift = ahead
            if self.lost > self.coast:
                self.speed = 0j
        if n < self.low and frame - self.seen >= self.redetect and found >= 2 * self.fewest:
            self.seen = frame
            if n < self.fewest:
                self.lost = 1


def camera_lock(fits: DataFrame, key: str, at: str, width: int = WIDTH, **limits) -> DataFrame:
    """(key, at, a, b, tx, ty, lost) for every frame of ``fits`` (a, b, tx, ty from the first frame, n matches, found features; null fits: nothing matched).

    The lock takes a fit if enough matches agree and it is within the search around a constant speed; it then moves by what a hand can do in
    a frame, inside rails of zoom and angle.  Else it coasts, searching wider, and after ``coast`` frames stands still.  New features give it a
    fresh start.  The machine goes over stretches of a take at once: two frames of good lock in a row make it forget, so stretches agree in a few
    rounds (``stretches.handed_over``), and the result is that of one pass in order.
    """
    rows = cut(fits.select(key, at, *(col(c).cast("double").alias(c) for c in ("a", "b", "tx", "ty")), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("found", F.lit(0)).cast("long").alias("found")))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(part: pd.DataFrame, state: np.ndarray | None, first: bool) -> tuple[pd.DataFrame, np.ndarray]:
        lock, out, start = Lock(**limits), [], 0
        values = list(zip(part[at].tolist(), part["a"].tolist(), part["b"].tolist(), part["tx"].tolist(), part["ty"].tolist(), part["n"].tolist(), part["found"].tolist(), strict=True))
        whole = lambda v: None if any(x is None or x != x for x in v[1:5]) else (complex(v[1], v[2]), complex(v[3], v[4]))
        if state is not None:
            lock.state = state
        elif first:
            lock.begin(values[0][0])
            out.append((*lock.state[:4], 0))
            start = 1
        else:
            lock.guess(values[0][0], next((f for v in values if (f := whole(v))), (1 + 0j, 0j)))
        for v in values[start:]:
            lock.step(v[0], whole(v), v[5], v[6])
            out.append((*lock.state[:4], lock.lost))
        told = pd.DataFrame(out, columns=["a", "b", "tx", "ty", "lost"])
        told.insert(0, key, part[key].to_list())
        told.insert(1, at, part[at].to_list())
        return told, lock.state

    return handed_over(rows, key, at, run, f"`{key}` {kinds[key]}, `{at}` {kinds[at]}, a double, b double, tx double, ty double, lost long", width)


def object_lock(lock: DataFrame, offsets: DataFrame, key: str, at: str, least: float = 0.35, width: int = WIDTH) -> DataFrame:
    """The lock with one object pinned: ``offsets`` (dx, dy, score) of its patch add up where they are sure, and are taken out of the lock."""
    none, one = F.lit(0.0), F.lit(1.0)
    sure = F.coalesce(col("score") >= least, F.lit(False))
    dx, dy = (F.coalesce(F.when(sure, col(c)), none) for c in ("dx", "dy"))
    rows = cut(lock.join(offsets.select(key, at, "dx", "dy", "score"), [key, at], "left").select(key, at, "a", "b", "tx", "ty", F.array(one, none, dx, none, one, dy, none, none, one).alias("m")))
    total = running_product(rows, key, at, "m", width).select(key, at, F.element_at("product", 3).alias("x"), F.element_at("product", 6).alias("y"))
    return rows.join(total, [key, at]).select(key, at, "a", "b", (col("tx") - col("a") * col("x") + col("b") * col("y")).alias("tx"), (col("ty") - col("b") * col("x") - col("a") * col("y")).alias("ty"))

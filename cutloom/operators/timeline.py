"""Which clip shows where: interval joins of frames with clips, lanes, edges, gaps and transitions.

Clips have seq_id, ord (list order), source_id, src_in, src_out, rate, start, stop, track.  Spans are half open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from .curves import asof
from .lineage import shares

BUCKET = 256


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], point: str, low: str, high: str, how: str = "inner", width: float = BUCKET, closed: bool = False, parts: int | None = None) -> DataFrame:
    """Points with the spans that cover them (low <= point < high, or <= high if ``closed``), equal on ``keys``.

    Both sides are dealt by key and bucket of ``width``, so a key with very many rows is spread over its buckets and each
    point meets the spans of its bucket only.  ``parts`` is the number of partitions, if it is to grow with the rows.
    """
    start, stop = F.col(low), F.col(high)
    wide = spans.where(stop >= start if closed else stop > start).withColumn("_to", F.explode(F.sequence(N.floor_long(start / width), N.floor_long((stop if closed else stop - 1) / width))))
    wide = wide.withColumnsRenamed({k: f"_to_{k}" for k in keys})
    near = points.withColumn("_bucket", N.floor_long(F.col(point) / width))
    if parts:
        near, wide = near.repartition(parts, *keys, "_bucket"), wide.repartition(parts, *(f"_to_{k}" for k in keys), "_to")
    on = [F.col(k) == F.col(f"_to_{k}") for k in keys] + [F.col("_bucket") == F.col("_to"), start <= F.col(point), F.col(point) <= stop if closed else F.col(point) < stop]
    return near.join(wide, on, how).drop("_bucket", "_to", *(f"_to_{k}" for k in keys))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Pairs of rows, equal on ``keys``, whose half-open spans ``a`` of the left and ``b`` of the right overlap; column names must differ.

    Of two spans that overlap one starts inside the other, so these are two interval joins, of pairs that start together the first.
    """
    meet = overlap(F.col(a[0]), F.col(a[1]), F.col(b[0]), F.col(b[1]))
    inside = interval_join(left, right, keys, a[0], *b).where(meet)
    around = interval_join(right, left, keys, b[0], *a).where(meet & (F.col(b[0]) > F.col(a[0])))
    return inside.unionByName(around)


def within(points: DataFrame, marks: DataFrame, keys: list[str], point: str, mark: str, reach: int) -> DataFrame:
    """Points with the marks that lie at most ``reach`` from them, equal on ``keys``; dealt by key and stretch of twice the reach."""
    width = max(2 * reach, 1)
    stretch = lambda c: N.floor_long(c / width)
    near = points.withColumn("_bucket", F.explode(F.array_distinct(F.array(stretch(F.col(point) - reach), stretch(F.col(point) + reach)))))
    there = marks.withColumn("_to", stretch(F.col(mark))).withColumnsRenamed({k: f"_to_{k}" for k in keys})
    on = [F.col(k) == F.col(f"_to_{k}") for k in keys] + [F.col("_bucket") == F.col("_to"), F.abs(F.col(mark) - F.col(point)) <= reach]
    return near.join(there, on).drop("_bucket", "_to", *(f"_to_{k}" for k in keys))


def lengths(clips: DataFrame) -> DataFrame:
    return clips.select("seq_id", "ord", N.source_length().alias("srclength"), N.clip_length().alias("cliplength"), (F.col("start") + N.clip_length()).alias("clipend"))


def frames(clips: DataFrame, step: int = 1) -> DataFrame:
    """(seq_id, n): every timeline frame of every sequence, or each ``step``-th."""
    ends = clips.groupBy("seq_id").agg(F.max("stop").alias("total"))
    return ends.where("total > 0").select("seq_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(step).cast("long"))).alias("n"))


def clips_at(points: DataFrame, clips: DataFrame) -> DataFrame:
    return interval_join(points, clips, ["seq_id"], "n", "start", "stop")


def topmost(hits: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Of the clips at a point, the one on the highest lane; of equals the first in the list."""
    best = F.max_by(F.struct(*columns), F.struct(F.col("track"), -F.col("ord"))).alias("_best")
    return hits.groupBy(*keys).agg(best).select(*keys, "_best.*")


def segments(clips: DataFrame, width: int = BUCKET, columns: tuple[str, ...] = ("ord", "source_id", "src_in", "rate", "start")) -> DataFrame:
    """(seq_id, stretch, a, b, and the topmost clip's ``columns``): sequences cut wherever a clip starts or ends.

    Inside a segment nothing changes, so the stack is resolved once a segment and not once a frame; gaps have nulls.  Clips and
    the span of their whole sequence are dealt by stretch of ``width`` frames once, so the work on a very long sequence is shared: a stretch knows
    all that reaches into it, and what is grouped by stretch later moves no row.
    """
    start, stop, edge = F.col("start"), F.col("stop"), F.col("stretch") * width
    named = [F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)]
    clips = clips.where("seq_id is not null")
    shown = clips.where("stop > start").select("seq_id", "start", "stop", "track", F.col("ord").alias("_ord"), *named, F.lit(True).alias("_is"))
    ends = clips.groupBy("seq_id").agg(F.lit(0).cast("long").alias("start"), F.max("stop").alias("stop")).where("stop > 0")
    spans = shown.unionByName(ends, allowMissingColumns=True)
    spans = spans.withColumn("stretch", F.explode(F.sequence(N.floor_long(start / width), N.floor_long((stop - 1) / width)))).repartition(shares(clips), "seq_id", "stretch")
    spans = spans.withColumn("_a", F.greatest(start, edge)).withColumn("_b", F.least(stop, edge + width)).drop("start", "stop")
    here = Window.partitionBy("seq_id", "stretch")
    spans = spans.withColumn("_cuts", F.array_sort(F.array_union(F.collect_set("_a").over(here), F.collect_set("_b").over(here))))  # width + 1 at most
    place = lambda c: F.array_position("_cuts", F.col(c)).cast("int")
    parts = F.transform(F.sequence(place("_a"), place("_b") - 1), lambda i: F.struct(F.get("_cuts", i - 1).alias("a"), F.get("_cuts", i).alias("b")))
    hits = spans.withColumn("_part", F.explode(parts)).select("seq_id", "stretch", "_part.*", "track", "_ord", "_is", *(f"_c{i}" for i in range(len(columns))))
    best = F.max_by(F.struct(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(columns))), F.when(F.col("_is"), F.struct(F.col("track"), -F.col("_ord")))).alias("_best")
    return hits.groupBy("seq_id", "stretch", "a", "b").agg(best).select("seq_id", "stretch", "a", "b", "_best.*")


def locate(points: DataFrame, clips: DataFrame) -> DataFrame:
    """Each point's topmost clip and the source frame it shows; nulls in a gap."""
    hits = interval_join(points, segments(clips).drop("stretch"), ["seq_id"], "n", "a", "b", "left")
    return hits.select(*points.columns, "ord", "source_id", N.source_frame("n").alias("source_frame"))


def locate_frames(clips: DataFrame) -> DataFrame:
    """The same for every frame of every sequence; frames are made from segments at the end and never shuffled."""
    rows = segments(clips).withColumn("n", F.explode(F.sequence(F.col("a"), F.col("b") - 1)))
    return rows.select("seq_id", "n", "ord", "source_id", N.source_frame("n").alias("source_frame"))


def neighbours(clips: DataFrame, *columns: str) -> DataFrame:
    """For each clip the start of the next and the end of the previous clip on its own lane, null at the ends, and ``columns`` of its own.

    Clips of a lane may overlap, so these are as-of lookups, not lead and lag.  A clip without length would find its own edges;
    where no other clip has one there, the lookup is from a frame further.
    """
    lane = ["seq_id", "track"]
    alone = lambda edge: (F.col("stop") == F.col("start")) & (F.count("*").over(Window.partitionBy(*lane, edge)) == 1)
    rows = clips.select(*lane, "ord", "start", "stop", *(c for c in columns if c not in ("start", "stop")))
    rows = rows.withColumn("_after", F.col("stop") + alone("start").cast("long")).withColumn("_before", F.col("start") - alone("stop").cast("long"))
    starts = clips.select(*lane, F.col("start").alias("_after"), F.col("start").alias("next_start"))
    stops = clips.select(*lane, F.col("stop").alias("_before"), F.col("stop").alias("prev_end"))
    found = asof(asof(rows, starts, lane, "_after", ["next_start"], forward=True), stops, lane, "_before", ["prev_end"])
    return found.select("seq_id", "ord", "track", "next_start", "prev_end", *columns)


def around(points: DataFrame, marks: DataFrame, keys: list[str], point: str, mark: str) -> DataFrame:
    """Points with ``prev`` and ``nxt``: the last mark before and the first after each, not those at the point itself; whole numbers."""
    back = marks.select(*keys, F.col(mark).alias("_back"), F.col(mark).alias("prev"))
    ahead = marks.select(*keys, F.col(mark).alias("_ahead"), F.col(mark).alias("nxt"))
    rows = points.withColumn("_back", F.col(point) - 1).withColumn("_ahead", F.col(point) + 1)
    return asof(asof(rows, back, keys, "_back", ["prev"]), ahead, keys, "_ahead", ["nxt"], forward=True).drop("_back", "_ahead")


def next_edit(points: DataFrame, clips: DataFrame) -> DataFrame:
    """Points (seq_id, n) with the edit points (clip edges and frame 0) before and after them."""
    marks = edges(clips).unionByName(clips.select("seq_id", F.lit(0).cast("long").alias("edge"))).distinct()
    return around(points, marks, ["seq_id"], "n", "edge")


def nearest_cut(points: DataFrame, clips: DataFrame) -> DataFrame:
    """Points (seq_id, n) with the clip start that is nearest; of equals the earlier."""
    marks = clips.select("seq_id", F.col("start").alias("at")).distinct()
    back = marks.select("seq_id", F.col("at").alias("n"), F.col("at").alias("_b"))
    ahead = marks.select("seq_id", F.col("at").alias("n"), F.col("at").alias("_a"))
    rows = asof(asof(points, back, ["seq_id"], "n", ["_b"]), ahead, ["seq_id"], "n", ["_a"], forward=True)
    nearest = F.when(F.col("_a").isNull() | (F.col("n") - F.col("_b") <= F.col("_a") - F.col("n")), F.col("_b")).otherwise(F.col("_a"))
    return rows.select("seq_id", "n", F.coalesce(nearest, "_a").alias("at"))


def edge_at(points: DataFrame, clips: DataFrame, zone: int) -> DataFrame:
    """(seq_id, n, ord, side, edge): the clip edge nearest to each point, at most ``zone`` away; of equals by list order, ``in`` first."""
    sides = F.array(F.struct(F.lit("in").alias("side"), F.col("start").alias("edge")), F.struct(F.lit("out").alias("side"), F.col("stop").alias("edge")))
    edge = clips.select("seq_id", "ord", F.explode(sides).alias("e")).select("seq_id", "ord", "e.*")
    near = within(points, edge, ["seq_id"], "n", "edge", zone).withColumn("far", F.abs(F.col("edge") - F.col("n")))
    return near.groupBy("seq_id", "n").agg(F.min_by(F.struct("ord", "side", "edge"), F.struct("far", "ord", "side")).alias("b")).select("seq_id", "n", "b.*")


def reader_keys(clips: DataFrame, far: int) -> DataFrame:
    """(seq_id, a_ord, b_ord, apart, own_reader): clips that show together, how far apart in the source, and whether that is over ``far``."""
    clips = clips.select("seq_id", "ord", "src_in", "start", "stop", "rate")
    a, b = (clips.select("seq_id", *(F.col(c).alias(f"{k}_{c}") for c in clips.columns[1:])) for k in "ab")
    pairs = overlapping(a, b, ["seq_id"], ("a_start", "a_stop"), ("b_start", "b_stop")).where("a_ord < b_ord").withColumn("n", F.greatest("a_start", "b_start"))
    shows = lambda k: F.col(f"{k}_src_in") + F.when(F.col(f"{k}_rate") == 1.0, F.col("n") - F.col(f"{k}_start")).otherwise(N.floor_long((F.col("n") - F.col(f"{k}_start")) * F.col(f"{k}_rate")))
    return pairs.withColumn("apart", F.abs(shows("a") - shows("b"))).select("seq_id", "a_ord", "b_ord", "apart", (F.col("apart") > far).alias("own_reader"))


def lane_gaps(clips: DataFrame) -> DataFrame:
    """Empty spans between consecutive clips of a lane."""
    by = Window.partitionBy("seq_id", "track").orderBy("start", "ord")
    return clips.withColumn("gap_stop", F.lead("start").over(by)).where("gap_stop > stop").select("seq_id", "track", F.col("stop").alias("gap_start"), "gap_stop")


def edges(clips: DataFrame) -> DataFrame:
    return clips.select("seq_id", F.explode(F.array("start", "stop")).alias("edge")).distinct()


def compact(clips: DataFrame) -> DataFrame:
    """Lane numbers without gaps, order kept."""
    used = clips.select("seq_id", "track").distinct()
    rank = used.withColumn("lane", F.dense_rank().over(Window.partitionBy("seq_id").orderBy("track")).cast("long"))
    return clips.join(rank, ["seq_id", "track"]).select("seq_id", "ord", "lane")


def overlap(start: Column, stop: Column, other_start: Column, other_stop: Column) -> Column:
    return (start < other_stop) & (other_start < stop)


def can_place(clips: DataFrame, moves: DataFrame) -> DataFrame:
    """(seq_id, ord, ok) of moves (seq_id, ord, new_start): whether the clip has room there on its lane."""
    moved = moves.join(clips, ["seq_id", "ord"]).select("seq_id", "ord", "track", "new_start", (F.col("new_start") + F.col("len")).alias("new_stop"))
    other = clips.select("seq_id", "track", F.col("ord").alias("o_ord"), F.col("start").alias("o_start"), F.col("stop").alias("o_stop"))
    hit = overlapping(moved, other, ["seq_id", "track"], ("new_start", "new_stop"), ("o_start", "o_stop")).where("ord <> o_ord")
    taken = hit.select("seq_id", "ord").distinct().withColumn("taken", F.lit(True))
    return moved.join(taken, ["seq_id", "ord"], "left").select("seq_id", "ord", "new_start", F.col("taken").isNull().alias("ok"))


def free_track(clips: DataFrame, wants: DataFrame) -> DataFrame:
    """(seq_id, at, length, lane): the lowest lane from ``want`` up on which [at, at + length) is free; a new one at most."""
    tops = clips.groupBy("seq_id").agg(F.max("track").alias("top"))
    tries = wants.join(tops, "seq_id").withColumn("want", F.greatest("want", F.lit(1))).withColumn("lane", F.explode(F.sequence(F.least("want", F.col("top") + 1), F.col("top") + 1)))
    other = clips.select("seq_id", F.col("track").alias("lane"), "start", "stop")
    spans = tries.select("seq_id", "lane", "at", "length", (F.col("at") + F.col("length")).alias("until")).distinct()
    taken = overlapping(spans, other, ["seq_id", "lane"], ("at", "until"), ("start", "stop")).select("seq_id", "lane", "at", "length").distinct()
    free = tries.join(taken, ["seq_id", "lane", "at", "length"], "left_anti")
    return free.groupBy("seq_id", "at", "length").agg(F.min("lane").alias("lane"))


def _cuts(clips: DataFrame, *columns: str) -> DataFrame:
    """(seq_id, at, left, right): cuts with the (ord, len, and ``columns``) of both clips, in one pass."""
    side = F.struct("ord", "len", *columns)
    none = F.lit(None).cast(clips.select(side).schema[0].dataType)
    ends = F.array(F.struct(F.col("stop").alias("at"), side.alias("left"), none.alias("right")), F.struct(F.col("start").alias("at"), none.alias("left"), side.alias("right")))
    both = clips.select("seq_id", F.explode(ends).alias("e")).select("seq_id", "e.*")
    return both.groupBy("seq_id", "at").agg(F.min("left").alias("left"), F.min("right").alias("right")).where("left is not null and right is not null")


def cuts(clips: DataFrame) -> DataFrame:
    """(seq_id, at, left_ord, right_ord): frames where a clip ends and one starts, the first of each in the list, whatever the lane."""
    return _cuts(clips).select("seq_id", "at", F.col("left.ord").alias("left_ord"), F.col("right.ord").alias("right_ord"))


def dissolve_length(left_len, right_len, fps: float) -> Column:
    """What a one-click blend takes: 0.6 s, half the shorter clip at most, two frames at least."""
    return F.greatest(F.least(N.half_even(F.lit(0.6 * fps)), N.div(left_len, 2), N.div(right_len, 2)), F.lit(2))


def clamp_transition(duration, left_len, right_len) -> Column:
    """The largest even duration that overruns neither clip."""
    return 2 * F.greatest(F.least(N.div(duration, 2), N.col(left_len), N.col(right_len)), F.lit(0))


def transitions(clips: DataFrame, duration: int, *columns: str) -> DataFrame:
    """A transition of at most ``duration`` at every cut that has room for two frames: at, length, span and the two clips; of these also ``columns``, as left_ and right_."""
    rows = _cuts(clips, *columns).select("seq_id", "at", *(F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in ("left", "right") for c in ("ord", "len", *columns)))
    sized = rows.withColumn("duration", clamp_transition(F.lit(duration), "left_len", "right_len").cast("long")).where("duration >= 2")
    spans = sized.withColumn("span_start", F.col("at") - N.div("duration", 2)).withColumn("span_stop", F.col("span_start") + F.col("duration"))
    return spans.select("seq_id", "at", "left_ord", "right_ord", "duration", "span_start", "span_stop", *(f"{k}_{c}" for k in ("left", "right") for c in columns))


def transition_at(points: DataFrame, spans: DataFrame, *columns: str) -> DataFrame:
    """The first transition (by its cut) whose span covers a point, and ``columns`` of it.

    Transitions are short, so each gives a row for a frame, and these and the points are grouped by frame: nothing is joined, and sequences that are dealt already stay where they are.
    """
    covered = F.explode(F.sequence("span_start", F.col("span_stop") - 1)).alias("n")
    shown = spans.where("span_stop > span_start").select("seq_id", covered, F.struct("at", "left_ord", "right_ord", "duration", "span_start", *columns).alias("t"))
    asked = points.select("seq_id", "n", F.lit(True).alias("_asked"))
    hits = asked.unionByName(shown, allowMissingColumns=True).groupBy("seq_id", "n").agg(F.max("_asked").alias("_asked"), F.min("t").alias("t"))
    return hits.where("_asked and t is not null and seq_id is not null").select("seq_id", "n", "t.*")


def mix(n, span_start, duration) -> Column:
    """The incoming side's share at frame n."""
    return N.clamp((N.col(n) - N.col(span_start) + 0.5) / N.col(duration), 0.0, 1.0)

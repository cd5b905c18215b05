"""Keyframe curves: as-of lookup of the keys around a frame, eased interpolation, key edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N


def key_ease(ease, interp=None) -> Column:
    """A key's own ease; a curve that is smooth as a whole smooths its linear keys."""
    if interp is None:
        return N.col(ease)
    return F.when((N.col(ease) == "linear") & (N.col(interp) == "smooth"), "smooth").otherwise(N.col(ease))


def asof(points: DataFrame, marks: DataFrame, keys: list[str], at: str, columns: list[str], forward: bool = False, prefix: str = "", width: float = 10_000) -> DataFrame:
    """Each point with the columns of the last mark at or before it (or the first at or after it), null where there is none.

    Points and marks are sorted together by key and stretch of ``width``, so no pairs are made and a key with very many rows
    is spread over its stretches.  What a stretch itself lacks comes from the nearest one before (or after) that has a mark:
    one row a stretch, which is sorted in as a mark beyond that end.
    """
    stretch = N.floor_long(F.col(at) / width).alias("_s")
    kind = marks.select(F.struct(*columns)).schema[0].dataType
    left = points.select("*", stretch, F.lit(None).cast(kind).alias("_mark"), F.lit(1).alias("_is"))
    right = marks.select(*keys, at, stretch, F.struct(*columns).alias("_mark"), F.lit(0).alias("_is"))
    edge, pick = (F.min_by("_mark", at), F.first) if forward else (F.max_by("_mark", at), F.last)
    beyond = Window.partitionBy(*keys).orderBy("_s")
    beyond = beyond.rowsBetween(1, Window.unboundedFollowing) if forward else beyond.rowsBetween(Window.unboundedPreceding, -1)
    stretches = points.select(*keys, stretch, F.lit(None).cast(kind).alias("_edge")).distinct().unionByName(right.groupBy(*keys, "_s").agg(edge.alias("_edge")))
    stretches = stretches.groupBy(*keys, "_s").agg(F.first("_edge", ignorenulls=True).alias("_edge"))
    carried = stretches.withColumn("_mark", pick("_edge", ignorenulls=True).over(beyond)).where("_s is not null and _mark is not null").select(*keys, "_s", "_mark", F.lit(0).alias("_is"), F.lit(1).alias("_far"))
    near = left.unionByName(right, allowMissingColumns=True).withColumn("_far", F.lit(0)).unionByName(carried, allowMissingColumns=True)
    own = Window.partitionBy(*keys, "_s")
    if forward:
        found = F.first("_mark", ignorenulls=True).over(own.orderBy("_far", F.col(at), F.col("_is").desc()).rowsBetween(1, Window.unboundedFollowing))
    else:
        found = F.last("_mark", ignorenulls=True).over(own.orderBy(F.col("_far").desc(), F.col(at), F.col("_is")).rowsBetween(Window.unboundedPreceding, 0))
    out = near.withColumn("_found", found).where("_is = 1")
    return out.select(*points.columns, *(F.col(f"_found.{c}").alias(prefix + c) for c in columns))


def value_at(points: DataFrame, curves: DataFrame) -> DataFrame:
    """(owner_id, frame, value): the curve at each point; flat beyond its ends, null without keys."""
    keys = curves.withColumn("k", F.col("frame"))
    around = asof(points, keys, ["owner_id"], "frame", ["k", "value", "ease"], prefix="a_")
    around = asof(around, keys, ["owner_id"], "frame", ["k", "value", "ease"], forward=True, prefix="b_")
    t = (F.col("frame") - F.col("a_k")) / (F.col("b_k") - F.col("a_k"))
    slope = lambda c: F.when(F.col(c) == "smooth", 0.0).otherwise(1.0)
    eased = F.col("a_value") + N.hermite(t, slope("a_ease"), slope("b_ease")) * (F.col("b_value") - F.col("a_value"))
    value = F.when(F.col("a_k").isNull(), F.col("b_value")).when(F.col("b_k").isNull() | (F.col("a_k") == F.col("frame")) | (F.col("a_ease") == "hold"), F.col("a_value")).otherwise(eased)
    return around.select("owner_id", "frame", value.alias("value"))


def remove_keys(curves: DataFrame, gone: DataFrame) -> DataFrame:
    """Curves without the keys of ``gone`` (owner_id, frame)."""
    return curves.join(gone.select("owner_id", "frame").distinct(), ["owner_id", "frame"], "left_anti")


def move_keys(curves: DataFrame, moves: DataFrame) -> DataFrame:
    """Keys of ``moves`` (owner_id, frame, to) at their new frames, value and ease kept; a key that was there gives way."""
    keys = curves.join(moves.select("owner_id", "frame", F.col("to").alias("_to")), ["owner_id", "frame"], "left")
    moved = keys.where("_to is not null").withColumn("frame", F.col("_to")).drop("_to")
    rows = keys.where("_to is null").drop("_to").withColumn("_new", F.lit(0)).unionByName(moved.withColumn("_new", F.lit(1)))
    rest = [c for c in curves.columns if c not in ("owner_id", "frame")]
    return rows.groupBy("owner_id", "frame").agg(F.max_by(F.struct(*rest), F.struct("_new", *rest)).alias("_r")).select("owner_id", "frame", *(f"_r.{c}" for c in rest))


def set_ease(curves: DataFrame, changes: DataFrame) -> DataFrame:
    """Curves with other eases at the keys of ``changes`` (owner_id, frame, new_ease)."""
    rows = curves.join(changes.select("owner_id", "frame", "new_ease"), ["owner_id", "frame"], "left").withColumn("ease", F.coalesce("new_ease", "ease"))
    return rows.select(*curves.columns)


def fade_keys(curves: DataFrame, clips: DataFrame, frames: int) -> DataFrame:
    """Curves with a fade keyed at each clip's (owner_id, src_in, src_out, rate) first frames: 0 there, 1 after ``frames`` timeline frames."""
    last = F.least(F.col("src_in") + N.floor_long(F.lit(frames) * F.col("rate")), F.col("src_out") - 1)
    keys = F.array(F.struct(F.col("src_in").alias("frame"), F.lit(0.0).alias("value")), F.struct(last.alias("frame"), F.lit(1.0).alias("value")))
    fresh = clips.where("src_out - src_in > 1").select("owner_id", F.explode(keys).alias("k")).select("owner_id", "k.frame", "k.value", F.lit("linear").alias("ease"))
    rest = curves.select("owner_id", "frame", "value", "ease").join(fresh.select("owner_id", "frame"), ["owner_id", "frame"], "left_anti")
    return rest.unionByName(fresh)


def fade_in_length(curves: DataFrame, clips: DataFrame) -> DataFrame:
    """(owner_id, frames): length of the fade keyed at a clip's first source frame; 0 if there is none."""
    keys = curves.join(clips, "owner_id")
    info = keys.groupBy("owner_id", "src_in", "rate").agg(F.count("*").alias("n"), F.min(F.struct("frame", "value")).alias("first"), F.min(F.when(F.col("value") > 0.98, F.col("frame"))).alias("full"))
    ok = (F.col("n") >= 2) & (F.col("first.frame") == F.col("src_in")) & (F.col("first.value") < 0.02) & F.col("full").isNotNull()
    return info.select("owner_id", F.when(ok, N.timeline_frames(F.col("full") - F.col("src_in") + 1)).otherwise(F.lit(0)).cast("long").alias("frames"))


def effective(clips: DataFrame, sampled: DataFrame) -> DataFrame:
    """A clip's static parameters, overridden by its curves' values at the frame."""
    return clips.join(sampled.withColumnRenamed("value", "curve"), "owner_id", "left").withColumn("value", F.coalesce("curve", "static"))


def clear_fade(curves: DataFrame, clips: DataFrame) -> DataFrame:
    """Curves without the keys in the fade zone of ``clips`` (owner_id, src_in, src_out, direction ``in`` or ``out``): the half of the clip at that end, one frame at least.

    Keys elsewhere stay.  A clip may be given once for each direction.
    """
    half = F.greatest(N.div(F.col("src_out") - F.col("src_in"), 2), F.lit(1))
    at_end = F.col("direction") == "out"
    zones = clips.select("owner_id", F.when(at_end, F.col("src_out") - half).otherwise(F.col("src_in")).alias("_low"), F.when(at_end, F.col("src_out")).otherwise(F.col("src_in") + half).alias("_high"))
    zones = zones.groupBy("owner_id").agg(F.collect_set(F.struct("_low", "_high")).alias("_zones"))  # two a clip
    inside = F.exists("_zones", lambda z: F.col("frame").between(z["_low"], z["_high"]))
    return curves.join(zones, "owner_id", "left").where(~F.coalesce(inside, F.lit(False))).select(*curves.columns)


def fade(curves: DataFrame, clips: DataFrame) -> DataFrame:
    """Curves with fades of ``clips`` (owner_id, src_in, src_out, rate, direction, frames) in place of those that were there.

    ``frames`` are timeline frames; a fade takes their number at the clip's rate in source frames, one at least: in from 0 at the first to 1 at its last one,
    out from 1 to 0 at the clip's last.  Of two values for one frame the one to 0 stays.
    """
    n = F.greatest(N.half_even(F.col("frames") * F.col("rate")), F.lit(1))
    at_end = F.col("direction") == "out"
    ends = F.array(
        F.struct(F.when(at_end, F.col("src_out") - n).otherwise(F.col("src_in") + n - 1).alias("frame"), F.lit(1.0).alias("value")),
        F.struct(F.when(at_end, F.col("src_out") - 1).otherwise(F.col("src_in")).alias("frame"), F.lit(0.0).alias("value")),
    )
    fresh = clips.select("owner_id", F.explode(ends).alias("k")).groupBy("owner_id", "k.frame").agg(F.min("k.value").alias("value"))
    rest = clear_fade(curves.select("owner_id", "frame", "value", "ease"), clips).withColumnRenamed("value", "_old")
    both = rest.join(fresh, ["owner_id", "frame"], "full")
    return both.select("owner_id", "frame", F.coalesce("value", "_old").alias("value"), F.coalesce("ease", F.lit("linear")).alias("ease"))


def materialise_ease(curves: DataFrame) -> DataFrame:
    """Curves (with ``interp``, the ease of the whole) whose keys say it themselves: linear keys of a smooth curve become smooth, and the curve linear."""
    return curves.withColumn("ease", key_ease("ease", "interp")).withColumn("interp", F.when(F.col("interp") == "smooth", "linear").otherwise(F.col("interp")))


def toggle_keys(curves: DataFrame, points: DataFrame) -> DataFrame:
    """Curves without the keys that ``points`` (owner_id, frame) name, and with new ones, of the value that the curve has there, where there was none.

    A point of an owner without any key takes ``static`` of ``points``, if it has such a column, and nothing else.
    """
    want = points.select("owner_id", "frame", *(c for c in points.columns if c == "static")).dropDuplicates(["owner_id", "frame"])
    keys = curves.select("owner_id", "frame", "value", "ease")
    new = want.join(keys.select("owner_id", "frame"), ["owner_id", "frame"], "left_anti")
    static = new.select("owner_id", "frame", F.col("static").alias("_static")) if "static" in new.columns else new.select("owner_id", "frame", F.lit(None).cast("double").alias("_static"))
    made = value_at(new.select("owner_id", "frame"), keys).join(static, ["owner_id", "frame"]).select("owner_id", "frame", F.coalesce("value", "_static").alias("value"), F.lit("linear").alias("ease")).where("value is not null")
    return remove_keys(keys, want).unionByName(made)


def clear_curves(curves: DataFrame, owners: DataFrame) -> DataFrame:
    """Curves without any key of ``owners`` (owner_id)."""
    return curves.join(owners.select("owner_id").distinct(), "owner_id", "left_anti").select(*curves.columns)

"""Edits: a table of clips in, the table after the edit out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from . import timeline as T
from .lineage import shares

SHAPE = ["seq_id", "ord", "part", "source_id", "src_in", "src_out", "rate", "start", "track"]


def split_at(clips: DataFrame, points: DataFrame) -> DataFrame:
    """Each sequence's topmost clip at its point n cut in two (part 0 and 1); all other clips once, as part 0.

    The cut is a source frame, and the right half starts where that frame shows, so nothing moves.  No cut at a clip's first frame.
    """
    hit = T.topmost(T.clips_at(points, clips), ["seq_id", "n"], "ord")
    rows = clips.join(hit, ["seq_id", "ord"], "left").withColumn("cut", F.when(F.col("n") != F.col("start"), N.source_frame("n")))
    halves = F.when(
        F.col("cut") > F.col("src_in"),
        F.array(
            F.struct(F.lit(0).alias("part"), F.col("src_in").alias("a"), F.col("cut").alias("b"), F.col("start").alias("s")),
            F.struct(F.lit(1).alias("part"), F.col("cut").alias("a"), F.col("src_out").alias("b"), N.timeline_frame("cut").alias("s")),
        ),
    ).otherwise(F.array(F.struct(F.lit(0).alias("part"), F.col("src_in").alias("a"), F.col("src_out").alias("b"), F.col("start").alias("s"))))
    out = rows.withColumn("h", F.explode(halves))
    return out.select("seq_id", "ord", "h.part", "source_id", F.col("h.a").alias("src_in"), F.col("h.b").alias("src_out"), "rate", F.col("h.s").alias("start"), "track")


def _trimmed(trims: DataFrame, clips: DataFrame, parts: int) -> DataFrame:
    """Trims with their clips, in a number of partitions that grows with the clips."""
    keys = ["seq_id", "ord"]
    return trims.repartition(parts, *keys).join(clips.repartition(parts, *keys), keys)


def trim_right(clips: DataFrame, media: DataFrame, trims: DataFrame) -> DataFrame:
    """(seq_id, ord, src_out, stop) of trims (seq_id, ord, n): the clip ends at n, within its media and before the next on its lane."""
    near = T.neighbours(clips, "source_id", "src_in", "rate", "start").join(media.hint("shuffle_hash"), "source_id")
    rows = _trimmed(trims, near, shares(clips))
    most = F.least(F.col("start") + N.timeline_frames(F.col("nframes") - F.col("src_in")), F.coalesce("next_start", F.lit(2**62)))
    end = N.clamp("n", F.col("start") + 1, F.greatest(most, F.col("start") + 1))
    return rows.withColumn("stop", end).select("seq_id", "ord", N.source_frame("stop").alias("src_out"), "stop")


def trim_left(clips: DataFrame, trims: DataFrame) -> DataFrame:
    """(seq_id, ord, src_in, start): the clip starts at n, after the previous on its lane and within its media; its end stays."""
    rows = _trimmed(trims, T.neighbours(clips, "src_in", "rate", "start", "stop"), shares(clips))
    least = F.greatest(F.coalesce("prev_end", F.lit(0)), F.col("start") - N.timeline_frames("src_in"))
    at = N.clamp("n", F.least(least, F.col("stop") - 1), F.col("stop") - 1)
    rows = rows.withColumn("delta", at - F.col("start"))
    return rows.select("seq_id", "ord", (F.col("src_in") + N.half_even(F.col("delta") * F.col("rate"))).alias("src_in"), (F.col("start") + F.col("delta")).alias("start"))


def ripple_delete(clips: DataFrame, gone: DataFrame) -> DataFrame:
    """Clips without ``gone`` (seq_id, ord; one a sequence); what starts at or after it, on any lane, moves up by its length."""
    cut = gone.join(clips, ["seq_id", "ord"]).select("seq_id", F.col("ord").alias("g_ord"), F.col("start").alias("g_start"), F.col("len").alias("g_len"))
    rows = clips.join(cut, "seq_id", "left").where("g_ord is null or ord <> g_ord")
    return rows.select("seq_id", "ord", F.when(F.col("start") >= F.col("g_start"), F.col("start") - F.col("g_len")).otherwise(F.col("start")).alias("start"), "track")


def close_gaps(clips: DataFrame) -> DataFrame:
    """Every clip moved up by the gaps before it on its own lane."""
    by = Window.partitionBy("seq_id", "track").orderBy("start", "ord")
    rows = clips.withColumn("gap", F.greatest(F.col("start") - F.lag("stop").over(by), F.lit(0)))
    shift = F.coalesce(F.sum("gap").over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return rows.select("seq_id", "ord", "track", (F.col("start") - shift).alias("start"))


def joinable(clips: DataFrame) -> DataFrame:
    """(seq_id, left_ord, right_ord): halves of one cut, next to each other in time and in the source, on one lane."""
    right = clips.select("seq_id", "track", "source_id", "rate", F.col("start").alias("stop"), F.col("src_in").alias("src_out"), F.col("ord").alias("right_ord"), F.col("part").alias("right_part"))
    pairs = clips.join(right, ["seq_id", "track", "source_id", "rate", "stop", "src_out"])
    return pairs.where("(ord, part) <> (right_ord, right_part)").select("seq_id", F.col("ord").alias("left_ord"), F.col("part").alias("left_part"), "right_ord", "right_part")


def join_islands(clips: DataFrame) -> DataFrame:
    """Runs of joinable neighbours merged to one clip each."""
    by = Window.partitionBy("seq_id", "track").orderBy("start", "src_in", "ord", "part")
    same = (F.lag("source_id").over(by) == F.col("source_id")) & (F.lag("rate").over(by) == F.col("rate")) & (F.lag("stop").over(by) == F.col("start")) & (F.lag("src_out").over(by) == F.col("src_in"))
    rows = clips.withColumn("fresh", F.when(same, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("seq_id", "track", "island", "source_id", "rate").agg(F.min("start").alias("start"), F.min("src_in").alias("src_in"), F.max("src_out").alias("src_out"), F.count("*").alias("parts")).drop("island")


def snap_start(moves: DataFrame, targets: DataFrame, snap: int) -> DataFrame:
    """Moves (seq_id, ord, len, new_start) with either edge pulled to the nearest target within ``snap`` frames; first of equals, left edge first.

    Targets are (seq_id, pos, target), pos their order.
    """
    sides = F.array(F.struct(F.lit(0).alias("side"), F.lit(0).cast("long").alias("off")), F.struct(F.lit(1).alias("side"), F.col("len").alias("off")))
    rows = moves.select("seq_id", "ord", "new_start", F.explode(sides).alias("e")).select("seq_id", "ord", "new_start", "e.*").withColumn("edge", F.col("new_start") + F.col("off"))
    tries = T.within(rows, targets, ["seq_id"], "edge", "target", snap).withColumn("dist", F.abs(F.col("target") - F.col("edge")))
    best = tries.groupBy("seq_id", "ord").agg(F.min_by(F.col("target") - F.col("off"), F.struct("dist", "pos", "side")).alias("cand"))
    return moves.join(best, ["seq_id", "ord"], "left").select("seq_id", "ord", F.greatest(F.coalesce("cand", "new_start"), F.lit(0)).alias("start"), F.col("cand").isNotNull().alias("snapped"))


def move(clips: DataFrame, moves: DataFrame, targets: DataFrame, snap: int) -> DataFrame:
    """(seq_id, ord, start, moved): the snapped start where the lane has room, else the old one."""
    wanted = snap_start(moves.join(clips.select("seq_id", "ord", "len"), ["seq_id", "ord"]), targets, snap)
    ok = T.can_place(clips, wanted.select("seq_id", "ord", F.col("start").alias("new_start")))
    return ok.join(clips.select("seq_id", "ord", "start"), ["seq_id", "ord"]).select("seq_id", "ord", F.when(F.col("ok"), F.col("new_start")).otherwise(F.col("start")).alias("start"), F.col("ok").alias("moved"))


def ripple_captions(captions: DataFrame, cuts: DataFrame) -> DataFrame:
    """Captions at or after a cut (seq_id, at, by; seconds) earlier by its length."""
    rows = captions.join(cuts, "seq_id", "left")
    hit = F.col("start") >= F.col("at")
    return rows.select("seq_id", "ord", F.when(hit, F.col("start") - F.col("by")).otherwise(F.col("start")).alias("start"), F.when(hit, F.col("stop") - F.col("by")).otherwise(F.col("stop")).alias("stop"))


def upsert(base: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with the rows of ``fresh`` in place of those with equal keys."""
    rows = base.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    rest = [c for c in base.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_new").alias("_r")).select(*keys, *(f"_r.{c}" for c in rest))


def blend_fit(pairs: DataFrame, seconds: float, fps: float) -> DataFrame:
    """Pairs of clips (seq_id, and a_ and b_ ord, start, len) made to overlap: the later one's fade length and its new start."""
    first = (F.col("a_start") <= F.col("b_start"))
    side = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    rows = pairs.select("seq_id", side("a_ord", "b_ord").alias("from_ord"), side("b_ord", "a_ord").alias("into_ord"), side("a_start", "b_start").alias("f_start"), side("a_len", "b_len").alias("f_len"), side("b_len", "a_len").alias("i_len"))
    rows = rows.withColumn("fade", F.greatest(F.least(N.half_even(F.lit(seconds * fps)), N.div("i_len", 2)), F.lit(2)))
    return rows.select("seq_id", "from_ord", "into_ord", "fade", F.greatest(F.col("f_start") + F.col("f_len") - F.col("fade"), F.col("f_start")).alias("new_start"))

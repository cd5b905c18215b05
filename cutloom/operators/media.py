"""Sources: packet indexes, rates, caches, rings, and the frames a contact sheet shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N

# The standard frame rates, in the order in which they are tried.
STANDARD_RATES = [24000 / 1001, 24.0, 25.0, 30000 / 1001, 30.0, 48.0, 50.0, 60000 / 1001, 60.0, 120000 / 1001, 120.0]


def snap_rate(fps, nframes, duration) -> Column:
    """The effective rate where the stated one is off by over 1 %; the first standard rate within 0.2 % of it, else itself."""
    effective = N.col(nframes) / N.col(duration)
    standard = F.coalesce(*(F.when(F.abs(effective - r) / r < 0.002, F.lit(r)) for r in STANDARD_RATES), effective)
    off = (N.col(nframes) > 0) & (N.col(duration) > 0) & (F.abs(effective - N.col(fps)) / N.col(fps) > 0.01)
    return F.when(off, standard).otherwise(N.col(fps))


def packet_index(packets: DataFrame) -> DataFrame:
    """(source_id, frame, t, is_key): packets in display order."""
    by = Window.partitionBy("source_id").orderBy("t", F.col("is_key").desc())
    return packets.withColumn("frame", (F.row_number().over(by) - 1).cast("long")).select("source_id", "frame", "t", "is_key")


def gops(index: DataFrame) -> DataFrame:
    """(source_id, gop, firstframe, nframes): runs of frames that begin with a key frame; frames before the first are run 0."""
    by = Window.partitionBy("source_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    rows = index.withColumn("gop", F.sum(F.col("is_key").cast("long")).over(by))
    return rows.groupBy("source_id", "gop").agg(F.min("frame").alias("firstframe"), F.count("*").alias("nframes"))


def running_total(rows: DataFrame, keys: list[str], order: list[str], value: str, width: int) -> DataFrame:
    """``before`` and ``total``: the sum of what comes earlier in ``order`` and of all, per key.

    Two passes: sums of stretches of ``width`` of the first order column, then sums within a stretch; a key with very many rows is
    spread over its stretches.  The first order column is a whole number and not null.
    """
    rows = rows.withColumn("_s", N.floor_long(F.col(order[0]) / width))
    sums = rows.groupBy(*keys, "_s").agg(F.sum(value).alias("_sum"))
    by = Window.partitionBy(*keys)
    sums = sums.withColumn("_earlier", F.coalesce(F.sum("_sum").over(by.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("_sum").over(by))
    inner = Window.partitionBy(*keys, "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(sums.drop("_sum"), [*keys, "_s"])
    return out.withColumn("before", F.col("_inner") + F.col("_earlier")).drop("_s", "_inner", "_earlier")


def keep_until(files: DataFrame, order: list[str], size: str, most: int, keys: list[str], width: int = 1000) -> DataFrame:
    """Files with ``gone``: the first ones in ``order``, deleted one by one until what is left fits ``most``."""
    return running_total(files, keys, order, size, width).withColumn("gone", F.col("total") - F.col("before") > most).drop("before", "total")


def lru_keep(touches: DataFrame, group: str, item: str, at: str, capacity: int) -> DataFrame:
    """The items of each group that are still held: the ``capacity`` last touched."""
    last = touches.groupBy(group, item).agg(F.max(at).alias("last"))
    return last.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("last"), item))).where(F.col("r") <= capacity).select(group, item, "last")


def ring(frames: DataFrame, capacity: int) -> DataFrame:
    """(source_id, slot, frame): which frame each slot of a ring holds after all were written in order."""
    return frames.groupBy("source_id", F.pmod("frame", F.lit(capacity)).cast("long").alias("slot")).agg(F.max("frame").alias("frame"))


def seeks(reads: DataFrame) -> DataFrame:
    """(source_id, reads, seeks): reads in order; a seek is a read that is not of the frame after the one before."""
    by = Window.partitionBy("source_id").orderBy("i")
    jump = F.coalesce(F.col("frame") != F.lag("frame").over(by) + 1, F.col("frame") != 0)
    return reads.withColumn("jump", jump.cast("long")).groupBy("source_id").agg(F.count("*").alias("reads"), F.sum("jump").alias("seeks"))


def sheet_grid(n, aspect, size: int) -> list[Column]:
    """Columns, rows, cell width and cell height of a contact sheet of n cells; zeros for none."""
    n, aspect = N.col(n), N.col(aspect)
    cols = F.greatest(N.half_even(F.sqrt(n / F.greatest(aspect, F.lit(0.001)))), F.lit(1))
    rows = F.greatest(F.ceil(n / cols), F.lit(1))
    high = F.greatest(F.floor(F.lit(size) / rows), F.lit(16))
    wide = F.greatest(N.half_even(high * aspect), F.lit(16))
    return [F.when(n <= 0, F.lit(0)).otherwise(c).cast("long").alias(k) for c, k in ((cols, "cols"), (rows, "rows"), (wide, "cellw"), (high, "cellh"))]


def sheet_frames(spans: DataFrame, n: int) -> DataFrame:
    """(seq_id, frame): n evenly spaced frames of each span (seq_id, a, b), each once."""
    rows = spans.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.select("seq_id", N.half_even(F.col("a") + F.col("i") * (F.col("b") - F.col("a")) / (n - 1)).alias("frame")).distinct()


def timecode(n, fps: float) -> Column:
    frames = round(fps if fps > 0 else 25.0)
    total = F.greatest(N.col(n), F.lit(0))
    s = N.div(total, frames)
    part = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat_ws(":", part(N.div(s, 3600)), part(N.div(s, 60) % 60), part(s % 60), part(total % frames))


def exact_frames(points: DataFrame, index: DataFrame) -> DataFrame:
    """(source_id, frame, t) of the frames asked for; one that is not in the index is an error, never another frame."""
    rows = points.join(index.select("source_id", "frame", "t"), ["source_id", "frame"], "left")
    missing = F.raise_error(F.concat(F.lit("no frame "), F.col("frame").cast("string"), F.lit(" in source "), F.col("source_id").cast("string"))).cast("double")
    return rows.select("source_id", "frame", F.when(F.col("t").isNull(), missing).otherwise(F.col("t")).alias("t"))


def wishes(wanted: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """What is wanted now and not held yet, each once; earlier wishes do not count."""
    return wanted.select(*keys).distinct().join(held.select(*keys), keys, "left_anti")


def first_codec(line) -> Column:
    """The codec of a probe's line, whose further fields may be empty."""
    return F.element_at(F.split(F.trim(N.col(line)), ","), 1)


def recoverable(saved, project) -> Column:
    """Whether an autosave is there and newer than its project, or the project is missing."""
    return N.col(saved).isNotNull() & (N.col(project).isNull() | (N.col(saved) > N.col(project)))

"""Audio by the cut list: sample spans, silence, resampling and additive mixing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from .lineage import cut
from .stretches import WIDTH, handed_over
from .timeline import segments

RATE = 48_000
BLOCK = 4096
STRETCH = 100  # blocks that are dealt together
HALF = 0.5 + 1e-6  # a place in the middle of two samples goes up, however its last bits came out


def cut_list(clips: DataFrame, fps: float) -> DataFrame:
    """(seq_id, branch, kind, frames): all clips by start, silence where one starts after the last one's end.

    An overlap adds nothing; each clip plays whole, as many lanes as there are.
    """
    by = Window.partitionBy("seq_id").orderBy("start", "ord")
    rows = clips.withColumn("gap", F.greatest(F.col("start") - F.coalesce(F.lag("stop").over(by), F.lit(0)), F.lit(0)))
    parts = F.array(F.struct(F.lit(0).alias("k"), F.lit("silence").alias("kind"), F.col("gap").alias("frames")), F.struct(F.lit(1).alias("k"), F.lit("clip").alias("kind"), F.col("len").alias("frames")))
    flat = rows.select("seq_id", "start", "ord", F.explode(parts).alias("p")).where("p.kind = 'clip' or p.frames > 0")
    order = Window.partitionBy("seq_id").orderBy("start", "ord", "p.k")
    return flat.select("seq_id", F.row_number().over(order).cast("long").alias("branch"), "p.kind", F.col("p.frames").cast("long").alias("frames"))


def spans(clips: DataFrame, fps: float, source_fps: float) -> DataFrame:
    """(seq_id, ord, first, last, source_sample): a clip's timeline samples and where its sound starts in the source."""
    sample = lambda n: F.ceil(N.col(n) / fps * RATE).cast("long")
    return clips.where("len > 0").select("seq_id", "ord", sample("start").alias("first"), sample("stop").alias("last"), N.half_even(F.col("src_in") / source_fps * RATE).alias("source_sample"))


def resample(x: str, ratio: float) -> Column:
    """An array at ``ratio`` times its rate, linear between samples; one sample at least."""
    n = f"greatest(1, cast(floor(size({x}) * {ratio}D) as int))"
    at = f"i / {ratio}D"
    low = f"element_at({x}, least(cast(floor({at}) as int) + 1, size({x})))"
    high = f"element_at({x}, least(cast(floor({at}) as int) + 2, size({x})))"
    return F.expr(f"transform(sequence(0, {n} - 1), i -> (1 - ({at} - floor({at}))) * {low} + ({at} - floor({at})) * {high})")


def resample_to(x: str, n: str) -> Column:
    """An array stretched to n points, ends kept."""
    at = f"(i * (size({x}) - 1) / (cast({n} as double) - 1))"
    low = f"element_at({x}, cast(floor({at}) as int) + 1)"
    high = f"element_at({x}, least(cast(floor({at}) as int) + 2, size({x})))"
    body = f"transform(sequence(0, {n} - 1), i -> {low} + ({at} - floor({at})) * ({high} - {low}))"
    return F.expr(f"case when size({x}) = {n} then {x} when size({x}) = 1 then array_repeat({x}[0], {n}) when {n} = 1 then array({x}[0]) else {body} end")


def mix(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """Samples added and kept to 16 bits."""
    return tracks.groupBy(*keys).agg(F.sum("sample").alias("_s")).select(*keys, N.clamp("_s", -32768, 32767).cast("long").alias("sample"))


def blocks(first, last, size: int = BLOCK) -> Column:
    """The numbers of the fixed blocks that a sample span touches."""
    return F.sequence(N.div(first, size), N.div(N.col(last) - 1, size))


def block_pieces(clips: DataFrame, fps: float, source_fps: float, size: int = BLOCK) -> DataFrame:
    """(seq_id, stretch, block, first, n, source_id, ord, at, ratio): the sounding stretches of every block of ``size`` timeline samples.

    ``first`` counts within the block; ``at`` is the source sample, whole and share, that its first sample falls on, and ``ratio`` how far the source goes on a
    sample.  Each piece knows its place in the source by itself, so blocks can be filled in any order and give what one fill gives.
    The clip on top sounds; what is in no piece is silent.  A block lies in one ``stretch`` of STRETCH blocks, by which pieces are dealt: grouped with it, they stay where they are.
    """
    sample = lambda n: F.ceil(N.col(n) / fps * RATE).cast("long")
    laid = clips.select("seq_id", "ord", "track", "source_id", "src_in", "rate", F.col("start").alias("_from"), sample("start").alias("start"), sample("stop").alias("stop"))
    rows = segments(laid, size * STRETCH, ("ord", "source_id", "src_in", "rate", "_from")).where("ord is not null")
    rows = rows.withColumn("block", F.explode(blocks("a", "b", size)))
    p, q = F.greatest(F.col("a"), F.col("block") * size), F.least(F.col("b"), (F.col("block") + 1) * size)
    at = (F.col("src_in") + (p * fps / RATE - F.col("_from")) * F.col("rate")) / source_fps * RATE
    return rows.select("seq_id", "stretch", "block", (p - F.col("block") * size).alias("first"), (q - p).alias("n"), "source_id", "ord", at.alias("at"), (F.col("rate") * fps / source_fps).alias("ratio"))


def filled(pieces: DataFrame, sounds: DataFrame, size: int = BLOCK) -> DataFrame:
    """(seq_id, block, samples): each block's samples, from ``sounds`` (source_id, chunk, samples: ``size`` samples of the source from chunk * size on).

    A timeline sample takes the source sample nearest to where it falls; before the source's first and after its last it is silent.  Pieces
    meet the chunks that they reach, so sound travels as arrays and a block is put together from ``size`` samples at most.
    """
    last = F.col("at") + (F.col("n") - 1) * F.col("ratio")
    chunk = lambda x: N.floor_long(F.floor(x + HALF) / size)
    reach = pieces.where(last > -1).withColumn("chunk", F.explode(F.sequence(F.greatest(chunk(F.col("at")), F.lit(0).cast("long")), F.greatest(chunk(last), F.lit(0).cast("long")))))
    heard = reach.join(sounds.select("source_id", "chunk", F.col("samples").alias("_s")), ["source_id", "chunk"])
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    one = heard.select("seq_id", "block", "first", "at", "ratio", "chunk", "_s", k.alias("k"))
    place = F.floor(F.col("at") + F.col("k") * F.col("ratio") + HALF) - F.col("chunk") * size
    one = one.withColumn("_i", place.cast("int")).where((F.col("_i") >= 0) & (F.col("_i") < F.size("_s")))
    got = one.select("seq_id", "block", (F.col("first") + F.col("k")).alias("i"), F.get("_s", F.col("_i")).cast("int").alias("v"))
    whole = got.groupBy("seq_id", "block").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    return whole.select("seq_id", "block", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("samples"))


class Feeder:
    """What a sound card is fed: block after block, from where the playhead is if that is over a quarter second away."""

    def __init__(self, fps: float, size: int = BLOCK, slack: int = RATE // 4):
        self.fps, self.size, self.slack, self.cursor = fps, size, slack, None

    def tick(self, playhead: float) -> tuple[int, bool]:
        """(first sample of the block, whether the feed jumped)."""
        expected = round(playhead / self.fps * RATE)
        jumped = self.cursor is None or abs(self.cursor - expected) > self.slack
        start = expected if jumped else self.cursor
        self.cursor = start + self.size
        return start, jumped


def fed(ticks: DataFrame, key: str, at: str, fps: float, size: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """(key, at, first, jumped) of every tick (key, at, playhead) in order: a jump makes the feed forget, so sessions go over stretches at once."""
    rows = cut(ticks.select(key, at, F.col("playhead").cast("double").alias("playhead")))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(part, state, first):
        feeder = Feeder(fps, size)
        if state is not None:
            feeder.cursor = int(state[0])
        out = [feeder.tick(p) for p in part["playhead"].tolist()]
        told = part[[key, at]].copy()
        told["first"], told["jumped"] = [x[0] for x in out], [x[1] for x in out]
        return told, np.array([float(feeder.cursor)])

    return handed_over(rows, key, at, run, f"`{key}` {kinds[key]}, `{at}` {kinds[at]}, first long, jumped boolean", width)

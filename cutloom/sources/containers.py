"""Video streams and containers as bytes: groups of pictures of H.264 and H.265 from byte ranges, and the frames that an edit list cuts off.

A stream is a table of ranges (path, at, content): its bytes from ``at`` on, in pieces of any size.  A piece is searched by itself; the first bytes of the next
one are joined to its end, so what lies across a border is found once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.curves import asof
from ..operators.lineage import cut
from ..operators.media import running_total

HEAD = 5  # bytes after the first one of a start code that a unit is told by
STRETCH = 1 << 22  # bytes of a stream that are sorted together
_START = re.compile(b"\x00\x00\x01")


class Codec(NamedTuple):
    """Fixed values of a codec: unit types of key pictures, of what may stand right before one, of slices, of parameter sets in order, of open groups."""

    shift: int
    mask: int
    key: tuple[int, ...]
    before: tuple[int, ...]
    slices: tuple[int, ...]
    parameters: tuple[int, ...]
    open: tuple[int, ...]
    first_flag: bool  # whether a slice tells that it is a picture's first one


H264 = Codec(0, 0x1F, (5,), (7, 8), (1, 5), (7, 8), (), False)
H265 = Codec(1, 0x3F, (19, 20), (32, 33, 34, 39), tuple(range(22)), (32, 33, 34), (21,), True)


def ranges(blobs: DataFrame, size: int) -> DataFrame:
    """(path, at, content) of whole files (path, content), in pieces of ``size`` bytes."""
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.length("content") - 1, F.lit(0)).cast("long"), F.lit(size).cast("long"))).alias("at")
    return blobs.where("content is not null").select("path", pieces, "content").select("path", "at", F.substring("content", (F.col("at") + 1).cast("int"), F.lit(size)).alias("content"))


def units(streams: DataFrame, codec: Codec) -> DataFrame:
    """(path, at, kind, frame): where each unit's start code begins, the unit's type and whether a picture starts with it.

    Pieces may be as short as a byte; a unit whose header is cut off by the stream's end is left out.
    """
    pieces = streams.select("path", "at", "content").where("length(content) > 0")
    heads = pieces.select("path", F.explode(F.expr(f"transform(sequence(0, least({HEAD}, length(content)) - 1), i -> struct(at + i AS place, substring(content, i + 1, 1) AS byte))")).alias("h")).select("path", "h.*")
    ends = pieces.select("path", "at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(HEAD - 1)), lambda i: F.struct(i.alias("i"), (F.col("at") + F.length("content") + i).alias("place")))).alias("e")).select("path", "at", "e.*")
    after = ends.join(heads, ["path", "place"]).groupBy("path", "at").agg(F.array_sort(F.collect_list(F.struct("i", "byte"))).alias("after"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, at, content, after in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "content", "after")), strict=True):
                raw = content + b"".join(x["byte"] for x in after or [])
                for m in _START.finditer(raw):
                    i = m.start()
                    if i < len(content) and i + 3 < len(raw):
                        kind = raw[i + 3] >> codec.shift & codec.mask
                        first = not codec.first_flag or (i + 5 < len(raw) and raw[i + 5] >= 0x80)
                        out.append((path, at + i, kind, kind in codec.slices and first))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.bool_()))], ["path", "at", "kind", "frame"])

    return pieces.join(after, ["path", "at"], "left").mapInArrow(run, "path string, at long, kind int, frame boolean")


def refused(found: DataFrame, codec: Codec) -> DataFrame:
    """(path, reason) of streams, by their units, that cannot be entered at a group: with open groups, or without a key picture."""
    one = found.groupBy("path").agg(F.max(F.col("kind").isin(*codec.open) if codec.open else F.lit(False)).alias("open"), F.max(F.col("kind").isin(*codec.key)).alias("key"))
    reason = F.when(F.col("open"), "open groups").when(~F.col("key"), "no key picture")
    return one.select("path", reason.alias("reason")).where("reason is not null")


def groups(streams: DataFrame, codec: Codec) -> DataFrame:
    """(path, gop, b0, b1, firstframe, nframes): groups of pictures, as byte ranges that can be decoded by themselves.

    A group starts at each key unit, with the parameter sets right before it, and ends before the next; its frames are the pictures that start in it.  Streams that
    are ``refused`` have no rows.  Start, end and counts come from as-of lookups and running sums over stretches of bytes, so one long stream is spread.
    """
    found = cut(units(streams, codec))
    found = cut(found.join(refused(found, codec), "path", "left_anti"))
    size = streams.groupBy("path").agg(F.max(F.col("at") + F.length("content")).alias("size"))
    other = found.where(~F.col("kind").isin(*codec.before)).select("path", F.col("at").alias("_other"), (F.col("at") + 1).alias("at"))
    keys = asof(found.where(F.col("kind").isin(*codec.key)).select("path", "at"), other, ["path"], "at", ["_other"], width=STRETCH)
    keys = keys.select("path", (F.coalesce("_other", F.lit(-1).cast("long")) + 1).alias("at"))
    starts = cut(asof(keys, found.select("path", "at", F.col("at").alias("b0")), ["path"], "at", ["b0"], forward=True, width=STRETCH).select("path", "b0").distinct().withColumn("at", F.col("b0")))
    inside = asof(found.where("frame").select("path", "at"), starts, ["path"], "at", ["b0"], width=STRETCH).where("b0 is not null")
    counts = starts.drop("at").join(inside.groupBy("path", "b0").agg(F.count("*").alias("nframes")), ["path", "b0"], "left").withColumn("nframes", F.coalesce("nframes", F.lit(0).cast("long"))).withColumn("one", F.lit(1).cast("long"))
    counts = running_total(counts, ["path"], ["b0"], "nframes", STRETCH).withColumnRenamed("before", "firstframe").drop("total")
    counts = running_total(counts, ["path"], ["b0"], "one", STRETCH).withColumnRenamed("before", "gop").drop("total", "one")
    ends = asof(counts.withColumn("at", F.col("b0") + 1), starts.select("path", "at", F.col("b0").alias("next")), ["path"], "at", ["next"], forward=True, width=STRETCH)
    return ends.join(size, "path").select("path", "gop", "b0", (F.coalesce("next", "size") - 1).alias("b1"), "firstframe", "nframes")


def parameter_sets(streams: DataFrame, codec: Codec) -> DataFrame:
    """(path, kind, b0, b1): the first of each parameter set that a stream carries, to go before groups that lack them; none where one is missing."""
    found = cut(units(streams, codec))
    first = found.where(F.col("kind").isin(*codec.parameters)).groupBy("path", "kind").agg(F.min("at").alias("b0"))
    whole = first.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") == len(codec.parameters)).select("path")
    after = asof(first.join(whole, "path").withColumn("at", F.col("b0") + 1), found.select("path", "at", F.col("at").alias("next")), ["path"], "at", ["next"], forward=True, width=STRETCH)
    size = streams.groupBy("path").agg(F.max(F.col("at") + F.length("content")).alias("size"))
    return after.join(size, "path").select("path", "kind", "b0", (F.coalesce("next", "size") - 1).alias("b1"))


# --- the edit list of a container
class Box(NamedTuple):
    kind: bytes
    low: int
    high: int


def boxes(raw: bytes, low: int, high: int) -> Iterator[Box]:
    """Boxes side by side within [low, high): length, four letters, and the body; length 1 is a 64-bit one after the letters, 0 reaches to the end.

    A length that is less than its own head ends the list; a body that is cut off ends with the bytes.
    """
    while low + 8 <= high:
        size, head = int.from_bytes(raw[low : low + 4]), 8
        if size == 1:
            if low + 16 > high:
                return
            size, head = int.from_bytes(raw[low + 8 : low + 16]), 16
        elif size == 0:
            size = high - low
        if size < head:
            return
        yield Box(raw[low + 4 : low + 8], low + head, min(low + size, high))
        low += size


def inner(raw: bytes, box: Box, *path: bytes) -> Iterator[Box]:
    """Boxes that lie in a box under the names of ``path``."""
    for one in boxes(raw, box.low, box.high):
        if one.kind == path[0]:
            yield from inner(raw, one, *path[1:]) if len(path) > 1 else (one,)


def edit_list_lead(raw: bytes) -> int:
    """Frames at the start of the video track that the edit list cuts off: what its first time is past the first frame's own offset, in frames.

    0 without an edit list, without a video track or a frame length, and for what is no such container; of several video tracks with a frame length the last counts.
    """
    if len(raw) < 12 or raw[4:8] != b"ftyp":
        return 0
    number = lambda box, at, n=4: int.from_bytes(raw[box.low + at : box.low + at + n])
    first = lambda box, need, *path: next((b for b in inner(raw, box, *path) if b.high - b.low >= need), None)
    lead = 0
    for track in inner(raw, Box(b"", 0, len(raw)), b"moov", b"trak"):
        handler = first(track, 12, b"mdia", b"hdlr")
        lengths, offsets = (first(track, 16, b"mdia", b"minf", b"stbl", k) for k in (b"stts", b"ctts"))
        edits = first(track, 16, b"edts", b"elst")
        if handler is None or raw[handler.low + 8 : handler.low + 12] != b"vide" or lengths is None or not number(lengths, 12):
            continue
        time = 0
        if edits is not None:
            long = raw[edits.low] == 1
            time = number(edits, 16, 8) if long and edits.high - edits.low >= 24 else 0 if long else number(edits, 12)
        lead = max(0, time - (number(offsets, 12) if offsets else 0)) // number(lengths, 12)
    return lead


def edit_leads(blobs: DataFrame) -> DataFrame:
    """(path, lead) of containers (path, content); null contents have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leads = [edit_list_lead(c.as_py() or b"") for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leads, pa.int64())], ["path", "lead"])

    return blobs.select("path", "content").mapInArrow(run, "path string, lead long")

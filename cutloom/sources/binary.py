"""Binary files as tables: mask sidecars, matte planes and elementary video streams; frames written in order."""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Unit types of an H.264 byte stream.
SLICE, KEY_SLICE, PARAMETERS = 1, 5, (7, 8)
_START = re.compile(b"\x00\x00\x01(.)", re.S)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def mask_records(raw: bytes) -> list[tuple[int, int, int, bytes]]:
    """(frame, width, height, bytes) of records with three little-endian 32-bit numbers before the bytes.

    What does not fit at the end, or has no size, ends the list; of records for one frame the last counts.
    """
    found, at = {}, 0
    while len(raw) - at >= 12:
        frame, w, h = struct.unpack_from("<iii", raw, at)
        at += 12
        if w <= 0 or h <= 0 or len(raw) - at < w * h:
            break
        found[frame] = (frame, w, h, raw[at : at + w * h])
        at += w * h
    return sorted(found.values())


def masks(blobs: DataFrame) -> DataFrame:
    """(path, frame, w, h, alpha) of mask sidecars (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *r) for p, c in zip(*(batch.column(k).to_pylist() for k in ("path", "content")), strict=True) for r in mask_records(c or b"")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["path", "frame", "w", "h", "alpha"])

    return blobs.select("path", "content").mapInArrow(run, "path string, frame long, w int, h int, alpha binary")


def pack_masks(masks: DataFrame) -> DataFrame:
    """(path, content): masks (path, frame, w, h, alpha) as sidecars, records in order of frame; the inverse of ``masks``.

    Masks without a size, or whose bytes are not w * h, are left out; of several for one frame the one with the most bytes, then the greatest, stays.  A sidecar is one file, so one row holds it.
    """
    good = masks.where((F.col("w") > 0) & (F.col("h") > 0) & (F.length("alpha") == F.col("w") * F.col("h")))
    one = good.groupBy("path", "frame").agg(F.max(F.struct(F.length("alpha").alias("n"), F.hex("alpha").alias("x"), "w", "h")).alias("m"))
    number = lambda c: F.concat(*(F.lpad(F.hex(F.pmod(F.floor(F.col(c).cast("long") / (1 << s)), F.lit(256))), 2, "0") for s in (0, 8, 16, 24)))
    rows = one.select("path", "frame", F.concat(number("frame"), number("m.w"), number("m.h"), F.col("m.x")).alias("r"))
    whole = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("frame", "r"))).alias("l"))
    return whole.select("path", F.unhex(F.array_join(F.transform("l", lambda x: x["r"]), "")).alias("content"))


def pack_planes(planes: DataFrame) -> DataFrame:
    """(path, w, h, n, content): a matte cache from (path, frame, w, h, alpha): every frame's plane, one after another, from the first frame to the last; what is missing is empty.

    All planes of a cache have the size of the largest; others count as missing.
    """
    size = planes.groupBy("path").agg(F.max(F.struct((F.col("w") * F.col("h")).alias("_n"), "w", "h")).alias("s"), F.min("frame").alias("_a"), F.max("frame").alias("_b"))
    all_ = size.select("path", "s.w", "s.h", (F.col("_b") - F.col("_a") + 1).alias("n"), F.explode(F.sequence("_a", "_b")).alias("frame"))
    good = planes.where(F.length("alpha") == F.col("w") * F.col("h")).groupBy("path", "frame", "w", "h").agg(F.max(F.hex("alpha")).alias("x"))
    filled = all_.join(good, ["path", "frame", "w", "h"], "left").withColumn("x", F.coalesce("x", F.repeat(F.lit("00"), (F.col("w") * F.col("h")).cast("int"))))
    whole = filled.groupBy("path", "w", "h", "n").agg(F.array_sort(F.collect_list(F.struct("frame", "x"))).alias("l"))
    return whole.select("path", "w", "h", "n", F.unhex(F.array_join(F.transform("l", lambda v: v["x"]), "")).alias("content"))


def write_files(blobs: DataFrame, folder: str) -> int:
    """Each row (path, content) as a file under ``folder``, which all machines share; the number of files.

    Tasks write to a name of their own and then move it, so a task that runs twice, or a lost one, leaves whole files only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        place, root = FileSystem.from_uri(folder)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = f"{root}/{path}"
                place.create_dir(name.rpartition("/")[0], recursive=True)
                part = f"{name}.{uuid.uuid4().hex}.part"
                with place.open_output_stream(part) as out:
                    out.write(content or b"")
                place.move(part, name)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return blobs.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def plane(content, w: int, h: int, n: int):
    """A matte cache's bytes, or zeros where it is missing or of another size."""
    size = w * h * n
    return F.when(F.length(content) == size, content).otherwise(F.lit(bytes(size)))


def gop_index(raw: bytes) -> list[tuple[int, int, int, int, int]]:
    """(gop, first byte, last byte, first frame, frames) of an Annex B stream: groups begin at a key slice and take the
    parameter sets right before it along; frames are slices.  No groups without a key slice.
    """
    units = [(m.start(), m[1][0] & 31) for m in _START.finditer(raw)]
    starts = []
    for j, (_, kind) in enumerate(units):
        if kind == KEY_SLICE:
            while j and units[j - 1][1] in PARAMETERS:
                j -= 1
            starts.append(j)
    out, frame = [], 0
    for g, (a, b) in enumerate(zip(starts, [*starts[1:], len(units)])):  # noqa: B905
        n = sum(kind in (SLICE, KEY_SLICE) for _, kind in units[a:b])
        out.append((g, units[a][0], (units[b][0] if b < len(units) else len(raw)) - 1, frame, n))
        frame += n
    return out


def gops(blobs: DataFrame) -> DataFrame:
    """(path, gop, b0, b1, firstframe, nframes) of streams (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *r) for p, c in zip(*(batch.column(k).to_pylist() for k in ("path", "content")), strict=True) for r in gop_index(c or b"")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i == 0 else pa.int64()) for i in range(6)], ["path", "gop", "b0", "b1", "firstframe", "nframes"])

    return blobs.select("path", "content").mapInArrow(run, "path string, gop long, b0 long, b1 long, firstframe long, nframes long")


def write_frames(frames: DataFrame, path: str, *keys: str) -> None:
    """Frames as Parquet, dealt and sorted by their keys and frame number; an empty table is an error."""
    if not frames.head(1):
        raise ValueError("there are no frames to write")
    frames.repartitionByRange(*keys, "frame").sortWithinPartitions(*keys, "frame").write.mode("overwrite").parquet(path)


def decimated(frames: DataFrame, fps: float, to_fps: float, *keys: str) -> DataFrame:
    """The frames that a lower rate shows, renumbered; ``keys`` tell sequences apart."""
    n = F.floor(F.col("frame") * to_fps / fps).cast("long")
    first = frames.withColumn("_n", n).groupBy(*keys, "_n").agg(F.min("frame").alias("frame"))
    return frames.join(first, [*keys, "frame"]).withColumn("frame", F.col("_n")).drop("_n")

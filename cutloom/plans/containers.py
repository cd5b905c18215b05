"""Queries over byte streams: units of video streams made of events, containers made of parts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..sources import containers as C
from ..sources import tables as S
from .registry import query

#: the unit that an event becomes, by its number: key picture, parameter sets, other slices; in hexadecimal after the start code
H264 = {0: "65", 1: "67", 2: "68", 3: "06"}
H265 = {0: "2601", 1: "4001", 2: "4201", 3: "4401", 4: "4E01"}


def _stream(spark, d, kinds, other, flag):
    events = S.table(spark, d, "events")
    kind = F.col("event_id") * 7 % 23
    head = F.lit(other)
    for k, v in kinds.items():
        head = F.when(kind == k, v).otherwise(head)
    body = F.repeat(F.lit("FF"), (F.col("event_id") % 5 + 1).cast("int"))
    first = F.when(F.col("event_id") % 3 == 0, "00").otherwise("80") if flag else F.lit("")
    unit = F.concat(F.lit("000001"), head, first, body)
    whole = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", unit.alias("u")))).alias("s"))
    blobs = whole.select(F.col("user_id").cast("string").alias("path"), F.unhex(F.array_join(F.transform("s", lambda x: x["u"]), "")).alias("content"))
    return C.ranges(blobs, 37)  # so that start codes lie across borders


def _sql(kinds, flag, head):
    """Groups by counting over the events themselves."""
    case = " ".join(f"WHEN {k} THEN {k}" for k in kinds)
    slices = f"kind IN (0, -1){' AND event_id % 3 <> 0' if flag else ''}"
    return f"""WITH u AS (SELECT CAST(user_id AS VARCHAR) AS path, event_id, CASE event_id * 7 % 23 {case} ELSE -1 END AS kind, 3 + {head} + event_id % 5 + 1 AS size FROM events),
o AS (SELECT *, sum(size) OVER w - size AS at, sum(size) OVER (PARTITION BY path) AS whole, row_number() OVER w AS i, max(CASE WHEN kind IN (-1, 0{', 3' if not flag else ''}) THEN event_id END) OVER (PARTITION BY path ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stop FROM u WINDOW w AS (PARTITION BY path ORDER BY event_id)),
s AS (SELECT DISTINCT k.path, (SELECT min(p.at) FROM o p WHERE p.path = k.path AND p.event_id > coalesce(k.stop, -1)) AS b0 FROM o k WHERE kind = 0),
g AS (SELECT path, b0, row_number() OVER (PARTITION BY path ORDER BY b0) - 1 AS gop, lead(b0) OVER (PARTITION BY path ORDER BY b0) AS next FROM s),
n AS (SELECT g.path, g.gop, g.b0, coalesce(g.next, any_value(o.whole)) - 1 AS b1, count(*) FILTER ({slices}) AS nframes FROM g JOIN o ON o.path = g.path AND o.at >= g.b0 AND o.at < coalesce(g.next, o.whole) GROUP BY g.path, g.gop, g.b0, g.next)
SELECT path, gop, CAST(b0 AS BIGINT) AS b0, CAST(b1 AS BIGINT) AS b1, CAST(sum(nframes) OVER (PARTITION BY path ORDER BY gop) - nframes AS BIGINT) AS firstframe, nframes FROM n"""


@query(_sql(H264, False, 1))
def h264_groups(spark, d):
    return C.groups(_stream(spark, d, H264, "41", False), C.H264)


@query(_sql(H265, True, 3))
def h265_groups(spark, d):
    return C.groups(_stream(spark, d, H265, "0201", True), C.H265)


def _container(key: int, size: int) -> bytes:
    """A sound track before the video track, 64-bit lengths and times in some, no edit list in some."""
    word = lambda n, width=4: n.to_bytes(width)

    def box(kind: bytes, *body: bytes) -> bytes:
        whole = b"".join(body)
        return word(1) + kind + word(len(whole) + 16, 8) + whole if key % 3 == 0 else word(len(whole) + 8) + kind + whole

    table = lambda kind, value: box(kind, word(0), word(1), word(5), word(value))
    handler = lambda kind: box(b"hdlr", word(0), word(0), kind, word(0))
    times = b"\1\0\0\0" + word(1) + word(9, 8) + word(size * 40, 8) if key % 2 == 0 else word(0) + word(1) + word(9) + word(size * 40)
    edits = b"" if key % 7 == 0 else box(b"edts", box(b"elst", times))
    sound = box(b"trak", box(b"mdia", handler(b"soun"), box(b"minf", box(b"stbl", table(b"stts", 1)))), edits)
    video = box(b"trak", box(b"mdia", handler(b"vide"), box(b"minf", box(b"stbl", table(b"stts", key % 11 + 1), table(b"ctts", key % 900)))), edits)
    return box(b"ftyp", b"isom") + box(b"moov", sound, video)


def _containers(batches):
    for batch in batches:
        made = [_container(k, n) for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(made, pa.binary())], ["path", "content"])


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE greatest(p_size * 40 - p_partkey % 900, 0) // (p_partkey % 11 + 1) END AS lead FROM part")
def edit_list_leads(spark, d):
    return C.edit_leads(S.table(spark, d, "part").select("p_partkey", "p_size").mapInArrow(_containers, "path string, content binary"))

"""Packing by concatenation and cutting.

Two passes.  The first tokenizes each scan partition once, in its own order, and stores every document's ids with its
offset inside the partition.  Prefix sums over the partitions' totals then give each partition's place in the one long
stream; that table (one row per scan partition: its first sequence, the offset there) holds the boundary records.  The second pass
cuts the stream at multiples of the window.  Documents are never shuffled.

Empty input gives no rows.  A null or empty text is one end token.  Repeated rows are packed once each.  A document that
is longer than a window has a piece in each window it touches.  Other columns are ignored; a null doc_id stays null.
Only the last sequence can be short, whatever the number of partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MAX_IDS = 1 << 23  # in a batch, but for a single document with more
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _tokenize(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, part, at = common.bpe_encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, n = memo.ended(batch.column("text"), end_id)
            ends = np.cumsum(n)
            starts, low = ends - n, 0
            while low < len(n):  # 32-bit offsets: many batches rather than one with too many bytes of ids
                high = max(low + 1, int(np.searchsorted(ends, starts[low] + MAX_IDS, "right")))
                offsets = (np.append(starts[low:high], ends[high - 1]) - starts[low]) * memo.width
                raw = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids[starts[low] : ends[high - 1]])])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()).slice(low, high - low), pa.array([part] * (high - low), pa.int32()), pa.array(at + starts[low:high]), pa.array(n[low:high]), raw], ["doc_id", "part", "at", "n", "ids"])
                low = high
            at += int(n.sum())

    return run


def _cut(window: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, at, sequence, total, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "first", "n", "ids")), strict=True):
                ids = np.frombuffer(raw, dtype=kind).astype("<u4")
                start = 0
                while start < total:
                    offset = (at + start) % window
                    length = min(window - offset, total - start)
                    rows.append((doc, start, length, zlib.crc32(ids[start : start + length]), total, sequence + (at + start) // window, offset))
                    start += length
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(names), names)

    return run


def tokens(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """(doc_id, part, at, n, ids): the stored first pass."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return common.stored(rows.mapInArrow(_tokenize(tokenizer, end_id), "doc_id long, part int, at long, n long, ids binary"), "tokens")


def boundaries(toks: DataFrame, window: int) -> DataFrame:
    """(part, sequence_id, offset): the sequence in which each partition begins, and where.  As many rows as the first pass had tasks."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return toks.groupBy("part").agg(F.sum("n").alias("total")).select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")).select("part", F.expr(f"base div {window}").alias("sequence_id"), (F.col("base") % window).alias("offset"))


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece, see PIECES: ``start`` counts the document's ids before it, ``offset`` the sequence's."""
    from tokenizers import Tokenizer

    kind = "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 65536 else "<u4"
    toks = tokens(docs, tokenizer, end_id)
    placed = toks.join(F.broadcast(boundaries(toks, window)), "part")  # a row per task of the first pass
    at = F.col("at") + F.col("offset")  # within the partition's stretch of the stream, from the start of its first sequence
    return placed.select("doc_id", at.alias("at"), F.col("sequence_id").alias("first"), "n", "ids").mapInArrow(_cut(window, kind), PIECES)

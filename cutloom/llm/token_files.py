"""Token ids in Arrow files of fixed-size-list batches.

Documents are range-partitioned by doc_id; each task writes its partition's ids, in doc_id order, as one Arrow IPC file
of equal-length sequences ``ids: fixed_size_list<uint16 or uint32>[sequence]`` with ``mask: fixed_size_list<bool>``
(false: padding, at a file's end only), uncompressed, so that a mapped file gives any sequence without copying.  A second
Arrow file beside it lists the documents (doc_id, start, n_tokens inside the file).  Each attempt of a task writes
a pair of files under a name of its own, and the manifest, a row per file pair, names the pairs that count; nothing is
renamed.  Names of one ``write`` begin alike and unlike all others, so writers can share a folder: once the manifest is stored, those pairs of
this write that it does not name, of attempts that were lost or not needed, are removed, and nothing else.  The manifest
orders the files; offsets are prefix sums over it.

A null text is empty: its end id alone.  Empty input makes no file and no rows.  Repeated doc_ids are neighbours, ordered by
their text's hash, and spread over files by it.  Null doc_ids come first.  A task holds a batch, whatever the number of its documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MANIFEST = "part int, first_doc long, n_docs long, n_tokens long, path string"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class SequenceWriter:
    """Streams ids into an Arrow file; holds at most one batch of ``rows`` sequences."""

    def __init__(self, sink, kind: str, length: int, rows: int = 256):
        self.length, self.rows, self.width = length, rows, np.dtype(kind).itemsize
        item = pa.uint16() if self.width == 2 else pa.uint32()
        self.item, self.buffer, self.size = item, [], 0
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = pa.ipc.new_file(sink, self.schema)

    def add(self, raw: bytes) -> None:
        self.buffer.append(raw)
        self.size += len(raw)
        full = self.rows * self.length * self.width
        if self.size >= full:
            data = b"".join(self.buffer)
            end = len(data) // full * full
            for at in range(0, end, full):
                self._batch(data[at : at + full])
            self.buffer, self.size = [data[end:]], len(data) - end

    def _batch(self, raw: bytes) -> None:
        count = len(raw) // self.width
        filled = -(-count // self.length) * self.length
        ids = pa.Array.from_buffers(self.item, filled, [None, pa.py_buffer(raw + bytes((filled - count) * self.width))])
        mask = pa.array(np.arange(filled) < count)
        self.file.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(x, self.length) for x in (ids, mask)], schema=self.schema))

    def close(self) -> None:
        if self.size:
            self._batch(b"".join(self.buffer))
        self.file.close()


DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _write(tokenizer: str, end_id: int, length: int, folder: str, prefix: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, first, total, writer, memo = TaskContext.get().partitionId(), 0, None, 0, None, None
        fs, root = filesystem(folder)
        name = f"{prefix}-part-{part:06d}-{uuid.uuid4().hex}"
        mine = f"{root}/{name}"
        for batch in batches:
            if writer is None and batch.num_rows:
                memo = common.bpe_encoder(tokenizer)
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(f"{mine}.ids.arrow")
                writer = SequenceWriter(sink, memo.kind, length)
                listing = fs.open_output_stream(f"{mine}.docs.arrow")
                docs = pa.ipc.new_file(listing, DOCS)
                first = batch.column("doc_id")[0].as_py()
            if writer is not None and batch.num_rows:
                ids, n = memo.ended(batch.column("text"), end_id)
                writer.add(ids.tobytes())
                starts = total + np.cumsum(n) - n
                docs.write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(starts, pa.int64()), pa.array(n, pa.int64())], schema=DOCS))
                count += batch.num_rows
                total += int(n.sum())
        rows: list[tuple] = []
        if writer:
            for one in (writer, sink, docs, listing):
                one.close()
            rows = [(part, first, count, total, f"{folder}/{name}")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], [x.split()[0] for x in MANIFEST.split(", ")])

    return run


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, length: int = 2048) -> DataFrame:
    """Writes into ``folder`` and returns the manifest, one row per file, with each file's ``base`` (ids in the files before)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = F.col("doc_id"), F.xxhash64("text")  # many rows with one id, or none, are dealt by their texts
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    prefix = uuid.uuid4().hex[:16]
    manifest = common.stored(ordered.mapInArrow(_write(tokenizer, end_id, length, folder, prefix), MANIFEST), "manifest")
    _tidy(folder, prefix, {r.path.rsplit("/", 1)[1] for r in manifest.select("path").toLocalIterator()})  # a name for each task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _tidy(folder: str, prefix: str, named: set[str]) -> None:
    """Removes the files of this write's attempts that are not in its manifest."""
    fs, root = filesystem(folder)
    for found in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if found.base_name.startswith(f"{prefix}-") and found.base_name.endswith(".arrow") and found.base_name.split(".")[0] not in named:
            fs.delete_file(found.path)


class SequenceReader:
    """Random access to a file that ``SequenceWriter`` made.  Local files are mapped, not read."""

    def __init__(self, uri: str):
        fs, path = filesystem(f"{uri}.ids.arrow")
        self.file = pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path))
        self.uri = uri
        self.length = self.file.schema.field("ids").type.list_size
        self.per_batch = self.file.get_batch(0).num_rows * self.length if self.file.num_record_batches else 0
        self.at, self.values = -1, None

    def listing(self) -> Iterator[pa.RecordBatch]:
        """The file's documents, batch by batch."""
        fs, path = filesystem(f"{self.uri}.docs.arrow")
        with fs.open_input_file(path) as source:
            file = pa.ipc.open_file(source)
            for k in range(file.num_record_batches):
                yield file.get_batch(k)

    @property
    def docs(self) -> pa.Table:
        return pa.Table.from_batches(self.listing(), DOCS)

    def batch(self, k: int) -> np.ndarray:
        if k != self.at:
            self.at, self.values = k, self.file.get_batch(k).column("ids").flatten().to_numpy(zero_copy_only=True)
        return self.values

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        batch, row = divmod(i, self.per_batch // self.length)
        rows = self.file.get_batch(batch)
        return tuple(rows.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("ids", "mask"))

    def ids(self, start: int, n: int) -> np.ndarray:
        parts = []
        while n:
            batch, offset = divmod(start, self.per_batch)
            part = self.batch(batch)[offset : offset + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
            reader = SequenceReader(path)
            for docs in reader.listing():
                start, n = docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist()
                crc = [common.crc_u4(reader.ids(s, k)) for s, k in zip(start, n, strict=True)]
                yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array([base + s for s in start], pa.int64()), docs.column("n_tokens"), pa.array(crc, pa.int64())], [x.split()[0] for x in ROWS.split(", ")])


def read(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: its place in the whole stream, its ids and their unsigned crc32."""
    files = min(manifest.count(), 20_000)  # a task each, by ranges of part; a stated count keeps adaptive execution from merging them
    return manifest.select("path", "base", "part").repartitionByRange(max(1, files), "part").drop("part").mapInArrow(_read, ROWS)


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 2048) -> DataFrame:
    return read(write(docs, tokenizer, common.new_path(spark, "token-files"), end_id, length))

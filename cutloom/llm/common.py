"""Helpers that the training-data operators share: the shared work folder, word-level token memo, components."""

from __future__ import annotations

import atexit
import json
import os
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = b" \t\n\x0b\x0c\r"
MAX_BROADCAST_BYTES = 16 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_ROOTS: dict[str, str] = {}
_STORED: dict[int, str] = {}


def work_dir(spark: SparkSession) -> str:
    """A folder of this session in the shared place that ``spark.checkpoint.dir`` names; it goes when Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='cutloom-')}"
        _ROOTS[app] = f"{base.rstrip('/')}/cutloom-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove, spark, _ROOTS[app])
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(f"{_ROOTS[app]}/checkpoints")
        if spark.conf.get(BATCH_BYTES) == "67108864b":  # as it comes; batches of whole texts, as lists, take several times their bytes
            spark.conf.set(BATCH_BYTES, str(8 << 20))
    return _ROOTS[app]


def _remove(spark: SparkSession, root: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may have gone first
        return


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: lineage ends, columns can be pruned, lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    frame = spark.read.schema(df.schema).parquet(path)
    _STORED[id(frame)] = path
    weakref.finalize(frame, _STORED.pop, id(frame), None)
    return frame


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the shared folder: as ``stored``, but it keeps its partitioning, so the next join on it need not shuffle."""
    work_dir(df.sparkSession)
    frame = df.checkpoint()
    if file := frame._jdf.logicalPlan().rdd().getCheckpointFile():
        _STORED[id(frame)] = file.get()
        weakref.finalize(frame, _STORED.pop, id(frame), None)
    return frame


def discard(*frames: DataFrame) -> None:
    """Removes what ``stored`` wrote for these frames; no frame that is still to be computed may read them."""
    for frame in frames:
        if path := _STORED.pop(id(frame), None):
            _remove(frame.sparkSession, path)


def small(df: DataFrame) -> DataFrame:
    """``df`` (stored, of numbers only), to be broadcast if rows times columns of eight bytes are few enough; else joined by shuffle."""
    return F.broadcast(df) if df.count() * 8 * len(df.columns) <= MAX_BROADCAST_BYTES else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(column: str, n: int):
    """crc32 of an id's decimal text, modulo n: the fold rule of the learning operators (null ids: null)."""
    return F.crc32(F.col(column).cast("string")) % n


def bounded_sample(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n rows with the smallest hash of their keys: a fixed sample, whatever the order and partitioning (top-n, nothing is collected)."""
    return df.orderBy(F.xxhash64(*keys), *keys).limit(n)


def labelled(docs: DataFrame, marks: DataFrame, label: str, n: int) -> DataFrame:
    """(doc_id, text, label) of n marked doc_ids at most; one row for each different text of an id, and n rows at most.

    Ids are drawn first, so that only they are joined; ids that repeat with several texts are drawn from again, by a hash of
    id and text.
    """
    ids = bounded_sample(marks.select("doc_id", label), ["doc_id"], n)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")  # n rows of two numbers
    keyed = rows.withColumn("_h", F.xxhash64("doc_id", "text"))
    last = keyed.select("_h").distinct().orderBy("_h").limit(n).agg(F.max("_h")).first()[0]
    return keyed.where(F.col("_h") <= F.lit(last)).dropDuplicates(["doc_id", "_h"]).select("doc_id", "text", label)


# --- tokens -----------------------------------------------------------------------------------------------------------
_RARE = [chr(c).encode() for c in range(0x80, 0x3001) if chr(c).isspace()]
_ODD_BYTES = np.zeros(256, bool)
_ODD_BYTES[[0, 9, 11, 12, 13, 28, 29, 30, 31]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_POINT = np.zeros(256, bool)
_POINT[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_TABLE = np.random.default_rng(99).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _GOLD = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F)
_BLOCK_BYTES, _LONG = 1 << 19, 1 << 22


def _merged(many: tuple[np.ndarray, ...], few: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Columns of ``few`` put among those of ``many``; the first of either is sorted and stays so."""
    where = np.searchsorted(many[0], few[0])
    return tuple(np.insert(a, where, b) for a, b in zip(many, few, strict=True))


class Collision(Exception):
    """Two chunks of one hash."""


def cuts_like_gpt2(file: dict) -> bool:
    """Whether a ``tokenizers`` file normalises nothing, splits by the usual byte-level pattern and has special tokens only beside its BPE."""
    split, model = file.get("pre_tokenizer") or {}, file["model"]
    plain = file.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    return plain and model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and all(t["special"] for t in file["added_tokens"])


class TokenMemo:
    """Ids of whole Arrow columns by a ``tokenizers`` file with byte-level BPE and its usual split pattern.

    The file is checked for it; texts are encoded whole by a file with anything else.  That pattern always cuts before a space that starts a word, around a lone newline and between a letter and punctuation, so a
    text's ids are those of such chunks.  Chunks are found and hashed (64 bits) with numpy for many texts at once; only those not
    met before are encoded, many in one call, with a newline (a token of its own there) between them.  At most ``limit`` chunks
    are remembered, each with its size in bytes, which must agree too.  Texts with other white space than single spaces and newlines between words, or very long ones, are
    encoded as they are.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; idle threads of the library only spin
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # in a text, a special token's string is ordinary text
        self.kind = "<u2" if self.tok.get_vocab_size(with_added_tokens=True) <= 65536 else "<u4"
        self.width, self.limit = np.dtype(self.kind).itemsize, limit
        newline = self.tok.encode("\n", add_special_tokens=False).ids
        self.newline = newline[0] if len(newline) == 1 and cuts_like_gpt2(json.loads(self.tok.to_str())) else None
        self.powers = self.inverses = np.ones(1, np.uint64)
        self._forget()

    def _forget(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.layers = [none, none]  # sorted hashes, places in the pool, numbers of ids and of bytes: many, and those of late
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.kind)

    def _store(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(len(self.pool), self.kind)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _learn(self, keys: np.ndarray, sizes: np.ndarray, words: list[str]) -> None:
        at, n = [], []
        for low in range(0, len(words), 4096):
            group = words[low : low + 4096]
            ids = self._ids("\n".join(group)) if "\n" not in group else None
            cuts = np.flatnonzero(ids == self.newline) if ids is not None else np.zeros(0, np.int64)
            if ids is None or len(cuts) != len(group) - 1:
                parts = [self._ids(w) for w in group]
                size = np.array([len(x) for x in parts])
                at.append(self._store(np.concatenate(parts)) + np.cumsum(size) - size)
                n.append(size)
            else:
                ends = np.append(cuts, len(ids))
                starts = np.concatenate(([0], ends[:-1] + 1))
                at.append(self._store(ids) + starts)
                n.append(ends - starts)
        self.layers[1] = _merged(self.layers[1], (keys, np.concatenate(at), np.concatenate(n), sizes))
        if len(self.layers[1][0]) > 50_000 + len(self.layers[0][0]) // 8:
            self.layers = [_merged(*self.layers), tuple(x[:0] for x in self.layers[1])]

    def _find(self, keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the pool (-1: not known) and numbers of ids.  Equal hashes of chunks of unlike sizes are an error."""
        at, n = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        for known, place, size, length in self.layers:
            if len(known):
                where = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[where] == keys
                if (length[where[hit]] != sizes[hit]).any():
                    raise Collision
                at[hit], n[hit] = place[where[hit]], size[where[hit]]
        return at, n

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.powers) < len(data) + 1:
            self.powers, self.inverses = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(len(data), x, np.uint64)))) for x in (_BASE, pow(_BASE, -1, 2**64)))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * self.powers[: len(data)], out=total[1:])
        h = (total[ends] - total[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64) * _GOLD
        h = (h ^ (h >> np.uint64(29))) * _GOLD
        return h ^ (h >> np.uint64(32))

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of simple texts one after another, ids of each); ``offsets`` of the texts in ``data``."""
        space, line = data == 32, data == 10
        mark = np.zeros(len(data) + 1, bool)
        mark[:-1] = space | line
        mark[1:] |= line
        mark[1:-1] |= _POINT[data[1:]] & _LETTER[data[:-1]]
        mark[offsets] = True
        starts = np.flatnonzero(mark[:-1])
        ends = np.append(starts[1:], len(data))
        keys, first, which = np.unique(self._hashes(data, starts, ends), return_index=True, return_inverse=True)
        sizes = (ends - starts)[first]
        if (sizes[which] != ends - starts).any():
            raise Collision
        at, n = self._find(keys, sizes)
        new = np.flatnonzero(at < 0)
        if len(new):
            if sum(len(x[0]) for x in self.layers) + len(new) > self.limit:
                self._forget()
                new = np.arange(len(keys))
            raw = data.tobytes()
            self._learn(keys[new], sizes[new], [raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at, n = self._find(keys, sizes)
        at, n = at[which], n[which]
        total = np.concatenate(([0], np.cumsum(n)))
        ids = self.pool[np.repeat(at - total[:-1], n) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(starts, offsets)])

    def _whole_or_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        try:
            return self._block(data, offsets)
        except Collision:
            self._forget()
            parts = [self._ids(data[a:b].tobytes().decode()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return np.concatenate(parts), np.array([len(x) for x in parts])

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each text) of a string array; nulls have none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if not len(texts):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        buffers = texts.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(buffers[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        odd = self._odd(data, offsets)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        low, size = 0, np.diff(offsets)
        while low < len(size):
            if odd[low]:
                ids = self._ids(data[offsets[low] : offsets[low + 1]].tobytes().decode())
                parts.append((ids, np.array([len(ids)])))
                low += 1
                continue
            high = low + 1
            while high < len(size) and not odd[high] and offsets[high + 1] - offsets[low] <= _BLOCK_BYTES:
                high += 1
            parts.append(self._whole_or_block(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]) if offsets[high] > offsets[low] else (np.zeros(0, self.kind), np.zeros(high - low, np.int64)))
            low = high
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def ended(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``column``, with ``end_id`` after each text's ids."""
        ids, n = self.column(texts)
        n = n + 1
        last = np.cumsum(n) - 1
        out = np.full(len(ids) + len(n), end_id, self.kind)
        inner = np.ones(len(out), bool)
        inner[last] = False
        out[inner] = ids
        return out, n

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts are not simple."""
        size = np.diff(offsets)
        odd = size > _LONG
        if self.newline is None:
            return odd | True
        white = (data == 32) | (data == 10)
        bad = _ODD_BYTES[data]
        bad[:-1] |= white[:-1] & white[1:]
        some = size > 0
        odd[some] |= white[offsets[1:][some] - 1]
        places = [np.flatnonzero(bad)]
        if len(data) and data.max() > 127:
            raw = data.tobytes()
            for mark in _RARE:
                at = raw.find(mark)
                while at >= 0:
                    places.append(np.array([at]))
                    at = raw.find(mark, at + 1)
        places = np.concatenate(places)
        odd[np.searchsorted(offsets, places, "right") - 1] = True
        return odd


_ENCODERS: dict[str, TokenMemo] = {}


def bpe_encoder(path: str) -> TokenMemo:
    """The Python worker's memo over the ``tokenizers`` file at ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TokenMemo(path)
    return _ENCODERS[path]


class WordMemo(dict):
    """word -> what ``encode`` makes of it, in two generations of at most ``limit`` words."""

    def __init__(self, encode, limit: int = 400_000):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.encode(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value


def crc_u4(ids: np.ndarray) -> int:
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())


# --- components -------------------------------------------------------------------------------------------------------
def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of undirected ``edges(a, b)``; component is the smallest node that is reachable.

    Alternating large-star and small-star steps until nothing changes; each is one grouped minimum and one equi-join, so no
    neighbourhood is gathered in one place.  Every step is checkpointed to the shared folder, and what it no longer needs goes.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # checkpointed minima: both sides of the join then come straight from a shuffle, and a hub's edges can be split
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low2 = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small_ = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(small_.unionByName(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        discard(e, low, large, low2)
        e = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))

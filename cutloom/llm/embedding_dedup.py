"""Near-duplicate embeddings by collision counting over sorted one-dimensional projections.

Links are pairs of vectors with cosine >= 0.95.  Equal vectors are one class, so copies meet only once.  Every class has its
places on ``LINES`` random lines, in steps of ``STEP``.  A table sorts the classes that share its coarse code (signs of ``bits``
more projections) by their place on one of the lines; a pair within ``WINDOW`` there is counted over all lines, and if it is
within the window on at least ``least`` of them it is verified in double precision.  ``plan`` sets bits by the number of classes,
so that a code holds about ``CELL`` of them, tables so that a pair right at 0.95 is found with probability ``RECALL`` (closer ones
more surely), and least so that the count loses one such pair in a thousand.

1. A table is sent class numbers and places only, ``LINES`` bytes a class whatever the length of its vector.  A task gets
   one code of one table, cut into blocks where it is large, and names the classes that have a pair which reaches the count.
2. Only these classes' vectors are fetched and sent to the same tasks.  A pair is verified in the first table where it meets,
   known from codes that are kept with the class.  Link counts per class and links that connect come out, never a group's pairs.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own component.
Vectors of different lengths are not linked.  Null ids take no part and have a null component.  Rows that share an id have link
counts of their own (equal rows link with each other) and one component.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

COSINE, CELL, BLOCK, RECALL = 0.95, 512, 1024, 0.98
LINES, STEP, WINDOW = 32, 0.05, 10  # the window in steps: 0.5


class Plan(NamedTuple):
    bits: int
    tables: int
    least: int


def binomial_tail(n: int, k: int, p: float) -> float:
    """The chance of at least k hits in n."""
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))


def plan(n: int, recall: float = RECALL) -> Plan:
    """For n classes; there is no bound on bits."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / CELL)))
    near = math.erf(WINDOW * STEP / math.sqrt(2 - 2 * COSINE) / math.sqrt(2))
    least = max(k for k in range(LINES + 1) if binomial_tail(LINES, k, near) >= 0.999)
    hit = (1 - math.acos(COSINE) / math.pi) ** bits * near
    return Plan(bits, max(2, math.ceil(math.log(1 - recall) / math.log(1 - hit))), least)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [None if v is None else key_of(v) for v in map(vector, batch.column("embedding").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary())], ["vec_id", "key"])


def vector(x: list | None) -> np.ndarray | None:
    """Doubles (no negative zeros), None if it can link with nothing."""
    if x is None or None in x:
        return None
    v = np.array(x, dtype=np.float64) + 0.0
    return v if v.size and np.isfinite(v).all() and v.any() else None


def key_of(v: np.ndarray) -> bytes:
    return hashlib.blake2b(v.tobytes(), digest_size=16).digest()


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow in the norm
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def projections(size: int, p: Plan) -> np.ndarray:
    """Random directions for vectors of ``size``: the lines, then each table's sign projections."""
    return np.random.default_rng(size * 1_000_003 + 17).standard_normal((size, LINES + p.tables * p.bits))


def _placed(p: Plan):
    """(key, vec_id) of the wanted classes with codes (a cell number for each table) and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = [vector(x) for x in batch.column("embedding").to_pylist()]
            some = [i for i, v in enumerate(vectors) if v is not None]
            for size in sorted({vectors[i].size for i in some}):
                at = [i for i in some if vectors[i].size == size]
                r = known.setdefault(size, projections(size, p))
                y = unit(np.stack([vectors[i] for i in at])) @ r
                places = (np.clip(np.floor(y[:, :LINES] / STEP), -128, 127) + 128).astype(np.uint8)
                signs = (y[:, LINES:] > 0).reshape(len(at), p.tables, p.bits)
                codes = signs @ (1 << np.arange(p.bits, dtype=np.int64)) if p.bits else np.zeros((len(at), p.tables), np.int64)
                codes = codes * 8191 + size  # vectors of different lengths mostly part here, and for certain when verified
                keys = pa.array([key_of(vectors[i]) for i in at], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), keys, pa.array(list(codes), pa.list_(pa.int64())), pa.array([x.tobytes() for x in places], pa.binary())], ["vec_id", "key", "codes", "places"])

    return run


def _pairs(places: np.ndarray, order: np.ndarray, line: int, least: int, keep=None):
    """Pairs (indexes) within the window on ``line`` that are within it on at least ``least`` lines, bounded numbers at a time."""
    at = places[order, line].astype(np.int16)
    n = len(order)
    ends = np.searchsorted(at, at + WINDOW, "right")
    width = ends - np.arange(n) - 1
    before, low = np.concatenate(([0], np.cumsum(width))), 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(before, before[low] + 200_000, "right")) - 1)
        a = np.repeat(np.arange(low, high), width[low:high])
        b = a + 1 + np.arange(len(a)) - np.repeat(before[low:high] - before[low], width[low:high])
        low = high
        a, b = order[a], order[b]
        if keep is not None:
            own = keep(a, b)
            a, b = a[own], b[own]
        x, y = places[a], places[b]
        good = ((np.maximum(x, y) - np.minimum(x, y)) <= WINDOW).sum(axis=1) >= least
        yield a[good], b[good]


def _columns(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(classes, sides, places, whether sides differ) of a task's rows, classes ascending."""
    rows = rows.combine_chunks()
    pair = rows.column("pair")[0].as_py()
    places = np.frombuffer(b"".join(rows.column("places").to_pylist()), np.uint8).reshape(-1, LINES)
    return rows.column("cls").to_numpy(), rows.column("side").to_numpy(), places, pair >> 32 != pair & 0xFFFFFFFF


def _named(p: Plan):
    def run(rows: pa.Table) -> pa.Table:
        cls, side, places, crossing = _columns(rows)
        line = rows.column("tab")[0].as_py() % LINES
        some = np.zeros(len(cls), bool)
        for a, b in _pairs(places, np.argsort(places[:, line], kind="stable"), line, p.least, (lambda a, b: side[a] != side[b]) if crossing else None):
            some[a] = some[b] = True
        return rows.select(["tab", "code", "pair", "side", "cls"]).filter(pa.array(some))

    return run


def _verified(p: Plan):
    lines = np.arange(p.tables) % LINES

    def run(rows: pa.Table) -> pa.Table:
        cls, side, places, crossing = _columns(rows)
        tab = rows.column("tab")[0].as_py()
        line = tab % LINES
        codes, mult = np.array(rows.column("codes").to_pylist()), rows.column("mult").to_numpy()
        raw = rows.column("vec").to_pylist()
        lengths = np.array([len(v) for v in raw])
        counts, links = np.zeros(len(cls), np.int64), []
        for size in np.unique(lengths):
            at = np.flatnonzero(lengths == size)
            rank = np.zeros(len(cls), np.int64)
            rank[at] = np.arange(len(at))
            units = unit(np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(len(at), -1))
            order = at[np.argsort(places[at, line], kind="stable")]
            for a, b in _pairs(places, order, line, p.least, (lambda a, b: side[a] != side[b]) if crossing else None):
                x, y = places[a][:, lines], places[b][:, lines]
                met = (codes[a] == codes[b]) & ((np.maximum(x, y) - np.minimum(x, y)) <= WINDOW)
                first = met.argmax(axis=1) == tab
                a, b = a[first], b[first]
                near = np.einsum("ij,ij->i", units[rank[a]], units[rank[b]]) >= COSINE
                a, b = a[near], b[near]
                np.add.at(counts, a, mult[b])
                np.add.at(counts, b, mult[a])
                links.append((a, b))
        a, b = (np.concatenate(x) for x in zip(*links, strict=True)) if links else (np.zeros(0, int), np.zeros(0, int))
        label = np.arange(len(cls))
        while True:  # what is connected here, as a star each
            new = label.copy()
            np.minimum.at(new, a, label[b])
            np.minimum.at(new, b, label[a])
            new = new[new]
            if (new == label).all():
                break
            label = new
        some, joined = np.flatnonzero(counts), np.flatnonzero(label != np.arange(len(cls)))
        columns = np.concatenate((cls[some], cls[joined])), np.concatenate((np.full(len(some), -1), cls[label[joined]])), np.concatenate((counts[some], np.full(len(joined), -1)))
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n"])

    return run


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, vec) of rows whose vector is of the wanted class (an id may have others too)."""
    for batch in batches:
        found = [(c, v.tobytes()) for c, k, v in zip(batch.column("cls").to_pylist(), batch.column("key").to_pylist(), map(vector, batch.column("embedding").to_pylist()), strict=True) if v is not None and key_of(v) == k]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([v for _, v in found], pa.binary())], ["cls", "vec"])


def class_links(rows: DataFrame, classes: DataFrame, p: Plan) -> DataFrame:
    """(a, b, n): n links of class a where n >= 0, else a link of a and b; of classes (cls, rep, key, mult, codes, places)."""
    spread = classes.select("cls", "places", F.posexplode("codes").alias("tab", "code"))
    sizes = classes.select(F.posexplode("codes").alias("tab", "code")).groupBy("tab", "code").count()
    wide = common.stored(sizes.where(f"count > {BLOCK}").select("tab", "code", F.expr(f"int(ceil(count / {BLOCK}))").alias("blocks")), "wide-cells")
    dealt = spread.join(common.small(wide), ["tab", "code"], "left").withColumn("side", F.expr("if(blocks is null, 0, int(pmod(xxhash64(cls), blocks)))"))
    meets = F.expr("transform(sequence(0, coalesce(blocks, 1) - 1), x -> shiftleft(cast(least(x, side) as bigint), 32) + greatest(x, side))")
    dealt = dealt.withColumn("pair", F.explode(meets)).select("tab", "code", "pair", "side", "cls", "places")
    named = common.stored(dealt.groupBy("tab", "code", "pair").applyInArrow(_named(p), "tab int, code long, pair long, side int, cls long"), "near-vectors")
    wanted = common.stored(classes.select("cls", "rep", "key").join(common.small(common.stored(named.select("cls").distinct(), "near-classes")), "cls", "left_semi"), "wanted-vectors")
    fetched = rows.join(common.small(wanted), F.col("vec_id") == F.col("rep")).select("cls", "key", "embedding").mapInArrow(_vectors, "cls long, vec binary").dropDuplicates(["cls"])
    fetched = common.stored(fetched, "fetched-vectors")
    full = named.join(classes.select("cls", "mult", "codes", "places"), "cls").join(fetched, "cls")
    links = common.stored(full.groupBy("tab", "code", "pair").applyInArrow(_verified(p), "a long, b long, n long"), "vector-links")
    common.discard(named, fetched, wide)
    return links


def dedup(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each of ``vectors`` (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    read = common.stored(rows.mapInArrow(_read, "vec_id long, key binary"), "vector-keys")
    good = read.where("key is not null and vec_id is not null")
    merged = common.stored(good.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")).withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    p = plan(merged.count())
    sketched = rows.mapInArrow(_placed(p), "vec_id long, key binary, codes array<long>, places binary").join(merged, "key").where("vec_id = rep").dropDuplicates(["cls"])
    classes = common.stored(sketched.select("cls", "rep", "key", "mult", "codes", "places"), "vector-sketches")
    found = class_links(rows, classes, p)
    common.discard(classes)

    member = good.join(merged.select("key", "cls", "rep", "mult"), "key").select("vec_id", "cls", "rep", "mult")
    several = common.stored(member.groupBy("vec_id").agg(F.min("cls").alias("a"), F.max("cls").alias("high")).where("a < high").select("vec_id", "a"), "shared-vector-ids")
    twins = member.join(common.small(several), "vec_id").where("cls <> a").select("a", F.col("cls").alias("b"))
    comps = common.stored(common.components(found.where("n < 0").select("a", "b").unionByName(twins)).withColumnRenamed("node", "cls"), "vector-components")
    least = comps.join(merged.select("cls", "rep"), "cls").groupBy("component").agg(F.min("rep").alias("component_id"))
    counts = found.where("n >= 0").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("more"))
    facts = common.stored(comps.join(least, "component").select("cls", "component_id").join(counts, "cls", "full"), "vector-facts")
    common.discard(found, comps)
    linked = member.join(common.small(facts), "cls", "left").select("vec_id", (F.col("mult") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    alone = read.where("key is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

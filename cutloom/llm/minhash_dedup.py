"""Near-duplicate documents by b-bit MinHash.

A document is the set of its distinct 5-word shingles (words: lower-cased A-Z, split at ASCII white space; with fewer words the
whole sequence is one shingle; without words the set is empty and links with nothing).  Two documents are linked if
100 * |A and B| >= 75 * |A or B|; a component is what links reach.

1. One pass over the texts gives each row's set size, a 128-bit fingerprint of its set, 128 minima, of which the low 4
   bits are packed into 8 longs, and 32 band keys of 4 minima.  A pair at 0.75 shares a band with probability 1 - 5e-6.
2. Equal sets are one class with a number of its own; from here on classes are compared, not documents.
3. In each band bucket every class is paired with the smallest one (all pairs only of buckets up to three).  Pairs whose
   collision-corrected estimate, from bit counts of the packed signatures, is too low to be a link (4.3 standard
   deviations below 0.75) go; the others are verified on full sets.  Components of those links follow.
4. The members of a bucket are dealt into hands of about ``HAND`` by a hash of class and bucket, and within a hand all that are in
   different components meet, as in 3.  A class has a hand in each of its buckets, so near copies of one text, few of which may be
   links of the smallest one, become one component here, with work in proportion to the members.
5. Buckets that still hold several components are cut into blocks, so that a task sees two blocks of at most ``BLOCK`` classes.
   A block pair first gets sketches only and names the classes whose estimate against one of another component is
   high enough; the full sets of just these follow it, and links that join components come out, each pair in its first common
   band.  Links inside a component change nothing.
6. Class components become documents' at the end, by the smallest doc_id in each.

So work on a group of copies grows with its size times the number of members that stay apart, and no pair list of a group is emitted.
Rows that share a doc_id are one document: all their classes are in one component, n_shingles is each row's own; a row without
words stays alone.  A null text has an empty set.  Null doc_ids take part in nothing and have a null component.  Other columns are ignored.  An empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS, PER_CENT = 5, 75
BANDS, PER_BAND, BITS = 32, 4, 4
HASHES = BANDS * PER_BAND
BLOCK = 256
HAND = 8
_RNG = np.random.default_rng(20240501)
_MULTIPLY = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_FOLD = _RNG.integers(0, 2**63, PER_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def most_mismatches(similarity: float = PER_CENT / 100, deviations: float = 4.3) -> int:
    """Positions of the packed signature that may differ in a pair that is at ``similarity``."""
    chance = 2.0**-BITS
    match = similarity + (1 - similarity) * chance
    return HASHES - math.floor(HASHES * match - deviations * math.sqrt(HASHES * match * (1 - match)))


def estimate(mismatches):
    """Similarity from differing positions, corrected for low bits that agree by chance."""
    chance = 2.0**-BITS
    return ((HASHES - mismatches) / HASHES - chance) / (1 - chance)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = (total ^ h[k : k + n]) * _GOLD + (total >> np.uint64(29))
    return np.unique(_mixed(total))


def _minima(found: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        low = np.minimum(low, ((found[None, at : at + 1024] ^ _FLIP[:, None]) * _MULTIPLY[:, None]).min(axis=1))
    return low


def sketch(found: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """(fingerprint of two longs, band keys, packed low bits) of a non-empty set."""
    low = _minima(found)
    keys = _mixed((low.reshape(BANDS, PER_BAND) * _FOLD).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _GOLD)
    bits = (low * _GOLD) >> np.uint64(64 - BITS)
    packed = np.bitwise_or.reduce(bits.reshape(-1, 64 // BITS) << np.arange(0, 64, BITS, dtype=np.uint64), axis=1)
    return list(fingerprint(found)), keys.view(np.int64).tolist(), packed.view(np.int64).tolist()


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    longs = pa.list_(pa.int64())
    for batch in batches:
        sizes, first, second, bands, sigs = [], [], [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = shingles(text)
            sizes.append(len(found))
            whole, keys, packed = sketch(found) if len(found) and doc is not None else ([None, None], None, None)
            first.append(whole[0])
            second.append(whole[1])
            bands.append(keys)
            sigs.append(packed)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(bands, longs), pa.array(sigs, longs)], ["doc_id", "n_shingles", "f1", "f2", "bands", "sig"])


def fingerprint(found: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), "<i8").tolist())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the rows that are of the wanted class (a doc_id may have others too)."""
    for batch in batches:
        sets = [shingles(x) for x in batch.column("text").to_pylist()]
        own = [fingerprint(x) == (f1, f2) for x, f1, f2 in zip(sets, batch.column("f1").to_pylist(), batch.column("f2").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array([x.tobytes() for x in sets], pa.binary())], ["cls", "set"]).filter(pa.array(own, pa.bool_()))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are at 0.75 or more."""
    if 100 * min(len(a), len(b)) < PER_CENT * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common_ = int((both[1:] == both[:-1]).sum())
    return 100 * common_ >= PER_CENT * (len(a) + len(b) - common_)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [[np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("set_a", "set_b")]
        good = pa.array([linked(x, y) for x, y in zip(*sets, strict=True)], pa.bool_())
        yield batch.select(["a", "b"]).filter(good)


def mismatches(a: str, b: str):
    """A column: how many positions differ between two packed signatures, by bit counts."""
    nibbles = f"transform(zip_with({a}, {b}, (x, y) -> x ^ y), x -> bit_count((x | shiftrightunsigned(x, 1) | shiftrightunsigned(x, 2) | shiftrightunsigned(x, 3)) & 1229782938247303441L))"
    return F.expr(f"aggregate({nibbles}, 0, (s, x) -> s + x)")


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions that differ, of every packed signature of a and every one of b."""
    x = a[:, None, :] ^ b[None, :, :]
    for k in (1, 2):
        x = x | ((x >> k) & (2 ** (64 - k) - 1))
    return np.bitwise_count(x & 0x1111111111111111).sum(axis=2)


def _candidates(rows: pd.DataFrame, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a block pair that may be links between components and whose first common band is this one, likeliest first."""
    sig, band, comp, size = np.array(rows.sig.tolist()), np.array(rows.bands.tolist()), rows.comp.to_numpy(), rows.size_.to_numpy()
    differ = _differing(sig[left], sig[right])
    least, most = np.minimum(size[left][:, None], size[right][None, :]), np.maximum(size[left][:, None], size[right][None, :])
    p, q = np.nonzero((differ <= most_mismatches()) & (comp[left][:, None] != comp[right][None, :]) & (100 * least >= PER_CENT * most))
    order = np.argsort(differ[p, q], kind="stable")
    p, q = left[p[order]], right[q[order]]
    where, own = rows.band.iloc[0], np.zeros(len(p), bool)
    for at in range(0, len(p), 4096):
        own[at : at + 4096] = (band[p[at : at + 4096]] == band[q[at : at + 4096]]).argmax(axis=1) == where
    return p[own], q[own]


def _likely(rows: pd.DataFrame) -> pd.DataFrame:
    """The members of a block pair that may be linked with one of another component."""
    side = rows.side.to_numpy()
    left, right = np.flatnonzero(side == rows.i.iloc[0]), np.flatnonzero(side == rows.j.iloc[0])
    some = np.zeros(len(rows), bool)
    if len(left) and len(right):
        some[np.concatenate(_candidates(rows, left, right))] = True
    return rows.loc[some, ["key", "band", "cls", "comp", "side", "i", "j"]]


def _joined(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between components among one block pair's members: only those that join what is apart so far."""
    rows = rows.sort_values("cls", ignore_index=True)
    comp, side = rows.comp.to_numpy(), rows.side.to_numpy()
    left, right = (np.flatnonzero(side == rows.i.iloc[0]), np.flatnonzero(side == rows.j.iloc[0]))
    if not len(left) or not len(right):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    p, q = _candidates(rows, left, right)
    root = {c: c for c in comp}

    def find(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    sets, edges = {}, []
    for i, j in zip(p, q, strict=True):
        a, b = find(comp[i]), find(comp[j])
        if a == b:
            continue
        for k in (i, j):
            if k not in sets:
                sets[k] = np.frombuffer(rows.set.iloc[k], np.uint64)
        if linked(sets[i], sets[j]):
            root[max(a, b)] = min(a, b)
            edges.append((comp[i], comp[j]))
    return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows (doc_id, n_shingles, cls, rep), cls null without words; classes (cls, rep, size_, f1, f2, bands, sig).

    cls numbers the distinct sets, rep is the smallest doc_id that has one.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    all_ = common.stored(texts.mapInArrow(_sketched, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sig array<long>"), "sketches")
    some = all_.where("f1 is not null")
    merged = some.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size_"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))  # equal sets, equal sketches
    found = common.stored(merged.withColumn("cls", F.monotonically_increasing_id()), "classes")
    # stored first: then both sides of the join come straight from a shuffle, and a very large class can be split
    with_class = some.select("doc_id", "n_shingles", "f1", "f2").join(found.select("f1", "f2", "cls", "rep"), ["f1", "f2"]).select("doc_id", "n_shingles", "cls", "rep")
    none = all_.where("f1 is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("cls"), F.col("doc_id").alias("rep"))
    rows = common.stored(with_class.unionByName(none), "class-rows")
    common.discard(all_)
    return rows, found


def full_sets(docs: DataFrame, found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, set) of the classes in ``wanted(cls)``, from the texts of their smallest doc_id."""
    wanted = common.stored(found.select("cls", "rep", "f1", "f2").join(common.small(wanted), "cls", "left_semi"), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    return common.stored(texts.join(common.small(wanted), "rep").mapInArrow(_sets, "cls long, set binary").dropDuplicates(["cls"]), "sets")


def _links(docs: DataFrame, found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` of classes that are links: first by packed signatures, then on full sets."""
    sig = lambda x: found.select(F.col("cls").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("size_").alias(f"size_{x}"))
    close = F.expr(f"100 * least(size_a, size_b) >= {PER_CENT} * greatest(size_a, size_b)")
    likely = pairs.distinct().join(sig("a"), "a").join(sig("b"), "b").where(close & (mismatches("sig_a", "sig_b") <= most_mismatches())).select("a", "b")
    likely = common.stored(likely, "likely")
    sets = full_sets(docs, found, common.stored(likely.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "wanted"))
    full = likely.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("cls").alias("b"), F.col("set").alias("set_b")), "b")
    good = common.stored(full.mapInArrow(_verified, "a long, b long"), "links")
    common.discard(likely, sets)
    return good


def class_components(docs: DataFrame, rows: DataFrame, found: DataFrame) -> DataFrame:
    """(cls, component): of the classes that links connect with others, a number for each component."""
    spread = found.select("cls", F.posexplode("bands").alias("band", "key"))
    buckets = common.stored(spread.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.count("*").alias("n")).where("n > 1"), "buckets")
    members = common.stored(spread.join(common.small(buckets), "key"), "members")
    star = members.where("cls <> low").select(F.col("low").alias("a"), F.col("cls").alias("b"))
    third = members.where("n = 3 and cls <> low and cls <> high").select(F.col("cls").alias("a"), F.col("high").alias("b"))
    sketches = found.select("cls", "size_", "bands", "sig")
    shared = rows.where("cls is not null").groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("high")).where("a < high").select("doc_id", "a")  # doc_ids with several texts
    twins = rows.join(common.small(common.stored(shared, "shared-ids")), "doc_id").where("cls <> a").select("a", F.col("cls").alias("b"))
    comps = common.stored(common.components(_links(docs, found, star.unionByName(third)).unionByName(twins)).withColumnRenamed("node", "cls"), "components")

    def placed_in(comps: DataFrame) -> DataFrame:
        return members.where("n > 3").join(comps, "cls", "left").withColumn("comp", F.coalesce("component", "cls")).select("key", "band", "cls", "comp", "n")

    hands = placed_in(comps).withColumn("hand", F.expr(f"int(pmod(xxhash64(cls, key), int(ceil(n / {HAND}))))"))
    one, two = (hands.select("key", "hand", F.col("cls").alias(x), F.col("comp").alias(f"comp_{x}")) for x in "ab")
    more = _links(docs, found, one.join(two, ["key", "hand"]).where("a < b and comp_a <> comp_b").select("a", "b"))
    if not more.isEmpty():
        edges = more.unionByName(comps.select(F.col("cls").alias("a"), F.col("component").alias("b")))
        comps = common.stored(common.components(edges).withColumnRenamed("node", "cls"), "components")

    placed = placed_in(comps)
    sizes = placed.groupBy("key", "comp").count()
    open_ = sizes.groupBy("key").agg(F.max_by("comp", F.struct("count", "comp")).alias("major"), F.max("count").alias("n_major"), F.sum("count").alias("n"), F.count("*").alias("comps")).where("comps > 1")
    open_ = open_.select("key", "major", F.expr(f"int(ceil(n_major / {BLOCK}))").alias("wide"), F.expr(f"int(ceil((n - n_major) / {BLOCK}))").alias("tall"))
    at = placed.join(common.small(common.stored(open_, "open-buckets")), "key").withColumn("block", F.expr("int(pmod(xxhash64(cls), if(comp = major, wide, tall)))"))
    to = F.expr(
        "if(comp = major, transform(sequence(0, tall - 1), t -> struct(t as i, tall + block as j)),"
        " concat(transform(sequence(0, tall - 1), t -> struct(least(t, block) as i, greatest(t, block) as j)), transform(sequence(0, wide - 1), w -> struct(block as i, tall + w as j))))"
    )
    dealt = at.withColumn("side", F.expr("if(comp = major, tall + block, block)")).join(sketches, "cls").withColumn("to", F.explode(F.array_distinct(to))).select("key", "band", "cls", "comp", "side", "to.i", "to.j", "size_", "bands", "sig")
    named = common.stored(dealt.groupBy("key", "i", "j").applyInPandas(_likely, "key long, band int, cls long, comp long, side int, i int, j int"), "late-likely")
    if named.isEmpty():
        return comps
    sets = full_sets(docs, found, common.stored(named.select("cls").distinct(), "wanted"))
    whole = common.stored(sketches.join(sets, "cls"), "whole")  # a row a class, so that the members are joined once
    full = named.join(whole, "cls")
    late = common.stored(full.groupBy("key", "i", "j").applyInPandas(_joined, "a long, b long"), "late-links")  # of components
    common.discard(named, sets, whole, members)
    if late.isEmpty():
        return comps
    merged = common.components(late).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    alone = late.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(comps, "cls", "left_anti").select("cls", F.col("cls").alias("component"))
    return comps.unionByName(alone).join(merged, "component", "left").select("cls", F.coalesce("joined", "component").alias("component"))


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each of ``docs``."""
    rows, found = classes(docs)
    comps = common.stored(class_components(docs, rows, found), "class-components")
    least = comps.join(found.select("cls", "rep"), "cls").groupBy("component").agg(F.min("rep").alias("component_id"))
    named = common.stored(comps.join(least, "component").select("cls", "component_id"), "component-names")
    common.discard(comps, found)
    out = rows.join(common.small(named), "cls", "left").withColumn("component_id", F.coalesce("component_id", "rep"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those whose component has a smaller doc_id."""
    gone = common.small(common.stored(dedup(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))  # no name of docs can clash
    return rows.join(gone, F.col("_row.doc_id") == F.col("_gone"), "left_anti").select("_row.*")

"""Toxicity: a factorization machine over hashed terms.

Terms are lower-cased words without the punctuation around them, hashed to 2**20 buckets; a document's features are the
buckets it has.  A bounded sample of labelled training rows is read into a table of terms, and Spark counts on it:

1. terms by class; those whose chi-square passes ``TERM_CHI`` are features;
2. pairs of terms by class, in blocks of columns; both ends of a pair are features where its share of toxic rows differs from
   that of either end alone by ``PAIR_CHI`` (chi-square of the pair's rows), so a pair that matters only together is kept.

How many there are follows from these bounds alone.  Only the chosen columns of the sample are collected, and a machine with weights and
``RANK`` latent factors a term is fitted: its pairwise part scores what two terms mean together, which additive weights miss.  Scoring
reads whole texts in Arrow batches.

A null or empty text has no terms and gets the model's base score.  Repeated rows get equal scores.  Labels that
repeat for a doc_id count once, as the largest; null labels do not count.  Without labelled rows, or with one class
only, every score is the share of toxic rows (0 without any).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 2**20
MAX_TRAINING = 20_000
LEAST_ROWS, PAIR_ROWS = 3, 10  # of the sample, that a term and a pair must be in
PAIR_SHARE = 100  # an end of a pair must be in one of so many rows
TERM_CHI, PAIR_CHI = 20.0, 50.0
COLUMNS = 512  # in a block when pairs are counted
RANK = 8
THRESHOLD = 0.7
EDGES = b".,;:!?\"'()[]{}<>|*#$%&-_~`/\\=+^@"


def bucket(word: bytes) -> int:
    """A term's bucket, -1 if the word is punctuation only."""
    term = word.strip(EDGES)
    return zlib.crc32(term) % BUCKETS if term else -1


def words(text: str | None) -> set[bytes]:
    return set(text.lower().encode("utf-8", "surrogatepass").split()) if text else set()


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = common.WordMemo(bucket)
    for batch in batches:
        found = [sorted({memo[w] for w in words(x)} - {-1}) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "toxic", "terms"])


class Machine:
    """sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>) over the chosen terms that a document has."""

    def __init__(self, terms: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.index = {int(t): i for i, t in enumerate(terms)}
        self.bias, self.weights, self.factors = bias, weights, factors
        self.squares = (factors**2).sum(axis=1)

    def score(self, found: list[int]) -> float:
        z = self.bias
        if found:
            s = self.factors[found].sum(axis=0)
            z += self.weights[found].sum() + 0.5 * (s @ s - self.squares[found].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def _adam(params: list[np.ndarray], rate: float):
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]

    def step(grads: list[np.ndarray], t: int) -> None:
        for p, g, (m, v) in zip(params, grads, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    return step


def train(lists: list[np.ndarray], y: np.ndarray, steps: int = 4000, l2: float = 1e-4, seed: int = 11, balance: float = 0.5) -> Machine:
    """Fits a machine to documents' term lists (all their terms are features) and their classes, in numpy on this bounded sample.

    The rarer, toxic class weighs ``(clean / toxic) ** balance`` a row.
    """
    n, pos = len(y), float(y.sum())
    if not 0 < pos < n:
        p = min(max(pos / max(n, 1), 1e-12), 1 - 1e-12)
        return Machine(np.array([], int), float(np.log(p / (1 - p))), np.zeros(0), np.zeros((0, RANK)))
    size = np.array([len(x) for x in lists])
    flat = np.concatenate(lists).astype(np.int64)
    terms, place = np.unique(flat, return_inverse=True)
    ends = np.cumsum(size)
    rng = np.random.default_rng(seed)
    bias, w, v = np.array([np.log(pos / (n - pos))]), np.zeros(len(terms)), rng.normal(0, 0.05, (len(terms), RANK))
    step, t = _adam([bias, w, v], 0.02), 0
    parts, weight = max(1, n // 256), max(1.0, (n - pos) / pos) ** balance
    for _ in range(max(10, steps // parts)):
        for rows in np.array_split(rng.permutation(n), parts):
            a = np.zeros((len(rows), len(terms)))
            at = np.repeat(ends[rows] - np.cumsum(size[rows]), size[rows]) + np.arange(size[rows].sum())
            a[np.repeat(np.arange(len(rows)), size[rows]), place[at]] = 1
            s = a @ v
            z = bias[0] + a @ w + 0.5 * ((s**2).sum(axis=1) - a @ (v**2).sum(axis=1))
            g = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[rows]) * np.where(y[rows] > 0, weight, 1) / len(rows)
            t += 1
            ag = a.T @ g
            step([np.array([g.sum()]), ag + l2 * w, a.T @ (g[:, None] * s) - ag[:, None] * v + l2 * v], t)
    return Machine(terms, float(bias[0]), w, v)


def chi_square(rows, toxic, share):
    """Of a set of rows of which ``toxic`` are toxic, against the ``share`` of toxic rows that is expected."""
    share = np.clip(share, 1e-3, 1 - 1e-3)
    return (toxic - rows * share) ** 2 / np.maximum(rows * share * (1 - share), 1e-9)


def _pairs_of_blocks(rows: pa.Table) -> pa.Table:
    """The columns of two blocks that are an end of a pair with a share of toxic rows of its own."""
    rows = rows.combine_chunks()
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    block, y, number = rows.column("block").to_numpy(), rows.column("toxic").to_numpy(), rows.column("row").to_numpy()
    names, number = np.unique(number, return_inverse=True)
    marks = np.zeros(len(names), np.float32)
    marks[number] = y
    bits = np.unpackbits(np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8).reshape(len(y), -1), axis=1)
    sides = []
    for k in (i, j):
        x = np.zeros((len(names), bits.shape[1]), np.float32)
        x[number[block == k]] = bits[block == k]
        sides.append(x)
    a, b = sides
    together, toxic = a.T @ b, (a * marks[:, None]).T @ b
    shares = [(x * marks[:, None]).sum(axis=0) / np.maximum(x.sum(axis=0), 1) for x in sides]
    good = (together >= PAIR_ROWS) & (chi_square(together, toxic, shares[0][:, None]) > PAIR_CHI) & (chi_square(together, toxic, shares[1][None, :]) > PAIR_CHI)
    if i == j:
        np.fill_diagonal(good, False)
    found = np.union1d(i * COLUMNS + np.flatnonzero(good.any(axis=1)), j * COLUMNS + np.flatnonzero(good.any(axis=0)))
    return pa.table({"place": pa.array(found, pa.int64())})


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, toxic, block, bits): a row's columns, COLUMNS bits for each block that it has any of."""
    for batch in batches:
        out: list[tuple] = []
        for row, toxic, places in zip(*(batch.column(c).to_pylist() for c in ("row", "toxic", "places")), strict=True):
            places = np.array(places, np.int64)
            for block in np.unique(places // COLUMNS):
                bits = np.zeros(COLUMNS, np.uint8)
                bits[places[places // COLUMNS == block] % COLUMNS] = 1
                out.append((row, toxic, int(block), np.packbits(bits).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["row", "toxic", "block", "bits"])


def chosen_terms(sample: DataFrame) -> np.ndarray:
    """The features: buckets that alone or in a pair tell the classes of ``sample`` (doc_id, toxic, terms) apart.

    Copies count once here: many copies of one toxic document would make features of all its terms.
    """
    sample = common.stored(sample.dropDuplicates(["terms"]), "distinct-terms")
    n, pos = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < pos < n:
        return np.zeros(0, np.int64)
    each = sample.select("toxic", F.explode("terms").alias("term"))
    counts = common.stored(each.groupBy("term").agg(F.count("*").alias("rows"), F.sum("toxic").alias("toxic")).where(F.col("rows") >= max(LEAST_ROWS, n // 4000)), "term-counts")
    share = pos / n
    telling = (F.col("toxic") - F.col("rows") * share) ** 2 / (F.col("rows") * share * (1 - share) * F.greatest(1 - F.col("rows") / n, F.lit(1e-9))) > TERM_CHI
    alone = [r["term"] for r in counts.where(telling).select("term").collect()]  # buckets, of 2**20

    often = [r["term"] for r in counts.where(F.col("rows") >= max(PAIR_ROWS, n // PAIR_SHARE)).select("term").orderBy("term").collect()]  # the same
    if not often:
        return np.sort(np.array(alone, np.int64))
    spark, blocks = sample.sparkSession, -(-len(often) // COLUMNS)
    places = spark.createDataFrame([*zip(often, range(len(often)), strict=True)], "term int, place long")
    columns = each_row(sample).join(F.broadcast(places), "term").groupBy("row", "toxic").agg(F.collect_set("place").alias("places"))
    packed = columns.mapInArrow(_packed, "row long, toxic int, block long, bits binary")
    to = F.expr(f"transform(sequence(0L, {blocks - 1}L), x -> struct(least(x, block) as i, greatest(x, block) as j))")
    ends = packed.withColumn("to", F.explode(to)).select("row", "toxic", "block", "bits", "to.i", "to.j").groupBy("i", "j").applyInArrow(_pairs_of_blocks, "place long").distinct()
    paired = [often[r["place"]] for r in ends.collect()]  # buckets again
    return np.unique(np.array(alone + paired, np.int64))


def each_row(sample: DataFrame) -> DataFrame:
    return sample.select(F.xxhash64("doc_id", "terms").alias("row"), "toxic", F.explode("terms").alias("term"))


def fit(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING) -> Machine:
    """A machine from at most ``max_training`` labelled rows outside the held-out fold (crc32 of the id, modulo 3, is 1)."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(common.crc_mod("doc_id", 3) != 1)
    rows = common.labelled(docs, marked.withColumn("toxic", (F.col("toxic") == 1).cast("int")), "toxic", max_training)
    sample = common.stored(rows.select("doc_id", "toxic", "text").mapInArrow(_terms, "doc_id long, toxic int, terms array<int>"), "labelled-terms")
    chosen = chosen_terms(sample)
    wanted = docs.sparkSession.createDataFrame([(int(t),) for t in chosen], "term int")
    kept = each_row(sample).join(F.broadcast(wanted), "term", "left_semi").groupBy("row").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    every = sample.select(F.xxhash64("doc_id", "terms").alias("row"), "toxic").join(kept, "row", "left").select("toxic", F.coalesce("terms", F.array().cast("array<int>")).alias("terms"))
    got = every.orderBy("toxic", "terms").toArrow().combine_chunks()  # max_training rows of chosen columns; the same order however they came
    common.discard(sample)
    toxic, terms = got.column("toxic").to_numpy(), got.column("terms").combine_chunks()
    at, flat = terms.offsets.to_numpy(), terms.values.to_numpy()
    return train([flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)], toxic.astype(np.float64))


def score(docs: DataFrame, machine: Machine, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns of every row, score and predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = common.WordMemo(lambda w: machine.index.get(bucket(w), -1))
        for batch in batches:
            scores = [machine.score(sorted({memo[w] for w in words(x)} - {-1})) for x in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], [*keep, "score", "predicted"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["score double", "predicted int"])
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, unchanged, that are not predicted toxic."""
    wrapped = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "text")
    return score(wrapped, fit(docs, labels), keep=("_row",)).where("predicted = 0").select("_row.*")

"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from a sample of about ``per_language`` whole documents a language (each language's rows are kept with the
probability that gives that many, by a hash of their id), summed in Spark to one row per language and bucket.  The
log-probability matrix (buckets x languages) goes to the tasks in blocks of ``BLOCK`` languages, which score whole texts batch by batch in
numpy.  Every language of the rows is learned, whatever their number; its prior is its share of the rows.

Letters are what Unicode calls letters, lower-cased; everything else is a gap.  A null text, or one without a letter, is
``und`` with score 0.  Without any learned language every row is ``und``.  Ties go to the first language by name.
Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 15
PER_LANGUAGE = 2_000
BLOCK = 256  # languages in a block of the matrix: 32 MB


@cache
def _letters() -> np.ndarray:
    """Lower-case code point of each letter, 32 of anything else (letters whose lower case has two code points: their own)."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(text: str) -> np.ndarray | None:
    """The buckets of a text's 1-, 2- and 3-grams (gaps are one space, also at either end); None without a letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    points = _letters()[points]
    gap = points == 32
    if gap.all():
        return None
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    a = np.concatenate(([32], points[keep], [32])).astype(np.uint64)
    with np.errstate(over="ignore"):
        one = a * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] ^ a[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
        three = (two[:-1] ^ a[2:]) * np.uint64(0x165667B19E3779F9)
    shift = np.uint64(64 - BITS)
    return np.concatenate((one[a != 32] >> shift, two >> shift, three >> shift)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if (found := grams(text)) is not None:
                if lang not in total:
                    total[lang] = np.zeros(2**BITS, np.int64)
                total[lang] += np.bincount(found, minlength=2**BITS)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(counts[at])], ["lang", "bucket", "n"])


class Model(NamedTuple):
    names: list[str]
    priors: np.ndarray
    blocks: list[Broadcast]  # log-probabilities[bucket, language], BLOCK languages each


def log_probabilities(n_languages: int, language: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each bucket in each language, from its counts; half a count is added everywhere."""
    table = np.full((2**BITS, n_languages), 0.5)
    table[bucket, language] += n
    return (np.log(table) - np.log(table.sum(axis=0))).astype(np.float32)


def fit(rows: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """From the rows' text and lang."""
    spark = rows.sparkSession
    rows = rows.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), "doc_id").where("text is not null and lang is not null")
    sizes = common.stored(rows.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    # a row per language, no text
    drawn = rows.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) * F.col("rows") < F.lit(per_language * 1_000_000))
    counts = common.stored(drawn.select("text", "lang").mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "gram-counts")
    known = sizes.join(counts.select("lang").distinct(), "lang", "left_semi").orderBy("lang").collect()  # a row per language
    names, blocks = [r["lang"] for r in known], []
    for low in range(0, len(names), BLOCK):
        some = {x: i for i, x in enumerate(names[low : low + BLOCK])}
        got = counts.where(F.col("lang").between(names[low], names[min(low + BLOCK, len(names)) - 1])).toPandas()  # BLOCK languages x buckets at most
        blocks.append(spark.sparkContext.broadcast(log_probabilities(len(some), got.lang.map(some).to_numpy(), got.bucket.to_numpy(), got.n.to_numpy())))
    rows_of = np.array([r["rows"] for r in known], np.float64)
    return Model(names, np.log(rows_of / rows_of.sum()) if len(known) else rows_of, blocks)


def log_posterior(at: np.ndarray, priors: np.ndarray, blocks: list[np.ndarray]) -> np.ndarray:
    """Up to a constant: the prior's logarithm and those of a text's buckets, added up for each language."""
    return priors + np.concatenate([np.take(b, at, axis=0).sum(axis=0, dtype=np.float64) for b in blocks])


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row, lang_pred and score (the posterior)."""
    names, priors, shared = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [b.value for b in shared]
        for batch in batches:
            found, score = [], []
            for text in batch.column("_text").to_pylist():
                at = grams(text) if text and names else None
                if at is None:
                    found.append("und")
                    score.append(0.0)
                    continue
                total = log_posterior(at, priors, blocks)
                best = int(total.argmax())
                found.append(names[best])
                score.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["lang_pred string", "score double"])
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)

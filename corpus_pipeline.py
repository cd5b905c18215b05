"""Cleaning a corpus, stage by stage; every stage's rows are written and read again as the next one's documents.

A stage is a function of (spark, docs, sf_dir).  All but the last return the columns of documents:

* quality: documents that fail the base rules or that the isolation forest rejects go;
* toxicity: documents that the factorization machine calls toxic go;
* lines: repeated and nearly repeated lines go from all but their earliest document; every document stays;
* near-duplicates: of each group of near-duplicate documents the one with the smallest doc_id stays;
* packing: a row for each piece of a document in a sequence of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cutloom.llm import common, line_dedup, minhash_dedup, packing, quality_rules, toxicity
from cutloom.llm.queries import labels, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.work_dir(spark)
    return quality_rules.filtered(docs, labels(spark, sf_dir))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.work_dir(spark)
    return toxicity.filtered(docs, labels(spark, sf_dir))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.filtered(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("toxicity", toxic), ("lines", lines), ("near-duplicates", near_duplicates), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The numbered queries: each applies its operator with production parameters to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, conversation_repair, decontaminate, embedding_dedup, html_extract, language_id, line_dedup, minhash_dedup, packing, quality_rules, sentencepiece_fst, spelling_variants, token_files, toxicity
from .common import documents
from .oracles import ORACLE_SQL  # noqa: F401


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.work_dir(spark)
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity.fit(docs, labels(spark, sf_dir)))
    return scored.select("doc_id", F.coalesce(common.crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.dedup(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(documents(spark, sf_dir)).select("doc_id", "n_removed", "text")


def op3_line_dedup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op3_line_dedup, and equal lines of any length but none at all, and lines within one word."""
    return line_dedup.dedup(documents(spark, sf_dir), exact_chars=1, words=1).select("doc_id", "n_removed", "text")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.work_dir(spark)
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(spark, documents(spark, sf_dir), tokenizer_path())


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.work_dir(spark)
    return sentencepiece_fst.digests(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.work_dir(spark)
    docs = documents(spark, sf_dir)
    return quality_rules.judge(docs, quality_rules.fit(docs, labels(spark, sf_dir)))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.work_dir(spark)
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs.where(common.crc_mod("doc_id", 5) != 0))
    return language_id.predict(docs, model).select("doc_id", F.coalesce(common.crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(documents(spark, sf_dir), misspell=199)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversation_repair.repair(rows)


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_minhash_dedup, op3_line_dedup, op3_line_dedup_whole, op4_html_extract, op5_packing, op6_token_files, op7_sentencepiece, op8_embedding_dedup, op9_quality_rules, op10_language_id, op11_spelling_variants, op12_conversation_repair, op13_decontaminate)}

"""Driver tables read as timelines, curves, captions, signatures, palettes and packet lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators.lineage import shares

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]  # status and date come last in the SQL; lines that are alike up to these make the same clip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clips(spark: SparkSession, sf_dir: str, layout: str = "gappy") -> DataFrame:
    """Orders as sequences, their lines as clips.

    Layouts: ``gapless`` (one after another on lane 1), ``gappy`` (three empty frames between) and ``tracks`` (three lanes that overlap).  Dealt by sequence
    once, into partitions whose number grows with the table, so what goes by sequence later needs no other shuffle and a task's memory stays.
    """
    by = Window.partitionBy("seq_id").orderBy(*LINE_ORDER)
    rate = F.when(F.col("l_returnflag") == "A", 0.5).when(F.col("l_returnflag") == "R", 2.0).otherwise(1.0)
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(F.col("l_orderkey").alias("seq_id"), *LINE_ORDER).repartition(shares(lines), "seq_id").select(
        "seq_id",
        (F.row_number().over(by) - 1).cast("long").alias("ord"),
        F.col("l_partkey").alias("source_id"),
        (F.col("l_suppkey") % 10).alias("src_in"),
        (F.col("l_suppkey") % 10 + F.col("l_quantity").cast("long")).alias("src_out"),
        rate.alias("rate"),
    )
    rows = rows.withColumn("len", N.clip_length())
    before = Window.partitionBy("seq_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("len").over(before), F.lit(0)).cast("long")
    lane, at = {"gapless": (F.lit(1), start), "gappy": (F.lit(1), start + F.col("ord") * 3), "tracks": (1 + F.col("ord") % 3, N.floor_long(start / 2))}[layout]
    return rows.withColumn("start", at).withColumn("track", lane.cast("long")).withColumn("stop", F.col("start") + F.col("len"))


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(owner_id, frame, value, ease): a user's events as keys of one curve, a key a minute at most (the latest event's)."""
    first = Window.partitionBy("user_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", us.alias("us"))
    rows = rows.withColumn("frame", N.floor_long((F.col("us") - F.min("us").over(first)) / 60_000_000))
    ease = F.when(F.col("event_type").isin("view", "signup"), "smooth").when(F.col("event_type") == "error", "hold").otherwise("linear")
    keys = rows.withColumn("ease", ease).groupBy(F.col("user_id").alias("owner_id"), "frame")
    return keys.agg(F.max_by(F.struct("value", "ease"), "event_id").alias("k")).select("owner_id", "frame", "k.value", "k.ease")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, t, is_key): events as packets, seconds from the user's first; purchases are key frames."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), us.alias("us"), (F.col("event_type") == "purchase").alias("is_key"))
    return rows.select("source_id", ((F.col("us") - F.min("us").over(Window.partitionBy("source_id"))) / 1_000_000.0).alias("t"), "is_key")


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, ord, start, stop, text): a conversation's turns, each over half a second of the next."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("seq_id"), F.col("turn").alias("ord"), (F.col("turn") * 2.0).alias("start"), "text", "role")
    return rows.withColumn("stop", F.col("start") + 2.5)


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, sig): embeddings as frame signatures."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("sig"), "label")


def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, label, category, keywords, enabled): parts as commands."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.col("p_name").alias("label"), F.lower("p_brand").alias("category"), F.array("p_type").alias("keywords"), (F.col("p_size") % 2 == 0).alias("enabled"))

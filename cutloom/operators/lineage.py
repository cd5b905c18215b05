"""Cutting the lineage of iterative operators in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only for local masters, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="cutloom-")
        context.setCheckpointDir(base)
    return context.getCheckpointDir()


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut(frame: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder and read again, so that their size is known; the files go when the session ends."""
    spark = frame.sparkSession
    name = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    frame.write.parquet(name)
    path, files = _path(spark, name)
    files.deleteOnExit(path)
    out = spark.read.schema(frame.schema).parquet(name)
    _WRITTEN[id(out)] = name
    weakref.finalize(out, _WRITTEN.pop, id(out), None)
    return out


def discard(*frames: DataFrame) -> None:
    """Removes what ``cut`` wrote for these frames; nothing that is still to be computed may read them."""
    for frame in frames:
        if name := _WRITTEN.pop(id(frame), None):
            path, files = _path(frame.sparkSession, name)
            files.delete(path, True)


SHARE = 100_000


def shares(rows: DataFrame, most: int = SHARE) -> int:
    """How many partitions of ``most`` rows about these rows need: the number grows with them, so what a task holds does not."""
    return max(1, -(-rows.count() // most))

"""Ordered series cut into stretches of rows, so that a series with very many rows is spread over tasks.

Rows are range-partitioned by key and order.  A partition is a stretch: most series lie within one; a long one goes over several, and a boundary is
crossed by one series at most, so what is carried over is a row a partition.  Stretches follow the number of rows, not the values of the order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

WIDTH = 200_000


def ranged(rows: DataFrame, key: str, at: str, width: int = WIDTH) -> DataFrame:
    """``rows`` (stored: they are read three times) in order within partitions of about ``width`` rows, with the number of each as ``stretch``."""
    parts = max(1, -(-rows.count() // width))
    return rows.repartitionByRange(parts, key, at).sortWithinPartitions(key, at).withColumn("stretch", F.spark_partition_id())


def ranked(rows: DataFrame, key: str, at: str, width: int = WIDTH) -> DataFrame:
    """``rows`` (stored) with ``_rank``: the row's place within its key in order, from 0.  A key is spread over its stretches; ties of ``at`` in one go any way."""
    local = cut(ranged(rows, key, at, width).withColumn("_place", F.row_number().over(Window.partitionBy(key, "stretch").orderBy(at)) - 1))
    sizes = local.groupBy(key, "stretch").agg(F.count("*").alias("_n"))
    by = Window.partitionBy(key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.sum("_n").over(by)).where("_before is not null").select(key, "stretch", "_before")
    both = local.join(F.broadcast(before), [key, "stretch"], "left")  # a row a boundary at most
    return both.withColumn("_rank", F.col("_place") + F.coalesce("_before", F.lit(0))).drop("_place", "_before", "stretch")


def blocks(rows: DataFrame, key: str, at: str, half: int, width: int = WIDTH) -> DataFrame:
    """``rows`` (stored) dealt by key and ``_block``, with the ``half`` rows either side of each block beside it, which are not ``_own``.

    A window of ``half`` rows either side, partitioned by key and block, then says of a block's own rows what it says of them in the whole key.
    """
    width = max(width, half, 1)
    inside = F.pmod("_rank", F.lit(width))
    home = F.floor(F.col("_rank") / width)
    near = F.array(home, F.when((inside < half) & (home > 0), home - 1), F.when(inside >= width - half, home + 1))
    out = ranked(rows, key, at, width).withColumn("_block", F.explode(F.array_distinct(F.array_compact(near))))
    return out.withColumn("_own", F.col("_block") == home).drop("_rank")


def _long(rows: DataFrame, key: str, width: int) -> DataFrame:
    """(_k, _long): keys of more than ``width`` rows, a row for each ``width`` rows at most."""
    counts = rows.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    return cut(counts.where(F.col("_n") > width).select("_k", F.lit(True).alias("_long")))


def _apart(rows: DataFrame, key: str, long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of other keys, and those of long ones (stored)."""
    told = rows.join(F.broadcast(long), F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
    return told.where("_long is null").drop("_long"), cut(told.where("_long").drop("_long"))


def in_windows(rows: DataFrame, key: str, at: str, half: int, apply: Callable[[DataFrame, list[str]], DataFrame], width: int = WIDTH) -> DataFrame:
    """``apply(rows, keys)``, which adds columns from windows of up to ``half`` rows either side by ``keys`` and ``at``, with long keys spread.

    Keys of ``width`` rows at most are windows as they are; longer ones go through ``blocks``.  Rows are counted by key first.
    """
    long = _long(rows, key, width)
    if long.isEmpty():
        return apply(rows, [key])
    short, hot = _apart(rows, key, long)
    spread = apply(blocks(hot, key, at, half, width), [key, "_block"]).where("_own").drop("_block", "_own")
    return apply(short, [key]).unionByName(spread)


def running_sum(rows: DataFrame, key: str, at: str, value: str, out: str, width: int = WIDTH) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over the key's rows up to each, in order; long keys are summed by stretches, and what came before is added."""
    total = lambda frame, keys: frame.withColumn(out, F.sum(value).over(Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)))
    long = _long(rows, key, width)
    if long.isEmpty():
        return total(rows, [key])
    short, hot = _apart(rows, key, long)
    local = cut(total(ranged(hot, key, at, width), [key, "stretch"]))
    sums = local.groupBy(key, "stretch").agg(F.sum(value).alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy(key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))).drop("_sum")
    spread = local.join(F.broadcast(before), [key, "stretch"])  # a row a stretch and key, two a partition about
    return total(short, [key]).unionByName(spread.withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0))).drop("stretch", "_before"))


def _multiplied(a: Column, b: Column) -> Column:
    e = lambda m, i, j: F.element_at(m, 3 * i + j + 1)
    return F.array(*(e(a, i, 0) * e(b, 0, j) + e(a, i, 1) * e(b, 1, j) + e(a, i, 2) * e(b, 2, j) for i in range(3) for j in range(3)))


def running_product(rows: DataFrame, key: str, at: str, matrix: str, width: int = WIDTH) -> DataFrame:
    """(key, at, product): the product of each row's 3x3 ``matrix`` (row by row) with those of all earlier rows of its key, later ones on the left.

    Products are associative: each stretch multiplies up its own rows, stretches of a key are chained by one matrix each, and what was
    carried to a stretch is multiplied in.  Rows are stored; (key, at) is unique and not null.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            matrices = np.array(batch.column(2).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, 3, 3)
            out = np.empty_like(matrices)
            for i, k in enumerate(batch.column(0).to_pylist()):
                last = matrices[i] if now is None or k != now[0] else matrices[i] @ last
                now = (k,)
                out[i] = last
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, 9 * len(out) + 1, 9), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), values], [key, at, "stretch", "product"])

    some = ranged(rows.select(key, at, matrix), key, at, width)
    local = cut(some.mapInArrow(within, f"`{key}` {kinds[key]}, `{at}` {kinds[at]}, stretch int, product array<double>"))
    ends = local.groupBy(key, "stretch").agg(F.max_by("product", at).alias("product"))
    by = Window.partitionBy(key)
    ends = ends.withColumn("_many", F.count("*").over(by)).where("_many > 1").drop("_many")  # of series that cross a boundary

    def chained(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("stretch")
        carried, last = [], np.eye(3)
        for p in part["product"]:
            carried.append(last.ravel())
            last = np.asarray(p).reshape(3, 3) @ last
        return pd.DataFrame({key: part[key], "stretch": part["stretch"], "carried": carried})

    carried = ends.groupBy(key).applyInPandas(chained, f"`{key}` {kinds[key]}, stretch int, carried array<double>")
    both = local.join(F.broadcast(carried), [key, "stretch"], "left")  # a row a boundary, two a partition at most
    return both.select(key, at, F.when(F.col("carried").isNull(), F.col("product")).otherwise(_multiplied(F.col("product"), F.col("carried"))).alias("product"))


def handed_over(rows: DataFrame, key: str, at: str, run: Callable[[pd.DataFrame, np.ndarray | None, bool], tuple[pd.DataFrame, np.ndarray]], schema: str, width: int = WIDTH) -> DataFrame:
    """What a state machine says of every row in order, with one series over several tasks; exact for any machine, fast for one that forgets.

    ``run(stretch, state, first)`` goes over a stretch from a state (None: the series starts here if ``first``, else a guess of its own) and
    returns its rows of ``schema`` and the state that it ends in, an array of numbers.  All stretches start from a guess at once; then each starts
    from what the one before ended in, and only those whose start has changed run again, until none has.  After r rounds the first r stretches
    of every series are right whatever the machine; one that forgets is done in two.  A stretch is in memory, nothing longer.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    local = cut(ranged(rows, key, at, width))
    by = Window.partitionBy(key).orderBy("stretch")
    starts = local.select(key, "stretch").distinct().withColumn("first", F.row_number().over(by) == 1).withColumn("state", F.lit(None).cast("array<double>"))
    starts = cut(starts)

    def ended(part: pd.DataFrame) -> pd.DataFrame:
        _, state = run(part.sort_values(at), *_start(part))
        return pd.DataFrame({key: part[key].iloc[:1].to_list(), "stretch": part["stretch"].iloc[:1].to_list(), "end": [state]})

    def told(part: pd.DataFrame) -> pd.DataFrame:
        return run(part.sort_values(at), *_start(part))[0]

    ends = None
    changed = starts
    while True:
        new = local.join(changed.select(key, "stretch", "state", "first"), [key, "stretch"]).groupBy(key, "stretch").applyInPandas(ended, f"`{key}` {kinds[key]}, stretch int, end array<double>")
        ends = cut(new if ends is None else ends.join(changed.select(key, "stretch"), [key, "stretch"], "left_anti").unionByName(new))
        now = starts.drop("state").join(ends, [key, "stretch"]).withColumn("state", F.lag("end").over(by)).drop("end")
        before = starts.select(key, "stretch", F.col("state").alias("before"))
        starts = cut(now.join(before, [key, "stretch"]).withColumn("changed", ~F.col("state").eqNullSafe(F.col("before"))).drop("before"))
        changed = starts.where("changed")
        if changed.isEmpty():
            break
    return local.join(starts.select(key, "stretch", "state", "first"), [key, "stretch"]).groupBy(key, "stretch").applyInPandas(told, schema)


def _start(part: pd.DataFrame) -> tuple[np.ndarray | None, bool]:
    state = part["state"].iloc[0]
    return None if state is None else np.asarray(state, np.float64), bool(part["first"].iloc[0])

"""Masks that are known on a few frames of a take, carried to all others by a model that goes from frame to frame."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .curves import asof
from .lineage import cut


class Propagator(NamedTuple):
    """``start(mask, frame)`` is what is remembered at a marked frame; ``step(memory, frame)`` the mask of the next frame and what is remembered then.

    A frame is a dictionary of the payload columns.  Both are plain functions that tasks can be sent.
    """

    start: Callable[[Any, dict], Any]
    step: Callable[[Any, dict], tuple[Any, Any]]


HOLD = Propagator(lambda mask, frame: mask, lambda memory, frame: (memory, memory))


def propagate(frames: DataFrame, seeds: DataFrame, key: str, at: str, model: Propagator = HOLD, mask: str = "mask") -> DataFrame:
    """``frames`` with ``mask``: forward from each marked frame of ``seeds`` (key, at, mask) up to the next, and backward from the first one to the start.

    A take is cut at its marks; each part is one directed scan, in order of time or against it, and the parts meet at the marks, which keep
    the mask they were given.  Parts are dealt apart, so a take with many marks is spread, and only the model's memory is held, never
    the frames of a part.  Marks on frames that are not there are left out; takes without marks, or with a null key, have null masks; with several marks on one
    frame the least one counts.  ``frames`` is unique by (key, at) and has neither nulls in ``at`` nor a column named ``mask``.
    """
    kind = seeds.schema[mask].dataType
    rows = frames.join(seeds.groupBy(key, at).agg(F.min(mask).alias("_seed")).where(F.col("_seed").isNotNull()), [key, at], "left")
    rows = cut(rows)
    marks = rows.where("_seed is not null").select(key, at, F.col(at).alias("_mark"))
    first = marks.groupBy(key).agg(F.min(at).alias("_first"))
    parts = asof(rows, marks, [key], at, ["_mark"]).join(first, key, "left")
    part = F.coalesce("_mark", "_first")
    # the first mark starts a scan either way
    back = F.when(F.col(at) < F.col("_first"), F.array(F.lit(True))).when(F.col(at) == F.col("_first"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    dealt = parts.withColumn("_part", part).withColumn("_back", F.explode(back)).withColumn("_turn", F.when(F.col("_back"), -F.col(at)).otherwise(F.col(at)))
    payload = frames.columns
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, memory = None, None
        for batch in batches:
            lists = batch.to_pydict()
            names, parts, backs, seeds = lists[key], lists["_part"], lists["_back"], lists["_seed"]
            found, keep = [], []
            for i in range(batch.num_rows):
                frame = {c: lists[c][i] for c in payload}
                if parts[i] is None:
                    found.append(None)
                    keep.append(True)
                    continue
                if now != (names[i], parts[i], backs[i]):
                    now, memory = (names[i], parts[i], backs[i]), model.start(seeds[i], frame)
                    found.append(seeds[i])
                    keep.append(not backs[i])
                else:
                    value, memory = model.step(memory, frame)
                    found.append(value)
                    keep.append(True)
            out = pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in payload), pa.array(found, arrow)], [*payload, mask])
            yield out.filter(pa.array(keep))

    ordered = dealt.select(*payload, "_seed", "_part", "_back", "_turn").repartition(key, "_part", "_back").sortWithinPartitions(key, "_part", "_back", "_turn")
    schema = frames.select("*", F.lit(None).cast(kind).alias(mask)).schema
    return ordered.mapInArrow(run, schema)

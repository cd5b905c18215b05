"""Timelines are dealt by sequence once, in a number of partitions that grows with the table; lookups and cuts then need no join."""

from cutloom import plans
from cutloom.operators.lineage import shares
from cutloom.sources import tables

DATA = "/root/testdata/sf0.001"


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_number_of_partitions_grows(spark):
    assert [shares(spark.range(n), 1000) for n in (0, 1000, 1001, 60_000)] == [1, 1, 2, 60]


def test_one_shuffle_of_the_lines(spark):
    assert _plan(tables.clips(spark, DATA)).count("Exchange ") == 1
    assert _plan(plans.QUERIES["clip_at_track"](spark, DATA)).count("Exchange ") == 1


def test_without_joins(spark):
    for name in ("neighbours", "nearest_cut", "next_edit", "change_summary", "clip_at_track", "transition_spans"):
        assert "Join" not in _plan(plans.QUERIES[name](spark, DATA)), name

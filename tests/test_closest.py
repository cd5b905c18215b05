"""Nearest frames by blocks: the rows that every pair gives, without a row for each pair."""

import random

from cutloom import plans
from cutloom.operators import search as H

DATA = "/root/testdata/sf0.001"


def test_blocks_give_what_all_pairs_give(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(0, 3)) for _ in range(4)]) for i in range(300)] + [(300, [1.0, None, 2.0, 0.0]), (301, [0.1, 0.2, 0.3, float("nan")])]
    sigs = spark.createDataFrame(rows, "frame long, sig array<double>").repartition(3)
    refs = sigs.where("frame % 50 = 0")
    told = lambda scored: sorted((r.ref, r["rank"], r.frame, repr(r.score)) for r in H.nearest(scored, 6, 5).collect())
    want = told(H.distances(sigs, refs))
    few = H.closest(sigs, refs, 6, 5, block=40)
    assert told(few) == want
    assert few.count() <= 6 * 7 * 8  # k rows of each reference a block


def test_no_row_for_each_pair(spark):
    for name in ("knn_frames", "knn_nms"):
        plan = plans.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan, name

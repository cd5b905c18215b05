"""Chains longer than any fixed number of steps."""

from cutloom.operators import documents as D


def test_a_long_chain_is_walked_to_its_end(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 13)] + [(13, 1)], "src long, dst long")
    starts = spark.createDataFrame([(1,)], "node long")
    assert sorted(r.node for r in D.link_chain(edges, starts).collect()) == list(range(2, 14))
    assert sorted(r.node for r in D.link_chain(edges, starts, 4).collect()) == [2, 3, 4, 5]

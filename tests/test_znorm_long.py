"""Long signatures: the work grows with their length, not with its cube."""

import statistics

from cutloom.operators import search as H


def test_long_signature(spark):
    values = [float(i * 37 % 101) for i in range(3000)]
    got = spark.createDataFrame([(values,)], "sig array<double>").select(H.znorm("sig").alias("z")).first().z
    mean, deviation = statistics.fmean(values), statistics.pstdev(values)
    assert max(abs(z - (x - mean) / (deviation + 1e-6)) for z, x in zip(got, values, strict=True)) < 1e-9

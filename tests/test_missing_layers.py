"""A scene that lacks a layer has no value where the number of layers is told."""

import duckdb

from cutloom import plans
from cutloom.operators import pixels as P


def test_missing_layer(spark):
    rows = spark.createDataFrame([(0, t, 0.5, 1.0 if t == 0 else 0.6, 1.0) for t in range(4)] + [(1, 0, 0.5, 1.0, 1.0)], "k long, track long, value double, alpha double, cover double")
    got = {r.k: r.value for r in P.composite(rows, ["k"], tracks=4).collect()}
    assert got[1] is None and abs(got[0] - 0.5) < 1e-12
    assert {r.k: r.value for r in P.composite(rows, ["k"]).collect()}[1] == 0.5


def test_last_scene_is_short(spark, tmp_path):
    spark.range(6).selectExpr("id AS vec_id", "transform(sequence(1, 64), i -> float(sin(id * 64 + i))) AS embedding", "int(0) AS label").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    mine = {(r.scene, r.x, r.y): r.value for r in plans.QUERIES["alpha_composite"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    theirs = {(s, x, y): v for s, x, y, v in con.execute("select scene, x, y, value from (" + plans.ORACLE_SQL["alpha_composite"] + ")").fetchall()}
    assert mine == theirs and any(v is None for v in mine.values())

"""Documents that several tables are read from are made once."""

import json

from pyspark.sql import functions as F

from cutloom import plans
from cutloom.sources import project, tables


def test_project_documents_are_made_once(spark):
    plan = plans.QUERIES["project_documents"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan


def test_project_documents_are_dealt_once(spark):
    """Clips are dealt by project; joins of their effects and curves dealt clips, and then the texts made of them, anew."""
    clips = tables.clips(spark, "/root/testdata/sf0.001", "tracks").repartition(3, "seq_id").withColumn("source", F.col("source_id").cast("string"))
    clips = clips.withColumns({"timeinterp": F.lit("sample"), "clip_id": F.col("ord") + 1, "blendfrom": F.lit(0)})
    effects = clips.select("seq_id", F.col("ord").alias("clip_ord"), F.lit(0).alias("ord"), F.lit("blur").alias("kind"), F.lit(1).alias("slot_id"), F.lit(True).alias("enabled"), F.create_map(F.lit("sigma"), "rate").alias("params"))
    curves = clips.select("seq_id", F.col("ord").alias("clip_ord"), F.lit("opacity").alias("param"), F.lit("linear").alias("interp"), F.col("src_in").alias("frame"), F.col("rate").alias("value"), F.lit("hold").alias("ease"))
    words = clips.select("seq_id", "ord", "start", "stop", F.lit("word").alias("text"))
    docs = project.documents(clips, "seq_id", effects=effects, animations=curves, captions=words)
    docs.collect()
    plan = docs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [line for line in plan.splitlines() if "Exchange " in line]
    assert dealt and all("REPARTITION_BY_NUM" in line for line in dealt) and "Join" not in plan


def test_clips_of_one_place_and_projects_without_clips(spark):
    """Two clips of one place both stay, each with that place's effects; what belongs to no clip or project is left out; a project without a key is one too."""
    clips = [("p", 1, "a"), ("p", 1, "b"), ("p", 0, "c"), (None, 0, "d")]
    clips = spark.createDataFrame(clips, "k string, ord long, source string").selectExpr("*", "0L src_in", "9L src_out", "0L start", "1L track", "1D rate", "'flow' timeinterp", "5L clip_id", "0L blendfrom")
    effects = spark.createDataFrame([("p", 1, 0, "blur"), (None, 0, 0, "matte"), ("q", 0, 0, "lost"), ("p", 2, 0, "lost")], "k string, clip_ord long, ord long, kind string").selectExpr("*", "1L slot_id", "true enabled", "map('sigma', 2D) params")
    words = spark.createDataFrame([("p", 0, 0.5, 1.5, "w"), ("q", 0, 0.5, 1.5, "lost")], "k string, ord long, start double, stop double, text string")
    got = {r.k: json.loads(r.json) for r in project.documents(clips, "k", effects=effects, captions=words).collect()}
    shown = {k: [(c["source"], [e["type"] for e in c.get("effects", [])]) for c in doc["clips"]] for k, doc in got.items()}
    assert shown == {"p": [("c", []), ("a", ["blur"]), ("b", ["blur"])], None: [("d", ["matte"])]}
    assert [len(got[k]["captions"]) for k in ("p", None)] == [1, 0]

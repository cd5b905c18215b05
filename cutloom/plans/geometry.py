"""Queries over crops, placement, canvas and layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import geometry as G
from ..sources import tables as S
from .registry import edl, query


def _part(spark, d):
    return S.table(spark, d, "part").withColumn("s", F.col("p_size").cast("double")).withColumn("k", F.col("p_partkey"))


@query("SELECT p_partkey, CAST(least(greatest(p_size / 10.0 - 2, -1), 2) AS DOUBLE) AS x, CAST(least(greatest(p_size / 10.0 - 2, 0.05), 3) AS DOUBLE) AS w, NOT (p_partkey % 3 = 0 AND p_size % 2 = 0) AS cropped FROM part")
def crop_clamps(spark, d):
    v = F.col("s") / 10 - 2
    return _part(spark, d).select("p_partkey", G.crop_origin(v).alias("x"), G.crop_extent(v).alias("w"), G.has_crop((F.col("k") % 3).cast("double"), (F.col("p_size") % 2).cast("double"), F.lit(1.0), F.lit(1.0)).alias("cropped"))


SET = "t AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size / 10.0 ELSE 1 END AS scale, CASE WHEN p_partkey % 3 = 0 THEN p_size / 20.0 - 1 ELSE 0 END AS x, CASE WHEN p_partkey % 5 = 0 THEN p_size * 10.0 - 250 ELSE 0 END AS rotation FROM part)"


@query(f"WITH {SET} SELECT p_partkey, CAST(least(greatest(scale, 0.1), 4) AS DOUBLE) AS scale, CAST(least(greatest(x, -1), 1) AS DOUBLE) AS x, CAST(least(greatest(rotation, -180), 180) AS DOUBLE) AS rotation, scale = 1 AND x = 0 AND rotation = 0 AS neutral FROM t")
def placements(spark, d):
    when = lambda n, c: F.when(F.col("k") % n == 0, c)
    raw = when(2, F.col("s") / 10), when(3, F.col("s") / 20 - 1), F.lit(0.0), when(5, F.col("s") * 10 - 250)
    scale, x, _, rotation = G.set_transform(*raw)
    return _part(spark, d).select("p_partkey", scale.alias("scale"), x.alias("x"), rotation.alias("rotation"), G.is_neutral_frame(*raw).alias("neutral"))


@query("SELECT p_partkey, CAST(greatest(round_even(p_size / 100.0::DOUBLE * 32, 0), 1) AS BIGINT) AS w, CAST(greatest(round_even(p_size / 300.0::DOUBLE * 18, 0), 1) AS BIGINT) AS h FROM part")
def matte_layer(spark, d):
    w, h = G.matte_layer_size(F.col("s") / 100, F.col("s") / 300, 32, 18)
    return _part(spark, d).select("p_partkey", w.cast("long").alias("w"), h.cast("long").alias("h"))


@query("SELECT vec_id AS frame, round_even(embedding[1]::DOUBLE * 100 + 160, 0) - 15 >= 1 AND round_even(embedding[1]::DOUBLE * 100 + 160, 0) + 14 <= 320 AND round_even(embedding[2]::DOUBLE * 100 + 90, 0) - 15 >= 1 AND round_even(embedding[2]::DOUBLE * 100 + 90, 0) + 14 <= 180 AS ok FROM embeddings")
def feature_border(spark, d):
    e = lambda i: F.element_at("sig", i) * 100
    return S.signatures(spark, d).select("frame", G.trackable(e(1) + 160, e(2) + 90, F.lit(320), F.lit(180), 5, 10).alias("ok"))


LAYER = "t AS (SELECT p_partkey, p_size / 100.0::DOUBLE AS x, 0.1::DOUBLE AS y, 0.5::DOUBLE AS w, 0.25 + p_size / 100.0::DOUBLE AS h, 320.0::DOUBLE AS lw, 180.0::DOUBLE AS lh, 1280.0::DOUBLE AS cw, 720.0::DOUBLE AS ch, 1 + p_size / 50.0::DOUBLE AS sc, 0.1::DOUBLE AS px, -0.2::DOUBLE AS py, radians(p_partkey % 360 + 0.5::DOUBLE) AS r FROM part), s AS (SELECT *, least(cw / (w * lw), ch / (h * lh)) * sc AS z, cw / 2 + 0.5 + px * cw AS ax, ch / 2 + 0.5 + py * ch AS ay FROM t), m AS (SELECT *, cos(r) / z AS a, sin(r) / z AS b FROM s), f AS (SELECT *, (x + w / 2) * lw + 0.5 - a * ax - b * ay AS tx, (y + h / 2) * lh + 0.5 + b * ax - a * ay AS ty FROM m), c AS (SELECT f.p_partkey, (a * q.u + b * q.v + tx - 0.5) / lw AS u, (-b * q.u + a * q.v + ty - 0.5) / lh AS v FROM f, (VALUES (0.5::DOUBLE, 0.5::DOUBLE), (1280.5, 0.5), (0.5, 720.5), (1280.5, 720.5)) q(u, v))"


def _matrix(spark, d):
    crop = F.col("s") / 100, F.lit(0.1), F.lit(0.5), 0.25 + F.col("s") / 100
    return _part(spark, d), G.layer_matrix(crop, (320.0, 180.0), (1280.0, 720.0), (1 + F.col("s") / 50, F.lit(0.1), F.lit(-0.2), F.col("k") % 360 + 0.5))


@query(f"WITH {LAYER} SELECT p_partkey, CAST(round(a, 9) AS DOUBLE) AS a, CAST(round(b, 9) AS DOUBLE) AS b, CAST(round(tx, 6) AS DOUBLE) AS tx, CAST(round(ty, 6) AS DOUBLE) AS ty FROM f")
def layer_matrix(spark, d):
    rows, m = _matrix(spark, d)
    return rows.select("p_partkey", *(F.round(m[i], n).alias(c) for i, n, c in ((0, 9, "a"), (1, 9, "b"), (4, 6, "tx"), (5, 6, "ty"))))


@query(f"WITH {LAYER} SELECT p_partkey, CAST(round(min(u), 6) AS DOUBLE) AS x, CAST(round(min(v), 6) AS DOUBLE) AS y, CAST(round(max(u) - min(u), 6) AS DOUBLE) AS w, CAST(round(max(v) - min(v), 6) AS DOUBLE) AS h FROM c GROUP BY p_partkey")
def canvas_rect(spark, d):
    rows, m = _matrix(spark, d)
    return rows.select("p_partkey", *(F.round(v, 6).alias(c) for v, c in zip(G.canvas_rect(m, (320.0, 180.0), (1280.0, 720.0)), "xywh", strict=True)))


@query("WITH t AS (SELECT p_partkey, abs(p_size - p_partkey % 60) / 64.0::DOUBLE AS w, abs(p_partkey % 7 - p_size) / 64.0::DOUBLE AS h, p_partkey % 2 = 0 AS whole, p_partkey % 3 = 0 AS pinned FROM part), o AS (SELECT *, w >= 0.01 AND h >= 0.01 AS ok FROM t) SELECT p_partkey, ok, CAST(CASE WHEN ok AND whole THEN greatest(2 * (round_even(w * 640, 0)::BIGINT // 2), 2) WHEN pinned THEN 100 WHEN ok THEN 400 END AS BIGINT) AS canvas_w, CAST(CASE WHEN ok AND whole THEN greatest(2 * (round_even(h * 360, 0)::BIGINT // 2), 2) WHEN pinned THEN 50 WHEN ok THEN 300 END AS BIGINT) AS canvas_h FROM o")
def finish_crop(spark, d):
    rows = _part(spark, d).withColumn("crop", G.dragged_crop(F.col("s"), F.col("k") % 7, F.col("k") % 60, F.col("s"), 64.0, 64.0))
    rows = rows.withColumn("scope", F.when(F.col("k") % 2 == 0, "canvas").otherwise("clip")).withColumn("cw", F.when(F.col("k") % 3 == 0, 100)).withColumn("ch", F.when(F.col("k") % 3 == 0, 50))
    w, h = G.cropped("crop", "scope", 640, 360, "cw", "ch", F.lit(400), F.lit(300))
    return rows.select("p_partkey", F.col("crop").isNotNull().alias("ok"), w.cast("long").alias("canvas_w"), h.cast("long").alias("canvas_h"))


@query("WITH t AS (SELECT p_partkey, 10 + p_size * 0.5::DOUBLE AS s FROM part), r AS (SELECT *, CASE WHEN abs(s - 25) <= 0.01 THEN 1.0::DOUBLE ELSE s / 25 END AS r FROM t) SELECT p_partkey, CASE WHEN r = 1 THEN '' ELSE 'conformed ' || CAST(round(s, 2) AS VARCHAR) || ' → 25.0 fps (' || CASE WHEN r < 1 THEN 'each frame held ' || CAST(round(1 / r, 1) AS VARCHAR) || '×' ELSE 'every ' || CAST(round(r, 1) AS VARCHAR) || 'ᵗʰ frame kept' END || ')' END AS note FROM r")
def conform_note(spark, d):
    return _part(spark, d).select("p_partkey", G.conform_note(10 + F.col("s") * 0.5, F.lit(25.0)).alias("note"))


@query(f"WITH {edl()}, e AS (SELECT seq_id, max(stop) AS total FROM clips GROUP BY seq_id) SELECT c.seq_id, c.ord, printf('%02d:%06.3f  %d/%d', CAST(floor(start / 30.0::DOUBLE / 60) AS BIGINT), start / 30.0::DOUBLE - 60 * floor(start / 30.0::DOUBLE / 60), start, greatest(total - 1, 0)) AS clock FROM clips c JOIN e USING (seq_id)")
def clock(spark, d):
    clips = S.clips(spark, d)
    ends = clips.groupBy("seq_id").agg(F.max("stop").alias("total"))
    return clips.join(ends, "seq_id").select("seq_id", "ord", G.clock("start", "total", 30.0).alias("clock"))


@query("SELECT event_id, CAST((least(greatest(floor(value * 700), -32768), 32767) + event_id % 1000) / 65536.0::DOUBLE AS DOUBLE) AS mono FROM events")
def mono_mix(spark, d):
    left = N.clamp(N.floor_long(F.col("value") * 700), -32768, 32767)
    return S.table(spark, d, "events").select("event_id", ((left + F.col("event_id") % 1000) / 65536.0).alias("mono"))

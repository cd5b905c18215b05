"""Queries over curves, sources, caches, searches and catalogs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import curves as K
from ..operators import edits as E
from ..operators import media as M
from ..operators import search as H
from ..operators import timeline as T
from ..sources import tables as S
from .registry import CURVES, PACKETS, edl, query

INDEX = f"{PACKETS}, idx AS (SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY t, is_key DESC) - 1 AS BIGINT) AS frame, t, is_key FROM packets)"
GOPS = f"{INDEX}, runs AS (SELECT *, CAST(sum(is_key::INT) OVER (PARTITION BY source_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS BIGINT) AS gop FROM idx), gops AS (SELECT source_id, gop, min(frame) AS firstframe, count(*) AS nframes FROM runs GROUP BY ALL)"
POINTS = "pts AS (SELECT DISTINCT user_id AS owner_id, frame + 500 AS frame FROM ev)"
EASED = """pr AS (SELECT p.owner_id, p.frame, a.frame AS ak, a.value AS av, a.ease AS ae, b.frame AS bk, b.value AS bv, b.ease AS be FROM pts p
  ASOF LEFT JOIN curves a ON p.owner_id = a.owner_id AND p.frame >= a.frame ASOF LEFT JOIN curves b ON p.owner_id = b.owner_id AND p.frame < b.frame),
pt AS (SELECT *, (frame - ak)::DOUBLE / (bk - ak) AS t, CASE WHEN ae = 'smooth' THEN 0.0 ELSE 1.0 END AS m0, CASE WHEN be = 'smooth' THEN 0.0 ELSE 1.0 END AS m1 FROM pr),
vals AS (SELECT owner_id, frame, CASE WHEN ak IS NULL THEN bv WHEN bk IS NULL OR ak = frame OR ae = 'hold' THEN av ELSE av + ((t*t*t - 2*t*t + t) * m0 + (-2*t*t*t + 3*t*t) + (t*t*t - t*t) * m1) * (bv - av) END AS value FROM pt)"""


def _points(spark, d):
    keys = S.curves(spark, d)
    return keys, keys.select("owner_id", (F.col("frame") + 500).alias("frame")).distinct()


@query(f"WITH {CURVES}, {POINTS}, {EASED} SELECT owner_id, frame, CAST(round(value, 6) AS DOUBLE) AS value FROM vals")
def curve_value(spark, d):
    keys, points = _points(spark, d)
    return K.value_at(points, keys).withColumn("value", F.round("value", 6))


@query(f"WITH {CURVES}, {POINTS}, {EASED} SELECT c.c_custkey, CAST(round(coalesce(v.value, c.c_acctbal), 6) AS DOUBLE) AS value FROM customer c LEFT JOIN (SELECT owner_id, arg_min(value, frame) AS value FROM vals GROUP BY owner_id) v ON v.owner_id = c.c_custkey")
def effective_params(spark, d):
    keys, points = _points(spark, d)
    first = points.groupBy("owner_id").agg(F.min("frame").alias("frame"))
    static = S.table(spark, d, "customer").select(F.col("c_custkey").alias("owner_id"), F.col("c_acctbal").alias("static"))
    return K.effective(static, K.value_at(first, keys)).select(F.col("owner_id").alias("c_custkey"), F.round("value", 6).alias("value"))


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, CAST(max(event_id) AS BIGINT) AS version FROM events GROUP BY ALL")
def upsert_latest(spark, d):
    return S.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("version"))


@query(f"WITH {CURVES}, fresh AS (SELECT owner_id, frame, 0.5 AS value FROM curves WHERE frame % 3 = 0 UNION SELECT owner_id, frame + 1, 0.25 FROM curves WHERE frame % 3 = 1) SELECT owner_id, frame, CAST(coalesce(f.value, c.value) AS DOUBLE) AS value, coalesce(c.ease, 'linear') AS ease FROM curves c FULL JOIN (SELECT owner_id, frame, max(value) AS value FROM fresh GROUP BY ALL) f USING (owner_id, frame)")
def upsert_keys(spark, d):
    keys = S.curves(spark, d)
    fresh = keys.where("frame % 3 = 0").select("owner_id", "frame", F.lit(0.5).alias("v")).union(keys.where("frame % 3 = 1").select("owner_id", F.col("frame") + 1, F.lit(0.25)))
    fresh = fresh.groupBy("owner_id", "frame").agg(F.max("v").alias("v"))
    return keys.join(fresh, ["owner_id", "frame"], "full").select("owner_id", "frame", F.coalesce("v", "value").alias("value"), F.coalesce("ease", F.lit("linear")).alias("ease"))


@query(f"WITH {CURVES} SELECT p.owner_id, p.frame, max(k.frame) FILTER (k.frame < p.frame) AS prev, min(k.frame) FILTER (k.frame > p.frame) AS nxt FROM (SELECT owner_id, max(frame) // 2 AS frame FROM curves GROUP BY owner_id) p JOIN curves k USING (owner_id) GROUP BY ALL")
def next_key(spark, d):
    keys = S.curves(spark, d)
    points = keys.groupBy("owner_id").agg(N.div(F.max("frame"), 2).alias("frame"))
    return T.around(points, keys, ["owner_id"], "frame", "frame").select("owner_id", "frame", "prev", "nxt")


@query(f"WITH {CURVES} SELECT owner_id, frame, value, ease FROM curves WHERE frame % 4 <> 0")
def remove_keys(spark, d):
    keys = S.curves(spark, d).select("owner_id", "frame", "value", "ease")
    return K.remove_keys(keys, keys.where("frame % 4 = 0"))


@query(f"WITH {CURVES}, r AS (SELECT owner_id, CASE WHEN frame % 5 = 0 THEN frame + 3 ELSE frame END AS frame, value, ease, frame % 5 = 0 AS moved FROM curves) SELECT owner_id, frame, value, ease FROM r QUALIFY row_number() OVER (PARTITION BY owner_id, frame ORDER BY moved DESC) = 1")
def move_keys(spark, d):
    keys = S.curves(spark, d).select("owner_id", "frame", "value", "ease")
    return K.move_keys(keys, keys.where("frame % 5 = 0").withColumn("to", F.col("frame") + 3))


@query(f"WITH {CURVES} SELECT owner_id, frame, value, CASE WHEN frame % 2 = 0 THEN 'hold' ELSE ease END AS ease FROM curves")
def set_ease(spark, d):
    keys = S.curves(spark, d).select("owner_id", "frame", "value", "ease")
    return K.set_ease(keys, keys.where("frame % 2 = 0").select("owner_id", "frame", F.lit("hold").alias("new_ease")))


@query(f"WITH {CURVES}, c AS (SELECT owner_id, min(frame) AS src_in, max(frame) AS src_out FROM curves GROUP BY owner_id HAVING max(frame) - min(frame) > 1), f AS (SELECT owner_id, src_in AS frame, 0.0 AS value FROM c UNION ALL SELECT owner_id, least(src_in + 15, src_out - 1), 1.0 FROM c) SELECT owner_id, frame, CAST(coalesce(f.value, k.value) AS DOUBLE) AS value, CASE WHEN f.value IS NULL THEN k.ease ELSE 'linear' END AS ease FROM curves k FULL JOIN f USING (owner_id, frame)")
def fade_keys(spark, d):
    keys = S.curves(spark, d)
    spans = keys.groupBy("owner_id").agg(F.min("frame").alias("src_in"), F.max("frame").alias("src_out")).withColumn("rate", F.lit(0.5))
    return K.fade_keys(keys, spans, 30)


@query(f"WITH {CURVES}, c AS (SELECT owner_id, min(frame) AS src_in, count(*) AS n, arg_min(value, frame) AS v0, min(frame) FILTER (value > 98) AS hi FROM curves GROUP BY owner_id) SELECT owner_id, CAST(CASE WHEN n >= 2 AND v0 / 100 < 0.02 AND hi IS NOT NULL THEN floor((hi - src_in + 1) / 0.5) ELSE 0 END AS BIGINT) AS frames FROM c")
def fade_in_length(spark, d):
    keys = S.curves(spark, d).withColumn("value", F.col("value") / 100)
    clips = keys.groupBy("owner_id").agg(F.min("frame").alias("src_in")).withColumn("rate", F.lit(0.5))
    return K.fade_in_length(keys, clips)


ZONES = f"WITH {CURVES}, c AS (SELECT owner_id, min(frame) AS src_in, max(frame) + 1 AS src_out, CASE WHEN owner_id % 2 = 0 THEN 'out' ELSE 'in' END AS direction, greatest((max(frame) + 1 - min(frame)) // 2, 1) AS half, greatest(CAST(round_even((owner_id % 60 + 1) * 0.5::DOUBLE, 0) AS BIGINT), 1) AS n FROM curves GROUP BY owner_id), kept AS (SELECT k.* FROM curves k JOIN c USING (owner_id) WHERE NOT CASE direction WHEN 'out' THEN frame BETWEEN src_out - half AND src_out ELSE frame BETWEEN src_in AND src_in + half END)"


def _fading(spark, d):
    keys = S.curves(spark, d)
    clips = keys.groupBy("owner_id").agg(F.min("frame").alias("src_in"), (F.max("frame") + 1).alias("src_out"))
    return keys, clips.select("*", F.lit(0.5).alias("rate"), F.when(F.col("owner_id") % 2 == 0, "out").otherwise("in").alias("direction"), (F.col("owner_id") % 60 + 1).alias("frames"))


@query(f"{ZONES} SELECT owner_id, frame, value, ease FROM kept")
def clear_fade(spark, d):
    keys, clips = _fading(spark, d)
    return K.clear_fade(keys.select("owner_id", "frame", "value", "ease"), clips)


@query(f"{ZONES}, made AS (SELECT owner_id, frame, min(v) AS v FROM (SELECT owner_id, CASE direction WHEN 'out' THEN src_out - n ELSE src_in + n - 1 END AS frame, 1.0::DOUBLE AS v FROM c UNION ALL SELECT owner_id, CASE direction WHEN 'out' THEN src_out - 1 ELSE src_in END, 0.0 FROM c) GROUP BY ALL) SELECT owner_id, frame, coalesce(v, value) AS value, coalesce(ease, 'linear') AS ease FROM kept FULL JOIN made USING (owner_id, frame)")
def fades(spark, d):
    """Fades in and out by turns, in place of what was there."""
    return K.fade(*_fading(spark, d))


@query(f"WITH {CURVES} SELECT owner_id, frame, CASE WHEN owner_id % 3 = 0 AND ease = 'linear' THEN 'smooth' ELSE ease END AS ease, CASE WHEN owner_id % 3 = 1 THEN 'hold' ELSE 'linear' END AS interp FROM curves")
def materialise_ease(spark, d):
    interp = F.when(F.col("owner_id") % 3 == 0, "smooth").when(F.col("owner_id") % 3 == 1, "hold").otherwise("linear")
    return K.materialise_ease(S.curves(spark, d).withColumn("interp", interp)).select("owner_id", "frame", "ease", "interp")


TOGGLED = "want AS (SELECT DISTINCT owner_id, CASE WHEN frame % 2 = 0 THEN frame ELSE frame + 1 END AS frame FROM curves), pts AS (SELECT * FROM want w WHERE NOT EXISTS (FROM curves c WHERE c.owner_id = w.owner_id AND c.frame = w.frame))"


@query(f"WITH {CURVES}, {TOGGLED}, {EASED} SELECT owner_id, frame, CAST(round(value, 6) AS DOUBLE) AS value, ease FROM curves ANTI JOIN want USING (owner_id, frame) UNION ALL SELECT owner_id, frame, CAST(round(value, 6) AS DOUBLE), 'linear' FROM vals")
def toggle_keys(spark, d):
    """Keys at even frames go; where an odd one is, the next frame gets one unless it had one."""
    keys = S.curves(spark, d)
    points = keys.select("owner_id", F.when(F.col("frame") % 2 == 0, F.col("frame")).otherwise(F.col("frame") + 1).alias("frame"))
    return K.toggle_keys(keys, points).withColumn("value", F.round("value", 6))


RATES = "CASE " + " ".join(f"WHEN abs(e - {r!r}) / {r!r} < 0.002 THEN {r!r}" for r in M.STANDARD_RATES) + " ELSE e END"


@query(f"WITH s AS (SELECT p_partkey, CAST(p_size + 10 AS DOUBLE) AS fps, CAST(p_size * 10 + 200 AS BIGINT) AS nframes, CAST(p_size / 3.0 + 6.0 AS DOUBLE) AS duration FROM part), r AS (SELECT *, nframes / duration AS e FROM s) SELECT p_partkey, CAST(round(CASE WHEN abs(e - fps) / fps > 0.01 THEN {RATES} ELSE fps END, 9) AS DOUBLE) AS fps FROM r")
def rate_snap(spark, d):
    rows = S.table(spark, d, "part").select("p_partkey", (F.col("p_size") + 10).cast("double").alias("fps"), (F.col("p_size") * 10 + 200).cast("long").alias("nframes"), (F.col("p_size") / 3.0 + 6.0).alias("duration"))
    return rows.select("p_partkey", F.round(M.snap_rate("fps", "nframes", "duration"), 9).alias("fps"))


@query(f"WITH {INDEX} SELECT source_id, frame, t, is_key FROM idx")
def packet_index(spark, d):
    return M.packet_index(S.packets(spark, d))


@query(f"WITH {INDEX}, want AS (SELECT source_id, unnest(range(0, max(frame) + 4)) AS frame FROM idx GROUP BY source_id) SELECT w.source_id, w.frame, CAST(coalesce(i.t, w.frame / 30.0) AS DOUBLE) AS t FROM want w LEFT JOIN idx i USING (source_id, frame)")
def frame_time(spark, d):
    index = M.packet_index(S.packets(spark, d))
    want = index.groupBy("source_id").agg((F.max("frame") + 3).alias("last")).select("source_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("frame"))
    return want.join(index, ["source_id", "frame"], "left").select("source_id", "frame", F.coalesce("t", F.col("frame") / 30.0).alias("t"))


ASOF = f"{INDEX}, want AS (SELECT source_id, t + 1000.5 AS t FROM idx)"


@query(f"WITH {ASOF}, x AS (SELECT DISTINCT source_id, t FROM want) SELECT x.source_id, x.t, coalesce(i.frame, 0) AS frame FROM x ASOF LEFT JOIN (SELECT source_id, t, max(frame) AS frame FROM idx GROUP BY ALL) i ON x.source_id = i.source_id AND x.t + 0.000001 >= i.t")
def asof_frame(spark, d):
    index = M.packet_index(S.packets(spark, d))
    want = index.select("source_id", (F.col("t") + 1000.5).alias("t0")).distinct().withColumn("t", F.col("t0") + 1e-6)
    return K.asof(want, index, ["source_id"], "t", ["frame"]).select("source_id", F.col("t0").alias("t"), F.coalesce("frame", F.lit(0)).cast("long").alias("frame"))


@query(f"WITH {ASOF}, x AS (SELECT DISTINCT source_id, t FROM want) SELECT x.source_id, x.t, CAST(coalesce(i.t, 0.0) AS DOUBLE) AS key_t FROM x ASOF LEFT JOIN (SELECT DISTINCT source_id, t FROM idx WHERE is_key) i ON x.source_id = i.source_id AND x.t >= i.t")
def asof_keyframe(spark, d):
    index = M.packet_index(S.packets(spark, d))
    want = index.select("source_id", (F.col("t") + 1000.5).alias("t")).distinct()
    keys = index.where("is_key").select("source_id", "t", F.col("t").alias("key_t"))
    return K.asof(want, keys, ["source_id"], "t", ["key_t"]).select("source_id", "t", F.coalesce("key_t", F.lit(0.0)).alias("key_t"))


@query(f"WITH {INDEX} SELECT source_id, frame, t FROM idx WHERE frame % 2 = 1")
def exact_frames(spark, d):
    index = M.packet_index(S.packets(spark, d))
    return M.exact_frames(index.where("frame % 2 = 1").select("source_id", "frame"), index)


@query(f"WITH {INDEX} SELECT source_id, CAST(floor(t / 3600) AS BIGINT) AS second FROM idx EXCEPT SELECT source_id, CAST(floor(t / 3600) AS BIGINT) FROM idx WHERE is_key")
def thumb_wishes(spark, d):
    rows = S.packets(spark, d).withColumn("second", N.floor_long(F.col("t") / 3600))
    return M.wishes(rows, rows.where("is_key"), ["source_id", "second"])


@query("SELECT p_partkey, split_part(trim(lower(p_brand) || ',' || CASE WHEN p_size % 2 = 0 THEN ',' ELSE '' END), ',', 1) AS codec, CASE WHEN p_size % 5 = 0 THEN false ELSE p_partkey % 7 = 0 OR p_size > p_partkey % 50 END AS recoverable FROM part")
def probe_fields(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    line = F.concat(F.lower("p_brand"), F.lit(","), F.when(size % 2 == 0, ",").otherwise(""))
    saved, project = F.when(size % 5 != 0, size), F.when(key % 7 != 0, key % 50)
    return S.table(spark, d, "part").select("p_partkey", M.first_codec(line).alias("codec"), M.recoverable(saved, project).alias("recoverable"))


@query(f"WITH {GOPS} SELECT * FROM gops")
def gop_index(spark, d):
    return M.gops(M.packet_index(S.packets(spark, d)))


@query(f"WITH {GOPS}, want AS (SELECT source_id, unnest(range(-1, max(frame) + 4)) AS frame FROM idx GROUP BY source_id), m AS (SELECT source_id, min(gop) AS lo, max(gop) AS hi FROM gops GROUP BY ALL) SELECT w.source_id, w.frame, CASE WHEN w.frame < 0 THEN lo ELSE coalesce(g.gop, hi) END AS gop FROM want w JOIN m USING (source_id) LEFT JOIN gops g ON g.source_id = w.source_id AND g.firstframe <= w.frame AND w.frame < g.firstframe + g.nframes")
def gop_of(spark, d):
    runs = M.gops(M.packet_index(S.packets(spark, d))).withColumn("stop", F.col("firstframe") + F.col("nframes"))
    ends = runs.groupBy("source_id").agg(F.min("gop").alias("lo"), F.max("gop").alias("hi"), (F.max("stop") + 2).alias("last"))
    want = ends.withColumn("frame", F.explode(F.sequence(F.lit(-1).cast("long"), "last"))).drop("last")
    hit = T.interval_join(want, runs.select("source_id", "gop", "firstframe", "stop"), ["source_id"], "frame", "firstframe", "stop", "left")
    return hit.select("source_id", "frame", F.when(F.col("frame") < 0, F.col("lo")).otherwise(F.coalesce("gop", "hi")).alias("gop"))


@query(f"WITH {INDEX} SELECT w.source_id, w.frame AS want, arg_min(r.frame, (abs(r.frame - w.frame), r.frame)) AS frame FROM idx w JOIN idx r ON w.source_id = r.source_id AND r.frame % 4 = 0 AND abs(r.frame - w.frame) <= 4 GROUP BY ALL")
def nearest_resident(spark, d):
    index = M.packet_index(S.packets(spark, d))
    held = index.where("frame % 4 = 0").select("source_id", "frame")
    want = index.select("source_id", F.col("frame").alias("want"), F.explode(F.sequence(F.col("frame") - 4, F.col("frame") + 4)).alias("frame"))
    return want.join(held, ["source_id", "frame"]).groupBy("source_id", "want").agg(F.min_by("frame", F.struct(F.abs(F.col("frame") - F.col("want")), F.col("frame"))).alias("frame"))


@query(f"WITH {PACKETS}, th AS (SELECT DISTINCT source_id, CAST(floor(t / 3600) AS BIGINT) AS sec FROM packets), w AS (SELECT DISTINCT source_id, sec + 1 AS sec FROM th) SELECT w.source_id, w.sec AS want, arg_min(th.sec, (abs(th.sec - w.sec), -th.sec)) AS sec FROM w JOIN th ON th.source_id = w.source_id AND abs(th.sec - w.sec) <= 8 GROUP BY ALL")
def nearest_thumb(spark, d):
    thumbs = S.packets(spark, d).select("source_id", N.floor_long(F.col("t") / 3600).alias("sec")).distinct()
    want = thumbs.select("source_id", (F.col("sec") + 1).alias("want"), F.explode(F.sequence(F.col("sec") - 7, F.col("sec") + 9)).alias("sec")).distinct()
    return want.join(thumbs, ["source_id", "sec"]).groupBy("source_id", "want").agg(F.min_by("sec", F.struct(F.abs(F.col("sec") - F.col("want")), -F.col("sec"))).alias("sec"))


@query("WITH t AS (SELECT user_id, event_type AS item, max(event_id) AS last FROM events GROUP BY ALL) SELECT user_id, item, last FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last DESC, item) <= 3")
def lru_keep(spark, d):
    return M.lru_keep(S.table(spark, d, "events").withColumnRenamed("event_type", "item"), "user_id", "item", "event_id", 3)


@query(f"WITH {INDEX} SELECT source_id, frame % 24 AS slot, max(frame) AS frame FROM idx GROUP BY ALL")
def ring_slot(spark, d):
    return M.ring(M.packet_index(S.packets(spark, d)), 24)


@query(f"WITH {edl('gapless')}, r AS (SELECT source_id, seq_id * 100 + ord AS i, src_in AS frame FROM clips), j AS (SELECT *, coalesce(frame <> lag(frame) OVER (PARTITION BY source_id ORDER BY i) + 1, frame <> 0) AS jump FROM r) SELECT source_id, count(*) AS reads, CAST(sum(jump::INT) AS BIGINT) AS seeks FROM j GROUP BY source_id")
def seek_count(spark, d):
    return M.seeks(S.clips(spark, d, "gapless").select("source_id", (F.col("seq_id") * 100 + F.col("ord")).alias("i"), F.col("src_in").alias("frame")))


@query("WITH f AS (SELECT source, source || doc_id AS path, n_chars AS bytes, doc_id AS mtime FROM documents), r AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY source ORDER BY mtime, bytes, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(bytes) OVER (PARTITION BY source) AS total FROM f) SELECT path, total - before > 20000 AS gone FROM r")
def cache_prune(spark, d):
    files = S.table(spark, d, "documents").select("source", F.concat("source", F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("bytes"), F.col("doc_id").alias("mtime"))
    return M.keep_until(files, ["mtime", "bytes", "path"], "bytes", 20000, ["source"]).select("path", "gone")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 20")
def retention_topn(spark, d):
    by = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return S.table(spark, d, "orders").withColumn("r", F.row_number().over(by)).where("r <= 20").select("o_custkey", "o_orderkey")


@query("SELECT min(doc_id) AS doc_id, source, n_chars FROM documents WHERE n_chars % 2 = 0 AND NOT EXISTS (SELECT 1 FROM documents o WHERE o.source = documents.source AND o.n_chars = documents.n_chars AND o.doc_id % 10 = 0) GROUP BY source, n_chars")
def import_dedupe(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", "source", "n_chars")
    have = docs.where("doc_id % 10 = 0").select("source", "n_chars").distinct()
    return docs.where("n_chars % 2 = 0").join(have, ["source", "n_chars"], "left_anti").groupBy("source", "n_chars").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT p_partkey, (p_size * 100 * p_size * 60 > 2100000 OR CAST(p_retailprice AS BIGINT) * 10000 // greatest(p_size, 1) > 250000) AS needs FROM part")
def needs_proxy(spark, d):
    rows = S.table(spark, d, "part")
    heavy = N.div(F.expr("cast(p_retailprice as decimal(20,0))").cast("long") * 10000, F.greatest("p_size", F.lit(1)))
    return rows.select("p_partkey", ((F.col("p_size") * 100 * F.col("p_size") * 60 > 2_100_000) | (heavy > 250_000)).alias("needs"))


@query(f"WITH {edl()} SELECT seq_id, CAST(count(DISTINCT source_id) AS BIGINT) AS missing FROM clips WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = source_id AND p_size > 10) GROUP BY seq_id")
def missing_sources(spark, d):
    have = S.table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("source_id"))
    return S.clips(spark, d).join(have, "source_id", "left_anti").groupBy("seq_id").agg(F.count_distinct("source_id").alias("missing"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 7 = 0 THEN -1.0 ELSE value END AS DOUBLE) AS value FROM events")
def repairs_win(spark, d):
    base = S.table(spark, d, "events").select("event_id", "value")
    return E.upsert(base, base.where("event_id % 7 = 0").withColumn("value", F.lit(-1.0)), ["event_id"])


@query(f"WITH {edl()}, s AS (SELECT seq_id, max(stop) - 1 AS b FROM clips GROUP BY seq_id HAVING max(stop) > 0), i AS (SELECT seq_id, b, unnest(range(0, 16)) AS i FROM s) SELECT DISTINCT seq_id, CAST(round_even(i * b / 15.0, 0) AS BIGINT) AS frame FROM i")
def sheet_frames(spark, d):
    spans = S.clips(spark, d).groupBy("seq_id").agg((F.max("stop") - 1).alias("b")).where("b >= 0").withColumn("a", F.lit(0).cast("long"))
    return M.sheet_frames(spans, 16)


@query("WITH g AS (SELECT p_partkey, p_size AS n, 0.5 + p_size / 20.0 AS aspect FROM part), c AS (SELECT *, greatest(CAST(round_even(sqrt(n / greatest(aspect, 0.001)), 0) AS BIGINT), 1) AS cols FROM g), r AS (SELECT *, CAST(greatest(ceil(n / cols::DOUBLE), 1) AS BIGINT) AS rows FROM c), h AS (SELECT *, greatest(CAST(floor(512 / rows::DOUBLE) AS BIGINT), 16) AS cellh FROM r) SELECT p_partkey, cols, rows, greatest(CAST(round_even(cellh * aspect::DOUBLE, 0) AS BIGINT), 16) AS cellw, cellh FROM h")
def sheet_grid(spark, d):
    rows = S.table(spark, d, "part").select("p_partkey", F.col("p_size").alias("n"), (0.5 + F.col("p_size") / 20.0).alias("aspect"))
    return rows.select("p_partkey", *M.sheet_grid("n", "aspect", 512))


@query(f"WITH {edl()} SELECT seq_id, ord, lpad(CAST(start // 108000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(start // 1800 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(start // 30 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(start % 30 AS VARCHAR), 2, '0') AS code FROM clips")
def timecode(spark, d):
    return S.clips(spark, d).select("seq_id", "ord", M.timecode("start", 30.0).alias("code"))


@query("SELECT p_partkey AS name, p_name AS label, CAST(m - CASE WHEN p_size % 2 = 0 THEN 0 ELSE 0.25 END AS DOUBLE) AS score FROM (SELECT *, CASE WHEN lower(p_name) LIKE '1%' THEN 4.0 WHEN contains(lower(p_name), ' 1') THEN 3.0 WHEN contains(lower(p_name), '1') THEN 2.0 WHEN contains(lower(p_type), '1') THEN 1.5 WHEN contains(lower(p_brand), '1') THEN 1.0 ELSE 0 END AS m FROM part) WHERE m > 0 ORDER BY m - CASE WHEN p_size % 2 = 0 THEN 0 ELSE 0.25 END DESC, p_name, p_partkey LIMIT 12")
def rank_commands(spark, d):
    return H.rank_commands(S.palette(spark, d), "1")


@query("SELECT p_partkey AS name FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(p_type), 'steel') OR contains(lower(p_brand), '2')")
def kind_filter(spark, d):
    has = lambda c, q: F.lower(c).contains(q)
    return S.palette(spark, d).where(has("label", "a") | F.exists("keywords", lambda k: F.lower(k).contains("steel")) | has("category", "2")).select("name")


DIST = "dist AS (SELECT r.vec_id AS ref, e.vec_id AS frame, list_sum(list_transform(range(1, 65), lambda i: (e.embedding[i]::DOUBLE - r.embedding[i]::DOUBLE) ** 2)) / 64 AS score FROM embeddings e, embeddings r WHERE r.vec_id % 100 = 0)"


@query(f"WITH {DIST} SELECT ref, CAST(row_number() OVER (PARTITION BY ref ORDER BY score, frame) AS INT) AS rank, frame, CAST(round(score, 9) AS DOUBLE) AS score FROM dist WHERE abs(frame - ref) >= 30 QUALIFY rank <= 6")
def knn_frames(spark, d):
    sigs = S.signatures(spark, d)
    return H.nearest(H.closest(sigs, sigs.where("frame % 100 = 0"), 6, 30), 6, 30).select("ref", "rank", "frame", F.round("score", 9).alias("score"))


PICKS = """far AS (SELECT ref, frame, score, row_number() OVER (PARTITION BY ref ORDER BY score, frame) AS k FROM dist WHERE abs(frame - ref) >= 30),
r AS (SELECT DISTINCT ref, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS frame, CAST(NULL AS DOUBLE) AS score FROM far UNION ALL
  SELECT r.ref, f.k, CASE WHEN len(list_filter(taken, lambda t: abs(t - f.frame) < 30)) = 0 THEN list_append(taken, f.frame) ELSE taken END, CASE WHEN len(list_filter(taken, lambda t: abs(t - f.frame) < 30)) = 0 THEN f.frame END, f.score
  FROM r JOIN far f ON f.ref = r.ref AND f.k = r.k + 1 WHERE len(taken) < 6)"""


@query(f"WITH RECURSIVE {DIST}, {PICKS} SELECT ref, CAST(len(taken) AS BIGINT) AS rank, frame, CAST(round(score, 9) AS DOUBLE) AS score FROM r WHERE frame IS NOT NULL")
def knn_nms(spark, d):
    sigs = S.signatures(spark, d)
    return H.suppressed(H.closest(sigs, sigs.where("frame % 100 = 0"), H.most_ranked(6, 30)), 6, 30).withColumn("score", F.round("score", 9))


@query("WITH p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, b.vec_id - a.vec_id AS L, list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2)) / 64 AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id - a.vec_id BETWEEN 20 AND 120 AND (b.vec_id - a.vec_id - 20) % 2 = 0 AND a.vec_id % 2 = 0) SELECT label, a, b, CAST(round(score, 9) AS DOUBLE) AS score FROM p QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(score - 0.01 * L / 30.0, 9), a, L) = 1")
def find_loop(spark, d):
    return H.best_loop(S.signatures(spark, d), 20, 120, 2, 0.01, 30.0, ["label"]).withColumn("score", F.round("score", 9))


@query("WITH p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, b.vec_id - a.vec_id AS L, list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2)) / 64 AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id - a.vec_id BETWEEN 20 AND 120 AND (b.vec_id - a.vec_id - 20) % 2 = 0 AND a.vec_id % 2 = 0), m AS (SELECT label, a, b FROM p QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(score - 0.01 * L / 30.0, 9), a, L) = 1) SELECT label, 100 + label % 7 + a AS src_in, 100 + label % 7 + b AS src_out, CAST(0 AS BIGINT) AS start FROM m")
def loop_trim(spark, d):
    sigs = S.signatures(spark, d)
    clips = sigs.select("label").distinct().select("label", (100 + F.col("label") % 7).cast("long").alias("src_in"), F.lit(10_000).cast("long").alias("src_out"), F.lit(5).cast("long").alias("start"))
    return H.loop_trimmed(clips, H.best_loop(sigs, 20, 120, 2, 0.01, 30.0, ["label"]), "label").select("label", "src_in", "src_out", "start")


APART = """f AS (SELECT vec_id // 50 AS frame, vec_id AS ord, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, row_number() OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) AS k FROM embeddings),
r AS (SELECT DISTINCT frame, CAST(0 AS BIGINT) AS k, CAST([] AS DOUBLE[][]) AS kept, CAST(NULL AS BIGINT) AS ord FROM f UNION ALL
  SELECT frame, k, CASE WHEN near = 0 THEN list_append(kept, [x, y]) ELSE kept END, CASE WHEN near = 0 THEN ord END
  FROM (SELECT f.*, kept, len(list_filter(kept, lambda p: sqrt((p[1] - f.x) ** 2 + (p[2] - f.y) ** 2) < 8)) AS near FROM r JOIN f ON f.frame = r.frame AND f.k = r.k + 1))"""


@query(f"WITH RECURSIVE {APART} SELECT frame, ord FROM r WHERE ord IS NOT NULL")
def features_apart(spark, d):
    rows = S.signatures(spark, d).select(N.div("frame", 50).alias("frame"), F.col("frame").alias("ord"), (F.element_at("sig", 1) * 100).alias("x"), (F.element_at("sig", 2) * 100).alias("y"))
    return H.apart(rows, "frame", "ord", "x", "y", 8.0).select("frame", "ord")


@query("WITH s AS (SELECT user_id, event_id, abs(value - arg_min(value, event_id) OVER (PARTITION BY user_id)) AS diff FROM events) SELECT user_id, min(event_id) AS event_id FROM s WHERE diff > 50 GROUP BY user_id")
def find_change(spark, d):
    rows = S.table(spark, d, "events").select("user_id", "event_id", "value")
    first = rows.groupBy("user_id").agg(F.min_by("value", "event_id").alias("v0"))
    return H.first_change(rows.join(first, "user_id"), ["user_id"], "event_id", F.abs(F.col("value") - F.col("v0")), 50)


BISECT = """s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame, value FROM events), e AS (SELECT user_id, max(frame) AS b, arg_min(value, frame) AS v0, arg_max(value, frame) AS vn FROM s GROUP BY user_id),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS a, b, v0, abs(vn - v0) AS diff FROM e WHERE abs(vn - v0) > 50 UNION ALL
  SELECT r.user_id, CASE WHEN abs(s.value - v0) > 50 THEN a ELSE s.frame END, CASE WHEN abs(s.value - v0) > 50 THEN s.frame ELSE b END, v0, diff FROM r JOIN s ON s.user_id = r.user_id AND s.frame = (a + b) // 2 WHERE b - a > 1)"""


@query(f"WITH RECURSIVE {BISECT} SELECT user_id, b AS frame, CAST(round(diff, 6) AS DOUBLE) AS diff FROM r WHERE b - a <= 1")
def find_change_bisected(spark, d):
    by = Window.partitionBy("user_id").orderBy("event_id")
    rows = S.table(spark, d, "events").select("user_id", (F.row_number().over(by) - 1).cast("long").alias("frame"), "value")
    return H.bisected_change(rows, "user_id", "value", 50).withColumn("diff", F.round("diff", 6))


@query("WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT vec_id, e, list_sum(e) / len(e) AS mu FROM m), v AS (SELECT vec_id, e, mu, sqrt(list_sum(list_transform(e, lambda x: (x - mu) * (x - mu))) / len(e)) AS sd FROM s) SELECT vec_id AS frame, CAST(round((e[1] - mu) / (sd + 0.000001), 6) AS DOUBLE) AS first, CAST(round((e[64] - mu) / (sd + 0.000001), 6) AS DOUBLE) AS last FROM v")
def znorm_sig(spark, d):
    z = S.signatures(spark, d).select("frame", H.znorm("sig").alias("z"))
    return z.select("frame", F.round(F.element_at("z", 1), 6).alias("first"), F.round(F.element_at("z", 64), 6).alias("last"))

"""Queries over playback sessions, project documents and the effect catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import catalog as C
from ..operators import pixels as P
from ..operators.lineage import cut
from ..sources import project as J
from ..sources import tables as S
from ..streaming import stateful as Z
from .registry import edl, query
from .signals import PX
from .signals import _pixels as pixels

TAPS = "taps AS (SELECT user_id AS session, event_id AS at, CAST(CASE WHEN value >= 50 THEN 1 ELSE -1 END AS BIGINT) AS direction FROM events)"


def _taps(spark, d):
    return S.table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("at"), F.when(F.col("value") >= 50, 1).otherwise(-1).cast("long").alias("direction"))


@query(f"WITH {TAPS}, t AS (SELECT *, CASE WHEN direction = lag(direction) OVER w THEN 0 ELSE 1 END AS turn FROM taps WINDOW w AS (PARTITION BY session ORDER BY at)), r AS (SELECT *, sum(turn) OVER (PARTITION BY session ORDER BY at ROWS UNBOUNDED PRECEDING) AS run FROM t) SELECT session, at, CAST(direction * least(2 ** (row_number() OVER (PARTITION BY session, run ORDER BY at) - 1), 8) AS BIGINT) AS rate FROM r")
def shuttle_rates(spark, d):
    return Z.shuttle(_taps(spark, d))


def _moves(spark, d):
    return S.table(spark, d, "events").select(F.col("user_id").alias("session"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


SNAPSHOTS = """m AS (SELECT user_id AS session, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS tie FROM events), u AS (SELECT DISTINCT session, t FROM m),
n AS (SELECT session, t, min(t) OVER (PARTITION BY session ORDER BY t RANGE BETWEEN 3600000001 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM u),
r AS (SELECT session, min(t) AS t FROM u GROUP BY session UNION ALL SELECT n.session, n.next FROM r JOIN n ON n.session = r.session AND n.t = r.t AND n.next IS NOT NULL)"""


@query(f"WITH RECURSIVE {SNAPSHOTS} SELECT m.session, m.t AS at, r.t IS NOT NULL AND tie = 1 AS snapshot FROM m LEFT JOIN r ON r.session = m.session AND r.t = m.t")
def undo_snapshots(spark, d):
    return Z.coalesced(_moves(spark, d), 3_600_000_000)


@query("SELECT user_id AS session, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS slot, count(*) AS edits FROM events GROUP BY ALL")
def autosave_slots(spark, d):
    return Z.autosaves(_moves(spark, d), 3_600_000_000)


@query("WITH e AS (SELECT user_id, event_id, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS us, event_id % 3 - 1 AS rate FROM events) SELECT user_id, event_id, CAST(least(greatest(1000 + floor(us / 1e6::DOUBLE * 30 * rate), 0), 2000000) AS BIGINT) AS frame FROM e")
def playback_frames(spark, d):
    from pyspark.sql import Window

    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = S.table(spark, d, "events").withColumn("us", us - F.min(us).over(Window.partitionBy("user_id"))).withColumn("rate", F.col("event_id") % 3 - 1)
    return rows.select("user_id", "event_id", Z.played_frame(F.lit(1000), "us", 30, "rate", 2_000_000).cast("long").alias("frame"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, CAST(round(sum(value), 4) AS DOUBLE) AS total FROM events GROUP BY ALL".replace("time_bucket(INTERVAL '1 day', ts) AS start", "CAST(epoch_us(date_trunc('day', ts)) AS BIGINT) AS start"))
def event_windows(spark, d):
    events = S.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return Z.windowed(events, "1 day", "1 day").select(F.unix_micros("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"WITH {edl('tracks')} SELECT seq_id, ord, CAST(source_id AS VARCHAR) AS source, src_in, src_out, start, track, rate, 'sample' AS timeinterp, ord + 1 AS clip_id, CAST(0 AS BIGINT) AS blendfrom FROM clips")
def project_round_trip(spark, d):
    rows = S.clips(spark, d, "tracks").withColumn("source", F.col("source_id").cast("string"))
    return J.clips(J.parse(J.to_documents(rows, "seq_id")), "seq_id")


@query("SELECT event_id, CAST(round(1 - value / 100, 9) AS DOUBLE) AS inverted, CAST(round(value / 100 * 0.25, 9) AS DOUBLE) AS faded, CAST(round((value / 100) ** 2 * 0.5, 9) AS DOUBLE) AS curved FROM events")
def px_plugins(spark, d):
    kinds = C.builtin()
    kinds.expression("curve", "value * value * gain", params=(C.Param("gain", "Gain", 0, 1, 0.5),))
    rows = S.table(spark, d, "events").select("event_id", (F.col("value") / 100).alias("value"))
    made = [kinds.apply(rows, k, **p).select("event_id", F.round("value", 9).alias(n)) for k, p, n in (("invert", {}, "inverted"), ("opacity", {"alpha": 0.25}, "faded"), ("curve", {}, "curved"))]
    return made[0].join(made[1], "event_id").join(made[2], "event_id")


@query(f"WITH {PX}, b AS (SELECT dx, dy, w1 * w2 / 256.0 AS w FROM (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) a(dx, w1), (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) c(dy, w2)), m AS (SELECT frame, x, y, CASE WHEN v > 0.1 THEN 1.0 ELSE 0.0 END AS v FROM px) SELECT m.frame, m.x, m.y, CAST(round(sum(w * n.v), 9) AS DOUBLE) AS v FROM m CROSS JOIN b JOIN m n ON n.frame = m.frame AND n.x = least(greatest(m.x + dx, 0), 7) AND n.y = least(greatest(m.y + dy, 0), 7) GROUP BY ALL")
def px_matte(spark, d):
    """Every picture's bright pixels as a matte, feathered by the 5 x 5 binomial kernel: along rows, then along columns."""
    ones = {-2: 1 / 16, -1: 4 / 16, 0: 6 / 16, 1: 4 / 16, 2: 1 / 16}
    matte = pixels(spark, d).withColumn("v", F.when(F.col("v") > 0.1, 1.0).otherwise(0.0))
    along = P.stencil(matte, {(i, 0): w for i, w in ones.items()}, "v", "v", 8, 8)
    return P.stencil(along, {(0, i): w for i, w in ones.items()}, "v", "v", 8, 8).withColumn("v", F.round("v", 9))


FULL = f"""WITH {edl('tracks')},
fx AS (SELECT seq_id, ord, 'effect' AS part, CAST(p AS BIGINT) AS pos, 'kind' || ((ord + p) % 4) || ':' || (ord * 10 + p) AS name, CAST(src_in + p AS DOUBLE) AS number, CASE WHEN (ord + p) % 3 <> 0 THEN 'on' ELSE 'off' END AS text FROM clips, range(2) r(p) WHERE ord % 2 = 0),
an AS (SELECT seq_id, ord, 'key' AS part, src_in + k * 5 AS pos, CASE WHEN ord % 3 = 0 THEN 'opacity' ELSE 'blur' END AS name, CAST(k * 0.25 AS DOUBLE) AS number, CASE k % 2 WHEN 0 THEN 'smooth' ELSE 'hold' END AS text FROM clips, range(3) r(k) WHERE ord % 3 < 2),
tr AS (SELECT seq_id, ord, 'transition' AS part, start AS pos, 'dissolve' AS name, CAST(len % 9 AS DOUBLE) AS number, CAST(NULL AS VARCHAR) AS text FROM clips),
ca AS (SELECT seq_id, ord, 'caption' AS part, CAST(0 AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS name, start / 30.0::DOUBLE AS number, 'Line "' || ord || '"' || chr(10) || 'é' AS text FROM clips),
ov AS (SELECT seq_id, ord, 'overlay' AS part, stop AS pos, 'bar' AS name, CAST(rate AS DOUBLE) AS number, 'font' || source_id AS text FROM clips)
SELECT * FROM (FROM fx UNION ALL FROM an UNION ALL FROM tr UNION ALL FROM ca UNION ALL FROM ov)"""


@query(FULL)
def project_documents(spark, d):
    """Whole projects, with effects, curves, transitions, captions and overlays, written as documents and read again."""
    rows = S.clips(spark, d, "tracks")
    col = F.col
    whole = rows.select("seq_id", "ord", col("source_id").cast("string").alias("source"), "src_in", "src_out", "start", "track", "rate", F.lit("sample").alias("timeinterp"), (col("ord") + 1).alias("clip_id"), F.lit(0).alias("blendfrom"))
    pos = F.explode(F.array(F.lit(0), F.lit(1))).alias("ord")
    effects = rows.where("ord % 2 = 0").select("seq_id", col("ord").alias("clip_ord"), "src_in", pos)
    effects = effects.select("seq_id", "clip_ord", "ord", F.concat(F.lit("kind"), (col("clip_ord") + col("ord")) % 4).alias("kind"), (col("clip_ord") * 10 + col("ord")).alias("slot_id"), ((col("clip_ord") + col("ord")) % 3 != 0).alias("enabled"), F.create_map(F.lit("amount"), (col("src_in") + col("ord")).cast("double")).alias("params"))
    keys = rows.where("ord % 3 < 2").select("seq_id", col("ord").alias("clip_ord"), "src_in", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    keys = keys.select("seq_id", "clip_ord", F.when(col("clip_ord") % 3 == 0, "opacity").otherwise("blur").alias("param"), F.lit("linear").alias("interp"), (col("src_in") + col("k") * 5).alias("frame"), (col("k") * 0.25).cast("double").alias("value"), F.when(col("k") % 2 == 0, "smooth").otherwise("hold").alias("ease"))
    cuts = rows.select("seq_id", "ord", F.lit("dissolve").alias("kind"), col("start").alias("at"), (col("len") % 9).alias("duration"))
    words = rows.select("seq_id", "ord", (col("start") / 30.0).alias("start"), (col("stop") / 30.0).alias("stop"), F.concat(F.lit('Line "'), "ord", F.lit('"\né')).alias("text"))
    over = rows.select("seq_id", "ord", F.lit("bar").alias("kind"), "start", "stop", F.create_map(F.lit("rate"), "rate").alias("params"), F.create_map(F.lit("font"), F.concat(F.lit("font"), "source_id")).alias("settings"))
    docs = cut(J.parse(J.documents(whole, "seq_id", effects=effects, animations=keys, transitions=cuts, captions=words, overlays=over)))  # five tables are read from it
    flat = lambda rows, part, pos, name, number, text: rows.select("seq_id", col("ord").cast("long").alias("ord"), F.lit(part).alias("part"), pos.cast("long").alias("pos"), name.alias("name"), number.cast("double").alias("number"), text.alias("text"))
    null = F.lit(None).cast("string")
    slots = docs.select("seq_id", F.posexplode("clips").alias("ord", "c")).select("seq_id", "ord", F.posexplode("c.effects").alias("pos", "s"))
    parts = [
        flat(slots, "effect", col("pos"), F.concat("s.type", F.lit(":"), "s.id"), col("s.params")["amount"], F.when(col("s.enabled"), "on").otherwise("off")),
        flat(J.animations(docs, "seq_id"), "key", col("frame"), col("param"), col("value"), col("ease")),
        flat(J.listed(docs, "transitions", "seq_id"), "transition", col("at"), col("kind"), col("duration"), null),
        flat(J.listed(docs, "captions", "seq_id"), "caption", F.lit(0), null, col("start"), col("text")),
        flat(J.listed(docs, "overlays", "seq_id"), "overlay", col("stop"), col("kind"), col("params")["rate"], col("settings")["font"]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(f"WITH {PX}, n AS (SELECT a.frame, a.x, a.y, p.v AS low, q.v AS high FROM px a JOIN px p ON p.frame = a.frame AND p.x = greatest(a.x - 1, 0) AND p.y = greatest(a.y - 1, 0) JOIN px q ON q.frame = a.frame AND q.x = least(a.x + 1, 7) AND q.y = least(a.y + 1, 7)) SELECT frame, x, y, CAST(round(0.5 + 3 * (high - low), 9) AS DOUBLE) AS value FROM n")
def px_emboss(spark, d):
    """A registered stencil: grey and the slope of the light along the diagonal."""
    light = pixels(spark, d).withColumnRenamed("v", "value")
    return C.with_stencils().apply_stencil(light, "emboss", 8, 8, strength=3.0).withColumn("value", F.round("value", 9))

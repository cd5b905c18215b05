"""Queries over what is delivered frame by frame and block by block: masks, sound, served frames; and pictures warped and matched."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import audio as Au
from ..operators import masks as K
from ..operators import pixels as P
from ..sources import tables as S
from ..streaming import serving as V
from .motion import TAKES, E, _rounded, _takes
from .registry import FRAMES, edl, query
from .signals import PX
from .signals import _pixels as pixels

OWN = "own AS (SELECT take, frame, e[9] > 0.2 AS marked, list_transform(range(1, 5), lambda i: CAST(floor(abs(e[i]) * 1000) AS BIGINT)) AS p FROM takes)"
MASKS = f"""WITH RECURSIVE {TAKES}, {OWN},
heads AS (SELECT take, min(frame) AS head FROM own WHERE marked GROUP BY take),
there(take, frame, m) AS (SELECT take, frame, p FROM own WHERE marked UNION ALL
  SELECT o.take, o.frame, list_transform(range(1, 5), lambda i: (3 * t.m[i] + o.p[i]) // 4) FROM there t JOIN own o ON o.take = t.take AND o.frame = t.frame + 1 AND NOT o.marked),
back(take, frame, m) AS (SELECT o.take, o.frame, o.p FROM own o JOIN heads h ON h.take = o.take AND h.head = o.frame UNION ALL
  SELECT o.take, o.frame, list_transform(range(1, 5), lambda i: (3 * b.m[i] + o.p[i]) // 4) FROM back b JOIN own o ON o.take = b.take AND o.frame = b.frame - 1),
both_ways AS (SELECT * FROM there UNION ALL SELECT back.* FROM back JOIN heads USING (take) WHERE frame < head)
SELECT take, frame, array_to_string(m, ',') AS mask FROM own LEFT JOIN both_ways USING (take, frame)"""


def _blended(memory: list[int], frame: dict) -> tuple[list[int], list[int]]:
    new = [(3 * m + p) // 4 for m, p in zip(memory, frame["p"], strict=True)]
    return new, new


@query(MASKS)
def masks_both_ways(spark, d):
    """A few marked frames a take; the stand-in for a model blends the mask with each frame."""
    rows = _takes(spark, d)
    own = F.array(*(N.floor_long(F.abs(E(i)) * 1000) for i in range(1, 5)))
    frames = rows.select("take", "frame", own.alias("p"))
    seeds = rows.where(E(9) > 0.2).select("take", "frame", own.alias("mask"))
    out = K.propagate(frames, seeds, "take", "frame", K.Propagator(lambda mask, frame: mask, _blended))
    return out.select("take", "frame", F.array_join("mask", ",").alias("mask"))


# --- sound: 30 frames a second, sources of 15; a frame is 1,600 samples
SOUND = f"""WITH {edl('tracks')}, {FRAMES},
top AS (SELECT f.seq_id, f.n, max(struct_pack(track := c.track, ord := -c.ord)) AS t FROM frames f JOIN clips c ON f.seq_id = c.seq_id AND c.start <= f.n AND f.n < c.stop GROUP BY ALL),
seen AS (SELECT t.seq_id, c.src_in, c.start, c.rate, CAST(ceil(t.n / 30.0::DOUBLE * 48000) AS BIGINT) AS lo, CAST(ceil((t.n + 1) / 30.0::DOUBLE * 48000) AS BIGINT) AS hi FROM top t JOIN clips c ON c.seq_id = t.seq_id AND c.ord = -t.t.ord),
cut AS (SELECT seq_id, src_in, start, rate, b, greatest(lo, b * 4096) AS p, least(hi, (b + 1) * 4096) AS q FROM (SELECT *, unnest(range(lo // 4096, (hi - 1) // 4096 + 1)) AS b FROM seen)),
laid AS (SELECT *, q - p AS k, (src_in + (p * 30.0::DOUBLE / 48000 - start) * rate) / 15 * 48000 AS at FROM cut)
SELECT seq_id, CAST(b AS BIGINT) AS block, CAST(sum(k) AS BIGINT) AS sounding, CAST(round(sum(k * at + rate * k * (k - 1)), 2) AS DOUBLE) AS places FROM laid GROUP BY seq_id, b"""


@query(SOUND)
def sound_blocks(spark, d):
    """For every block of 4,096 samples how many sound, and the sum of the source samples that they fall on."""
    pieces = Au.block_pieces(S.clips(spark, d, "tracks"), 30.0, 15.0)
    n = F.col("n")
    return pieces.groupBy("seq_id", "stretch", "block").agg(F.sum("n").alias("sounding"), F.round(F.sum(n * F.col("at") + F.col("ratio") * n * (n - 1) / 2), 2).alias("places")).drop("stretch")


FED = """WITH RECURSIVE t AS (SELECT user_id AS session, event_id AS at, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_type, value FROM events),
ticks AS (SELECT session, at, k, CAST(round_even((k * 2.5::DOUBLE + CASE WHEN event_type = 'error' THEN value * 3 ELSE 0 END) / 30 * 48000, 0) AS BIGINT) AS want FROM t),
fed(session, at, k, first, jumped) AS (SELECT session, at, k, want, true FROM ticks WHERE k = 1 UNION ALL
  SELECT t.session, t.at, t.k, CASE WHEN abs(f.first + 4096 - t.want) > 12000 THEN t.want ELSE f.first + 4096 END, abs(f.first + 4096 - t.want) > 12000 FROM fed f JOIN ticks t ON t.session = f.session AND t.k = f.k + 1)
SELECT session, at, first, jumped FROM fed"""


@query(FED)
def sound_feed(spark, d):
    """Sessions whose playhead now and then is elsewhere."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    playhead = place * 2.5 + F.when(F.col("event_type") == "error", F.col("value") * 3).otherwise(0)
    ticks = S.table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("at"), playhead.alias("playhead"))
    return Au.fed(ticks, "session", "at", 30.0)


SERVED = """WITH ev AS (SELECT user_id AS session, event_id AS at, value >= 60 AS want, CAST(floor(value * 7) AS BIGINT) % 40 AS frame FROM events),
wants AS (SELECT session, at, frame FROM ev WHERE want), haves AS (SELECT session, at, frame FROM ev WHERE NOT want),
lasts AS (SELECT w.session, w.at, w.frame, h.frame AS got, max(h.at) AS came FROM wants w JOIN haves h ON h.session = w.session AND h.at < w.at GROUP BY ALL),
held AS (SELECT *, row_number() OVER (PARTITION BY session, at ORDER BY came DESC) AS age FROM lasts),
near AS (SELECT session, at, arg_min(got, (abs(got - frame)) * 1000 + got) AS shown, bool_or(got = frame) AS now FROM held WHERE age <= 8 GROUP BY session, at),
later AS (SELECT w.session, w.at FROM wants w JOIN haves h ON h.session = w.session AND h.frame = w.frame AND h.at > w.at AND h.at <= w.at + 20000 GROUP BY ALL)
SELECT w.session, w.at AS wanted_at, w.frame, CASE WHEN coalesce(n.now, false) OR l.at IS NOT NULL THEN w.frame ELSE n.shown END AS shown, coalesce(n.now, false) OR l.at IS NOT NULL AS exact
FROM wants w LEFT JOIN near n ON n.session = w.session AND n.at = w.at LEFT JOIN later l ON l.session = w.session AND l.at = w.at"""


@query(SERVED)
def served_frames(spark, d):
    """Wishes and arrivals of 40 frames, eight of them held; what each wish ends with."""
    events = S.table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("at"), (F.col("value") >= 60).alias("want"), (N.floor_long(F.col("value") * 7) % 40).alias("frame"))
    return V.served(events, 8, 20_000)


# --- pictures
WARP = f"""WITH {PX}, m AS (SELECT vec_id AS frame, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
t AS (SELECT frame, x, y, ((1 + e[1] / 4) * x + e[2] / 4 * y + e[3] * 2) / (e[7] / 40 * x + e[8] / 40 * y + 1) AS u, (e[4] / 4 * x + (1 + e[5] / 4) * y + e[6] * 2) / (e[7] / 40 * x + e[8] / 40 * y + 1) AS v FROM m, range(8) a(x), range(8) b(y)),
k AS (SELECT frame, x, y, least(greatest(u, 0), 7) AS u, least(greatest(v, 0), 7) AS v FROM t)
SELECT k.frame, k.x, k.y, CAST(round(sum(p.v * (1 - abs(k.u - p.x)) * (1 - abs(k.v - p.y))), 6) AS DOUBLE) AS v FROM k JOIN px p ON p.frame = k.frame AND abs(k.u - p.x) < 1 AND abs(k.v - p.y) < 1 GROUP BY k.frame, k.x, k.y"""


def _matrices(spark, d):
    m = F.array(1 + E(1) / 4, E(2) / 4, E(3) * 2, E(4) / 4, 1 + E(5) / 4, E(6) * 2, E(7) / 40, E(8) / 40, F.lit(1.0))
    return S.signatures(spark, d).select("frame", m.alias("m"))


@query(WARP)
def px_warp(spark, d):
    return _rounded(P.warp(pixels(spark, d), _matrices(spark, d), "v", 8, 8, 8, 8), "v", places=6)


@query(f"WITH {PX} SELECT a.frame, a.x, a.y, count(*) AS n, CAST(round(avg(b.v), 6) AS DOUBLE) AS mean, CAST(round(stddev_pop(b.v), 6) AS DOUBLE) AS deviation FROM px a JOIN px b ON a.frame = b.frame AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY ALL")
def px_window_stats(spark, d):
    return _rounded(P.window_stats(pixels(spark, d), "v", 2, 8, 8), "mean", "deviation", places=6)


MATCHED = f"""WITH {PX}, pairs AS (SELECT DISTINCT frame, frame + 1 AS to_frame, point, 2 + point AS x, 5 - point AS y FROM px, (VALUES (CAST(1 AS BIGINT)), (2)) t(point)),
tried AS (SELECT p.*, dx, dy FROM pairs p, range(-2, 3) a(dx), range(-2, 3) b(dy) WHERE x + dx BETWEEN 1 AND 6 AND y + dy BETWEEN 1 AND 6),
scored AS (SELECT t.frame, to_frame, point, dx, dy, coalesce(corr(a.v, b.v), 0) AS score FROM tried t JOIN px a ON a.frame = t.frame AND abs(a.x - t.x) <= 1 AND abs(a.y - t.y) <= 1 JOIN px b ON b.frame = t.to_frame AND b.x = a.x + dx AND b.y = a.y + dy GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY frame, point ORDER BY score DESC, dy, dx) AS place FROM scored)
SELECT b.frame, b.to_frame, b.point, b.dx, b.dy, CAST(round(b.score, 6) AS DOUBLE) AS score, CAST(round(b.score - coalesce(max(s.score) FILTER (greatest(abs(s.dx - b.dx), abs(s.dy - b.dy)) >= 2), 0), 6) AS DOUBLE) AS margin
FROM best b JOIN scored s ON s.frame = b.frame AND s.point = b.point WHERE b.place = 1 GROUP BY b.frame, b.to_frame, b.point, b.dx, b.dy, b.score"""


@query(MATCHED)
def px_match(spark, d):
    """Two squares of every picture, looked for in the next one."""
    light = pixels(spark, d)
    frames = light.select("frame").distinct()
    points = F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("point")
    pairs = frames.select("frame", (F.col("frame") + 1).alias("to_frame"), points).select("*", (F.col("point") + 2).alias("x"), (5 - F.col("point")).alias("y"))
    return _rounded(P.best_matches(P.correlate(light, pairs, "v", 1, 2, 8, 8)), "score", "margin", places=6)

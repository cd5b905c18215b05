"""Projects as JSON documents: read with defaults for what older ones lack, written in one piece, with dated checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOT = "struct<type:string,id:string,enabled:boolean,params:map<string,double>>"
CURVE = "struct<interp:string,frames:array<bigint>,values:array<double>,eases:array<string>>"
OVERLAY = "struct<kind:string,start:bigint,stop:bigint,params:map<string,double>,settings:map<string,string>>"
CLIP = f"struct<source:string,src_in:bigint,src_out:bigint,start:bigint,track:bigint,crop:array<double>,rate:double,timeinterp:string,id:string,blendfrom:string,effects:array<{SLOT}>,animations:map<string,{CURVE}>>"
SCHEMA = f"framerate double, canvas array<bigint>, clips array<{CLIP}>, transitions array<struct<kind:string,at:bigint,duration:bigint>>, captions array<struct<start:double,stop:double,text:string>>, overlays array<{OVERLAY}>"


def load(spark: SparkSession, path: str) -> DataFrame:
    """One row a document."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True).withColumn("path", F.input_file_name())


def parse(rows: DataFrame, column: str = "json") -> DataFrame:
    return rows.withColumn("p", F.from_json(column, SCHEMA)).select(*(c for c in rows.columns if c != column), "p.*")


def clips(projects: DataFrame, *keys: str) -> DataFrame:
    """A row a clip; rate 1, lane 1, sampled frames, no blend and enabled slots where a document does not say."""
    c = projects.select(*keys, F.posexplode("clips").alias("ord", "c"))
    interp = F.when(F.col("c.timeinterp") == "flow", "flow").otherwise("sample")
    return c.select(
        *keys, F.col("ord").cast("long").alias("ord"), "c.source", "c.src_in", "c.src_out", "c.start",
        F.coalesce("c.track", F.lit(1)).cast("long").alias("track"), F.coalesce("c.rate", F.lit(1.0)).alias("rate"), interp.alias("timeinterp"),
        F.coalesce(F.expr("try_cast(c.id as bigint)"), F.col("ord") + 1).cast("long").alias("clip_id"), F.coalesce(F.expr("try_cast(c.blendfrom as bigint)"), F.lit(0)).cast("long").alias("blendfrom"),
    )


def slots(projects: DataFrame, *keys: str) -> DataFrame:
    s = projects.select(*keys, F.posexplode("clips").alias("ord", "c")).select(*keys, "ord", F.posexplode("c.effects").alias("pos", "s"))
    return s.select(*keys, "ord", "pos", F.col("s.type").alias("kind"), F.coalesce("s.enabled", F.lit(True)).alias("enabled"), "s.params")


def missing(projects_clips: DataFrame, sources: DataFrame, *keys: str) -> DataFrame:
    """All sources of a document that are not there, together: (keys, missing)."""
    gone = projects_clips.select(*keys, "source").distinct().join(sources.select("source").distinct(), "source", "left_anti")
    return gone.groupBy(*keys).agg(F.array_sort(F.collect_set("source")).alias("missing"))


def to_documents(clip_rows: DataFrame, *keys: str, framerate: float = 30.0) -> DataFrame:
    """(keys, json): clips (ord, source, src_in, src_out, start, track, rate) as documents, in list order."""
    c = F.struct("ord", F.struct("source", "src_in", "src_out", "start", "track", "rate").alias("c"))
    docs = clip_rows.groupBy(*keys).agg(F.array_sort(F.collect_list(c)).alias("l"))
    return docs.select(*keys, F.to_json(F.struct(F.lit(framerate).alias("framerate"), F.transform("l", lambda x: x["c"]).alias("clips"))).alias("json"))


def _sorted(rows: str | Column, by: str) -> Column:
    """An array of structs in the order of one field; maps within them have none."""
    return F.array_sort(rows, lambda a, b: F.when(a[by] < b[by], -1).when(a[by] > b[by], 1).otherwise(0))


def _listed(rows: DataFrame, keys: list[str], name: str, kind: str, *fields: str) -> DataFrame:
    """(keys, name): an array of the rows' fields in the order of ``ord``."""
    whole = rows.groupBy(*keys).agg(_sorted(F.collect_list(F.struct("ord", F.struct(*fields).alias("v"))), "ord").alias("_l"))
    return whole.select(*keys, F.transform("_l", lambda x: x["v"]).cast(kind).alias(name))


def _together(parts: list[DataFrame]) -> DataFrame:
    """Rows of several tables one below the other; columns that a table lacks are null there.  Where all are dealt alike, so are these: grouping them moves no row."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def documents(
    clip_rows: DataFrame, *keys: str, effects: DataFrame | None = None, animations: DataFrame | None = None, transitions: DataFrame | None = None, captions: DataFrame | None = None, overlays: DataFrame | None = None, framerate: float = 30.0
) -> DataFrame:
    """(keys, json): whole projects as documents, all lists in the order of ``ord``.

    Clips (ord, source, src_in, src_out, start, track, rate, timeinterp, clip_id, blendfrom); effects (clip_ord, ord, kind, slot_id, enabled, params); animations (clip_ord, param, interp, frame, value,
    ease: a row a key); transitions (ord, kind, at, duration); captions (ord, start, stop, text); overlays (ord, kind, start, stop, params, settings).  Nulls are left out of a document, and read again as
    defaults; a list without rows is empty.  Effects and curves of clips that are not there are left out.  A project is one document, so one row holds it.

    Nothing is joined: what belongs to a clip, then to a project, is grouped from one table of all, so rows that are dealt by project already stay where they are.
    """
    on = list(keys)
    fields = ["source", "src_in", "src_out", "start", "track", "rate", "timeinterp"]
    clip = F.struct(*fields, F.col("clip_id").cast("string").alias("id"), F.col("blendfrom").cast("string").alias("blendfrom"))
    of_clips = [clip_rows.select(*on, "ord", clip.alias("_clip"))]
    if effects is not None:
        slots_ = effects.select(*on, "clip_ord", "ord", F.col("kind").alias("type"), F.col("slot_id").cast("string").alias("id"), "enabled", "params")
        of_clips.append(_listed(slots_, [*on, "clip_ord"], "effects", f"array<{SLOT}>", "type", "id", "enabled", "params").withColumnRenamed("clip_ord", "ord"))
    if animations is not None:
        keys_ = animations.groupBy(*on, "clip_ord", "param").agg(F.first("interp").alias("interp"), F.array_sort(F.collect_list(F.struct("frame", "value", "ease"))).alias("_keys"))
        part = lambda c: F.transform("_keys", lambda x: x[c])
        curves = keys_.select(*on, "clip_ord", "param", F.struct("interp", part("frame").alias("frames"), part("value").alias("values"), part("ease").alias("eases")).cast(CURVE).alias("_c"))
        curves = curves.groupBy(*on, "clip_ord").agg(F.map_from_entries(_sorted(F.collect_list(F.struct("param", "_c")), "param")).alias("animations"))
        of_clips.append(curves.withColumnRenamed("clip_ord", "ord"))
    own = [part.columns[-1] for part in of_clips[1:]]
    whole = _together(of_clips).groupBy(*on, "ord").agg(F.collect_list("_clip").alias("_clips"), *(F.first(c, ignorenulls=True).alias(c) for c in own))
    as_json = lambda c: F.to_json(F.struct(*(c[f].alias(f) for f in (*fields, "id", "blendfrom")), *own))
    lists = {
        "transitions": (transitions, "array<struct<kind:string,at:bigint,duration:bigint>>", ("kind", "at", "duration")),
        "captions": (captions, "array<struct<start:double,stop:double,text:string>>", ("start", "stop", "text")),
        "overlays": (overlays, f"array<{OVERLAY}>", ("kind", "start", "stop", "params", "settings")),
    }
    lists = {name: x for name, x in lists.items() if x[0] is not None}
    parts = [whole.where(F.size("_clips") > 0).select(*on, F.struct("ord", F.array_sort(F.transform("_clips", as_json)).alias("c")).alias("_clips"))]
    parts += [rows.select(*on, F.struct("ord", F.struct(*names).alias("v")).alias(name)) for name, (rows, _, names) in lists.items()]
    docs = _together(parts).groupBy(*on).agg(F.array_sort(F.collect_list("_clips")).alias("_clips"), *(_sorted(F.collect_list(name), "ord").alias(name) for name in lists))
    text = [F.lit(f'{{"framerate":{framerate},"clips":['), F.array_join(F.flatten(F.transform("_clips", lambda x: x["c"])), ","), F.lit("]")]
    for name, (_, kind, _) in lists.items():
        text += [F.lit(f',"{name}":'), F.to_json(F.transform(name, lambda x: x["v"]).cast(kind))]
    return docs.where(F.size("_clips") > 0).select(*on, F.concat(*text, F.lit("}")).alias("json"))


def animations(projects: DataFrame, *keys: str) -> DataFrame:
    """(keys, ord, param, interp, frame, value, ease): a row a key of the clips' curves; linear where a document does not say."""
    c = projects.select(*keys, F.posexplode("clips").alias("ord", "c")).select(*keys, F.col("ord").cast("long").alias("ord"), F.explode("c.animations").alias("param", "a"))
    rows = c.select(*keys, "ord", "param", F.coalesce("a.interp", F.lit("linear")).alias("interp"), "a", F.posexplode("a.frames").alias("i", "frame"))
    return rows.select(*keys, "ord", "param", "interp", "frame", F.get("a.values", "i").alias("value"), F.coalesce(F.get("a.eases", "i"), F.lit("linear")).alias("ease"))


def listed(projects: DataFrame, name: str, *keys: str) -> DataFrame:
    """(keys, ord, and its fields) of ``transitions``, ``captions`` or ``overlays``, a row each."""
    return projects.select(*keys, F.posexplode(name).alias("ord", "v")).select(*keys, F.col("ord").cast("long").alias("ord"), "v.*")


def newest(checkpoints: DataFrame, key: str, stamp: str, keep: int = 20) -> DataFrame:
    """The checkpoints that stay: the newest of each project."""
    return checkpoints.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(stamp)))).where(F.col("_r") <= keep).drop("_r")

"""Whole projects written and read, mask sidecars and caches written and read, stencils and overlays that are registered."""

import json

import pytest
from pyspark.sql import functions as F

from cutloom.operators import catalog as C
from cutloom.operators import motion as M
from cutloom.sources import binary as B
from cutloom.sources import project as J


def test_a_whole_project(spark):
    clips = spark.createDataFrame([("p", i, f"s{i}", 0, 9, 10 * i, 1, 1.0, "flow", 50 + i, 0) for i in range(12)], "k string, ord long, source string, src_in long, src_out long, start long, track long, rate double, timeinterp string, clip_id long, blendfrom long")
    effects = spark.createDataFrame([("p", 1, 1, "blur", 8, True, {"sigma": 2.0}), ("p", 1, 0, "matte", 7, False, {}), ("p", 99, 0, "lost", 1, True, {})], "k string, clip_ord long, ord int, kind string, slot_id long, enabled boolean, params map<string,double>")
    keys = spark.createDataFrame([("p", 2, "opacity", "smooth", 9, 1.0, "hold"), ("p", 2, "opacity", "smooth", 3, 0.0, "linear"), ("p", 2, "blur", "linear", 1, 5.0, "smooth")], "k string, clip_ord long, param string, interp string, frame long, value double, ease string")
    words = spark.createDataFrame([("p", 0, 0.5, 1.5, 'a "quoted"\nline, é')], "k string, ord long, start double, stop double, text string")
    docs = J.documents(clips, "k", effects=effects, animations=keys, captions=words, transitions=clips.limit(0).select("k", "ord", F.lit("x").alias("kind"), F.lit(1).alias("at"), F.lit(1).alias("duration")))
    plain = json.loads(docs.first().json)
    assert [c["id"] for c in plain["clips"]] == [str(50 + i) for i in range(12)] and plain["transitions"] == []
    assert [e["type"] for e in plain["clips"][1]["effects"]] == ["matte", "blur"] and plain["clips"][2]["animations"]["opacity"]["frames"] == [3, 9]
    read = J.parse(docs)
    assert {(r.ord, r.kind, r.enabled) for r in J.slots(read, "k").collect()} == {(1, "matte", False), (1, "blur", True)}
    assert {tuple(r)[1:] for r in J.animations(read, "k").collect()} == {(2, "opacity", "smooth", 3, 0.0, "linear"), (2, "opacity", "smooth", 9, 1.0, "hold"), (2, "blur", "linear", 1, 5.0, "smooth")}
    assert [(r.start, r.stop, r.text) for r in J.listed(read, "captions", "k").collect()] == [(0.5, 1.5, 'a "quoted"\nline, é')]
    assert J.listed(read, "overlays", "k").count() == 0
    assert [(r.clip_id, r.timeinterp) for r in J.clips(read, "k").orderBy("ord").collect()] == [(50 + i, "flow") for i in range(12)]


def test_sidecars_are_read_as_they_were_written(spark, tmp_path):
    rows = [("a.mask", f, 2, 3, bytearray([f % 256] * 6)) for f in (300, 4, 70_000)] + [("b/c.mask", -1, 1, 1, bytearray(b"x")), ("a.mask", 5, 2, 2, bytearray(b"bad")), ("a.mask", 6, 0, 0, bytearray()), ("a.mask", 4, 1, 1, bytearray(b"z"))]
    masks = spark.createDataFrame(rows, "path string, frame long, w int, h int, alpha binary")
    packed = B.pack_masks(masks)
    want = {("a.mask", f, 2, 3, bytes([f % 256] * 6)) for f in (4, 300, 70_000)} | {("b/c.mask", -1, 1, 1, b"x")}
    got = {(r.path, r.frame, r.w, r.h, bytes(r.alpha)) for r in B.masks(packed).collect()}
    assert got == want
    assert B.write_files(packed, f"file://{tmp_path}/out") == 2 and B.write_files(packed, f"file://{tmp_path}/out") == 2
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.mask*")) == ["a.mask", "b/c.mask"]
    again = B.masks(B.files(spark, f"file://{tmp_path}/out/*.mask"))
    assert {r.frame for r in again.collect()} == {4, 300, 70_000}


def test_caches_fill_what_is_missing(spark):
    rows = [("m", 3, 2, 1, bytearray(b"ab")), ("m", 5, 2, 1, bytearray(b"cd")), ("m", 4, 1, 1, bytearray(b"e"))]
    one = B.pack_planes(spark.createDataFrame(rows, "path string, frame long, w int, h int, alpha binary")).first()
    assert (one.w, one.h, one.n, bytes(one.content)) == (2, 1, 3, b"ab\0\0cd")


def test_stencils_register(spark):
    kinds = C.with_stencils()
    kinds.stencil("slope", ((1, 0), (-1, 0)), lambda at, gain: gain * (at(1, 0) - at(-1, 0)), params=(C.Param("gain", "Gain", 0, 9, 2),))
    light = spark.createDataFrame([(0, x, y, float(x * x + 10 * y)) for x in range(4) for y in range(3)], "frame long, x long, y long, value double")
    got = {(r.x, r.y): r.value for r in kinds.apply_stencil(light, "slope", 4, 3).collect()}
    v = lambda x, y: min(max(x, 0), 3) ** 2 + 10 * min(max(y, 0), 2)
    assert got == {(x, y): 2.0 * (v(x + 1, y) - v(x - 1, y)) for x in range(4) for y in range(3)}
    edges = {(r.x, r.y): r.value for r in kinds.apply_stencil(light, "edges", 4, 3).collect()}
    assert edges[1, 1] == pytest.approx((16.0**2 + 80.0**2) ** 0.5)


def test_overlays_register(spark):
    kinds = C.Overlays()
    kinds.register("text", "Text", (C.Param("size", "Size", 1, 99, 12),), lambda s: F.concat(F.lit("text "), s["size"], F.lit(" "), F.coalesce(s["words"], F.lit(""))))
    kinds.register("bar", "Bar", (), lambda s: F.lit("old"))
    kinds.register("bar", "Bar", (C.Param("w", "Width"),), lambda s: F.concat(F.lit("bar "), s["w"]))
    states = spark.createDataFrame([(1, "text", {"words": "hi"}), (2, "text", {"size": "30", "words": "yo"}), (3, "bar", None)], "id long, kind string, state map<string,string>")
    assert {r.id: r.drawing for r in kinds.drawn(states).collect()} == {1: "text 12.0 hi", 2: "text 30 yo", 3: "bar 0.0"}
    assert list(kinds.kinds) == ["text", "bar"] and kinds.version == 3
    with pytest.raises(Exception, match="no overlay kind comet"):
        kinds.drawn(states.withColumn("kind", F.lit("comet"))).collect()


def test_matrices_for_the_full_picture(spark):
    m = [1.0, 0.1, 4.0, 0.2, 0.9, -2.0, 0.001, 0.002, 1.0]
    got = spark.createDataFrame([(m,)], "m array<double>").select(M.scaled_to_source("m", 4.0).alias("m")).first().m
    at = lambda m, x, y: [(m[3 * i] * x + m[3 * i + 1] * y + m[3 * i + 2]) / (m[6] * x + m[7] * y + m[8]) for i in (0, 1)]
    small, full = at(m, 10, 7), at(got, 40, 28)
    assert full == pytest.approx([4 * c for c in small])

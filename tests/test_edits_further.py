"""Links with roles, fades in place of others, toggled keys, searches that look at few frames."""

import random

from pyspark.sql import functions as F

from cutloom.operators import curves as K
from cutloom.operators import documents as D
from cutloom.operators import search as H


def reached(edges, start):
    """Breadth first: node to (role, steps)."""
    seen, front, steps = {start: (None, 0)}, [start], 0
    while front:
        steps += 1
        by = {}
        for src, dst, role in edges:
            if src in front and dst not in seen:
                by[dst] = min(by.get(dst, (src, role)), (src, role))
        seen |= {n: (role, steps) for n, (_, role) in by.items()}
        front = list(by)
    return {(start, n, *v) for n, v in seen.items() if n != start}


def test_roles_by_the_shortest_way(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(30), rng.randrange(30), rng.choice(("into", "from", "masks"))) for _ in range(50)] + [(100 + i, 101 + i, "chain") for i in range(25)] + [(125, 100, "back"), (3, 3, "self")]
    links = spark.createDataFrame(edges, "src long, dst long, role string")
    starts = spark.createDataFrame([(n,) for n in (0, 1, 2, 100, 110, 999)], "node long")
    got = {tuple(r) for r in D.link_roles(links, starts, every=3).collect()}
    assert got == set().union(*(reached([e for e in edges if e[0] != e[1]], s) for s in (0, 1, 2, 100, 110, 999)))
    assert max(r[3] for r in got) == 25
    assert D.link_roles(links.limit(0), starts).collect() == []


def test_direct_parameters_only(spark):
    links = spark.createDataFrame([(1, 10, 0, 11, "mask"), (1, 11, 2, 20, "fadesinto"), (1, 10, 2, 21, "plain"), (1, 10, 3, 99, "gone")], "src_clip long, src_slot long, dst_clip long, dst_slot long, role string")
    slots = spark.createDataFrame([(1, 10, "blur"), (1, 11, "matte"), (2, 20, "opacity"), (2, 21, "unknown")], "clip_id long, slot_id long, kind string")
    kinds = spark.createDataFrame([("matte", ["feather"]), ("opacity", ["alpha"]), ("blur", ["sigma"])], "kind string, params array<string>")
    got = {(r.src_slot, r.to_clip, r.dst_slot, r.role, *r.params) for r in D.linked_params(links, slots, kinds).collect()}
    assert got == {(10, 1, 11, "mask", "feather"), (11, 2, 20, "fadesinto", "alpha")}


CURVE = "owner_id long, frame long, value double, ease string"


def test_a_fade_replaces_what_was_there(spark):
    keys = spark.createDataFrame([(1, f, f / 10, "hold") for f in (0, 4, 5, 6, 9, 10)] + [(2, 3, 0.5, "smooth")], CURVE)
    clips = spark.createDataFrame([(1, 0, 10, 0.5, "in", 4), (1, 0, 10, 0.5, "out", 1)], "owner_id long, src_in long, src_out long, rate double, direction string, frames long")
    got = {(r.owner_id, r.frame): (r.value, r.ease) for r in K.fade(keys, clips).collect()}
    assert got == {(1, 0): (0.0, "linear"), (1, 1): (1.0, "linear"), (1, 9): (0.0, "linear"), (2, 3): (0.5, "smooth")}
    one = {r.frame for r in K.clear_fade(keys, clips.where("direction = 'in'")).where("owner_id = 1").collect()}
    assert one == {6, 9, 10}  # the zone takes its last frame along
    back = K.fade_in_length(K.fade(keys, clips.where("direction = 'in'")), clips.where("direction = 'in'").select("owner_id", "src_in", "rate"))
    assert back.first().frames == 4  # a fade reads back the length it was given


def test_toggling_and_clearing(spark):
    keys = spark.createDataFrame([(1, 0, 0.0, "linear"), (1, 10, 1.0, "linear"), (2, 5, 3.0, "smooth")], CURVE)
    points = spark.createDataFrame([(1, 10, 9.0), (1, 4, 9.0), (1, 4, 9.0), (3, 1, 7.0)], "owner_id long, frame long, static double")
    got = {tuple(r) for r in K.toggle_keys(keys, points).collect()}
    assert got == {(1, 0, 0.0, "linear"), (1, 4, 0.4, "linear"), (2, 5, 3.0, "smooth"), (3, 1, 7.0, "linear")}
    assert {r.owner_id for r in K.clear_curves(keys, points).collect()} == {2}
    smooth = K.materialise_ease(keys.withColumn("interp", F.when(F.col("owner_id") == 1, "smooth").otherwise("hold"))).collect()
    assert {(r.owner_id, r.ease, r.interp) for r in smooth} == {(1, "smooth", "linear"), (2, "smooth", "hold")}


def test_bisection_looks_at_few_frames(spark):
    """A thousand and one frames, twelve looks: the renderer is asked for no more, and for no frame twice."""
    ends = spark.createDataFrame([(k, 1000) for k in range(5)] + [(7, 0), (8, 1)], "k long, last long")
    asked = []

    def render(frames):
        asked.extend((r.k, r.frame) for r in frames.collect())
        return frames.withColumn("value", F.when(F.col("frame") >= F.col("k") * 137 + 1, 9.0).otherwise(0.0))

    got = {r.k: (r.frame, r.diff) for r in H.bisected(ends, "k", render, 1.0).collect()}
    assert got == {k: (k * 137 + 1, 9.0) for k in range(5)}
    for k in range(5):
        mine = [f for q, f in asked if q == k]
        assert len(mine) == len(set(mine)) <= 12


def test_distances_in_blocks(spark):
    rng = random.Random(2)
    sigs = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(40)], "frame long, sig array<double>")
    refs = sigs.where("frame % 3 = 0")
    one, many = (sorted(map(tuple, H.distances(sigs, refs, most).collect())) for most in (1 << 20, 100))
    assert one == many and len(one) == 40 * 14

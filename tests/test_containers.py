"""Streams cut anywhere give the groups of the whole; containers, golden ones and cut off anywhere, give a defined lead."""

import random

import pytest

from cutloom.plans.containers import _container
from cutloom.sources import containers as C


def unit(codec, kind, first=True, n=3):
    head = bytes([0x60 | kind]) if codec is C.H264 else bytes([kind << 1, 1]) + (b"\xa0" if first else b"\x20")
    return b"\0\0\1" + head + b"x" * n


def plain(raw, codec):
    """(gop, b0, b1, firstframe, nframes), walking the bytes one by one."""
    units, i = [], 0
    while i + 3 < len(raw):
        if raw[i : i + 3] == b"\0\0\1":
            kind = raw[i + 3] & 31 if codec is C.H264 else raw[i + 3] >> 1 & 63
            first = kind in (1, 5) if codec is C.H264 else kind <= 21 and i + 5 < len(raw) and raw[i + 5] & 128
            units.append((i, kind, bool(first)))
            i += 3
        else:
            i += 1
    if any(k in codec.open for _, k, _ in units):
        return []
    starts = []
    for j, (_, kind, _) in enumerate(units):
        if kind in codec.key:
            while j and units[j - 1][1] in codec.before:
                j -= 1
            starts.append(j)
    out, frame = [], 0
    for g, (a, b) in enumerate(zip(starts, [*starts[1:], len(units)][: len(starts)], strict=True)):
        n = sum(u[2] for u in units[a:b])
        out.append((g, units[a][0], (units[b][0] if b < len(units) else len(raw)) - 1, frame, n))
        frame += n
    return out


GOLDEN = {
    C.H264: ([(7, 1), (8, 1), (5, 1), (1, 1), (1, 1), (7, 1), (5, 1), (1, 1)], [(0, 3), (3, 2)]),
    C.H265: ([(32, 1), (33, 1), (34, 1), (19, 1), (19, 0), (1, 1), (1, 0), (35, 1), (33, 1), (39, 1), (20, 1), (0, 1), (9, 1)], [(0, 1), (1, 1), (2, 3)]),
}


@pytest.mark.parametrize("codec", [C.H264, C.H265], ids=["h264", "h265"])
def test_golden_and_random_streams_in_pieces(spark, codec):
    rng = random.Random(1)
    golden, counts = GOLDEN[codec]
    streams = {"golden": b"junk" + b"".join(unit(codec, k, f) for k, f in golden), "empty": b"", "none": b"abc\0\0", "no key": unit(codec, 1) * 3, "cut off": unit(codec, codec.key[0]) + b"\0\0\1"}
    kinds = [*codec.key, *codec.before, 1, 1, 1, 6]
    for k in range(4):
        streams[f"r{k}"] = b"".join(unit(codec, rng.choice(kinds), rng.random() < 0.7, rng.randint(0, 5)) + b"\0" * rng.randint(0, 2) for _ in range(60))
    want = {(p, *g) for p, raw in streams.items() for g in plain(raw, codec)}
    assert [w[4:] for w in sorted(want) if w[0] == "golden"] == counts
    blobs = spark.createDataFrame([(p, bytearray(raw)) for p, raw in streams.items()] + [("null", None)], "path string, content binary")
    for size in (1, 7, 10_000):  # start codes lie across every border
        got = C.groups(C.ranges(blobs, size), codec)
        assert {tuple(r) for r in got.select("path", "gop", "b0", "b1", "firstframe", "nframes").collect()} == want
    found = C.units(C.ranges(blobs, 7), codec)
    assert {tuple(r) for r in C.refused(found, codec).collect()} == {("no key", "no key picture")}
    sets = {(r.path, r.kind): streams[r.path][r.b0 : r.b1 + 1] for r in C.parameter_sets(C.ranges(blobs, 7), codec).collect()}
    assert {k: sets["golden", k] for k in codec.parameters} == {k: unit(codec, k) for k in codec.parameters}


def test_open_groups_are_refused(spark):
    raw = unit(C.H265, 19) + unit(C.H265, 1) + unit(C.H265, 21) + unit(C.H265, 8)
    streams = C.ranges(spark.createDataFrame([("open", bytearray(raw)), ("closed", bytearray(raw[:18]))], "path string, content binary"), 5)
    assert [r.path for r in C.groups(streams, C.H265).collect()] == ["closed"]
    assert [tuple(r) for r in C.refused(C.units(streams, C.H265), C.H265).collect()] == [("open", "open groups")]


def test_edit_lists(spark):
    golden = {k: _container(k, 30) for k in (1, 2, 3, 6, 7)}
    assert [C.edit_list_lead(golden[k]) for k in (1, 2, 3, 6, 7)] == [1199 // 2, 1198 // 3, 1197 // 4, 1194 // 7, 0]
    assert C.edit_list_lead(golden[1].replace(b"ftyp", b"free")) == 0 and C.edit_list_lead(golden[1].replace(b"vide", b"subt")) == 0
    for raw in golden.values():
        for n in range(len(raw)):  # cut off anywhere: a number, no error
            assert C.edit_list_lead(raw[:n]) in (0, C.edit_list_lead(raw))
    rng = random.Random(2)
    for _ in range(300):
        raw = bytearray(golden[3])
        for _ in range(3):
            raw[rng.randrange(8, len(raw))] = rng.randrange(256)
        assert C.edit_list_lead(bytes(raw)) >= 0
    to_end = bytearray(golden[1])
    to_end[golden[1].index(b"moov") - 4 : golden[1].index(b"moov")] = b"\0\0\0\0"  # a length of 0 reaches to the end
    got = C.edit_leads(spark.createDataFrame([("a", to_end), ("b", None), ("c", bytearray(b""))], "path string, content binary"))
    assert {tuple(r) for r in got.collect()} == {("a", 599), ("b", 0), ("c", 0)}

import struct

import pytest

from cutloom.sources import binary as B


def test_masks(spark, tmp_path):
    record = lambda f, w, h, fill: struct.pack("<iii", f, w, h) + bytes([fill]) * (w * h)
    raw = record(4, 2, 3, 1) + record(2, 1, 1, 7) + record(4, 2, 2, 9)
    (tmp_path / "a.mask").write_bytes(raw + record(8, 5, 5, 1)[:20])
    (tmp_path / "b.mask").write_bytes(record(1, 0, 3, 1) + raw)
    got = B.masks(B.files(spark, f"file://{tmp_path}")).orderBy("frame").collect()
    assert [(r.frame, r.w, r.h, bytes(r.alpha)) for r in got] == [(2, 1, 1, b"\x07"), (4, 2, 2, b"\t" * 4)]


def test_gops(spark):
    unit = lambda kind, n: b"\x00\x00\x01" + bytes([0x60 | kind]) + b"x" * n
    raw = b"".join((unit(7, 2), unit(8, 2), unit(5, 4), unit(1, 3), unit(1, 3), unit(7, 2), unit(5, 1), unit(1, 1)))
    rows = B.gops(spark.createDataFrame([("s", raw), ("none", b"abc"), ("null", None)], "path string, content binary")).collect()
    assert [(r.gop, r.firstframe, r.nframes) for r in rows] == [(0, 0, 3), (1, 3, 2)]
    assert rows[0].b0 == 0 and rows[0].b1 + 1 == rows[1].b0 and rows[1].b1 == len(raw) - 1


def test_frames(spark, tmp_path):
    frames = spark.createDataFrame([(1, n) for n in range(30)], "seq_id long, frame long")
    B.write_frames(frames, f"file://{tmp_path}/out", "seq_id")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 30
    assert sorted(r.frame for r in B.decimated(frames, 30, 10).collect()) == list(range(10))
    with pytest.raises(ValueError):
        B.write_frames(frames.limit(0), f"file://{tmp_path}/none")

"""Streams give what the same rules give over the whole table; catalogs, models, history and projects behave."""

import random

import pytest
from pyspark.sql import functions as F

from cutloom.operators import catalog as C
from cutloom.sources import project as J
from cutloom.streaming import stateful as Z


def streamed(spark, tmp_path, frame, transform, parts=4):
    """What a stream over the frame's rows, in several files read one at a time, appends."""
    rows = sorted(map(tuple, frame.collect()), key=lambda r: r[1])
    folder = str(tmp_path / "in")
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], frame.schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    name = f"out_{random.randrange(10**9)}"
    query = transform(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted(map(tuple, spark.table(name).collect()))


def test_shuttle(spark, tmp_path):
    rng = random.Random(1)
    taps = spark.createDataFrame([(i % 3, i, rng.choice([1, 1, 1, -1])) for i in range(60)], "session long, at long, direction long")
    assert streamed(spark, tmp_path, taps, Z.shuttle_stream) == sorted(map(tuple, Z.shuttle(taps).collect()))
    rates = [0]
    for d in (1, 1, 1, 1, 1, -1, -1):
        rates.append(Z.next_rate(rates[-1], d))
    assert rates[1:] == [1, 2, 4, 8, 8, -1, -2]


def test_coalescing(spark, tmp_path):
    moves = spark.createDataFrame([(i % 2, i * 400_000) for i in range(50)], "session long, at long")
    assert streamed(spark, tmp_path, moves, Z.coalesced_stream) == sorted(map(tuple, Z.coalesced(moves).collect()))
    one = Z.coalesced(moves.where("session = 0")).orderBy("at").collect()
    assert [r.snapshot for r in one[:5]] == [True, False, True, False, True]


def test_catalog(spark):
    kinds = C.builtin()
    before = kinds.version
    kinds.expression("curve", "value * gain", params=(C.Param("gain", "Gain", 0, 1, 0.5),))
    kinds.expression("curve", "value * gain + 1", params=(C.Param("gain", "Gain", 0, 1, 0.5),))
    assert kinds.version == before + 2 and list(kinds.kinds)[-1] == "curve"
    rows = spark.createDataFrame([(1, 0.5)], "id long, value double")
    assert kinds.apply(rows, "curve", gain=0.25).first().value == 1.125
    assert kinds.kinds["levels"].keys == ["levels_low", "levels_high"]
    assert kinds.rows(spark).count() == 5


def test_models(spark):
    models, rows = C.Models(), spark.createDataFrame([(1,)], "id long")
    assert models.run("restore", rows) is rows
    with pytest.raises(LookupError):
        models.run("depth", rows)
    models.register("depth", lambda it: (b.assign(z=0.5) for b in it), "id long, z double")
    assert models.run("depth", rows).first().z == 0.5


def test_history(spark):
    tables = [spark.range(k) for k in range(4)]
    h = C.History({"clips": tables[0]})
    for t in tables[1:]:
        h.edit(clips=t)
    assert h.undo() and h.now["clips"] is tables[2] and h.redo() and not h.redo()
    h.undo()
    h.edit(clips=tables[0])
    assert not h.redo() and h.edits == 4


def test_project_defaults(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"framerate": 30.0, "clips": [{"source": "a", "src_in": 0, "src_out": 5, "start": 0, "timeinterp": "odd", "effects": [{"type": "blur", "params": {"sigma": 2}}]}, {"source": "b", "src_in": 0, "src_out": 5, "start": 5, "rate": 0.5, "blendfrom": "1"}]}')
    project = J.load(spark, f"file://{tmp_path}/p.json")
    a, b = J.clips(project).orderBy("ord").collect()
    assert (a.rate, a.track, a.timeinterp, a.blendfrom, b.rate, b.blendfrom) == (1.0, 1, "sample", 0, 0.5, 1)
    assert J.slots(project).first().enabled
    gone = J.missing(J.clips(project, "path"), spark.createDataFrame([("a",)], "source string"), "path").first()
    assert gone.missing == ["b"]


def test_windows_over_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", "click", 1.0) for i in range(40)], "id long, t string, event_type string, value double")
    events = rows.select("id", F.col("t").cast("timestamp").alias("ts"), "event_type", "value")
    got = streamed(spark, tmp_path, events, lambda s: Z.windowed(s, "1 minute", "10 minutes"))
    assert [r[2] for r in got] == [10, 10, 10]  # the last window is still open

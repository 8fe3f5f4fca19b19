import base64
import json

import pytest
from pyspark.sql import functions as F

from fixweave.sources import config, external, readers, writers
from fixweave.streaming import extract


def test_paths(monkeypatch):
    monkeypatch.setenv("FIXWEAVE_ROOT", "/data/")
    monkeypatch.setenv("FIXWEAVE_RESULTS", "/out")
    paths = config.Paths.from_environment()
    assert (paths.of("charts"), paths.of("results")) == ("/data/charts", "/out")


def test_json_files(spark, tmp_path):
    for name, text in {"a": '{"climb_altitude": 3000, "waypoints": ["X"], "holding_fix": ["Y"]}', "b": '{"x":', "c": "null", "d": "", "e": '{"waypoints": "X", "climb_altitude": true}'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows = readers.json_objects(spark, str(tmp_path))
    got = {r.sid: r for r in rows.select("sid", "has_output", *[c.alias(n) for n, c in readers.record_fields(F.col("record")).items()]).collect()}
    assert {k: r.has_output for k, r in got.items()} == {"a": True, "b": False, "c": False, "e": True}
    assert (got["a"].climb_altitude, got["a"].waypoints, got["a"].holding_fix) == ("3000", ["X"], None)
    assert (got["e"].waypoints, got["e"].climb_altitude) == (None, "true")


def test_arrays_keep_their_order(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"id": "b"}, {"id": "a", "holding_required": True}]))
    rows = readers.json_array(spark, str(tmp_path / "m.json"), readers.MANIFEST).orderBy("pos").collect()
    assert [(r.pos, r.id, r.holding_required) for r in rows] == [(0, "b", None), (1, "a", True)]


def test_latin1(spark, tmp_path):
    (tmp_path / "f.txt").write_bytes("caf\xe9 \n  x\n".encode("latin-1"))
    rows = readers.latin1_lines(spark, str(tmp_path / "f.txt")).collect()
    assert [(r.line_no, r.value) for r in rows] == [(0, "café "), (1, "  x")]
    assert sorted(r.value for r in readers.latin1_records(spark, str(tmp_path / "f.txt")).collect()) == ["  x", "café "]


def test_images_and_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(bytes(range(200)))
    (tmp_path / "b.png").write_bytes(b"1")
    got = {r.path[-5:]: r.base64 for r in readers.images(spark, str(tmp_path)).collect()}
    assert got["a.png"] == base64.standard_b64encode(bytes(range(200))).decode()
    assert readers.largest_file(spark, str(tmp_path), "*.png").endswith("a.png")
    listing = spark.read.format("binaryFile").load(str(tmp_path))
    assert [tuple(r) for r in writers.file_report(listing).collect()] == [("png", 2, 201)]
    name = lambda v: spark.createDataFrame([(v,)], "v string").select(readers.document_name(F.col("v"))).first()[0]
    assert name("data/x/00123i1_p0.png") == "00123I1.PDF"
    with pytest.raises(Exception, match="no page image"):
        name("x.png")
    assert spark.range(1).select(readers.relative_path(F.lit("data\\charts/a.png"))).first()[0] == "charts/a.png"


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("A", "x", 1, 0.12345), ("A", "y", 2, None)], "path string, field string, n int, p double")
    text = writers.markdown(df, "Scores", ["field"])
    assert "| A | x | 1 | 0.123 |" in text and "| A | y | 2 | N/A |" in text
    metrics = writers.nested_metrics(df, "path", "field", ["n", "p"]).first().metrics
    assert json.loads(metrics) == {"x": {"n": 1, "p": 0.12345}, "y": {"n": 2}}
    assert writers.percent(1, 3) == "33.3%" and writers.percent(1, 0) == "0.0%"
    writers.write_records(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_external_steps(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")
    got = external.apply_step(df, "t", "n", "int", lambda s: s.str.len().fillna(0).astype("int32"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", 1), (2, None, 0)]
    replies = spark.createDataFrame([(1, "x"), (1, "y")], "i int, text string")
    assert sorted((r.i, r.text) for r in external.replayed(df, replies, ["i"]).collect()) == [(1, "y"), (2, None)]


def test_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 10:00:00", "Climb to 900, left turn")], "at string, t string").selectExpr("cast(at as timestamp) at", "t").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, t string").parquet(str(tmp_path / "in"))
    query = extract.write_stream(extract.rule_stream(stream, "t", ["at"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert (row.climb_altitude, row.turn_direction) == (900, "LEFT")
    assert extract.counted(extract.rule_stream(stream, "t", ["at"]), "at").isStreaming

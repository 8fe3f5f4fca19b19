"""Lists looked up by key, first missing keys, rows after an anchor, typed scalars, and records of one key joined once."""

import pytest
from pyspark.sql import functions as F

from fixweave.operators.selection import first_missing, lookup_list
from fixweave.operators.sequence import after_first
from fixweave.sources.readers import first_lines, json_array, record_altitude, record_fields, template
from fixweave.sources.writers import write_array


def test_lookup_list_keeps_every_row(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("a", 4)], "k string, n int")
    right = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x"), ("c", "z"), (None, "w")], "k string, v string")
    got = {r.n: r.found for r in lookup_list(left, right, "k", F.col("v"), "found").collect()}
    assert got == {1: ["x", "y"], 4: ["x", "y"], 2: [], 3: []}


def test_first_missing_is_ordered_and_limited(spark):
    left, right = spark.range(0, 30).toDF("k"), spark.range(5, 40).toDF("k")
    assert [tuple(r) for r in first_missing(left, right, "k", 7).collect()] == [(k, "left") for k in range(5)] + [(30, "right"), (31, "right")]


def test_after_first_with_null_keys_and_ties(spark):
    rows = [("a", 1, "x"), ("a", 2, "go"), ("a", 2, "tie"), ("a", 3, "y"), ("a", 4, "go"), (None, 1, "go"), (None, 2, "z"), ("b", 1, "x"), ("c", None, "go"), ("c", 1, "w")]
    df = spark.createDataFrame(rows, "k string, t int, v string")
    got = sorted((r.k or "", r.v) for r in after_first(df, "k", ["t"], F.col("v") == "go").collect())
    assert got == [("", "z"), ("a", "go"), ("a", "y"), ("c", "w")]
    assert after_first(df.where("false"), "k", ["t"], F.col("v") == "go").count() == 0


@pytest.mark.parametrize(
    "record, altitude, holding",
    [
        ('{"climb_altitude": 3000, "holding_required": true}', "3000", "true"),
        ('{"climb_altitude": 3000.0, "holding_required": 1}', None, None),
        ('{"climb_altitude": 3000.5, "holding_required": "no"}', None, "no"),
        ('{"climb_altitude": true, "holding_required": false}', "true", "false"),
        ('{"climb_altitude": "3,000", "holding_required": [true]}', "3,000", None),
        ('{"climb_altitude": null}', None, None),
        ("{}", None, None),
    ],
)
def test_scalars_keep_their_json_types(spark, record, altitude, holding):
    made = record_fields(F.col("v"))
    row = spark.createDataFrame([(record,)], "j string").select(F.try_parse_json("j").alias("v")).select(made["climb_altitude"].alias("a"), made["holding_required"].alias("h")).first()
    assert (row.a, row.h) == (altitude, holding)


def test_a_truth_value_passes_as_an_altitude(spark):
    df = spark.createDataFrame([(f'{{"climb_altitude": {x}}}',) for x in ("true", "false", "4500", '"4500"', "4500.0", '"true"', "null")], "j string")
    assert [r[0] for r in df.select(record_altitude(F.try_parse_json("j"))).collect()] == [1, 0, 4500, 4500, None, None, None]


def test_json_array_and_template_over_several_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"k": 1,\n  "v": "x"},\n {"k": 2, "v": null}\n]\n')
    rows = json_array(spark, str(tmp_path / "a.json"), "k int, v string").collect()
    assert [tuple(r) for r in rows] == [(0, 1, "x"), (1, 2, None)]
    (tmp_path / "t.txt").write_text("\nOne {a}\n\nTwo\n")
    assert template(spark, str(tmp_path / "t.txt")) == "One {a}\n\nTwo"
    write_array(spark.createDataFrame([(3, None), (4, "y")], "k int, v string"), str(tmp_path / "out"))
    assert [tuple(r) for r in json_array(spark, str(tmp_path / "out"), "k int, v string").collect()] == [(0, 3, None), (1, 4, "y")]


def test_first_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é1\nb\n\nc\nd\n".encode("latin-1"))
    assert [(r.line_no, r.value) for r in first_lines(spark, str(tmp_path / "a.txt"), 3).collect()] == [(0, "é1"), (1, "b"), (3, "c")]

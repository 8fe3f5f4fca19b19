import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixweave.operators import flooding
from fixweave.operators.drift import failed_casts, neighbours, schema_changes, to_number, unify
from fixweave.operators.flooding import Field, correspondences, flood, name_likeness, name_tokens

SCHEMA = "feed string, file_no int, payload string, key string, size string"


def frame(spark, files):
    rows = [(f, n, p if isinstance(p, str) or p is None else json.dumps(p), "k", "s") for (f, n), payloads in files.items() for p in payloads]
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, files):
    return sorted(map(tuple, schema_changes(frame(spark, files)).collect()))


def test_names():
    assert name_tokens("climbAltitude_2") == ["climb", "altitude2"]
    assert name_tokens("_q") == ["q"]
    assert name_likeness("climb_alt", "climb_altitude") > 0.8
    assert name_likeness("q7", "q8") == 0


def test_flood_prefers_the_field_it_came_from():
    a = [Field("height", "number", {"n4": 10.0}), Field("wait", "boolean", {"b": 10.0}), Field("text", "string", {"sa": 10.0})]
    b = [Field("text", "string", {"sa": 10.0}), Field("wait_required", "boolean", {"b": 10.0}), Field("height_ft", "number", {"n4": 9.0})]
    score = flood(a, b)
    assert score.argmax(axis=1).tolist() == [2, 1, 0]
    assert correspondences(a, b, {"height", "wait"}, {"height_ft", "wait_required"}) == [("height", "height_ft"), ("wait", "wait_required")]
    assert flood([], b).shape == (0, 3) and correspondences([], [], set(), set()) == []


def record(**more):
    return {"alt": 4500, "text": "Climb to 4500 and hold", "ok": True, "q": {"Q1": "yes", "Q2": "no"}} | more


def without(d, *keys):
    return {k: v for k, v in d.items() if k not in keys}


def test_changes(spark):
    base = [record(alt=1000 * i) for i in range(1, 10)]
    files = {
        ("f", 1): base,
        ("f", 2): [without(r, "alt") | {"altitude_ft": r["alt"]} for r in base] + [{"altitude_ft": 1}, None, '{"alt":', "[1]"],
        ("f", 3): [without(r, "alt", "ok") | {"altitude_ft": str(r["alt"]), "seconds": 41} for r in base],
        ("f", 5): [without(r, "alt", "ok", "q") | {"altitude_ft": str(r["alt"]), "seconds": 42, "sheet": {"Q1": True, "q2": "no", "Q3": "no"}} for r in base],
        ("f", 6): ["{", None],
        ("g", 1): base,
        ("g", 2): base[:4] + [r | {"stray": 1} for r in base[4:6]],
    }
    assert changes(spark, files) == sorted(
        [
            ("f", 2, "renamed", "alt", "altitude_ft"),
            ("f", 3, "removed", "ok", ""),
            ("f", 3, "added", "", "seconds"),
            ("f", 3, "retyped", "altitude_ft", "altitude_ft"),
            ("f", 5, "renamed", "q", "sheet"),
            ("f", 5, "retyped", "sheet.Q1", "sheet.Q1"),
            ("f", 5, "renamed", "sheet.Q2", "sheet.q2"),
            ("f", 5, "added", "", "sheet.Q3"),
        ]
    )


def test_removed_and_added_are_no_rename(spark):
    base = [record() for _ in range(6)]
    found = changes(spark, {("f", 1): base, ("f", 2): [without(r, "ok") | {"reviewed": True} for r in base]})
    assert found == [("f", 2, "added", "", "reviewed"), ("f", 2, "removed", "ok", "")]


def test_empty_and_single_files(spark):
    assert changes(spark, {}) == []
    assert changes(spark, {("f", 1): [record()]}) == []
    assert changes(spark, {("f", 1): [None, ""], ("f", 2): [record()]}) == []
    long = record(text="x" * 300_000)
    assert changes(spark, {("f", 1): [long], ("f", 2): [long]}) == []


def test_unify(spark):
    files = {
        ("f", 1): [record(alt=4500), record(alt="8,200"), record(alt="unknown")],
        ("f", 2): [without(record(), "alt") | {"altitude_ft": v} for v in ({"feet": 3000}, [3100], "3200 ft")],
        ("f", 3): [without(record(), "alt") | {"altitude_ft": 7, "q": "Q1: no; Q2: uncertain", "ok": "N", "more": 1}, '{"alt":'],
    }
    table = unify(frame(spark, files), {"alt": "number", "ok": "boolean", "q": "answers"})
    rows = sorted(((r.file_no, r.well_formed, r.alt, r.ok, r.q, tuple(sorted((r.extras or {}).items()))) for r in table.collect()), key=repr)
    text = ("text", "Climb to 4500 and hold")
    yes = {"Q1": "yes", "Q2": "no"}
    assert rows == sorted(
        [(1, True, 4500.0, True, yes, (text,)), (1, True, 8200.0, True, yes, (text,)), (1, True, None, True, yes, (text,))]
        + [(2, True, v, True, yes, (text,)) for v in (3000.0, 3100.0, 3200.0)]
        + [(3, True, 7.0, False, {"Q1": "no", "Q2": "uncertain"}, (("more", "1"), text)), (3, False, None, None, None, ())],
        key=repr,
    )


def test_acceptance_comes_from_the_flooded_scores(monkeypatch):
    """With constant scores other pairs are taken, and with scores of 0 none."""
    text = lambda name, *words: Field(name, "string", {"s1": 9.0}, {w: 3.0 for w in words})
    a = [text("instruction", "climb", "hold"), text("remark", "none", "printed"), Field("height", "number", {"n4": 9.0})]
    b = [text("note", "none", "printed"), text("order", "climb", "hold"), Field("height", "number", {"n4": 9.0})]
    gone, new = {"instruction", "remark"}, {"note", "order"}
    assert correspondences(a, b, gone, new) == [("remark", "note"), ("instruction", "order")] or correspondences(a, b, gone, new) == [("instruction", "order"), ("remark", "note")]
    monkeypatch.setattr(flooding, "flood", lambda a, b: np.ones((len(a), len(b))))
    assert flooding.correspondences(a, b, gone, new) == [("instruction", "note"), ("remark", "order")]
    monkeypatch.setattr(flooding, "flood", lambda a, b: np.zeros((len(a), len(b))))
    assert flooding.correspondences(a, b, gone, new) == []


def test_other_prose_is_no_rename(spark):
    one = [record(text=f"climb straight ahead to the beacon number {i} and hold there") for i in range(8)]
    two = [without(r, "text") | {"weather": f"broken clouds with light rain over gate {i} since this morning"} for i, r in enumerate(one)]
    assert changes(spark, {("f", 1): one, ("f", 2): two}) == [("f", 2, "added", "", "weather"), ("f", 2, "removed", "text", "")]
    same = [without(r, "text") | {"narrative": r["text"]} for r in one]
    assert changes(spark, {("f", 1): one, ("f", 2): same}) == [("f", 2, "renamed", "text", "narrative")]


def test_neighbours_across_runs_of_files(spark):
    files = [("a", n) for n in (1, 2, 3, 9, 10, 30)] + [("b", 7)] + [("c", n) for n in range(1, 12)]
    df = spark.createDataFrame([(f, n, f"{f}{n}") for f, n in files], "feed string, file_no int, profile string")
    got = sorted((r.feed, r.file_no, r.before, r.profile) for r in neighbours(df, 4).collect())
    want = [(f, n, f"{f}{m}", f"{f}{n}") for (g, m), (f, n) in zip(files, files[1:]) if f == g]
    assert got == sorted(want)


@pytest.mark.parametrize(
    "text, number",
    [("8200", 8200), ("8,200", 8200), ("-3.5", -3.5), ("9500 ft", 9500), ("9500FEET", 9500), ("[11800]", 11800), ('["8,200"]', 8200), ('{"feet":4000,"text":"Climb to 300"}', 4000), ("1e4", 10000), ("1,234,567.5", 1234567.5)]
    + [(x, None) for x in ("FL180", "RW09", "914 m", "8 200", "unknown", "", "[1,2]", "[1200,1300]", '{"meters":900}', "8,20", "1,2", "0x10", "Climb to 4000", None, "[]", "{}")],
)
def test_numbers_are_not_invented(spark, text, number):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(to_number(F.col("t"))).first()[0] == number


def test_uncast_values_and_reused_names(spark):
    base = [record(alt=4500 + i) for i in range(4)]
    later = [without(record(), "alt") | {"altitude_ft": 5000 + i, "alt": "note"} if i == 0 else without(record(), "alt") | {"altitude_ft": 5000 + i} for i in range(4)]
    later[1] = without(later[1], "altitude_ft") | {"alt": 1}
    later[2]["altitude_ft"] = "FL180"
    df = frame(spark, {("f", 1): base, ("f", 2): later})
    table = unify(df, {"alt": "number", "ok": "boolean"})
    rows = {r.alt: r for r in table.where("file_no = 2").collect()}
    assert set(rows) == {5000.0, None, 5003.0} and rows[5000.0].extras["alt"] == "note"
    lost = [r for r in table.where("file_no = 2 and alt is null").collect()]
    assert sorted((r.uncast, r.extras.get("alt")) for r in lost if r.uncast) == [({"alt": "FL180"}, None)] and {r.extras.get("alt") for r in lost} == {"1", None}
    assert [tuple(r) for r in failed_casts(table).collect()] == [("f", "alt", 1, "FL180")]

"""Every word of prose counts, as itself, in what p2 compares."""

import json
import re
from collections import Counter

import pytest

from fixweave.operators import drift
from fixweave.operators.drift import schema_changes
from fixweave.operators.flooding import Field, correspondences

SCHEMA = "feed string, file_no int, payload string"


def frame(spark, files):
    return spark.createDataFrame([(f, n, json.dumps(p)) for (f, n), payloads in files.items() for p in payloads], SCHEMA)


def record(**prose):
    return {"alt": 4500, "ok": True} | prose


@pytest.mark.parametrize(
    "one, two",
    [
        # no word of these has a hash that 4 divides
        ("climb left inbound hold beacon course radial", "clouds light rain gate morning wind north"),
        # these have, and fall pairwise into one of 256 buckets
        ("fog run fit", "cut too boy"),
    ],
)
def test_unlike_words_are_no_rename(spark, one, two):
    files = {("f", 1): [record(memo=one)] * 5, ("f", 2): [record(line=two)] * 5, ("f", 3): [record(remark=two)] * 5}
    found = sorted(map(tuple, schema_changes(frame(spark, files)).collect()))
    assert found == [("f", 2, "added", "", "line"), ("f", 2, "removed", "memo", ""), ("f", 3, "renamed", "line", "remark")]


def test_words_are_counted_whole(spark):
    texts = ["Climb to 4000, then climb ON course", "  climb - hold\nat the fix  ", "été à Orly puis 9 Übergänge", "one", "1 2 3", "", "x" * 300_000 + " y"]
    df = frame(spark, {("f", 1): [record(memo=t) for t in texts] + [record(memo=None), record(memo=7)]})
    got = {r.mark[1:]: r.n for r in drift.file_counts(df).where("key = 'memo' and mark like 'w%'").collect()}
    want = Counter(w for t in texts if " " in t for w in set(re.findall(r"[^\W\d_]+", t.lower())))
    assert got == dict(want)


def test_pairs_of_files_hold_the_counts_of_both(spark):
    """Files far apart, in several runs of numbers, meet with all their fields."""
    numbers = [1, 2, 5, 300, 301, 900]
    files = {("f", n): [record(**{f"memo{i}": f"climb and hold {'abcdef'[i]}"})] * 3 for i, n in enumerate(numbers)}
    files |= {("g", 7): [record(memo="never met")], ("h", 1): [{}], ("h", 2): [record()], ("h", 3): [{}, {}]}
    found = sorted(map(tuple, schema_changes(frame(spark, files)).collect()))
    renamed = [("f", n, "renamed", f"memo{i}", f"memo{i + 1}") for i, n in enumerate(numbers[1:])]
    assert found == renamed + [("h", 2, "added", "", "alt"), ("h", 2, "added", "", "ok"), ("h", 3, "removed", "alt", ""), ("h", 3, "removed", "ok", "")]


@pytest.mark.parametrize("n", [1, 30, 1000])
def test_many_words_weigh_no_more_than_few(n):
    """Renames are found beside prose of any length."""
    prose = lambda name: Field(name, "string", {"ss1": 9.0}, {f"w{name}{i}": 1.0 + i % 7 for i in range(n)})
    same = [prose(x) for x in ("memo", "line", "note")]
    a = [*same, Field("height", "number", {"ns2": 9.0}), Field("wait", "boolean", {"bsb": 9.0})]
    b = [*same, Field("elevation", "number", {"ns2": 9.0}), Field("wait_required", "boolean", {"bsb": 9.0})]
    assert sorted(correspondences(a, b, {"height", "wait"}, {"elevation", "wait_required"})) == [("height", "elevation"), ("wait", "wait_required")]


def test_fields_of_very_many_words():
    """A score for each pair of all 80,000 words would take 51 GB."""
    spell = lambda i: f"w{i:05d}"
    memo, line = ({spell(i): 2.0 for i in range(start, start + 40_000)} for start in (0, 100_000))
    a = [Field("memo", "string", {"ss1": 9.0}, memo), Field("line", "string", {"ss1": 9.0}, line), Field("alt", "number", {"ns2": 9.0})]
    b = [Field("one", "string", {"ss1": 9.0}, dict(line)), Field("two", "string", {"ss1": 9.0}, dict(memo)), Field("alt", "number", {"ns2": 9.0})]
    assert sorted(correspondences(a, b, {"memo", "line"}, {"one", "two"})) == [("line", "one"), ("memo", "two")]

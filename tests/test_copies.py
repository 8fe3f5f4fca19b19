import random
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fixweave.operators.copies import diff_copies, list_form, number_form, split_points, text_form

SCHEMA = "k long, alt string, fix string, pts array<string>, at timestamp, __fw_side string, field string"
FIELDS = {"alt": number_form, "fix": text_form, "pts": list_form}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "extra", "extra") for r in rows], SCHEMA)


def found(spark, left, right):
    return sorted((tuple(r) for r in diff_copies(frame(spark, left), frame(spark, right), ["k"], FIELDS, "at", ("a", "b")).collect()), key=repr)


def at(day):
    return datetime(2024, 1, day)


def test_values_missing_rows_and_latest_state(spark):
    left = [
        (1, "4500", "ABCDE", ["X", "Y"], at(1)),
        (2, " +04500.0 ", " abcde", ["x ", "y"], at(1)),
        (3, None, "", None, at(1)),
        (4, "unknown", "A", [], at(1)),
        (5, "1", "OLD", [], at(1)),
        (5, "1", "NEW", [], at(2)),
        (5, "1", "NEW", [], at(2)),
        (6, "1", "A", ["A", "B"], at(1)),
        (7, "1", "A", ["A"], at(1)),
        (None, "1", "A", [], None),
    ]
    right = [
        (1, "4600", "ABCDE", ["X", "Y"], at(3)),
        (2, "4500", "ABCDE", ["X", "Y"], at(1)),
        (3, "", None, [], at(1)),
        (4, None, "A", None, at(1)),
        (5, "1.0", "new", [], at(1)),
        (6, "1", "A", ["B", "A"], at(1)),
        (8, "1", "A", [], at(1)),
        (None, "1", "B", [], None),
    ]
    assert found(spark, left, right) == sorted(
        [
            (1, "alt"),
            (3, "alt"), (3, "fix"), (3, "pts"),
            (4, "alt"), (4, "pts"),
            (6, "pts"),
            (7, "row_missing_in_b"),
            (8, "row_missing_in_a"),
            (None, "fix"),
        ],
        key=repr,
    )


def test_empty_tables(spark):
    assert found(spark, [], []) == []
    assert found(spark, [(1, "1", "A", [], at(1))], []) == [(1, "row_missing_in_b")]
    assert found(spark, [], [(1, "1", "A", [], at(1))]) == [(1, "row_missing_in_a")]


def test_very_long_value(spark):
    text = "x" * 500_000
    assert found(spark, [(1, "1", text, [], at(1))], [(1, "1", text + "y", [], at(1))]) == [(1, "fix")]


row = st.tuples(st.integers(0, 5), st.sampled_from(["1", "01", "-0", "0", None, "unknown", "1.50", "1.5"]), st.sampled_from(["a", "A ", "", None]), st.sampled_from([None, [], ["a"], ["A "], ["a", None]]), st.just(at(1)))


def plain(row):
    def text(v):
        return v if v is None else v.strip().lower()

    def number(v):
        try:
            return float(v)
        except (TypeError, ValueError):
            return text(v)

    return number(row[1]), text(row[2]), row[3] if row[3] is None else [text(x) for x in row[3]]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(left=st.lists(row, max_size=6, unique_by=lambda r: r[0]), right=st.lists(row, max_size=6, unique_by=lambda r: r[0]))
def test_against_brute_force(spark, left, right):
    a, b = {r[0]: plain(r) for r in left}, {r[0]: plain(r) for r in right}
    expected = [(k, "row_missing_in_b") for k in a.keys() - b.keys()] + [(k, "row_missing_in_a") for k in b.keys() - a.keys()]
    expected += [(k, f) for k in a.keys() & b.keys() for f, x, y in zip(FIELDS, a[k], b[k]) if x != y]
    assert found(spark, left, right) == sorted(expected, key=repr)


def test_merge_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        left = [(k, str(k), "A", [], at(1)) for k in range(50)]
        right = [(k, str(k + (k % 7 == 0)), "A", [], at(1)) for k in range(50) if k % 5]
        expected = [(k, "row_missing_in_b") for k in range(0, 50, 5)] + [(k, "alt") for k in range(50) if k % 5 and k % 7 == 0]
        assert found(spark, left, right) == sorted(expected, key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("keys", [["k"], ["s"], ["k", "s"], ["d", "k"]])
def test_ranges_and_hot_keys(spark, keys):
    """Many ranges, keys beyond the floats' whole numbers, null keys, and keys with a third of all rows."""
    r = random.Random(5)
    big = 2**60

    def rows(seed):
        q = random.Random(seed)
        out = []
        for i in range(1500):
            k = r.choice([big, big, None, *(big + q.randrange(400) for _ in range(4))])
            s = "hot" if k == big else f"s{q.randrange(9)}" if k is not None else None
            out.append((k, s, datetime(2024, 1, 1 + (k or 0) % 28), q.randrange(50), q.choice(["x", "y", None])))
        return out

    schema = "k long, s string, d timestamp, at int, v string"
    left, right = rows(1), rows(2)
    frames = [spark.createDataFrame(x, schema).repartition(5) for x in (left, right)]
    got = [tuple(x) for x in diff_copies(*frames, keys, {"v": text_form}, "at", ranges=7).collect()]
    place = {"k": 0, "s": 1, "d": 2}
    least = lambda v: (v is not None, v if v is not None else "")

    def latest(x):
        out = {}
        for row in x:
            key = tuple(row[place[k]] for k in keys)
            out[key] = max(out.get(key, ((-1,), None)), ((row[3], least(row[4])), row[4]), key=lambda t: t[0])
        return {k: v[1] for k, v in out.items()}

    a, b = latest(left), latest(right)
    want = [(*k, "row_missing_in_right") for k in a.keys() - b.keys()] + [(*k, "row_missing_in_left") for k in b.keys() - a.keys()]
    want += [(*k, "v") for k in a.keys() & b.keys() if a[k] != b[k]]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    points, hot = split_points(frames[0].unionByName(frames[1]).select("k"), 7)
    assert {x.k for x in hot} >= {big, None} and len(points) > 2

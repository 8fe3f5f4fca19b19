import json
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fixweave.operators.nested import find_entries, flatten_entries, flatten_records
from fixweave.operators.structural import StructuralIndex

value = st.recursive(
    st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(max_size=4), inner, max_size=3),
    max_leaves=12,
)


def well_formed(text):
    try:
        return isinstance(json.loads(text, parse_constant=lambda _: 1 / 0), (dict, list))
    except (ValueError, ZeroDivisionError, RecursionError):
        return False


@settings(max_examples=150, deadline=None)
@given(values=st.lists(value, min_size=1, max_size=5), seed=st.integers(0, 10**6), ascii_only=st.booleans())
def test_index_agrees_with_a_parser(values, seed, ascii_only):
    r = random.Random(seed)
    texts = []
    for v in values:
        text = json.dumps([v], ensure_ascii=ascii_only, indent=r.choice([None, 1])).encode("utf-8", "surrogatepass")
        if r.random() < 0.5:
            text = bytearray(text)
            text[r.randrange(len(text))] = r.choice(b'{}[],:"\\ 1t')
            text = bytes(text)
        elif r.random() < 0.3:
            text = text[: r.randrange(len(text) + 1)]
        try:
            text.decode()
        except UnicodeDecodeError:
            continue
        texts.append(text)
    index = StructuralIndex(texts)
    assert index.ok.tolist() == [well_formed(t.decode()) for t in texts]


def test_parents_and_keys():
    index = StructuralIndex([b'{"a": [1, {"b": "x"}], "c": {"d": null}}'])
    assert index.ok.tolist() == [True]
    hits = np.flatnonzero(index.named("b") | index.named("d"))
    assert [index.text(t) for t in hits] == ["x", None]
    assert [index.text(index.key[index.parent[t]]) if index.key[index.parent[t]] >= 0 else None for t in hits] == [None, "c"]


def legs(body):
    found, ok = find_entries([body.encode()], "legs", ["rt", "wpt"])
    return list(zip(found.values["rt"], found.values["wpt"])), bool(ok[0])


def test_layouts():
    a, b = {"rt": "A", "wpt": "1"}, {"rt": "B", "wpt": "2"}
    expected = [("A", "1"), ("B", "2")]
    for layout in (
        {"legs": [a, None, {}, b]},
        {"legs": [[a], [b]]},
        {"x": {"legs": {"020": b, "010": a}}},
        {"x": {"legs": {"10": b, "9": a}}},
        {"legs": json.dumps([a, b])},
        {"t": [{"legs": [a]}, {"legs": None}, {"legs": []}, {"legs": [b]}]},
        {"t": [{"legs": a}, {"legs": b}]},
        [{"legs": [{"k": {"rt": "A"}, "f": [{"wpt": "1"}]}]}, {"legs": [b]}],
    ):
        for indent in (None, 2):
            assert legs(json.dumps(layout, indent=indent)) == (expected, True), layout
    assert legs('{"legs": "[{\\"rt\\": "}') == ([], True)
    assert legs('{"legs": [{"rt": "A"}') == ([], False)
    assert legs("") == ([], False)
    assert legs('{"legs": [{"rt": "A", "legs": [{"rt": "inner"}]}]}')[0] == [("A", None)]
    assert legs('{"l\\u0065gs": [{"rt": "\\u0041"}]}')[0] == [("A", None)]


SCHEMA = "id long, body string, c struct<airport:string,legs:array<struct<rt:string,wpt:string>>>, leg_no string"


def test_table(spark):
    rows = [
        (1, '{"c": {"airport": " K ", "legs": [{"rt": " A ", "wpt": null}, {"wpt": "W"}]}}', None, "x"),
        (1, '{"c": {"airport": " K ", "legs": [{"rt": " A ", "wpt": null}, {"wpt": "W"}]}}', None, "x"),
        (2, None, ("L", [("B ", "V"), None, (None, None), (None, "U")]), "x"),
        (3, '{"c": ', None, "x"),
        (4, None, None, "x"),
        (5, None, (None, None), "x"),
        (None, '{"legs": [{"rt": "N"}]}', None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    out = flatten_entries(df, "id", "body", "c.legs", "legs", ["rt", "wpt"], number="no")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, 1, "A", ""), (1, 2, "", "W")] * 2 + [(2, 1, "B", "V"), (2, 2, "", "U"), (None, 1, "N", "")], key=repr)
    parents = flatten_records(df, ["id"], "body", "c", "legs", ["airport"])
    assert sorted(map(tuple, parents.collect()), key=repr) == sorted(
        [(1, "K", True, 2)] * 2 + [(2, "L", True, 2), (3, "", False, 0), (4, "", False, 0), (5, "", True, 0), (None, "", True, 1)], key=repr
    )
    assert flatten_entries(df.where("false"), "id", "body", "c.legs", "legs", ["rt"]).count() == 0


def test_long_and_deep_texts():
    many = json.dumps({"legs": [{"rt": str(i)} for i in range(20_000)]})
    assert len(legs(many)[0]) == 20_000
    deep = '{"a":' * 2000 + '{"legs":[{"rt":"D"}]}' + "}" * 2000
    assert legs(deep) == ([("D", None)], True)

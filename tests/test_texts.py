from pyspark.sql import functions as F

from fixweave.functions import responses as R
from fixweave.functions import textrules as X

TEXT = "MISSED APPROACH: Climb to 700 then climbing left turn to 4500 direct EVVIS and hold, continue climb-in-hold to 4500."


def rules(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(*[c.alias(n) for n, c in X.record(F.col("t")).items()]).first()


def test_rules(spark):
    r = rules(spark, TEXT)
    assert (r.climb_altitude, r.turn_direction, r.holding_required, r.holding_fix, r.waypoints) == (4500, "LEFT", True, "EVVIS", ["EVVIS"])
    r = rules(spark, "Climb to 99001 and turn right to abcde, track 123 to FGHIJ")
    assert (r.climb_altitude, r.turn_direction, r.holding_required, r.holding_fix) == (None, "RIGHT", False, None)
    assert r.waypoints == ["ABCDE", "FGHIJ"]
    for empty in (None, "", "  "):
        assert rules(spark, empty).raw_instruction == "unknown"


def test_hold_falls_back_to_the_first_waypoint(spark):
    assert rules(spark, "Climb direct CLIMB and hold near QWERT").holding_fix == "QWERT"
    assert rules(spark, "TO ABC/DEF 12 DME AND HOLD").holding_fix == "ABC"


def page(spark, lines):
    return X.page_instructions(spark.createDataFrame([(1, lines)], "k int, l array<string>"), F.col("l"), ["k"]).first().instruction


def test_page_instruction(spark):
    lines = ["TOWER 118.3", "ELEV 100", "MISSED APPROACH: Climb to 3000", "direct EVVIS and hold. ATIS 120.5", "then HOLD at EVVIS", "nothing", "123.45"]
    assert page(spark, lines) == "MISSED APPROACH: Climb to 3000 then HOLD at EVVIS"
    assert page(spark, ["x", "MISSED APPROACHClimb to 9000", "turn left"]) == "MISSED APPROACHClimb to 9000 turn left"
    equal = ["MISSED APPROACH climb AAAAA", *["-"] * 12, "MISSED APPROACH climb BBBBB"]
    assert page(spark, equal) == "MISSED APPROACH climb AAAAA"
    assert page(spark, ["nothing here"]) == "" and page(spark, []) == "" and page(spark, None) == ""


def parsed(spark, make, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_answers(spark):
    assert parsed(spark, R.altitude, ["4,000 ft", "123456", "unknown", "", None]) == [4000, 12345, None, None, None]
    assert parsed(spark, R.waypoints, ['["a", null, ""]', 'Points: ["b"] ok', "none", "[", None]) == [["A", "NONE"], ["B"], [], [], []]
    assert parsed(spark, R.turn, ["left ", "ahead"]) == ["LEFT", "unknown"]
    assert parsed(spark, lambda v: R.holding_fix(v, F.lit(False)), ["null", "unknown", "at MUDRE"]) == [None, None, "MUDRE"]
    assert parsed(spark, lambda v: R.holding_fix(v, F.lit(True)), ["null", "unknown", "1"]) == [None, "unknown", "unknown"]
    assert parsed(spark, R.instruction, ["", "Unknown", "track 10掳"]) == ["unknown", "unknown", "track 10°"]


def test_responses(spark):
    found = parsed(spark, lambda v: R.json_object(R.after_marker(v)).cast("string"), ['a\nJSON:\n{"x":1}\nend', '{"a":1} {"b":2}', "none", '{"a":1', None])
    assert found == ['{"x":1}', None, None, None, None] or found[1] == '{"a":1}'
    got = parsed(spark, lambda v: R.questionnaire(v, 3), ["Q1: YES\nQ3: uncertain"])
    assert got == [{"Q1": "yes", "Q2": "not_found", "Q3": "uncertain"}]
    assert parsed(spark, lambda v: R.fill("<{text}>", text=v), ["a"]) == ["<a>"]

import pytest
from pyspark.sql import functions as F

from fixweave.operators import fixed_width, selection, sequence

LEGS = "array<struct<trans_ident:string,seq_no:string,rt_type:string,wpt_ident:string,altitude1:string,alt_desc:string>>"
SCHEMA = f"pair_no long, chart_no long, id string, cifp struct<airport:string,proc_ident:string,legs:{LEGS}>"


def leg(rt, wpt="", alt=None, trans="R", seq="010", desc=" "):
    return (f"{trans:6}", seq, f"{rt:3}", f"{wpt:6}", alt, desc)


def records(spark, *procedures):
    df = spark.createDataFrame([(i, i, "x", ("KAAA", "R01  ", legs)) for i, legs in enumerate(procedures)], SCHEMA)
    return sequence.procedure_records(df).orderBy("pair_no").collect()


RW = leg("TF", "RW01")


def test_no_runway_leg_gives_no_legs(spark):
    r = records(spark, [leg("IF", "AAAAA"), leg("CA", alt=" 1000")])[0]
    assert (r.transition, r.raw_instruction, r.climb_altitude, r.waypoints, r.holding_required, r.holding_fix) == ("R", "unknown", None, [], False, None)


def test_altitude_falls_back_to_the_greatest(spark):
    r = records(spark, [RW, leg("DF", "AAAAA", " 3000"), leg("HM", "AAAAA", " 4000")])[0]
    assert r.climb_altitude == 4000 and r.waypoints == []


def test_after_course_leg(spark):
    legs = [leg("IF", "ZZZZZ"), RW, leg("CA", alt="  700", desc="+"), leg("DF", "", " FL18"), leg("DF", "EVVIS", " 4000", desc="+", seq="030"), leg("TF", "EVVIS"), None, leg("CA", alt="9000"), leg("HM", "", " 4000")]
    r = records(spark, legs)[0]
    assert (r.climb_altitude, r.waypoints, r.turn_trigger, r.direct_seq) == (4000, ["EVVIS"], "EVVIS", "010")
    assert (r.holding_required, r.holding_fix) == (True, "unknown")
    assert r.raw_instruction == "CA 700+ft -> DF -> DF EVVIS 4000+ft -> TF EVVIS -> CA 9000ft -> HM 4000ft"


def test_first_runway_leg_decides_the_transition(spark):
    r = records(spark, [leg("TF", "RW09", trans="X"), RW, leg("CA", trans="X"), leg("DF", "BBBBB", trans="X"), leg("DF", "CCCCC")])[0]
    assert r.transition == "X" and r.waypoints == ["BBBBB"]


def test_null_and_empty_legs(spark):
    for r in records(spark, None, []):
        assert r.raw_instruction == "unknown" and r.transition is None


def test_fixed_width_round_trip_and_guards(spark):
    values = {"airport": "KAAA", "proc_ident": "R01", "trans_ident": "R", "seq_no": "030", "turn_dir": "L", "rt_type": "DF"}
    line = fixed_width.render(fixed_width.APPROACH, {k: F.lit(v) for k, v in values.items()})
    text = spark.range(1).select(line.alias("v")).first().v
    assert len(text) == 60 and text[6:10] == "KAAA" and text[12] == "F" and text[43] == "L"
    lines = [text, text[:48], "X" + text[1:], text[:12] + "D" + text[13:], text[:38] + "2" + text[39:], None, ""]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "n int, v string")
    assert [r.asDict() for r in fixed_width.parse(df, "v").collect()] == [values]


def test_first_line_wins_and_lookup(spark):
    index = fixed_width.first_wins(spark.createDataFrame([("A", "R", 2), ("A", "L", 1), ("B", "", 3)], "k string, turn string, n int"), ["k"], "turn", "n")
    rows = spark.createDataFrame([("A", 1), ("C", 2), (None, 3)], "key string, i int")
    assert sorted((r.i, r.turn) for r in fixed_width.lookup(rows, index, {"key": "k"}, "turn").collect()) == [(1, "L"), (2, ""), (3, "")]


def test_selection(spark):
    df = spark.createDataFrame([(i, "RL"[i % 2], i % 7) for i in range(400)], "k long, s string, g int")
    got = selection.stratified(df, "k", "s", {"R": 5, "L": 3}, "g", 2, 7).collect()
    again = selection.stratified(df.repartition(5), "k", "s", {"R": 5, "L": 3}, "g", 2, 7).collect()
    assert {r.k for r in got} == {r.k for r in again}
    assert sum(r.s == "R" for r in got) <= 5 and sum(r.s == "L" for r in got) <= 3
    assert max(sum(r.g == g for r in got) for g in range(7)) <= 2
    both = selection.missing_keys(df.where("k < 3"), df.where("k between 2 and 4"), "k")
    assert sorted((r.k, r.only_in) for r in both.collect()) == [(0, "left"), (1, "left"), (3, "right"), (4, "right")]


def test_strict_join(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string"), spark.createDataFrame([(1, "c"), (2, "d"), (3, "e")], "k long, y string")
    assert sorted((r.k, r.x, r.y) for r in selection.strict_join(left, right, "k").collect()) == [(1, "a", "c"), (2, "b", "d")]
    with pytest.raises(Exception, match="no partner for 2"):
        selection.strict_join(left, right.where("k <> 2"), "k").collect()
    assert selection.expect_rows(left, 2, "left") is left
    with pytest.raises(ValueError, match="2 rows, not 3"):
        selection.expect_rows(left, 3, "left")


def test_rows(spark):
    df = spark.createDataFrame([("u", t, e) for t, e in enumerate("axbxc")], "u string, t int, e string")
    assert [r.e for r in sequence.after_first(df, "u", ["t"], F.col("e") == "x").orderBy("t").collect()] == ["b", "x", "c"]
    assert sequence.first_match(df, "u", ["t"], F.col("e") == "x", "t").first().t == 1
    scored = sequence.context(df, "u", ["t"], (F.col("e") == "x").cast("int"), 1, 1)
    assert sequence.best_per_key(scored, "u", "score", ["t"]).first().t == 2

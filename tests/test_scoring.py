import pytest
from pyspark.sql import functions as F

from fixweave.functions import normalize as N
from fixweave.operators import scoring, taxonomy

RECORD = "id long, climb_altitude string, turn_direction string, holding_required string, holding_fix string, waypoints array<string>, pos int"


def one(spark, make, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v")).alias("x")).collect()]


def test_normalisers(spark):
    assert one(spark, N.altitude, ["3,000", " 3000 ", "3000.5", "+3000", "FL180", "", None, "unknown", "3000\n"]) == [None, 3000, None, 3000, None, None, None, None, 3000]
    assert one(spark, N.turn, ["unknown", None, " left", "straight", "NONE"]) == ["UNKNOWN", None, "LEFT", None, "NONE"]
    assert one(spark, N.holding, ["yes", "0", "True", "maybe", None]) == [True, False, True, None, None]
    assert one(spark, N.fix, ["null", "", "unknown", "mudre", "None", None, " a "]) == [None, None, None, "MUDRE", None, None, "A"]
    df = spark.createDataFrame([(["a", "A ", "", None],), (None,)], "w array<string>")
    assert [r[0] for r in df.select(N.waypoint_set(F.col("w"))).collect()] == [["A", "NONE"], []]


@pytest.fixture(scope="module")
def scores(spark):
    manifest = spark.createDataFrame([(i, 10 - i) for i in range(1, 7)], "id long, pos int")
    reference = spark.createDataFrame(
        [
            (1, "4000", "LEFT", "true", "ABCDE", ["A", "B"], 0),
            (2, "unknown", "NONE", "false", "FIXES", [], 0),
            (3, "5000", "RIGHT", "true", None, ["A"], 0),
            (4, "5000", "NONE", "true", "ABCDE", ["A"], 0),
            (5, "5000", "NONE", "true", "ABCDE", ["A", "B"], 0),
        ],
        RECORD,
    )
    candidate = spark.createDataFrame(
        [
            (1, "4000", "left", "true", "abcde", ["b", "a", "a"], 0),
            (2, "100", "unknown", "true", "OTHER", ["X"], 0),
            (3, None, None, "false", "ABCDE", None, 0),
            (4, "5001", "LEFT", "true", "WRONG", ["X"], 0),
            (6, "1", "LEFT", "true", "A", [], 0),
        ],
        RECORD,
    )
    return scoring.scored(manifest, reference, {"P": candidate}, "id")


def test_confusion(scores):
    got = {r.field: (r.tp, r.fp, r.fn) for r in scoring.confusion(scores).collect()}
    assert got == {"climb_altitude": (1, 3, 3), "turn_direction": (1, 3, 4), "holding_required": (2, 3, 3), "holding_fix": (1, 3, 2)}


def test_summary_and_samples(scores):
    s = scoring.summary(scores).first()
    assert (s.n, s.wp_tp, s.wp_fp, s.wp_fn) == (6, 2, 2, 4)
    assert s.coverage == pytest.approx(5 / 6) and s.mean_jaccard == pytest.approx(2 / 6) and s.exact_rate == pytest.approx(2 / 6)
    by = {r.id: r for r in scoring.per_sample(scores, "id").collect()}
    assert by[1].scalar_exact_rate == 1.0 and by[6].scalar_exact_rate is None and by[5].scalar_exact_rate == 0.0
    assert by[6].wp_jaccard == 1.0 and by[5].wp_jaccard == 0.0 and not by[5].has_output


def test_no_prediction_has_no_precision(spark):
    manifest = spark.createDataFrame([(1,)], "id long")
    empty = spark.createDataFrame([], RECORD)
    rows = scoring.confusion(scoring.scored(manifest, empty, {"P": empty}, "id")).collect()
    assert {(r.tp, r.fp, r.fn, r.precision, r.f1) for r in rows} == {(0, 0, 0, None, None)}


def test_labels(scores):
    labels = taxonomy.labelled(scores)
    got = {r.id: sorted(x.label for x in r.labels) for r in labels.collect()}
    assert got == {
        1: [],
        2: sorted(["climb_altitude:spurious_prediction", "turn_direction:wrong_direction", "holding_required:false_hold", "holding_fix:spurious_prediction", "waypoints:spurious_only"]),
        3: sorted(["climb_altitude:missing_prediction", "turn_direction:missing_prediction", "holding_required:missed_hold", "waypoints:missed_all"]),
        4: sorted(["climb_altitude:wrong_value", "turn_direction:hallucinated_turn", "holding_fix:wrong_fix", "waypoints:noisy_mismatch"]),
        5: ["sample:no_output"],
        6: sorted(["climb_altitude:spurious_prediction", "turn_direction:spurious_prediction", "holding_required:spurious_prediction", "holding_fix:spurious_prediction"]),
    }
    top = taxonomy.top(taxonomy.label_counts(labels), 2, ["path"], "label").orderBy("rank").collect()
    assert [(r.label, r.n) for r in top] == [("climb_altitude:spurious_prediction", 2), ("holding_fix:spurious_prediction", 2)]
    first = taxonomy.first_examples(labels, "id", "pos", 1).where("label = 'climb_altitude:spurious_prediction'").collect()
    assert [(r.id, r["rank"]) for r in first] == [(6, 1)]
    assert "waypoints:missed_all" in {p for r in taxonomy.signatures(labels).collect() for p in r.signature.split(" | ")}

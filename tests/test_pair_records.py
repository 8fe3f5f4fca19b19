import json
import os

import pytest

from fixweave.operators import sequence
from fixweave.plans import data_queries, reference_queries
from fixweave.plans.data_queries import whole_pairs

FIELDS = ["trans_ident", "seq_no", "rt_type", "wpt_ident", "altitude1", "alt_desc"]
LEGS = f"array<struct<{','.join(f'{f}:string' for f in FIELDS)}>>"
SCHEMA = f"pair_no long, chart_no long, id string, cifp struct<airport:string,proc_ident:string,legs:{LEGS}>, body string"

ROWS = [("R     ", "010", "TF ", "RW01  ", "", ""), ("R     ", "020", "CA ", "", "  700", "+"), ("R     ", "030", "DF ", "EVVIS ", " 4000", "+"), ("R     ", "040", "HM ", "EVVIS ", " 4000", "")]
OBJECTS = [dict(zip(FIELDS, r)) for r in ROWS]
UNKEYED = [{k: v for k, v in o.items() if k != "seq_no"} for o in OBJECTS]
LAYOUTS = [
    {"cifp": {"airport": " KAAA ", "proc_ident": "R01  ", "legs": [None, {}, *OBJECTS]}},
    {"cifp": {"airport": "KAAA", "proc_ident": "R01", "legs": {o["seq_no"]: u for o, u in reversed(list(zip(OBJECTS, UNKEYED)))}}},
    {"cifp": {"airport": "KAAA", "proc_ident": "R01", "legs": json.dumps(OBJECTS)}},
    {"cifp": [{"airport": "KAAA", "proc_ident": "R01", "legs": OBJECTS}]},
    {"cifp": {"airport": "KAAA", "proc_ident": "R01", "transitions": [{"trans_ident": "R", "legs": [{k: v for k, v in o.items() if k != "trans_ident"} for o in OBJECTS]}]}},
]


def tables(spark):
    rows = [(0, 0, "x", ("KAAA", "R01  ", ROWS), None)]
    rows += [(3 * i, i, "x", None, json.dumps(v)) for i, v in enumerate(LAYOUTS, 1)]
    rows += [(100, 9, "x", None, '{"cifp": {"airport": "KAAA", "legs": ['), (101, 9, "x", None, None), (102, 9, "x", None, '{"cifp": {"airport": "KAAA", "legs": null}}')]
    return spark.createDataFrame(rows, SCHEMA)


def test_bodies_give_the_record_of_the_typed_pair(spark):
    got = {r.pair_no: r for r in sequence.procedure_records(whole_pairs(tables(spark)), keep=("pair_no", "well_formed")).collect()}
    assert len(got) == 9
    expected = tuple(got[0])[1:]
    assert (got[0].raw_instruction, got[0].direct_seq, got[0].waypoints) == ("CA 700+ft -> DF EVVIS 4000+ft -> HM EVVIS 4000ft", "030", ["EVVIS"])
    for i in range(1, 6):
        assert tuple(got[3 * i])[1:] == expected
    assert [(got[k].well_formed, got[k].raw_instruction) for k in (100, 101, 102)] == [(False, "unknown"), (False, "unknown"), (True, "unknown")]


def test_bodies_give_lines_and_turns(spark):
    pairs = whole_pairs(tables(spark))
    lines = reference_queries.line_table(pairs).collect()
    place = {"L": 0, "R": 1, "": 2}
    assert sorted((r.pair_no, r.p, r.airport, r.proc_ident, r.trans_ident, r.seq_no, r.rt_type) for r in lines) == [
        (3 * i, p, "KAAA", "R01", "R", leg[1], leg[2].strip()) for i in range(6) for p, leg in enumerate(ROWS)
    ]
    assert all(place[r.turn_dir] == (r.pair_no + r.p) % 3 for r in lines)
    # the DF leg of the first pair stands at place 2
    turns = {r.pair_no: r.turn_direction for r in reference_queries.turn_table(pairs).collect()}
    assert turns == {3 * i: "NONE" for i in range(6)} | dict.fromkeys((100, 101, 102), "NONE")
    moved = whole_pairs(tables(spark).where("pair_no > 0").selectExpr("pair_no + 1 AS pair_no", "chart_no", "id", "cifp", "body"))
    assert {r.turn_direction for r in reference_queries.turn_table(moved).where("pair_no < 100").collect()} == {"LEFT"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_whole_table_by_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = data_queries.read_table(spark, folder, "pairs_100").select("pair_no", "cifp", "body").collect()
    records = {r.pair_no: r for r in data_queries.p5_records(spark, folder).collect()}
    assert sorted(records) == sorted(r.pair_no for r in rows)

    def readable(r):
        try:
            return r.body is None or isinstance(json.loads(r.body), dict)
        except ValueError:
            return False

    assert {k: r.well_formed for k, r in records.items()} == {r.pair_no: readable(r) for r in rows}
    # the query of all pairs, on those that are typed
    given = {r.pair_no for r in rows if r.cifp is not None}
    every = {r.pair_no: r for r in reference_queries.q_procedure_record(spark, folder).collect()}
    assert sorted(every) == sorted(records) and given < set(every)
    typed = {k: r for k, r in every.items() if k in given}
    assert typed and all(records[k].asDict() == r.asDict() | {"well_formed": True} for k, r in typed.items())
    assert {(r.pair_no, r.p): r for r in data_queries.p5_lines(spark, folder).collect() if r.pair_no in typed} == {
        (r.pair_no, r.p): r for r in reference_queries.q_fixed_width(spark, folder).collect() if r.pair_no in given
    }
    lines, legs = data_queries.p5_lines(spark, folder).collect(), data_queries.p5_legs(spark, folder).collect()
    count = lambda found: {k: sum(r.pair_no == k for r in found) for k in records if k not in typed}
    assert count(lines) == count(legs)
    assert {r.pair_no for r in data_queries.p5_turns(spark, folder).collect()} == set(records)

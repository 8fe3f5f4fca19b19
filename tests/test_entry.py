import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "events documents path_o path_o_mirror path_a path_b path_c path_e pairs_100 eval_items mix_targets manifest".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def core(name):
    return name.startswith("q_") or name[:2] in ("p1", "p2", "p5")


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in entry.queries() if core(n)])
def test_query(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(repr(tuple(r[columns.index(c)] for c in sorted(columns))) for r in result.fetchall())
    assert sorted(repr(tuple(r[c] for c in sorted(columns))) for r in rows) == expected

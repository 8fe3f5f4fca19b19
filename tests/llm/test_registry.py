import os

import pytest

from fixweave.llm import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, name):
    df = registry.QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name.endswith("_found"):
        assert len(rows) == len({tuple(r) for r in rows}) > 0
    if name in registry.SQL:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for t in ("documents", "eval_items"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        result = con.execute(registry.SQL[name])
        columns = [d[0] for d in result.description]
        assert sorted(map(repr, result.fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in rows)

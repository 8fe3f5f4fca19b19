"""The shared folder and the tables written to it."""

from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest

from fixweave.session import BoundExceeded, NoSharedFolder, collect_bounded, materialise, passing_path, scratch_tables, shared_dir


def _cluster(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[3,2,1000]"])
def test_cluster_without_shared_folder_is_an_error(master):
    with pytest.raises(NoSharedFolder):
        shared_dir(_cluster(master))


def test_named_folder_is_used_on_any_master():
    assert shared_dir(_cluster("yarn", "hdfs://host/shared/")) == "hdfs://host/shared"


def test_local_master_makes_one_folder():
    spark = _cluster("local[2]")
    assert shared_dir(spark) == shared_dir(spark)


def test_scratch_tables_are_deleted(spark):
    with scratch_tables(spark) as keep:
        table = keep(spark.range(10), "numbers")
        path = Path(table.inputFiles()[0].removeprefix("file://")).parent
        assert path.exists() and table.count() == 10
    assert not path.exists() and not path.parent.exists()


def test_passing_path_is_in_a_new_folder(spark):
    one, two = passing_path(spark, "x"), passing_path(spark, "x")
    assert one != two and Path(one.removeprefix("file://")).parent.is_dir()


def test_materialised_table_outlives_its_block(spark):
    table = materialise(spark.range(3).toDF("n"), "kept")
    assert sorted(r.n for r in table.collect()) == [0, 1, 2]
    assert "Range" not in table._jdf.queryExecution().toString()


def test_bounded_collect_raises_beyond_its_bound(spark):
    assert len(collect_bounded(spark.range(5), 5, "numbers")) == 5
    with pytest.raises(BoundExceeded):
        collect_bounded(spark.range(6), 5, "numbers")

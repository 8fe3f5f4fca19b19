"""Session settings and the few driver-side helpers the operators share."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession


def build_session(app: str = "fixweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; ``master`` and ``conf`` only for local use."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


class NoSharedFolder(RuntimeError):
    """A cluster that names no folder which all its machines share."""


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing, a temporary folder is made if the master is this very
    process; on a cluster it would be another folder on every machine, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors share")
        folder = getattr(spark, "_fixweave_dir", None) or tempfile.mkdtemp(prefix="fixweave-")
        spark._fixweave_dir = folder
    return folder.rstrip("/")


def _path(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def passing_path(spark: SparkSession, name: str) -> str:
    """A path in a new folder of the shared one, which is deleted when the driver ends."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place, files = _path(spark, folder)
    files.mkdirs(place)
    files.deleteOnExit(place)
    return f"{folder}/table"


def materialise(df: DataFrame, name: str, scratch: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the cut of its lineage.

    Unlike a cache the written table survives the loss of any executor. It is deleted when
    the driver ends, or sooner by ``scratch_tables``, which passes its list as ``scratch``.
    """
    spark = df.sparkSession
    path = passing_path(spark, name)
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """``materialise`` for tables that are read only inside the block, and deleted at its end."""
    written: list[str] = []
    try:
        yield lambda df, name: materialise(df, name, written)
    finally:
        for path in written:
            place, files = _path(spark, path)
            files.delete(place.getParent(), True)


class BoundExceeded(ValueError):
    """A table said to be small has more rows than its bound."""


def collect_bounded(df: DataFrame, bound: int, what: str) -> list[Row]:
    """Rows of a table whose size has a proven bound; raises rather than cut it off."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise BoundExceeded(f"{what}: more than {bound} rows")
    return rows


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their Python workers
    need neither an installation nor the driver's path; executors that join later get it too."""
    context = spark.sparkContext
    if getattr(context, "_fixweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    # the driver serves the file itself; nothing is read from its disk by others
    path = Path(tempfile.mkdtemp(prefix="fixweave-")) / "fixweave_package.zip"
    path.write_bytes(packed.getvalue())
    context.addPyFile(str(path))
    context._fixweave_shipped = True


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")

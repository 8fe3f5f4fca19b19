"""The column extractors over a stream: they keep no state, so any source will do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.textrules import record


def rule_stream(stream: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Records read out of a stream of instructions."""
    return stream.select(*keep, *[c.alias(n) for n, c in record(F.col(text)).items()])


def counted(stream: DataFrame, time: str, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Records per window and turn; those later than the watermark no longer count."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), "turn_direction").agg(F.count("*").alias("n"))


def write_stream(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends to files exactly once; restarts from ``checkpoint``, which lies in shared storage."""
    return df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).start(folder)

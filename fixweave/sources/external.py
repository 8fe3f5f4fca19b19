"""External steps behind an interface: page text recognition, rendering and model calls.

They can't run without their services; a step takes a function from a batch of inputs to
a batch of outputs, and recorded responses replay through ``replayed``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Call:
    """Parameters of a model call."""

    model: str
    max_tokens: int
    temperature: float = 0.0


def apply_step(df: DataFrame, column: str, out: str, kind: str, step: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """``out`` = step(column), batch by batch on the executors; other columns stay."""
    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), f"`{out}` {kind}"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{out: step(frame[column])})

    return df.mapInPandas(run, schema)


def replayed(requests: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """Each request with its recorded response; null where none was recorded."""
    known = responses.groupBy(*keys).agg(F.max("text").alias("text"))
    return requests.join(known, keys, "left")

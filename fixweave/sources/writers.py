"""Writers of records and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import collect_bounded

#: Reports have a row per path, field or label: this many at most.
MAX_REPORT_ROWS = 100_000


def write_records(df: DataFrame, folder: str, by: str = "path") -> None:
    """Records as JSON lines, one folder per path; compact files, not one per record."""
    df.write.mode("overwrite").partitionBy(by).json(folder)


def write_array(df: DataFrame, path: str) -> None:
    """A small table in its order as one JSON array, as manifests are kept: ``MAX_REPORT_ROWS`` rows at most."""
    rows = collect_bounded(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")), MAX_REPORT_ROWS, path)
    text = "[\n" + ",\n".join(r.j for r in rows) + "\n]"
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def trace(answers: dict[str, Column]) -> Column:
    """A record's questions and recorded answers as a JSON array, in their order; null answers are empty."""
    return F.to_json(F.array(*[F.struct(F.lit(q).alias("question"), F.coalesce(a.cast("string"), F.lit("")).alias("answer")) for q, a in answers.items()]))


def write_texts(df: DataFrame, folder: str, key: str, text: str) -> None:
    """The text beside each record (recognised pages, raw responses) as JSON lines of key and text, without nulls."""
    df.where(F.col(text).isNotNull()).select(key, text).write.mode("overwrite").json(folder)


def nested_metrics(df: DataFrame, outer: str, inner: str, values: list[str]) -> DataFrame:
    """One row per ``outer`` with a JSON object of its ``inner`` entries' values."""
    entry = F.struct(F.col(inner).cast("string").alias("k"), F.struct(*values).alias("v"))
    grouped = df.groupBy(outer).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return grouped.select(outer, F.to_json(F.map_from_entries("e")).alias("metrics"))


def shown(value: float | int | str | bool | None, digits: int = 3) -> str:
    """Floats with three decimals, null as N/A."""
    if value is None:
        return "N/A"
    return f"{value:.{digits}f}" if isinstance(value, float) else str(value)


def percent(part: int, whole: int) -> str:
    return f"{part / whole:.1%}" if whole else "0.0%"


def markdown(df: DataFrame, title: str, order: list[Column | str]) -> str:
    """A report table as markdown text, in the given order."""
    rows = collect_bounded(df.orderBy(*order), MAX_REPORT_ROWS, title)
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join(shown(v) for v in row) + " |" for row in rows]
    return "\n".join(lines) + "\n"


def file_report(df: DataFrame) -> DataFrame:
    """Files and bytes by extension of a ``binaryFile`` listing."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return df.groupBy(kind.alias("kind")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))

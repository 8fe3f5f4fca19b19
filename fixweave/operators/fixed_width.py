"""Fixed-width records from a declared layout, and lookups in them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import strip


@dataclass(frozen=True)
class Layout:
    """Fields by name, with first character (from 1) and length, and the guards of a record."""

    fields: tuple[tuple[str, int, int], ...]
    prefix: str
    least: int
    marks: tuple[tuple[int, tuple[str, ...]], ...]


#: Approach records of the public procedure file format.
APPROACH = Layout(
    fields=(("airport", 7, 4), ("proc_ident", 14, 5), ("trans_ident", 20, 6), ("seq_no", 27, 3), ("turn_dir", 44, 1), ("rt_type", 48, 3)),
    prefix="SUSAP",
    least=49,
    marks=((13, ("F",)), (39, ("0", "1"))),
)


def parse(df: DataFrame, line: str, layout: Layout = APPROACH, keep: tuple[str, ...] = ()) -> DataFrame:
    """Trimmed fields of the lines that are records of the layout; other lines, null ones too, drop out."""
    text = F.col(line)
    fits = text.startswith(layout.prefix) & (F.length(text) >= layout.least)
    for at, allowed in layout.marks:
        fits = fits & F.substring(text, at, 1).isin(*allowed)
    return df.where(fits).select(*keep, *[strip(F.substring(text, at, n)).alias(name) for name, at, n in layout.fields])


def render(layout: Layout, values: dict[str, Column], width: int = 60) -> Column:
    """A line of the layout: each value padded or cut to its place, guards filled in."""
    cells = {at: (n, F.rpad(F.coalesce(values[name], F.lit("")), n, " ")) for name, at, n in layout.fields if name in values}
    cells |= {at: (1, F.lit(allowed[0])) for at, allowed in layout.marks}
    parts, at = [F.lit(layout.prefix)], len(layout.prefix) + 1
    for start in sorted(cells):
        if start > at:
            parts.append(F.lit(" " * (start - at)))
        parts.append(cells[start][1])
        at = start + cells[start][0]
    return F.rpad(F.concat(*parts), width, " ")


def first_wins(records: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """One row per key, with the value of the record that came first."""
    return records.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def lookup(df: DataFrame, index: DataFrame, on: dict[str, str], value: str, default: str = "") -> DataFrame:
    """``value`` of the index by several columns (``on``: own column to the index's), else ``default``.

    The index has one row per key; Spark broadcasts it only if it is known to be small.
    """
    right = index.select(*[F.col(b).alias(f"__fw_{b}") for b in on.values()], F.col(value).alias("__fw_value"))
    match = [F.col(a) == F.col(f"__fw_{b}") for a, b in on.items()]
    joined = df.join(right, match, "left").withColumn(value, F.coalesce("__fw_value", F.lit(default)))
    return joined.drop("__fw_value", *[f"__fw_{b}" for b in on.values()])

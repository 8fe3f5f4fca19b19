"""Differences between two copies of one dataset.

Split points come from a sample of the keys of both copies, and both copies are cut into
ranges at the same points. Keys that would fill a range by themselves are reduced to their
latest state before that. Each range is sorted by key and age, and one streaming pass holds
a cursor in either copy: the lesser key is missing from the other copy, equal keys are
compared field by field. The cursors move over runs of keys, a batch at a time.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..session import collect_bounded

_SIDE, _AT, _STATE, _FORM = "__fw_side", "__fw_at", "__fw_state", "__fw_form_"

_BLANKS = r"(?U)^\s+|\s+$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"


def text_form(value: Column) -> Column:
    """Equal for texts that differ only in case or in blanks around them; null stays null."""
    return F.lower(F.regexp_replace(value.cast("string"), _BLANKS, ""))


def number_form(value: Column) -> Column:
    """As ``text_form``, but numbers (optional sign and decimals, any length) are equal by value."""
    text = text_form(value)
    whole = F.regexp_replace(F.regexp_extract(text, r"^[+-]?([0-9]*)", 1), "^0+", "")
    part = F.regexp_replace(F.regexp_extract(text, r"\.([0-9]*)$", 1), "0+$", "")
    digits = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))
    sign = F.when(text.startswith("-") & (digits != "0"), "-").otherwise("")
    return F.when(text.rlike(_NUMBER), F.concat(F.lit("#"), sign, digits)).otherwise(text)


def list_form(value: Column) -> Column:
    """Lists are equal element by element under ``text_form``; order and repetition count,
    a null element is no text, and a null list is not an empty one."""
    return F.when(value.isNotNull(), F.to_json(F.transform(value, text_form), {"ignoreNullFields": "false"}))


#: Rows of a range, keys sampled for it, and keys sampled at most, which come to the driver.
#: Beyond 20,000 ranges the ranges grow instead.
RANGE_ROWS, SAMPLE, MAX_SAMPLE = 1_000_000, 100, 500_000


def split_points(keys: DataFrame, ranges: int | None = None) -> tuple[list[Row], list[Row]]:
    """Keys at which to cut into ranges of about ``RANGE_ROWS`` rows, in order, and hot keys:
    those with half a range of the sample or more. Only the key columns are read."""
    total = keys.count()
    ranges = ranges or min(max(keys.sparkSession.sparkContext.defaultParallelism, -(-total // RANGE_ROWS)), MAX_SAMPLE // 25)
    wanted = min(ranges * SAMPLE, MAX_SAMPLE)
    sample = keys if total <= wanted else keys.sample(min(1.0, 1.1 * wanted / total), 17)
    counted = collect_bounded(sample.groupBy(*keys.columns).agg(F.count("*").alias("__fw_n")).orderBy(*keys.columns), 2 * MAX_SAMPLE, "sampled keys")
    share = max(sum(r["__fw_n"] for r in counted) / ranges, 1.0)
    points, hot, before = [], [], 0.0
    for r in counted:
        key = Row(**{c: r[c] for c in keys.columns})
        if r["__fw_n"] >= max(share / 2, 64):
            hot.append(key)
            continue
        if before >= share:
            points.append(key)
            before = 0.0
        before += r["__fw_n"]
    return points, hot


def latest_state(df: DataFrame, keys: Sequence[str], order_by: str, values: Sequence[str]) -> DataFrame:
    """One row per key: ``order_by`` and ``values`` of the row with the greatest of them."""
    state = F.struct(order_by, *values)
    return df.groupBy(*keys).agg(F.max(state).alias(_STATE)).select(*keys, *[F.col(f"{_STATE}.{c}").alias(c) for c in (order_by, *values)])


def _ranks(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """A number per row that grows where the key changes; rows are sorted by key."""
    change = np.zeros(table.num_rows, bool)
    for k in keys:
        column = table.column(k).combine_chunks()
        a, b = column[:-1], column[1:]
        both = pc.and_(pc.is_null(a), pc.is_null(b))
        change[1:] |= ~pc.or_(pc.fill_null(pc.equal(a, b), False), both).to_numpy(zero_copy_only=False)
    return np.cumsum(change)


def _equal(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Elementwise equality in which null equals null."""
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    return pc.or_(pc.fill_null(pc.equal(a, b), False), both).to_numpy(zero_copy_only=False)


def _merge(keys: Sequence[str], forms: Sequence[str], names: Sequence[str]) -> Callable:
    """``names`` are those of the fields, then of a row missing left and of one missing right."""

    def walk(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """All states of the keys in ``table`` are there, each copy's oldest first."""
        rank, side = _ranks(table, keys), table.column(_SIDE).to_numpy()
        # the last state of each key in either copy: the rows that the two cursors stop at
        last = np.flatnonzero(np.append((rank[1:] != rank[:-1]) | (side[1:] != side[:-1]), True))
        left, right = last[side[last] == 0], last[side[last] == 1]
        at = np.searchsorted(rank[right], rank[left])  # where the right cursor stands for each left key
        met = (at < len(right)) & (rank[right[np.minimum(at, max(len(right) - 1, 0))]] == rank[left]) if len(right) else np.zeros(len(left), bool)
        pair = right[at[met]] if len(right) else right
        rows = [left[~met], np.setdiff1d(right, pair, assume_unique=True)]
        codes = [np.full(len(rows[0]), len(forms) + 1), np.full(len(rows[1]), len(forms))]
        for f, form in enumerate(forms):
            column = table.column(form).combine_chunks()
            unlike = ~_equal(column.take(pa.array(left[met])), column.take(pa.array(pair))) if len(pair) else np.zeros(0, bool)
            rows.append(left[met][unlike])
            codes.append(np.full(int(unlike.sum()), f))
        row, code = np.concatenate(rows), np.concatenate(codes)
        order = np.lexsort((code, row))
        if len(row):
            found = table.select(list(keys)).take(pa.array(row[order]))
            yield pa.RecordBatch.from_arrays([*(found.column(k).combine_chunks() for k in keys), pa.array(np.array(names, object)[code[order]], pa.string())], names=[*keys, "field"])

    def newest(table: pa.Table) -> pa.Table:
        """Only the last state of each copy, which is all that counts of a key that goes on."""
        side = table.column(_SIDE).to_numpy()
        return table.take(pa.array(np.flatnonzero(np.append(side[1:] != side[:-1], True))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            # the last key may go on in the next batch
            rank = _ranks(table, keys)
            cut = int(np.searchsorted(rank, rank[-1]))
            if cut:
                yield from walk(table.slice(0, cut))
            rest = newest(table.slice(cut))
        if rest is not None:
            yield from walk(rest)

    return run


def diff_copies(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    fields: dict[str, Callable[[Column], Column]],
    order_by: str,
    names: tuple[str, str] = ("left", "right"),
    ranges: int | None = None,
) -> DataFrame:
    """Rows missing on either side and fields whose values differ.

    ``fields`` maps a column to its comparison form. The result has the key columns and
    ``field``: a field's name, or ``row_missing_in_<name>``. Several states of a key count
    as the one with the greatest ``order_by``, among ties the greatest values; a null
    ``order_by`` is the oldest. Null keys are one key; null equals null and nothing else; columns that aren't named don't count, whatever their names; two empty
    copies, or two equal ones, give no rows.
    """
    fields = dict(fields)
    forms = [f"{_FORM}{i}" for i in range(len(fields))]
    raw = [df.select(*keys, F.col(order_by).alias(_AT), *[F.col(f).alias(form) for form, f in zip(forms, fields)], F.lit(i).cast("tinyint").alias(_SIDE)) for i, df in enumerate((left, right))]
    both = raw[0].unionByName(raw[1])
    points, hot = split_points(both.select(*keys), ranges)
    if hot:
        # at most two hot keys for each range
        known = F.broadcast(both.sparkSession.createDataFrame(hot, both.select(*keys).schema))
        same = reduce(lambda a, b: a & b, [both[k].eqNullSafe(known[k]) for k in keys])
        reduced = latest_state(both.join(known, same, "left_semi"), [*keys, _SIDE], _AT, forms)
        both = both.join(known, same, "left_anti").unionByName(reduced)
    cut = both.repartitionById(len(points) + 1, _range_of(points, keys)).sortWithinPartitions(*keys, _SIDE, _AT, *forms)
    compared = cut.select(*keys, _SIDE, *[make(F.col(form)).alias(form) for form, make in zip(forms, fields.values())])
    names_ = [*fields, *(f"row_missing_in_{n}" for n in names)]
    return compared.mapInArrow(_merge(list(keys), forms, names_), compared.select(*keys).schema.add("field", "string"))


def _range_of(points: list[Row], keys: Sequence[str]) -> Column:
    """The range that a row's key falls into: how many split points are not beyond it; null keys are the least."""
    if not points:
        return F.lit(0)
    # pandas would turn whole numbers beside a null into floats: nulls are told apart here
    some = [next((p[i] for p in points if p[i] is not None), None) for i in range(len(keys))]
    filled = [F.coalesce(F.col(k), F.lit(v)) if v is not None else F.lit(0) for k, v in zip(keys, some)]
    if len(keys) == 1 and isinstance(some[0], (int, str)) and all(p[0] is not None for p in points):
        splits = np.array([p[0] for p in points], object if isinstance(some[0], str) else np.int64)

        @F.pandas_udf("int")
        def place(key: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(splits, key.to_numpy(), side="right").astype(np.int32))

        return F.when(F.col(keys[0]).isNull(), F.lit(0)).otherwise(place(filled[0]))
    marks = [tuple((v is not None, v if v is not None else 0) for v in p) for p in points]

    @F.pandas_udf("int")
    def place_of(frame: pd.DataFrame) -> pd.Series:
        values, there = ([frame[f"{c}{i}"] for i in range(len(keys))] for c in "vt")
        rows = zip(zip(*there), zip(*values))
        return pd.Series([bisect_right(marks, tuple((t, v if t else 0) for t, v in zip(ts, vs))) for ts, vs in rows], dtype="int32")

    parts = [c.alias(f"v{i}") for i, c in enumerate(filled)] + [F.col(k).isNotNull().alias(f"t{i}") for i, k in enumerate(keys)]
    return place_of(F.struct(*parts))

"""Deeply nested records into flat tables that keep parent-child links.

Texts are indexed a batch at a time by ``structural.StructuralIndex``; entries of a named
list are found at whatever depth they stand, and each becomes one row that points to its
record. Records that are already typed are exploded by the engine itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .structural import ARR, ARR_END, OBJ, OBJ_END, STRING, StructuralIndex


@dataclass
class Entries:
    """Entries of a list in the order in which they stand, one element each."""

    doc: np.ndarray
    place: np.ndarray
    values: dict[str, list[str | None]]


def _order_in_object(index: StructuralIndex, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Objects under the list's key: those keyed by number, and those that are an entry themselves.

    Gives the numbered children, their numbers, and the objects that are one entry.
    """
    keys = np.flatnonzero(index.is_key)
    keys = keys[np.isin(index.parent[keys], lists)]
    texts = [index.raw[index.start[k] + 1 : index.end[k] - 1] for k in keys]
    numeric = np.array([t.isdigit() for t in texts], bool)
    named = np.unique(index.parent[keys[~numeric]])
    use = numeric & ~np.isin(index.parent[keys], named)
    number = np.array([int(t) if u else 0 for t, u in zip(texts, use)], object)[use] if use.any() else np.zeros(0, object)
    return keys[use] + 2, number, named


def _blank_entry(index: StructuralIndex, objects: np.ndarray) -> np.ndarray:
    return index.kind[objects + 1] == OBJ_END


def find_entries(texts: list[bytes], name: str, fields: Sequence[str], outer: Sequence[str] = (), key_field: str | None = None) -> tuple[Entries, np.ndarray]:
    """Entries of every list called ``name``, and which texts are well-formed.

    A list may be an array (also of arrays), an object whose keys are numbers (taken in
    their order), one object that is itself the entry, or a string that holds any of
    these as JSON. ``fields`` are looked up anywhere inside an entry, those in ``outer``
    also beside the list that holds it; ``key_field`` is the number an entry is keyed by
    where it has none itself. Nulls and empty objects are no entries.
    """
    index = StructuralIndex(texts)
    good = index.ok[index.doc] if len(index.doc) else np.zeros(0, bool)
    lists = index.named(name) & good
    inside_array = index.parent >= 0

    arrays = lists & (index.kind == ARR)
    while True:  # arrays inside the list's arrays: one round per level of nesting
        grown = arrays | (good & (index.kind == ARR) & inside_array & arrays[np.maximum(index.parent, 0)])
        if (grown == arrays).all():
            break
        arrays = grown
    entry = np.flatnonzero(good & (index.kind == OBJ) & inside_array & arrays[np.maximum(index.parent, 0)])
    place = [entry.astype(object)]
    rank = [np.zeros(len(entry), object)]
    objects = np.flatnonzero(lists & (index.kind == OBJ))
    numbered, number, single = _order_in_object(index, objects)
    keep = (index.kind[numbered] == OBJ) if len(numbered) else np.zeros(0, bool)
    entries = np.concatenate([entry, numbered[keep], single]).astype(np.int64)
    # numbered entries sort by number within their list, which stands at its own place
    place += [index.parent[numbered[keep]].astype(object), single.astype(object)]
    rank += [number[keep], np.zeros(len(single), object)]
    places, ranks = np.concatenate(place), np.concatenate(rank)
    fine = ~_blank_entry(index, entries) if len(entries) else np.zeros(0, bool)
    entries, places, ranks = entries[fine], places[fine], ranks[fine]

    by_token = np.argsort(entries, kind="stable")
    starts, stops = entries[by_token], index.close[entries[by_token]] if len(entries) else entries
    # an entry inside another entry is part of it
    top = np.ones(len(starts), bool)
    if len(starts):
        top[1:] = starts[1:] > np.maximum.accumulate(stops)[:-1]
    by_token, starts, stops = by_token[top], starts[top], stops[top]

    values: dict[str, list[str | None]] = {}
    for f in fields:
        found: list[str | None] = [None] * len(starts)
        hits = np.flatnonzero(index.named(f) & good & ~index.opens) if len(starts) else np.zeros(0, np.int64)
        if len(hits):
            at = np.searchsorted(starts, hits, side="right") - 1
            own = (at >= 0) & (hits < stops[np.maximum(at, 0)])
            for t, i in zip(hits[own], at[own]):
                if found[i] is None:
                    found[i] = index.text(t)
            if f in outer:
                beside: dict[int, str | None] = {}
                for t in hits[~own]:
                    beside.setdefault(int(index.parent[t]), index.text(t))
                for i, s in enumerate(starts):
                    holder = index.parent[s]
                    while found[i] is None and holder >= 0:
                        found[i] = beside.get(int(holder))
                        holder = index.parent[holder] if found[i] is None and index.kind[holder] == ARR else -1 if index.kind[holder] == OBJ else holder
        if f == key_field:
            for i in np.flatnonzero(np.isin(starts, numbered)):
                if found[i] is None:
                    found[i] = index.text(starts[i] - 2)
        values[f] = found
    docs = index.doc[starts] if len(starts) else starts
    rows = [(int(d), int(p), r, 0) for d, p, r in zip(docs, places[by_token], ranks[by_token])]

    # lists written as text: the same search inside them
    held = np.flatnonzero(lists & (index.kind == STRING))
    if len(held):
        inner, _ = find_entries([_nested_list(index.text(t), name) for t in held], name, fields, outer, key_field)
        rows += [(int(index.doc[held[d]]), int(held[d]), 0, i) for i, d in enumerate(inner.doc)]
        for f in fields:
            values[f] += inner.values[f]
    order = sorted(range(len(rows)), key=rows.__getitem__)
    doc = np.array([rows[i][0] for i in order], np.int64)
    return Entries(doc, np.arange(len(order)), {f: [v[i] for i in order] for f, v in values.items()}), index.ok


def _nested_list(text: str | None, name: str) -> bytes:
    return f'{{"{name}":{text}}}'.encode() if text else b""


def _number(doc: np.ndarray) -> np.ndarray:
    """1, 2, ... within each run of equal values."""
    if not len(doc):
        return doc
    head = np.ones(len(doc), bool)
    head[1:] = doc[1:] != doc[:-1]
    at = np.arange(len(doc))
    return at - np.maximum.accumulate(np.where(head, at, 0)) + 1


def _rows(body: str, name: str, fields: Sequence[str], outer: Sequence[str], carry: Sequence[str], number: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(body).to_pylist()]
            found, _ = find_entries(texts, name, fields, outer)
            if len(found.doc):
                at = pa.array(found.doc)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(at) for c in carry), pa.array(_number(found.doc), pa.int32()), *(pa.array(v, pa.string()) for v in found.values.values())],
                    names=[*carry, number, *found.values],
                )

    return run


def trimmed(value: Column) -> Column:
    return F.coalesce(F.regexp_replace(value.cast("string"), r"(?U)^\s+|\s+$", ""), F.lit(""))


def flatten_entries(
    df: DataFrame, key: str, body: str, typed: str | None, name: str, fields: Sequence[str], outer: Sequence[str] = (), number: str = "entry_no"
) -> DataFrame:
    """One row per entry of the list ``name``: ``key``, its number from 1, and ``fields``.

    ``body`` is JSON text and ``typed`` (optional) a path to an array of structs, of which
    a record fills one. Fields are trimmed and empty where missing. Null bodies, texts that
    aren't well-formed (cut off or otherwise), empty lists and null entries give no rows;
    a record delivered again counts again; other columns don't matter.
    """
    columns = list(dict.fromkeys([key, body]))
    texts = df.where(F.col(body).isNotNull()).select(*columns)
    schema = T.StructType([texts.schema[key], T.StructField(number, T.IntegerType()), *(T.StructField(f, T.StringType()) for f in fields)])
    rows = texts.mapInArrow(_rows(body, name, fields, outer, [key], number), schema)
    if typed:
        there = lambda e: F.exists(F.array(*[e[f].cast("string").isNotNull() for f in kept]), lambda x: x)
        kept = [f.name for f in df.select(typed).schema[0].dataType.elementType.fields]
        entry = F.filter(F.col(typed), lambda e: e.isNotNull() & there(e))
        exploded = df.where(F.col(typed).isNotNull() & F.col(body).isNull()).select(key, F.posexplode(entry).alias("__fw_pos", "__fw_entry"))
        rows = rows.unionByName(exploded.select(key, (F.col("__fw_pos") + 1).alias(number), *[(F.col(f"__fw_entry.{f}") if f in kept else F.lit(None)).cast("string").alias(f) for f in fields]))
    return rows.select(key, number, *[trimmed(F.col(f)).alias(f) for f in fields])


def _first_values(index: StructuralIndex, field: str, n: int) -> pa.Array:
    """The first value under ``field`` in each of ``n`` texts."""
    value: list[str | None] = [None] * n
    for t in np.flatnonzero(index.named(field) & index.ok[index.doc] & ~index.opens):
        if value[index.doc[t]] is None:
            value[index.doc[t]] = index.text(t)
    return pa.array(value, pa.string())


def _records(body: str, name: str, fields: Sequence[str], carry: Sequence[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(body).to_pylist()]
            index = StructuralIndex(texts)
            found, _ = find_entries(texts, name, ())
            count = np.bincount(found.doc, minlength=len(texts)) if len(texts) else np.zeros(0)
            columns = [_first_values(index, f, len(texts)) for f in fields]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carry), *columns, pa.array(index.ok), pa.array(count, pa.int32())],
                names=[*carry, *fields, "well_formed", "n_entries"],
            )

    return run


def flatten_records(df: DataFrame, keys: Sequence[str], body: str, typed: str, name: str, fields: Sequence[str]) -> DataFrame:
    """The parent table: one row per record with ``fields``, whether it is well-formed, and its number of entries.

    ``typed`` is the struct that holds ``fields`` and the list where ``body`` is null. A
    record with neither is kept, not well-formed, without entries.
    """
    texts = df.where(F.col(body).isNotNull()).select(*keys, body)
    schema = T.StructType([*(texts.schema[k] for k in keys), *(T.StructField(f, T.StringType()) for f in fields), T.StructField("well_formed", T.BooleanType()), T.StructField("n_entries", T.IntegerType())])
    parsed = texts.mapInArrow(_records(body, name, fields, keys), schema)
    struct = df.select(typed).schema[0].dataType
    kept = [f.name for f in struct[name].dataType.elementType.fields]
    entry = F.filter(F.col(f"{typed}.{name}"), lambda e: e.isNotNull() & F.exists(F.array(*[e[f].cast("string").isNotNull() for f in kept]), lambda x: x))
    direct = df.where(F.col(body).isNull()).select(
        *keys,
        *[F.col(f"{typed}.{f}").cast("string").alias(f) for f in fields],
        F.col(typed).isNotNull().alias("well_formed"),
        F.coalesce(F.size(entry), F.lit(0)).alias("n_entries"),
    )
    both = parsed.unionByName(direct)
    return both.select(*keys, *[trimmed(F.col(f)).alias(f) for f in fields], "well_formed", F.greatest("n_entries", F.lit(0)).alias("n_entries"))


def _gathered(body: str, name: str, fields: Sequence[str], outer: Sequence[str], key_field: str | None, record: Sequence[str], carry: Sequence[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(body).to_pylist()]
            index = StructuralIndex(texts)
            found, _ = find_entries(texts, name, fields, outer, key_field)
            starts = np.concatenate(([0], np.cumsum(np.bincount(found.doc, minlength=len(texts)))))
            entries = pa.StructArray.from_arrays([pa.array(found.values[f], pa.string()) for f in fields], names=list(fields))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carry), *(_first_values(index, f, len(texts)) for f in record), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), entries), pa.array(index.ok)],
                names=[*carry, *(f"__fw_{f}" for f in record), "__fw_list", "well_formed"],
            )

    return run


def gather_entries(
    df: DataFrame, keys: Sequence[str], body: str, typed: str, name: str, fields: Sequence[str], record: Sequence[str], outer: Sequence[str] = (), key_field: str | None = None
) -> DataFrame:
    """One row per record: ``keys``, a struct ``typed`` of ``record`` and the list ``name``, and whether it is well-formed.

    The struct is that of the record, or what ``body`` holds in its place, with entries as
    ``find_entries`` finds them. A text that isn't well-formed, and a record with neither,
    is kept, not well-formed, without entries. Nothing is shuffled.
    """
    entry = T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in fields]))
    texts = df.where(F.col(body).isNotNull()).select(*keys, body)
    schema = T.StructType([*(texts.schema[k] for k in keys), *(T.StructField(f"__fw_{f}", T.StringType()) for f in record), T.StructField("__fw_list", entry), T.StructField("well_formed", T.BooleanType())])
    parsed = texts.mapInArrow(_gathered(body, name, fields, outer, key_field, record, keys), schema)
    parsed = parsed.select(*keys, F.struct(*[F.col(f"__fw_{f}").alias(f) for f in record], F.col("__fw_list").alias(name)).alias(typed), "well_formed")
    own = F.transform(F.col(f"{typed}.{name}"), lambda e: F.when(e.isNotNull(), F.struct(*[e[f].cast("string").alias(f) for f in fields])))
    direct = df.where(F.col(body).isNull()).select(
        *keys, F.struct(*[F.col(f"{typed}.{f}").cast("string").alias(f) for f in record], own.alias(name)).alias(typed), F.col(typed).isNotNull().alias("well_formed")
    )
    return parsed.unionByName(direct)

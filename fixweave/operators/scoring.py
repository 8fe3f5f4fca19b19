"""Scoring of extracted records against reference records.

``scored`` gives one row per (path, record) with the outcome of every field; all reports
are aggregates of it, so it is read once. All candidates join the reference on its key
alone, so each side is shuffled once, and records are spread over paths after that;
aggregates combine before their shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N

SCALARS = ("climb_altitude", "turn_direction", "holding_required", "holding_fix")
_MAKE = {"climb_altitude": N.altitude, "turn_direction": N.turn, "holding_required": N.holding, "holding_fix": N.fix}


def latest(df: DataFrame, key: str, order_by: str, tie: str) -> DataFrame:
    """The newest record of each key."""
    state = F.struct(*[F.col(c) for c in (*SCALARS, "waypoints")])
    return df.groupBy(key).agg(F.max_by(state, F.struct(order_by, tie)).alias("r")).select(key, "r.*")


def normalized(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, *[_MAKE[f](F.col(f)).alias(f) for f in SCALARS], N.waypoint_set(F.col("waypoints")).alias("waypoints"))


def _said(record: str, field: str) -> Column:
    value = F.col(f"{record}.{field}").isNotNull()
    return value & F.coalesce(F.col(f"{record}.holding_required"), F.lit(False)) if field == "holding_fix" else value


def scored(manifest: DataFrame, reference: DataFrame, candidates: dict[str, DataFrame], key: str) -> DataFrame:
    """``path, key, has_output, fields, waypoints``: per field applicable, predicted, matched, tp, fp, fn.

    A wrong value costs both a false positive and a miss. Records of the manifest without a
    reference are scored as undetermined; a path without a record has no output. ``manifest``
    keeps its own columns. Reference and candidates have one record per key (``latest``).
    """
    ref = normalized(reference, key).select(key, F.struct(*SCALARS, "waypoints").alias("ref"))
    joined = manifest.join(ref, key, "left")
    for i, c in enumerate(candidates.values()):
        joined = joined.join(normalized(c, key).select(key, F.struct(*SCALARS, "waypoints").alias(f"__fw_pred{i}")), key, "left")
    paths = F.array(*[F.struct(F.lit(p).alias("path"), F.col(f"__fw_pred{i}").alias("pred")) for i, p in enumerate(candidates)])
    rows = joined.select(*manifest.columns, "ref", F.explode(paths).alias("__fw_x")).select("__fw_x.path", *manifest.columns, "ref", "__fw_x.pred")
    outcome = []
    for f in SCALARS:
        applicable, predicted = F.coalesce(_said("ref", f), F.lit(False)), F.coalesce(_said("pred", f), F.lit(False))
        matched = applicable & predicted & F.col(f"ref.{f}").eqNullSafe(F.col(f"pred.{f}"))
        outcome.append(
            F.struct(
                F.lit(f).alias("field"),
                applicable.alias("applicable"),
                predicted.alias("predicted"),
                matched.alias("matched"),
                matched.cast("bigint").alias("tp"),
                (predicted & ~matched).cast("bigint").alias("fp"),
                (applicable & ~matched).cast("bigint").alias("fn"),
            )
        )
    empty = F.array().cast("array<string>")
    a, b = F.coalesce(F.col("ref.waypoints"), empty), F.coalesce(F.col("pred.waypoints"), empty)
    has = F.col("pred").isNotNull()
    hits, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    jaccard = F.when(~has, 0.0).when(union == 0, 1.0).otherwise(hits / union)
    points = F.struct(
        F.when(has, hits).otherwise(0).cast("bigint").alias("tp"),
        F.when(has, F.size(b) - hits).otherwise(0).cast("bigint").alias("fp"),
        (F.size(a) - F.when(has, hits).otherwise(0)).cast("bigint").alias("fn"),
        jaccard.alias("jaccard"),
        (has & (F.size(a) == hits) & (F.size(b) == hits)).alias("exact"),
    )
    return rows.select("path", *manifest.columns, has.alias("has_output"), "ref", "pred", F.array(*outcome).alias("fields"), points.alias("points"))


def precision(tp: Column, fp: Column) -> Column:
    return F.try_divide(tp.cast("double"), tp + fp)


def f1(p: Column, r: Column) -> Column:
    """Null where either is null or both are 0."""
    return F.try_divide(2 * p * r, p + r)


def _with_prf(df: DataFrame, prefix: str = "") -> DataFrame:
    tp, fp, fn = (F.col(f"{prefix}{c}") for c in ("tp", "fp", "fn"))
    p, r = precision(tp, fp), precision(tp, fn)
    return df.withColumns({f"{prefix}precision": p, f"{prefix}recall": r, f"{prefix}f1": f1(p, r)})


def confusion(scores: DataFrame) -> DataFrame:
    """tp, fp, fn with precision, recall and F1 per path and scalar field."""
    cells = scores.select("path", F.explode("fields").alias("c"))
    return _with_prf(cells.groupBy("path", F.col("c.field").alias("field")).agg(*[F.sum(f"c.{x}").alias(x) for x in ("tp", "fp", "fn")]))


def summary(scores: DataFrame) -> DataFrame:
    """Per path: coverage, micro-averaged scalars, waypoint counts, mean Jaccard and exact rate."""
    total = lambda c: F.sum(F.aggregate("fields", F.lit(0).cast("bigint"), lambda acc, x: acc + x[c]))
    sums = scores.groupBy("path").agg(
        F.count("*").alias("n"),
        F.avg(F.col("has_output").cast("double")).alias("coverage"),
        *[total(c).alias(f"scalar_{c}") for c in ("tp", "fp", "fn")],
        *[F.sum(f"points.{c}").alias(f"wp_{c}") for c in ("tp", "fp", "fn")],
        F.avg("points.jaccard").alias("mean_jaccard"),
        F.avg(F.col("points.exact").cast("double")).alias("exact_rate"),
    )
    return _with_prf(_with_prf(sums, "scalar_"), "wp_")


def per_sample(scores: DataFrame, key: str) -> DataFrame:
    """Per record the mean of its applicable matches (null without any) and its waypoint scores."""
    applicable = F.filter("fields", lambda x: x["applicable"])
    hit = F.size(F.filter(applicable, lambda x: x["matched"]))
    return scores.select(
        "path", key, "has_output", F.try_divide(hit.cast("double"), F.size(applicable)).alias("scalar_exact_rate"), F.col("points.exact").alias("wp_exact"), F.col("points.jaccard").alias("wp_jaccard")
    )

"""Labels of errors, their counts, examples and signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import SCALARS


def _scalar_label(i: int, field: str) -> Column:
    cell = F.col("fields")[i]
    ref, pred = F.col(f"ref.{field}"), F.col(f"pred.{field}")
    if field == "holding_required":
        wrong = F.when(ref & ~pred, "missed_hold").when(~ref & pred, "false_hold").otherwise("wrong_value")
    elif field == "turn_direction":
        sided = lambda c: c.isin("LEFT", "RIGHT")
        wrong = F.when((pred == "NONE") & sided(ref), "missed_turn").when(sided(pred) & (ref == "NONE"), "hallucinated_turn").otherwise("wrong_direction")
    else:
        wrong = F.lit("wrong_fix" if field == "holding_fix" else "wrong_value")
    kind = (
        F.when(cell["matched"] | (~cell["applicable"] & ~cell["predicted"]), F.lit(None).cast("string"))
        .when(~cell["applicable"], "spurious_prediction")
        .when(~cell["predicted"], "missing_prediction")
        .otherwise(wrong)
    )
    return F.when(kind.isNotNull(), F.struct(F.lit(field).alias("field"), F.concat(F.lit(f"{field}:"), kind).alias("label")))


def _waypoint_label() -> Column:
    tp, fp, fn = (F.col(f"points.{c}") for c in ("tp", "fp", "fn"))
    kind = (
        F.when((fp == 0) & (fn == 0), F.lit(None).cast("string"))
        .when((tp == 0) & (fn == 0), "spurious_only")
        .when((tp == 0) & (fp == 0), "missed_all")
        .when(tp == 0, "noisy_mismatch")
        .when(fn == 0, "extra_points")
        .when(fp == 0, "missing_points")
        .otherwise("mixed_missing_and_extra")
    )
    return F.when(kind.isNotNull(), F.struct(F.lit("waypoints").alias("field"), F.concat(F.lit("waypoints:"), kind).alias("label")))


def labelled(scores: DataFrame) -> DataFrame:
    """Each scored record with the array of its ``(field, label)``; one without output has just ``sample:no_output``."""
    found = F.filter(F.array(*[_scalar_label(i, f) for i, f in enumerate(SCALARS)], _waypoint_label()), lambda x: x.isNotNull())
    none = F.array(F.struct(F.lit("sample").alias("field"), F.lit("sample:no_output").alias("label")))
    return scores.withColumn("labels", F.when(F.col("has_output"), found).otherwise(none))


def label_counts(labels: DataFrame, *by: str) -> DataFrame:
    """Records per path (or ``by``) and label."""
    rows = labels.select("path", F.explode("labels").alias("x")).select("path", "x.field", "x.label")
    return rows.groupBy("path", *by, "label").agg(F.count("*").alias("n"))


def top(counts: DataFrame, k: int, within: list[str], name: str) -> DataFrame:
    """The ``k`` commonest of each group; ties in the order of ``name``."""
    order = Window.partitionBy(*within).orderBy(F.desc("n"), name)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def signatures(labels: DataFrame) -> DataFrame:
    """Records per path and set of labels, written sorted with `` | `` between them; records without labels have none."""
    text = F.array_join(F.array_sort(F.transform("labels", lambda x: x["label"])), " | ")
    return labels.where(F.size("labels") > 0).groupBy("path", text.alias("signature")).agg(F.count("*").alias("n"))


def first_examples(labels: DataFrame, key: str, position: str, k: int) -> DataFrame:
    """The first ``k`` records (by ``position``) of each path and label, and their ranks.

    Ranked within groups of records first, so that a label that most records have never
    brings more than ``k`` rows per group to one task.
    """
    rows = labels.select("path", key, position, F.explode("labels").alias("x")).select("path", key, position, "x.label")
    salted = rows.withColumn("__fw_salt", F.pmod(F.xxhash64(key), F.lit(256)))
    part = Window.partitionBy("path", "label", "__fw_salt").orderBy(position, key)
    few = salted.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k).drop("rank", "__fw_salt")
    order = Window.partitionBy("path", "label").orderBy(position, key)
    return few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

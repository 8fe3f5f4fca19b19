"""Selection of samples by strata with quotas, a cap per group and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_order(key: str, seed: int) -> Column:
    """An order that looks random and is the same on every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def stratified(df: DataFrame, key: str, stratum: str, quotas: dict[str, int], group: str, cap: int, seed: int) -> DataFrame:
    """At most ``cap`` rows of each group and at most the quota of each stratum, in seeded order.

    Ranks are taken in ranges of the order first, so that a stratum with most of the rows
    never meets in one task: no more than its quota can be taken from any range.
    """
    order = seeded_order(key, seed)
    rows = df.where(F.col(stratum).isin(*quotas)).withColumn("__fw_order", order)
    few = rows.withColumn("__fw_salt", F.pmod(F.xxhash64(key), F.lit(64)))
    few = few.withColumn("__fw_r", F.row_number().over(Window.partitionBy(group, "__fw_salt").orderBy("__fw_order", key))).where(F.col("__fw_r") <= cap)
    capped = few.withColumn("__fw_r", F.row_number().over(Window.partitionBy(group).orderBy("__fw_order", key))).where(F.col("__fw_r") <= cap)
    quota = F.coalesce(*[F.when(F.col(stratum) == s, q) for s, q in quotas.items()])
    part = capped.withColumn("__fw_r", F.row_number().over(Window.partitionBy(stratum, "__fw_salt").orderBy("__fw_order", key))).where(F.col("__fw_r") <= quota)
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("__fw_order", key))
    return part.withColumn("__fw_r", rank).where(F.col("__fw_r") <= quota).withColumnRenamed("__fw_r", "rank").drop("__fw_order", "__fw_salt")


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that stand on one side only, with the side that has them."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("only_in", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("only_in", F.lit("right")))


def first_missing(left: DataFrame, right: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The ``n`` least keys that only one side has, in order."""
    return missing_keys(left, right, key).orderBy(key, "only_in").limit(n)


def lookup_list(left: DataFrame, right: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Every row of ``left`` with the sorted distinct ``value``s that ``right`` has for its key; an empty list for none."""
    lists = right.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(name))
    return left.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no output yet."""
    return df.join(done.select(key), key, "left_anti")


def strict_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join that loses no row of the left side: a key without a partner is an error."""
    joined = left.join(right.withColumn("__fw_there", F.lit(True)), key, "left")
    lost = F.raise_error(F.concat(F.lit("no partner for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")
    return joined.where(F.coalesce(F.col("__fw_there"), lost)).drop("__fw_there")


def expect_rows(df: DataFrame, n: int, what: str) -> DataFrame:
    """``df``, after making sure that it has ``n`` rows."""
    if (found := df.count()) != n:
        raise ValueError(f"{what}: {found} rows, not {n}")
    return df

"""Queries p3, p4, p6, p7 and p8 and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from .encoding import repair_encoding
from .leaks import find_leaks
from .mixing import mix_sources
from .personal import find_personal
from .scans import clean_scans


def p3_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of path A with its text in continuous paragraphs and the noise found in it."""
    return clean_scans(read_table(spark, folder, "path_a"), "rec_id", "raw_instruction", "waypoints")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each record's kinds of noise."""
    return p3_repaired(spark, folder).select("rec_id", F.explode("noise").alias("noise"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records of path C whose instruction is garbled."""
    return repair_encoding(read_table(spark, folder, "path_c"), "rec_id", "raw_instruction").select("rec_id")


def p4_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The same records with the original text wherever it can be had."""
    return repair_encoding(read_table(spark, folder, "path_c"), "rec_id", "raw_instruction")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every evaluation item and document that share eight consecutive words."""
    return find_leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items"), "doc_id", "item_id")


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents leak each item; items that don't leak have none."""
    items = read_table(spark, folder, "eval_items")
    leaks = p6_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return items.select("item_id", "suite").join(leaks, "item_id", "left").na.fill(0, ["n_docs"])


def _mix(spark: SparkSession, folder: str):
    return mix_sources(read_table(spark, folder, "documents"), read_table(spark, folder, "mix_targets"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mix: each document with its number of copies."""
    return _mix(spark, folder).documents


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares of the mix."""
    return _mix(spark, folder).report


def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with typed placeholders for its personal data, and the kinds found."""
    return find_personal(read_table(spark, folder, "documents"), "doc_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's kinds of personal data."""
    return p8_redacted(spark, folder).select("doc_id", F.explode("kinds").alias("pii_kind"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found,
    "p3_repaired": p3_repaired,
    "p4_found": p4_found,
    "p4_restored": p4_restored,
    "p6_found": p6_found,
    "p6_items": p6_items,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_redacted": p8_redacted,
}

_LEAKS = """
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
     d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
     ir AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' '))) AS run FROM i),
     dr AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' '))) AS run FROM d),
     leak AS (SELECT DISTINCT item_id, doc_id FROM ir JOIN dr USING (run))
"""
#: Queries whose operator SQL can express over whole tables.
SQL: dict[str, str] = {
    "p6_found": _LEAKS + "SELECT item_id, doc_id FROM leak",
    "p6_items": _LEAKS + "SELECT item_id, suite, count(doc_id) AS n_docs FROM eval_items LEFT JOIN leak USING (item_id) GROUP BY ALL",
}

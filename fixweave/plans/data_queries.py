"""The p1, p2 and p5 queries over the chart tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.copies import diff_copies, list_form, number_form, text_form
from ..operators.drift import failed_casts, schema_changes, unify
from ..operators.nested import flatten_entries, flatten_records
from ..operators import scoring
from ..session import materialise, read_table
from .reference_queries import line_table, procedure_table, turn_table, whole_pairs


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every chart that one copy of path O lacks and every field in which the copies differ."""
    fields = {"climb_altitude": number_form, "turn_direction": text_form, "holding_fix": text_form, "waypoints": list_form}
    copies = [read_table(spark, folder, name) for name in ("path_o", "path_o_mirror")]
    return diff_copies(*copies, ["chart_no"], fields, "loaded_at", ("path_o", "path_o_mirror"))


def _feeds(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "path_b").unionByName(read_table(spark, folder, "path_e"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every change of a layout and the file where it starts."""
    return schema_changes(_feeds(spark, folder))


#: The consistent table's columns beside those of a row.
RECORD = {
    "raw_instruction": "string",
    "climb_altitude": "number",
    "waypoints": "list",
    "turn_direction": "string",
    "holding_required": "boolean",
    "holding_fix": "string",
    "initial_track": "string",
    "turn_trigger": "string",
    "evidence": "string",
    "_questionnaire": "answers",
}


def p2_table(spark: SparkSession, folder: str) -> DataFrame:
    """All records of paths B and E in one consistent table."""
    return unify(_feeds(spark, folder), RECORD)


def p2_uncast(spark: SparkSession, folder: str) -> DataFrame:
    """How many values of each field of that table could not be cast."""
    return failed_casts(p2_table(spark, folder))


def p2_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Paths B and E scored against path O, by the consistent table."""
    whole = F.col("climb_altitude") == F.floor("climb_altitude")
    rows = p2_table(spark, folder).where("well_formed").withColumns(
        {"climb_altitude": F.when(whole, F.col("climb_altitude").cast("bigint").cast("string")), "holding_required": F.col("holding_required").cast("string")}
    )
    # written once: both paths are taken from it
    rows = materialise(rows.select("feed", "chart_no", "raw_no", "written_at", *scoring.SCALARS, "waypoints"), "feed-records")
    paths = {p.upper(): scoring.latest(rows.where(F.col("feed").startswith(f"{p}-")), "chart_no", "written_at", "raw_no") for p in "be"}
    reference = scoring.latest(read_table(spark, folder, "path_o"), "chart_no", "loaded_at", "rec_id")
    scores = scoring.scored(read_table(spark, folder, "manifest").select("chart_no", "pos"), reference, paths, "chart_no")
    return scoring.summary(scores)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every leg of every pair."""
    return flatten_entries(read_table(spark, folder, "pairs_100"), "pair_no", "body", "cifp.legs", "legs", ["rt_type", "wpt_ident"], number="leg_no")


def p5_legs(spark: SparkSession, folder: str) -> DataFrame:
    """Every leg with all its fields; ``pair_no`` points to p5_pairs."""
    fields = ["trans_ident", "seq_no", "rt_type", "wpt_ident", "altitude1", "alt_desc"]
    return flatten_entries(read_table(spark, folder, "pairs_100"), "pair_no", "body", "cifp.legs", "legs", fields, outer=["trans_ident"], number="leg_no")


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per pair with its airport, procedure and number of legs."""
    pairs = flatten_records(read_table(spark, folder, "pairs_100"), ["pair_no", "chart_no", "id"], "body", "cifp", "legs", ["airport", "proc_ident"])
    return pairs.withColumnRenamed("n_entries", "n_legs")


def p5_records(spark: SparkSession, folder: str) -> DataFrame:
    """The canonical record of every pair; one whose body can't be read is kept, not ``well_formed``."""
    return procedure_table(whole_pairs(read_table(spark, folder, "pairs_100")), "well_formed")


def p5_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every leg of every pair, written as a fixed-width line and parsed again."""
    return line_table(whole_pairs(read_table(spark, folder, "pairs_100")))


def p5_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The turn of every pair, looked up in the lines of all."""
    return turn_table(whole_pairs(read_table(spark, folder, "pairs_100")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_table": p2_table,
    "p2_uncast": p2_uncast,
    "p2_summary": p2_summary,
    "p5_found": p5_found,
    "p5_legs": p5_legs,
    "p5_pairs": p5_pairs,
    "p5_records": p5_records,
    "p5_lines": p5_lines,
    "p5_turns": p5_turns,
}

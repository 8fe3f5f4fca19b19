"""Queries over the chart tables that exercise the record, scoring and text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import responses as R
from ..functions import textrules as X
from ..operators import fixed_width, scoring, selection, sequence, taxonomy
from ..operators.nested import gather_entries
from ..session import passing_path, read_table
from ..sources.readers import document_name, json_array, record_altitude, record_fields, relative_path
from ..sources.writers import trace, write_array, write_records

Query = Callable[[SparkSession, str], DataFrame]


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    table = lambda n: scoring.latest(read_table(spark, folder, n), "chart_no", "loaded_at", "rec_id")
    manifest = read_table(spark, folder, "manifest").select("chart_no", "pos")
    return scoring.scored(manifest, table("path_o"), {"A": table("path_a"), "C": table("path_c")}, "chart_no")


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return taxonomy.labelled(_scores(spark, folder))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def q_scalar_confusion(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(scoring.confusion(_scores(spark, folder)), "precision", "recall", "f1")


def q_summary(spark: SparkSession, folder: str) -> DataFrame:
    ratios = ["coverage", "mean_jaccard", "exact_rate", *(f"{a}_{b}" for a in ("scalar", "wp") for b in ("precision", "recall", "f1"))]
    return _rounded(scoring.summary(_scores(spark, folder)), *ratios)


def q_per_sample(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(scoring.per_sample(_scores(spark, folder), "chart_no"), "scalar_exact_rate", "wp_jaccard")


def q_label_counts(spark: SparkSession, folder: str) -> DataFrame:
    return taxonomy.label_counts(_labels(spark, folder))


def q_top_labels(spark: SparkSession, folder: str) -> DataFrame:
    return taxonomy.top(taxonomy.label_counts(_labels(spark, folder)), 12, ["path"], "label")


def q_topk_per_field(spark: SparkSession, folder: str) -> DataFrame:
    return taxonomy.top(taxonomy.label_counts(_labels(spark, folder), "field"), 5, ["path", "field"], "label")


def q_signatures(spark: SparkSession, folder: str) -> DataFrame:
    return taxonomy.top(taxonomy.signatures(_labels(spark, folder)), 8, ["path"], "signature")


def q_label_examples(spark: SparkSession, folder: str) -> DataFrame:
    return taxonomy.first_examples(_labels(spark, folder), "chart_no", "pos", 10).select("path", "label", "rank", "chart_no")


def q_normalized(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "path_a").unionByName(read_table(spark, folder, "path_c"))
    made = rows.select(
        "path_code",
        "rec_id",
        N.altitude(F.col("climb_altitude")).alias("climb_altitude"),
        N.turn(F.col("turn_direction")).alias("turn_direction"),
        N.holding(F.col("holding_required")).alias("holding_required"),
        N.fix(F.col("holding_fix")).alias("holding_fix"),
        F.array_join(F.array_sort(N.waypoint_set(F.col("waypoints"))), " ").alias("waypoints"),
    )
    return made


def whole_pairs(pairs: DataFrame) -> DataFrame:
    """Every pair with its legs as cifp has them, read from body where cifp is null."""
    fields = ["trans_ident", "seq_no", "rt_type", "wpt_ident", "altitude1", "alt_desc"]
    whole = gather_entries(pairs, ["pair_no", "chart_no", "id"], "body", "cifp", "legs", fields, ["airport", "proc_ident"], outer=["trans_ident"], key_field="seq_no")
    return whole.withColumn("cifp", F.col("cifp").withField("airport", N.strip(F.col("cifp.airport"))))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return whole_pairs(read_table(spark, folder, "pairs_100"))


def procedure_table(pairs: DataFrame, *keep: str) -> DataFrame:
    records = sequence.procedure_records(pairs, keep=("pair_no", "chart_no", "id", *keep))
    return records.withColumn("waypoints", F.array_join("waypoints", " "))


def _lines(pairs: DataFrame) -> DataFrame:
    """Every leg as a fixed-width line; the turn follows from its place."""
    legs = pairs.select("pair_no", "cifp.airport", "cifp.proc_ident", F.posexplode("cifp.legs").alias("p", "leg")).where(F.col("leg").isNotNull())
    turn = F.element_at(F.array(F.lit("L"), F.lit("R"), F.lit(" ")), (F.pmod(F.col("pair_no") + F.col("p"), F.lit(3)) + 1).cast("int"))
    values = {"airport": F.col("airport"), "proc_ident": N.strip(F.col("proc_ident")), "turn_dir": turn}
    values |= {c: N.strip(F.col(f"leg.{c}")) for c in ("trans_ident", "seq_no", "rt_type")}
    return legs.select("pair_no", "p", (F.col("pair_no") * 1000 + F.col("p")).alias("line_no"), fixed_width.render(fixed_width.APPROACH, values).alias("line"))


def line_table(pairs: DataFrame) -> DataFrame:
    return fixed_width.parse(_lines(pairs), "line", keep=("pair_no", "p"))


def turn_table(pairs: DataFrame) -> DataFrame:
    parsed = fixed_width.parse(_lines(pairs), "line", keep=("line_no",))
    index = fixed_width.first_wins(parsed, ["airport", "proc_ident", "trans_ident", "seq_no"], "turn_dir", "line_no")
    records = sequence.procedure_records(pairs).select("pair_no", "airport", "proc_ident", "transition", "direct_seq")
    found = fixed_width.lookup(records, index, {"airport": "airport", "proc_ident": "proc_ident", "transition": "trans_ident", "direct_seq": "seq_no"}, "turn_dir")
    turn = F.when(F.col("turn_dir") == "L", "LEFT").when(F.col("turn_dir") == "R", "RIGHT").otherwise("NONE")
    return found.select("pair_no", turn.alias("turn_direction"))


def q_procedure_record(spark: SparkSession, folder: str) -> DataFrame:
    return procedure_table(_pairs(spark, folder))


def q_fixed_width(spark: SparkSession, folder: str) -> DataFrame:
    return line_table(_pairs(spark, folder))


def q_turn_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return turn_table(_pairs(spark, folder))


def q_rules(spark: SparkSession, folder: str) -> DataFrame:
    made = X.rule_records(read_table(spark, folder, "path_a"), "raw_instruction", ["rec_id"])
    return made.drop("raw_instruction").withColumn("waypoints", F.array_join("waypoints", " "))


def q_page_instruction(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "path_a")
    return X.page_instructions(rows, F.split(F.coalesce("raw_instruction", F.lit("")), r"\r?\n"), ["rec_id"])


def q_clean_line(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "path_c").select("rec_id", X.clean_line(F.col("raw_instruction")).alias("line"))


def q_json_response(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.lit("Evidence first.\nJSON:\n"), F.col("payload"), F.lit("\nend"))
    parsed = R.json_object(R.after_marker(text))
    rows = read_table(spark, folder, "path_b").select("raw_no", parsed.alias("v"))
    return rows.select("raw_no", F.col("v").isNotNull().alias("parsed"), F.try_variant_get("v", "$.turn_trigger", "string").alias("turn_trigger"))


def q_questionnaire(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "path_e").select("raw_no", R.questionnaire(F.col("payload")).alias("a"))
    return rows.select("raw_no", *[F.col("a")[f"Q{q}"].alias(f"q{q}") for q in range(1, 7)])


def q_answers(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "path_c")
    answers = F.create_map(
        *[F.lit("raw_instruction"), F.coalesce("raw_instruction", F.lit(" "))],
        *[F.lit("climb_altitude"), F.concat(F.coalesce("climb_altitude", F.lit("unknown")), F.lit(" ft"))],
        *[F.lit("waypoints"), F.concat(F.lit("Points: "), F.to_json("waypoints"))],
        *[F.lit("turn_direction"), F.lower("turn_direction")],
        *[F.lit("holding_required"), F.upper("holding_required")],
        *[F.lit("holding_fix"), F.coalesce("holding_fix", F.lit("null"))],
    )
    made = R.answer_record(F.col("answers"))
    columns = [made[c].alias(c) for c in ("climb_altitude", "turn_direction", "holding_required", "holding_fix")]
    return rows.select("rec_id", answers.alias("answers")).select("rec_id", *columns, F.array_join(made["waypoints"], " ").alias("waypoints"))


def q_strat_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "manifest").withColumn("kind", F.substring(N.strip(F.col("proc_ident")), 1, 1))
    return selection.stratified(rows, "chart_no", "kind", {"R": 60, "L": 25, "I": 15}, "airport", 2, 2604).select("kind", "rank", "chart_no", "airport")


def q_missing_keys(spark: SparkSession, folder: str) -> DataFrame:
    return selection.missing_keys(read_table(spark, folder, "manifest"), read_table(spark, folder, "path_a"), "chart_no")


def q_not_done(spark: SparkSession, folder: str) -> DataFrame:
    return selection.not_done(read_table(spark, folder, "manifest").select("chart_no", "id"), read_table(spark, folder, "path_c"), "chart_no")


def q_first_missing(spark: SparkSession, folder: str) -> DataFrame:
    return selection.first_missing(read_table(spark, folder, "manifest"), read_table(spark, folder, "path_b"), "chart_no")


def q_airport_procedures(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the procedures of its airport."""
    rows = read_table(spark, folder, "documents").select("doc_id", "airport")
    found = selection.lookup_list(rows, read_table(spark, folder, "manifest"), "airport", N.strip(F.col("proc_ident")), "procedures")
    return found.withColumn("procedures", F.array_join("procedures", " "))


def q_strict_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of path C with its chart; a record without one is an error."""
    return selection.strict_join(read_table(spark, folder, "path_c").select("chart_no", "rec_id"), read_table(spark, folder, "manifest").select("chart_no", "pos", "id"), "chart_no")


def q_expected_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The evaluation items, of which there must be 240."""
    return selection.expect_rows(read_table(spark, folder, "eval_items"), 240, "evaluation items").select("item_id", "suite")


def q_point_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The chart at place 7 of the manifest."""
    return read_table(spark, folder, "manifest").where(F.col("pos") == 7).select("chart_no", "pos", "id")


def q_filled(spark: SparkSession, folder: str) -> DataFrame:
    """A template filled for each chart."""
    rows = read_table(spark, folder, "manifest")
    return rows.select("chart_no", R.fill("Chart {sid} of {airport}: {sid}", sid=F.col("id"), airport=F.coalesce("airport", F.lit("?"))).alias("prompt"))


def q_instruction(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded instructions with their signs mended."""
    return read_table(spark, folder, "path_c").select("rec_id", R.instruction(F.coalesce("raw_instruction", F.lit(""))).alias("instruction"))


def q_record_types(spark: SparkSession, folder: str) -> DataFrame:
    """Altitude and holding of path B's records as their JSON types allow."""
    rows = read_table(spark, folder, "path_b").select("raw_no", F.try_parse_json("payload").alias("v"))
    made = record_fields(F.col("v"))
    return rows.select("raw_no", record_altitude(F.col("v")).alias("climb_altitude"), N.holding(made["holding_required"]).alias("holding_required"))


def q_written_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records written as JSON lines, one folder per path, and read again."""
    rows = read_table(spark, folder, "path_a").select("rec_id", "path_code", "climb_altitude", "waypoints")
    place = passing_path(spark, "records")
    write_records(rows, place, "path_code")
    found = spark.read.schema(rows.schema).json(place)
    return found.withColumn("waypoints", F.array_join("waypoints", " "))


def q_trace(spark: SparkSession, folder: str) -> DataFrame:
    """The questions put to each record and their answers, as one JSON text."""
    answers = {f: F.col(f) for f in ("turn_direction", "holding_fix")}
    return read_table(spark, folder, "path_c").select("rec_id", trace(answers).alias("trace"))


def q_written_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest selected by quotas, written as one JSON array and read again."""
    rows = read_table(spark, folder, "manifest").withColumn("kind", F.substring(N.strip(F.col("proc_ident")), 1, 1))
    chosen = selection.stratified(rows, "chart_no", "kind", {"R": 20, "L": 10}, "airport", 2, 2604)
    place = passing_path(spark, "manifest")
    write_array(chosen.orderBy("pos").select("chart_no", "id", "airport"), place)
    return json_array(spark, place, "chart_no bigint, id string, airport string").withColumn("pos", F.col("pos").cast("bigint"))


def q_manifest_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Charts joined with their newest pair; the others are reported, none is lost."""
    newest = read_table(spark, folder, "pairs_100").groupBy("chart_no").agg(F.max_by("pair_no", F.struct("loaded_at", "pair_no")).alias("pair_no"))
    joined = read_table(spark, folder, "manifest").select("chart_no", "id").join(newest, "chart_no", "left")
    return joined.withColumn("has_pair", F.col("pair_no").isNotNull())


def q_holding_legs(spark: SparkSession, folder: str) -> DataFrame:
    legs = F.transform(F.coalesce("ma_holding_legs", F.array()), lambda x: F.struct(N.strip(x["rt_type"]).alias("rt"), N.strip(x["wpt_ident"]).alias("wpt")))
    rows = read_table(spark, folder, "manifest").select("chart_no", legs.alias("legs"))
    kept = F.filter("legs", lambda x: x["rt"].isin("HF", "HA") | x["wpt"].startswith("M"))
    text = F.array_join(F.transform(kept, lambda x: F.concat_ws(" ", x["rt"], x["wpt"])), ", ")
    return rows.select("chart_no", F.exists("legs", lambda x: x["rt"].isin("HF", "HA")).alias("explicit_hold"), text.alias("kept"))


def q_count_if(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "manifest")
    return rows.groupBy("airac").agg(F.count("*").alias("n"), F.count_if(F.col("holding_required")).alias("holds"), F.count_if(F.col("total_legs").isNull()).alias("no_legs"))


def q_procedures_by_airport(spark: SparkSession, folder: str) -> DataFrame:
    names = F.array_join(F.array_sort(F.collect_set(N.strip(F.col("proc_ident")))), " ")
    return read_table(spark, folder, "manifest").groupBy("airport").agg(F.count("*").alias("n"), names.alias("procedures"))


def q_largest(spark: SparkSession, folder: str) -> DataFrame:
    order = F.struct(-F.col("n_chars"), F.col("doc_id"))
    return read_table(spark, folder, "documents").groupBy("source").agg(F.min_by("doc_id", order).alias("doc_id"), F.max("n_chars").alias("n_chars"))


def q_heads(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "manifest").select("chart_no", "pos", "holding_required")
    held, free = rows.where("holding_required").orderBy("pos").limit(6), rows.where("not holding_required").orderBy("pos").limit(4)
    return held.unionByName(free)


def q_paths_of_images(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "pairs_100").where(F.col("image_path").rlike(r"_p0\.[A-Za-z]+$"))
    return rows.select("pair_no", relative_path(F.col("image_path")).alias("path"), document_name(F.col("image_path")).alias("document"))


_ORDER = ["ts", "event_id"]


def q_after_anchor(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "events")
    later = sequence.after_first(rows, "user_id", _ORDER, F.col("event_type") == "signup")
    return later.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def q_after_flag(spark: SparkSession, folder: str) -> DataFrame:
    rows = sequence.after_first(read_table(spark, folder, "events"), "user_id", _ORDER, F.col("event_type") == "error").where(F.col("event_type") != "error")
    first = rows.groupBy("user_id", "event_type").agg(F.min(F.struct(*_ORDER)).alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "event_type")))
    return first.groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda x: x["event_type"]), " ").alias("types"))


def q_first_match(spark: SparkSession, folder: str) -> DataFrame:
    return sequence.first_match(read_table(spark, folder, "events"), "user_id", _ORDER, F.col("event_type") == "purchase", "event_id")


def q_context_window(spark: SparkSession, folder: str) -> DataFrame:
    rows = sequence.context(read_table(spark, folder, "events"), "user_id", _ORDER, (F.col("event_type") == "click").cast("bigint"), 2, 9)
    best = sequence.best_per_key(rows.where(F.col("event_type") == "error"), "user_id", "score", _ORDER)
    return best.select("user_id", "event_id", "score")


QUERIES: dict[str, Query] = {
    name: value for name, value in list(globals().items()) if name.startswith("q_")
}

"""Readers of the reference's file kinds. Directories are read, not lists of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import altitude
from ..functions.responses import fill  # noqa: F401  (templates are filled where they are read)

LEG = "struct<trans_ident:string,seq_no:string,rt_type:string,wpt_ident:string,altitude1:string,alt_desc:string>"
MANIFEST = "id string, image string, airport string, proc_ident string, holding_required boolean, total_legs int, ma_holding_legs array<struct<rt_type:string,wpt_ident:string>>"
PAIRS = f"id string, image_path string, cifp struct<airport:string,proc_ident:string,legs:array<{LEG}>>"
RECORD = (
    "raw_instruction string, climb_altitude string, waypoints array<string>, turn_direction string, holding_required string,"
    " holding_fix string, initial_track string, turn_trigger string, holding_details struct<track:string,direction:string,leg_time:string>"
)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array, with ``pos``, its order from 0."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", f"array<struct<{_fields(schema)}>>")).alias("pos", "x")).select("pos", "x.*")


def _fields(schema: str) -> str:
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema))


def json_objects(spark: SparkSession, directory: str) -> DataFrame:
    """One object per file: ``sid`` (the file's name), ``record`` as a variant, ``has_output``.

    Unreadable, cut off and literally null files have no output; files of no bytes have no row, as if they were absent.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(directory)
    text = files.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("sid"), F.try_parse_json(F.decode("content", "UTF-8")).alias("record"))
    return text.withColumn("has_output", F.col("record").isNotNull() & (F.schema_of_variant("record") != "VOID"))


def record_fields(record: Column) -> dict[str, Column]:
    """Scalars of a variant record as text, waypoints as a list; other types are undetermined, not errors.

    An altitude that is no whole number (``3000.0``) is undetermined; whether holding is required
    may be a truth value or text, not a number.
    """
    kind = lambda f: F.schema_of_variant(F.try_variant_get(record, f"$.{f}", "variant"))
    text = lambda f: F.when(~kind(f).rlike("^(ARRAY|OBJECT)"), F.try_variant_get(record, f"$.{f}", "string"))
    out = {f: text(f) for f in ("raw_instruction", "climb_altitude", "turn_direction", "holding_required", "holding_fix", "initial_track", "turn_trigger")}
    alt, hold = kind("climb_altitude"), kind("holding_required")
    out["climb_altitude"] = F.when(~alt.rlike("^(DECIMAL|DOUBLE|FLOAT)"), out["climb_altitude"])
    out["holding_required"] = F.when(hold.isin("BOOLEAN", "STRING"), out["holding_required"])
    return out | {"waypoints": F.try_variant_get(record, "$.waypoints", "array<string>")}


def record_altitude(record: Column) -> Column:
    """The altitude of a variant record as a number; a truth value passes as 1 or 0."""
    kind = F.schema_of_variant(F.try_variant_get(record, "$.climb_altitude", "variant"))
    return F.when(kind == "BOOLEAN", F.try_variant_get(record, "$.climb_altitude", "boolean").cast("int")).otherwise(altitude(record_fields(record)["climb_altitude"]))


def latin1_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of Latin-1 files with their file and number from 0, for layouts where the first line wins."""
    files = spark.read.format("binaryFile").load(path)
    lines = files.select(F.col("path").alias("file"), F.posexplode(F.split(F.decode("content", "ISO-8859-1"), r"\r?\n")).alias("line_no", "value"))
    return lines.where(F.col("value") != "")


def first_lines(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    """The first ``n`` lines of Latin-1 files, in order: a look at what a file holds."""
    return latin1_lines(spark, path).orderBy("file", "line_no").limit(n)


def latin1_records(spark: SparkSession, path: str) -> DataFrame:
    """Lines of large Latin-1 files, split among tasks, without numbers."""
    reader = spark.read.option("encoding", "ISO-8859-1").option("sep", "\u0001").option("quote", "")
    return reader.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).schema("value string").csv(path)


def template(spark: SparkSession, path: str) -> str:
    """A prompt file's text without white space around it."""
    return spark.read.text(path, wholetext=True).first().value.strip()


def images(spark: SparkSession, directory: str, pattern: str = "*.png") -> DataFrame:
    """``path``, ``length`` and the content in standard base64 on one line."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    return files.select("path", "length", F.regexp_replace(F.base64("content"), "\r\n", "").alias("base64"))


def largest_file(spark: SparkSession, directory: str, pattern: str) -> str | None:
    """The largest file that matches; the first by name of equals."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(directory)
    row = files.agg(F.min_by("path", F.struct(-F.col("length"), "path")).alias("path")).first()
    return row.path if row else None


def document_name(image: Column) -> Column:
    """The document of a page image: ``x_p0.png`` is of ``X.PDF``; an error for other names."""
    stem = F.regexp_extract(image, r"([^/\\]+)_p0\.[^.]+$", 1)
    return F.when(stem == "", F.raise_error(F.concat(F.lit("no page image: "), image))).otherwise(F.concat(F.upper(stem), F.lit(".PDF")))


def relative_path(path: Column) -> Column:
    """Paths without their data folder, with slashes."""
    return F.regexp_replace(F.translate(path, "\\", "/"), "^data/", "")

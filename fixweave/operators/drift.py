"""Schemas that drift between the files of a feed.

Records are parsed once into variants; counts of fields, types, value shapes and words per
file are pre-aggregated in the JVM, so a file or feed with most of the rows sends only its
counts. Those of a file meet those of the one before it as sorted rows, of which one pair of
files at a time is held, and similarity flooding decides which vanished field another one
carries on.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .flooding import Field, correspondences

CHANGES = "feed string, file_no int, change_kind string, field_before string, field_after string"
_CHANGES = pa.schema([(x.split()[0], pa.int32() if x.endswith("int") else pa.string()) for x in CHANGES.split(", ")])
#: Value shapes are hashed into so many buckets: shapes of codes hardly ever recur, but fill them alike.
SHAPE_BUCKETS = 256
_FIELD = ("feed", "file_no", "key", "inner")
#: Files whose numbers fall into one such range are compared in one task at most.
RUN = 256
#: Shapes of more characters are told by the value's length only.
LONGEST_SHAPE = 24


def parsed(payload: Column) -> Column:
    """The payload as a variant; null if it is not one well-formed JSON object."""
    whole = payload.rlike(r"^\s*\{[\s\S]*\}\s*$")
    return F.when(whole, F.try_parse_json(payload))


def _type(value: Column) -> Column:
    name = F.schema_of_variant(value)
    kinds = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean"}
    found = F.when(name == "VOID", F.lit(None).cast("string"))
    for start, kind in kinds.items():
        found = found.when(name.startswith(start), kind)
    return found.otherwise("number")


def _marks(kind: Column, text: Column) -> Column:
    """What a whole value looks like, as a list of which the first entry stands for the value.

    Numbers by their digits before the point, other values by their runs of letters and
    digits, long ones by their length in powers of two. Of prose, every word follows, once
    for the value.
    """
    runs = F.regexp_replace(F.regexp_replace(text, "[0-9]+", "9"), r"\p{L}+", "a")
    size = F.concat(F.lit("~"), F.ceil(F.log2(F.length(text))).cast("string"))
    shape = (
        F.when(kind == "boolean", "b")
        .when(kind == "number", F.concat(F.lit("n"), F.length(F.regexp_extract(text, r"^-?0*([0-9]*)", 1)).cast("string")))
        .when(kind == "object", "o")
        .otherwise(F.concat(F.substring(kind, 1, 1), F.when(F.length(runs) <= LONGEST_SHAPE, runs).otherwise(size)))
    )
    words = F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), "")
    prose = F.when((kind == "string") & text.contains(" "), F.transform(words, lambda w: F.concat(F.lit("w"), w)))
    first = F.array(F.concat(F.lit("s"), F.pmod(F.xxhash64(shape), F.lit(SHAPE_BUCKETS)).cast("string")))
    return F.when(kind.isNotNull(), F.concat(first, F.coalesce(prose, F.array().cast("array<string>"))))


def file_counts(df: DataFrame) -> DataFrame:
    """How often each mark stands in each field of each file, by (feed, file_no, key, inner, kind, mark).

    Records that aren't well-formed objects don't count. A row without a key counts the
    file's records, one without ``inner`` is of a top-level field, one without ``mark`` counts nulls.
    """
    explode = df.sparkSession.tvf.variant_explode_outer
    records = df.select("feed", "file_no", parsed(F.col("payload")).alias("v")).where(F.col("v").isNotNull())
    keyed = records.lateralJoin(explode(F.col("v").outer())).select("feed", "file_no", "pos", "key", "value")
    inside = F.when(F.schema_of_variant("value").startswith("OBJECT"), F.col("value"))
    nested = keyed.withColumn("inside", inside).lateralJoin(explode(F.col("inside").outer()).toDF("__fw_pos", "inner", "__fw_value"))
    once = F.coalesce(F.col("__fw_pos"), F.lit(0)) == 0
    view = lambda when, key, inner, value: F.when(when, F.struct(key.alias("key"), inner.alias("inner"), value.alias("v")))
    nothing, blank = F.lit(None).cast("string"), F.lit(None).cast("variant")
    # the record itself is a row without a key: their number is the file's size
    views = F.array(
        view(once & (F.coalesce("pos", F.lit(0)) == 0), nothing, nothing, blank),
        view(once & F.col("key").isNotNull(), F.col("key"), nothing, F.col("value")),
        view(F.col("inner").isNotNull(), F.col("key"), F.col("inner"), F.col("__fw_value")),
    )
    rows = nested.select("feed", "file_no", F.explode(F.filter(views, lambda x: x.isNotNull())).alias("x")).select("feed", "file_no", "x.*")
    typed = rows.select("feed", "file_no", "key", "inner", F.when(F.col("key").isNotNull(), _type(F.col("v"))).alias("kind"), F.col("v").cast("string").alias("text"))
    marked = typed.select("feed", "file_no", "key", "inner", "kind", F.explode_outer(_marks(F.col("kind"), F.col("text"))).alias("mark"))
    return marked.groupBy("feed", "file_no", "key", "inner", "kind", "mark").agg(F.count("*").alias("n"))


def kept_fields(counts: DataFrame) -> DataFrame:
    """The fields with presence above half, as (feed, file_no, key, inner); a row without a key for every file.

    Presence of a nested key is judged over the records in which its parent is an object.
    """
    # words come beside the mark that stands for their value
    values = F.when(F.col("mark").startswith("w"), 0).otherwise(F.col("n"))
    fields = counts.groupBy("feed", "file_no", "key", "inner").agg(F.sum(values).alias("present"), F.sum(F.when(F.col("kind") == "object", values).otherwise(0)).alias("objects"))
    by_file = Window.partitionBy("feed", "file_no")
    size = F.max(F.when(F.col("key").isNull(), F.col("present"))).over(by_file)
    owner = F.max(F.when(F.col("inner").isNull(), F.col("objects"))).over(by_file.partitionBy("feed", "file_no", "key"))
    judged = fields.select("*", size.alias("size"), owner.alias("owner"))
    kept = judged.where(F.when(F.col("inner").isNull(), F.col("present") * 2 > F.col("size")).otherwise(F.col("present") * 2 > F.col("owner")))
    return kept.select("feed", "file_no", "key", "inner")


#: Counts of one field: of its types, its value shapes and its words.
Counts = tuple[dict[str, int], dict[str, float], dict[str, float]]


def _fields(counted: dict[tuple[str, str | None], Counts]) -> dict[str, Field]:
    out: dict[str, Field] = {}
    # top-level fields come before the keys in them
    for (key, inner), (kinds, shapes, words) in sorted(counted.items(), key=lambda x: (x[0][1] is not None, x[0][0], x[0][1] or "")):
        most = max(kinds, key=kinds.get) if kinds else None
        kind = most if most and kinds[most] * 2 > sum(kinds.values()) else None
        if inner is None:
            out[key] = Field(key, kind, shapes, words)
        elif key in out:
            out[key].children[inner] = Field(inner, kind, shapes, words)
    return out


def _two_files(rows: Iterable[tuple]) -> tuple[dict[str, Field], dict[str, Field]]:
    """The fields of the earlier and of the later file, from the counts of both in any order."""
    files: tuple[dict, dict] = ({}, {})
    for _, _, later, key, inner, kind, mark, n in rows:
        if key is None:
            continue
        kinds, shapes, words = files[later].setdefault((key, inner), ({}, {}, {}))
        if mark is None:
            continue
        if mark[0] == "s":
            kinds[kind] = kinds.get(kind, 0) + n
            shapes[f"{kind}{mark}"] = n
        else:
            words[mark] = n
    return _fields(files[0]), _fields(files[1])


def _changes(before: dict[str, Field], after: dict[str, Field]) -> Iterator[tuple[str, str, str]]:
    gone, new = before.keys() - after.keys(), after.keys() - before.keys()
    renamed = correspondences(list(before.values()), list(after.values()), set(gone), set(new))
    for x, y in renamed:
        yield "renamed", x, y
    for x in sorted(gone - {x for x, _ in renamed}):
        yield "removed", x, ""
    for y in sorted(new - {y for _, y in renamed}):
        yield "added", "", y
    for x in sorted(before.keys() & after.keys()):
        if before[x].type and after[x].type and before[x].type != after[x].type:
            yield "retyped", x, x


def _nested_field(fields: dict[str, Field], keys: re.Pattern) -> str | None:
    """The object most of whose keys match."""
    share = {f.name: sum(bool(keys.search(c)) for c in f.children) / len(f.children) for f in fields.values() if f.type == "object" and f.children}
    best = max(share, key=lambda x: (share[x], x), default=None)
    return best if best is not None and share[best] > 0.5 else None


def _compare(nested_keys: str):
    pattern = re.compile(nested_keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for (feed, file_no), counts in groupby(rows, key=lambda row: row[:2]):
            before, after = _two_files(counts)
            found = list(_changes(before, after))
            x, y = _nested_field(before, pattern), _nested_field(after, pattern)
            if x is not None and y is not None:
                found += [(kind, a and f"{y}.{a}", b and f"{y}.{b}") for kind, a, b in _changes(before[x].children, after[y].children)]
            if found:
                yield pa.RecordBatch.from_pylist([dict(zip(_CHANGES.names, (feed, file_no, *change))) for change in found], schema=_CHANGES)

    return run


def schema_changes(df: DataFrame, nested_keys: str = r"^[Qq][0-9]+") -> DataFrame:
    """Every change between a file and the file before it in the same feed.

    ``df`` has ``feed, file_no, payload``; ``nested_keys`` tells the object whose own keys
    are fields too. Null or broken payloads don't count, a file of nothing else is passed
    over, a feed of one file has no changes, rows that occur again count again (which no
    majority depends on unless it hangs on them), and other columns don't matter.
    """
    # both are read more than once
    counts = materialise(file_counts(df.select("feed", "file_no", "payload")), "file-counts")
    kept = materialise(kept_fields(counts), "file-fields")
    pairs = neighbours(kept.where(F.col("key").isNull()).select("feed", "file_no", F.struct("file_no").alias("profile")))
    side = lambda which, later: F.struct(F.col(which)["file_no"].alias("of"), F.lit(later).alias("later"))
    sides = pairs.select(F.col("feed").alias("of_feed"), F.col("file_no").alias("pair"), F.inline(F.array(side("before", 0), side("profile", 1))))
    # merged, as neither side has a bound: their files are packed, and would seem small enough to be sent out whole
    wanted = kept.hint("merge").join(sides, F.col("feed").eqNullSafe(F.col("of_feed")) & F.col("file_no").eqNullSafe(F.col("of"))).select("pair", "later", *[F.col(c).alias(f"of_{c}") for c in _FIELD])
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in _FIELD]
    rows = counts.hint("merge").join(wanted, same).select("feed", "pair", "later", "key", "inner", "kind", "mark", "n")
    # comparing is work for the processor: as many tasks as there are cores, whatever the bytes
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, 1)
    return rows.repartition(tasks, "feed", "pair").sortWithinPartitions("feed", "pair").mapInArrow(_compare(nested_keys), CHANGES)


def neighbours(profiles: DataFrame, run: int = RUN) -> DataFrame:
    """Each file with the profile of the file before it in its feed, as ``before``.

    Files meet within runs of ``run`` numbers; only the ends of runs meet across a whole feed.
    """
    of_run = Window.partitionBy("feed", "__fw_run").orderBy("file_no")
    last = F.lead("file_no").over(of_run).isNull()
    placed = profiles.withColumn("__fw_run", F.floor(F.col("file_no") / run)).withColumns({"before": F.lag("profile").over(of_run), "__fw_last": last})
    ends = placed.where("__fw_last").select("feed", "__fw_run", "profile")
    earlier = ends.withColumn("__fw_next", F.lead("__fw_run").over(Window.partitionBy("feed").orderBy("__fw_run"))).where(F.col("__fw_next").isNotNull())
    earlier = earlier.select("feed", F.col("__fw_next").alias("__fw_run"), F.col("profile").alias("__fw_earlier"))
    first = placed.where(F.col("before").isNull()).drop("before").join(earlier, ["feed", "__fw_run"]).withColumnRenamed("__fw_earlier", "before")
    columns = ["feed", "file_no", "before", "profile"]
    return placed.where(F.col("before").isNotNull()).select(*columns).unionByName(first.select(*columns))


def _aliases(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by feed and file; the names in force are carried from file to file."""
    feed, names = None, {}
    for frame in frames:
        rows = []
        for f, file_no, renames in zip(frame.feed, frame.file_no, frame.renames):
            if f != feed:
                feed, names = f, {}
            step = [(r["a"], r["b"]) for r in renames] if renames is not None else []
            moved = {b: names.get(a, a) for a, b in step}
            names = {k: v for k, v in names.items() if k not in {a for a, _ in step}} | moved
            if current := {v: k for k, v in names.items() if k != v}:
                rows.append((f, file_no, current))
        yield pd.DataFrame(rows, columns=["feed", "file_no", "actual"])


def field_names(df: DataFrame, changes: DataFrame) -> DataFrame:
    """Per file with renamed fields: a map from a field's first name to the one in force."""
    renamed = changes.where((F.col("change_kind") == "renamed") & ~F.col("field_before").contains("."))
    steps = renamed.groupBy("feed", "file_no").agg(F.collect_list(F.struct(F.col("field_before").alias("a"), F.col("field_after").alias("b"))).alias("renames"))
    files = df.groupBy("feed", "file_no").agg(F.count("*").alias("__fw_n")).drop("__fw_n")
    ordered = files.join(steps, ["feed", "file_no"], "left").repartition("feed").sortWithinPartitions("feed", "file_no")
    return ordered.mapInPandas(_aliases, "feed string, file_no int, actual map<string,string>")


_NUMBER = r"[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"


def to_number(text: Column) -> Column:
    """The number that a whole value is: plain, with thousands set off by commas, in feet
    (`"9500 ft"`), as the one entry of a list (`[11800]`) or under `feet` in an object
    (`{"feet": 4000, "text": ...}`). Anything else is no number: null, not a guess."""
    held = F.coalesce(F.regexp_extract(text, r"^\s*\[([^\[\],]*(?:,[0-9]{3})*[^\[\],]*)\]\s*$", 1), F.lit(""))
    inner = F.when(text.rlike(r"^\s*\{"), F.from_json(text, "map<string,string>")["feet"]).when(text.rlike(r"^\s*\["), F.regexp_replace(held, r'^\s*"|"\s*$', "")).otherwise(text)
    number = F.regexp_extract(inner, rf"(?i)^\s*({_NUMBER})\s*(?:ft|feet)?\s*$", 1)
    return F.regexp_replace(number, ",", "").try_cast("double")


def to_boolean(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word.isin("true", "yes", "y", "1", "1.0"), True).when(word.isin("false", "no", "n", "0", "0.0"), False)


def to_list(text: Column) -> Column:
    """The entries of a JSON list; any other value is a list of itself."""
    return F.when(text.rlike(r"^\s*\["), F.coalesce(F.from_json(text, "array<string>"), F.array(text))).when(text.isNotNull(), F.array(text))


def to_answers(text: Column) -> Column:
    """Answers by question from an object, a list of question and answer, or text such as `Q1: yes; Q2: no`."""
    flat = F.regexp_replace(text, r'"question"\s*:\s*"([^"]*)"\s*,\s*"answer"\s*:', r'"$1":')
    pairs = F.regexp_extract_all(flat, F.lit(r'([Qq][0-9]+)\w*"?\s*:\s*"?(\w+)'), 0)
    key = lambda p: F.upper(F.regexp_extract(p, r"[Qq][0-9]+", 0))
    value = lambda p: F.regexp_extract(p, r'(\w+)$', 1)
    unique = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: key(q) == key(p)))
    return F.when(text.isNotNull(), F.map_from_entries(F.transform(unique, lambda p: F.struct(key(p), value(p)))))


def unify(df: DataFrame, target: dict[str, str], nested_keys: str = r"^[Qq][0-9]+") -> DataFrame:
    """All records in one table: renamed fields under their first name, values cast to ``target``.

    ``target`` maps a field to ``number``, ``boolean``, ``string``, ``list`` or ``answers``;
    keys beside it are kept as text in ``extras``. A value that can't be cast is null in its
    column and kept as text in ``uncast``, by field. In a file in which a field has another
    name, its first name is not looked up: another field may have taken it. Every row comes
    out: one whose payload isn't well-formed has ``well_formed`` false and null fields.
    """
    casts = {"number": to_number, "boolean": to_boolean, "string": lambda x: x, "list": to_list, "answers": to_answers}
    names = field_names(df, schema_changes(df, nested_keys))
    joined = df.join(names, ["feed", "file_no"], "left").withColumn("__fw_v", parsed(F.col("payload")))
    record = F.when(F.col("__fw_v").isNotNull(), F.from_json("payload", "map<string,string>"))
    taken = F.coalesce(F.map_values("actual"), F.array().cast("array<string>"))
    name = lambda f: F.coalesce(F.col("actual")[F.lit(f)], F.when(~F.array_contains(taken, f), F.lit(f)))
    flat = joined.withColumn("__fw_m", record).withColumn("__fw_raw", F.struct(*[F.col("__fw_m")[name(f)].alias(f) for f in target]))
    extras = F.map_filter("__fw_m", lambda k, _: ~F.array_contains(F.array_compact(F.array(*[name(f) for f in target])), k))
    kept = [c for c in df.columns if c != "payload" and c not in target]
    made = flat.select(*kept, F.col("__fw_m").isNotNull().alias("well_formed"), *[casts[t](F.col("__fw_raw")[f]).alias(f) for f, t in target.items()], extras.alias("extras"), "__fw_raw")
    lost = [F.when(F.col(f).isNull() & F.col("__fw_raw")[f].isNotNull(), F.struct(F.lit(f).alias("key"), F.col("__fw_raw")[f].alias("value"))) for f in target]
    return made.withColumn("uncast", F.map_from_entries(F.array_compact(F.array(*lost)))).drop("__fw_raw")


def failed_casts(unified: DataFrame) -> DataFrame:
    """How many values of each field could not be cast, per feed, with the least of them."""
    each = unified.select("feed", F.explode("uncast").alias("field", "value"))
    return each.groupBy("feed", "field").agg(F.count("*").alias("n"), F.min("value").alias("example"))

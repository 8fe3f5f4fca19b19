"""Analytics over the ordered legs of a procedure.

Legs are an array of structs whose order counts; every operator is a higher-order function
on that array, so a procedure never leaves its row and nothing is shuffled. The window
forms at the end do the same for sequences that lie in rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import leg_altitude, strip

#: Leg types that hold.
HOLDS = ("HM", "HF", "HA")
_TEXT = ("trans_ident", "seq_no", "rt_type", "wpt_ident", "alt_desc")


def clean_legs(legs: Column) -> Column:
    """Trimmed legs with a whole-number altitude; null lists and entries disappear."""
    present = F.filter(F.coalesce(legs, F.array()), lambda x: x.isNotNull())
    return F.transform(
        present,
        lambda x: F.struct(*[F.coalesce(strip(x[c]), F.lit("")).alias(c) for c in _TEXT], leg_altitude(x["altitude1"]).alias("altitude")),
    )


def _first(values: Column, of) -> Column:
    """What ``of`` gives of the first element; null without one."""
    return F.when(F.size(values) > 0, of(F.element_at(values, 1)))


def main_transition(legs: Column) -> Column:
    """The transition of the first runway leg; else R, else I, else null."""
    runway = F.filter(legs, lambda x: x["wpt_ident"].startswith("RW"))
    named = F.transform(legs, lambda x: x["trans_ident"])
    return F.coalesce(_first(runway, lambda x: x["trans_ident"]), F.when(F.array_contains(named, "R"), "R"), F.when(F.array_contains(named, "I"), "I"))


def after_runway(legs: Column, transition: Column) -> Column:
    """Legs of the transition after its first runway leg; none without such a leg."""
    own = F.filter(legs, lambda x: (x["trans_ident"] == transition) & (transition != ""))
    marks = F.transform(own, lambda x: x["wpt_ident"].startswith("RW"))
    at = F.array_position(marks, True)
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.filter(own, lambda _, i: i >= at)).otherwise(F.filter(own, lambda _: F.lit(False)))


def after_course(legs: Column) -> Column:
    """Legs after the first CA leg, without CA legs."""
    at = F.array_position(F.transform(legs, lambda x: x["rt_type"] == "CA"), True)
    return F.filter(legs, lambda x, i: (at > 0) & (i >= at) & (x["rt_type"] != "CA"))


def climb_altitude(legs: Column) -> Column:
    """The first altitude after a CA leg, else the greatest of all."""
    stated = F.filter(after_course(legs), lambda x: x["altitude"].isNotNull())
    return F.coalesce(_first(stated, lambda x: x["altitude"]), F.array_max(F.transform(legs, lambda x: x["altitude"])))


def waypoints(legs: Column) -> Column:
    """Fixes after a CA leg, each once, in order."""
    return F.array_distinct(F.filter(F.transform(after_course(legs), lambda x: x["wpt_ident"]), lambda w: w != ""))


def holding(legs: Column) -> tuple[Column, Column]:
    """Whether a leg holds, and the fix of the first that does ("unknown" if it has none)."""
    found = F.filter(legs, lambda x: x["rt_type"].isin(*HOLDS))
    fix = _first(found, lambda x: F.when(x["wpt_ident"] == "", "unknown").otherwise(x["wpt_ident"]))
    return F.size(found) > 0, fix


def turn_trigger(legs: Column) -> Column:
    """Fix or altitude of the first DF leg that has either."""
    said = F.transform(F.filter(legs, lambda x: x["rt_type"] == "DF"), lambda x: F.coalesce(F.nullif(x["wpt_ident"], F.lit("")), x["altitude"].cast("string")))
    return F.try_element_at(F.filter(said, lambda x: x.isNotNull()), F.lit(1))


def first_direct(legs: Column) -> Column:
    """Sequence number of the first DF leg; null without one."""
    return _first(F.filter(legs, lambda x: x["rt_type"] == "DF"), lambda x: x["seq_no"])


def instruction(legs: Column) -> Column:
    """The legs written out, ``CA 700+ft -> DF ABCDE 3000+ft``; "unknown" without legs."""

    def piece(x: Column) -> Column:
        sign = F.when(x["alt_desc"].isin("+", "-"), x["alt_desc"]).otherwise("")
        return F.concat(
            x["rt_type"],
            F.when(x["wpt_ident"] != "", F.concat(F.lit(" "), x["wpt_ident"])).otherwise(""),
            F.when(x["altitude"].isNotNull(), F.concat(F.lit(" "), x["altitude"].cast("string"), sign, F.lit("ft"))).otherwise(""),
        )

    return F.when(F.size(legs) > 0, F.array_join(F.transform(legs, piece), " -> ")).otherwise("unknown")


def procedure_records(pairs: DataFrame, legs: str = "cifp.legs", keep: tuple[str, ...] = ("pair_no", "chart_no", "id")) -> DataFrame:
    """The canonical record of each procedure from its legs, without the turn, which needs a lookup."""
    staged = pairs.select(*keep, F.col("cifp.airport").alias("airport"), strip(F.col("cifp.proc_ident")).alias("proc_ident"), clean_legs(F.col(legs)).alias("legs"))
    staged = staged.withColumn("transition", main_transition(F.col("legs")))
    staged = staged.withColumn("missed", after_runway(F.col("legs"), F.coalesce("transition", F.lit(""))))
    held, fix = holding(F.col("missed"))
    return staged.select(
        *keep,
        "airport",
        "proc_ident",
        "transition",
        first_direct(F.col("missed")).alias("direct_seq"),
        instruction(F.col("missed")).alias("raw_instruction"),
        climb_altitude(F.col("missed")).alias("climb_altitude"),
        waypoints(F.col("missed")).alias("waypoints"),
        held.alias("holding_required"),
        fix.alias("holding_fix"),
        turn_trigger(F.col("missed")).alias("turn_trigger"),
    )


# sequences in rows


def after_first(df: DataFrame, key: str, order: list[str], anchor: Column) -> DataFrame:
    """Rows after the first one of their key that matches ``anchor``; rows that tie with it don't follow it.

    The anchors are an aggregate, so that a key with most of the rows is never sorted in one
    task. Null keys are a key of their own; nulls in ``order`` come first.
    """
    place = F.struct(*order)
    first = df.where(anchor).groupBy(F.col(key).alias("__fw_key")).agg(F.min(place).alias("__fw_first"))
    return df.join(first, F.col(key).eqNullSafe(F.col("__fw_key"))).where(place > F.col("__fw_first")).drop("__fw_key", "__fw_first")


def first_match(df: DataFrame, key: str, order: list[str], match: Column, value: str) -> DataFrame:
    """``value`` of each key's first matching row: an aggregate, without a sort."""
    return df.where(match).groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def context(df: DataFrame, key: str, order: list[str], value: Column, before: int, after: int) -> DataFrame:
    """Sum of ``value`` over the rows from ``before`` rows back to ``after`` rows on."""
    frame = Window.partitionBy(key).orderBy(*order).rowsBetween(-before, after)
    return df.withColumn("score", F.sum(value).over(frame))


def best_per_key(df: DataFrame, key: str, score: str, order: list[str]) -> DataFrame:
    """The row with the greatest score of each key; the first of equals."""
    rank = Window.partitionBy(key).orderBy(F.desc(score), *order)
    return df.withColumn("__fw_rank", F.row_number().over(rank)).where(F.col("__fw_rank") == 1).drop("__fw_rank")

"""Normalisers of extracted values. Inputs are strings; undetermined values become null.

Three states stay apart upstream: no record (a left join's null row), "unknown" and null.
Scoring treats the last two alike, so both are null here, except where noted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"(?U)^\s+|\s+$"


def strip(value: Column) -> Column:
    """Removes all kinds of white space at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(value, _SPACE, "")


def altitude(value: Column) -> Column:
    """Whole feet; null for null, "unknown", decimals, separators and anything else."""
    return F.when(strip(value).rlike(r"^[+-]?[0-9]+$"), strip(value)).try_cast("int")


def turn(value: Column) -> Column:
    """LEFT, RIGHT, NONE, or UNKNOWN: the word "unknown" counts as a prediction of its own,
    a null doesn't; other words are null."""
    word = F.upper(strip(value))
    return F.when(word.isin("LEFT", "RIGHT", "NONE", "UNKNOWN"), word)


def holding(value: Column) -> Column:
    word = F.lower(strip(value))
    return F.when(word.isin("true", "yes", "1"), True).when(word.isin("false", "no", "0"), False)


def fix(value: Column) -> Column:
    """The fix in capitals; null for null, "null", "none", "unknown" and the empty text."""
    word = strip(value)
    return F.when(~F.lower(word).isin("", "null", "none", "unknown"), F.upper(word))


def waypoint_set(value: Column) -> Column:
    """Distinct waypoints in capitals without blanks; empty for a null list; a null entry is "NONE"."""
    names = F.transform(F.coalesce(value, F.array().cast("array<string>")), lambda w: F.upper(strip(F.coalesce(w, F.lit("None")))))
    return F.array_distinct(F.filter(names, lambda w: w != ""))


def leg_altitude(value: Column) -> Column:
    """Altitude of a padded leg value; flight levels and blanks are null."""
    return altitude(value)

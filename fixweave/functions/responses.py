"""Parsers of recorded model responses and answers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import strip


def fill(template: str, **values: Column) -> Column:
    """The template with each ``{name}`` replaced."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), value)
    return out


def json_span(text: Column) -> Column:
    """From the first brace to the last; null without both."""
    return F.nullif(F.regexp_extract(text, r"(\{[\s\S]*\})", 1), F.lit(""))


def json_object(text: Column) -> Column:
    """The response's object as a variant; null if none is well-formed."""
    return F.try_parse_json(json_span(text))


def after_marker(text: Column) -> Column:
    """What follows the last line that says just ``JSON:``; the whole text without one."""
    return strip(F.element_at(F.split(text, r"(?m)^JSON:\s*$"), -1))


def questionnaire(text: Column, questions: int = 6) -> Column:
    """Answers yes, no or uncertain to Q1.. in small letters, else not_found."""
    pairs = []
    for q in range(1, questions + 1):
        said = F.lower(F.regexp_extract(text, rf"(?i)Q{q}:\s*(yes|no|uncertain)", 1))
        pairs += [F.lit(f"Q{q}"), F.when(said != "", said).otherwise("not_found")]
    return F.create_map(*pairs)


#: How a degree sign and a ring may arrive, and what they stand for.
SIGNS = (("掳", "°"), ("\\u00b0", "°"), ("Å", " "))


def instruction(text: Column) -> Column:
    """The text with its signs mended; "unknown" for an empty one."""
    body = fixed = strip(text)
    for sign, meant in SIGNS:
        fixed = F.replace(fixed, F.lit(sign), F.lit(meant))
    return F.when((body == "") | (F.lower(body) == "unknown"), "unknown").otherwise(fixed)


def altitude(text: Column) -> Column:
    """The first three to five digits, thousands separators aside; null for none."""
    found = F.regexp_extract(F.replace(strip(text), F.lit(","), F.lit("")), r"\d{3,5}", 0)
    return F.nullif(found, F.lit("")).cast("int")


def turn(text: Column) -> Column:
    word = F.upper(strip(text))
    return F.when(word.isin("LEFT", "RIGHT", "NONE", "UNKNOWN"), word).otherwise("unknown")


def holding(text: Column) -> Column:
    """True, false, or null for unknown and anything else."""
    word = F.lower(strip(text))
    return F.when(word == "true", True).when(word == "false", False)


def holding_fix(text: Column, required: Column) -> Column:
    """The first word of three to six letters; null for null (and for unknown without a hold), else "unknown"."""
    low = F.lower(strip(text))
    name = F.regexp_extract(F.upper(strip(text)), r"\b([A-Z]{3,6})\b", 1)
    none = (low == "null") | ((required == F.lit(False)) & low.isin("unknown", ""))
    return F.when(none, F.lit(None).cast("string")).when(low.isin("unknown", "") | (name == ""), "unknown").otherwise(name)


def waypoints(text: Column) -> Column:
    """A JSON list, or the widest bracketed part that is one, in capitals; else empty. A null entry is "NONE"."""
    whole = F.from_json(F.when(strip(text).rlike(r"^\["), text), "array<string>")
    part = F.from_json(F.nullif(F.regexp_extract(text, r"(\[[\s\S]*\])", 1), F.lit("")), "array<string>")
    names = F.transform(F.coalesce(whole, part, F.array().cast("array<string>")), lambda w: F.upper(strip(F.coalesce(w, F.lit("None")))))
    return F.filter(names, lambda w: w != "")


def answer_record(answers: Column) -> dict[str, Column]:
    """The canonical record from a map of answer texts; the fix counts only unless holding is false,
    and what no question asks for is null."""
    need = holding(answers["holding_required"])
    return {
        "raw_instruction": instruction(answers["raw_instruction"]),
        "climb_altitude": altitude(answers["climb_altitude"]),
        "waypoints": waypoints(answers["waypoints"]),
        "turn_direction": turn(answers["turn_direction"]),
        "holding_required": need,
        "holding_fix": F.when(~F.coalesce(need == F.lit(False), F.lit(False)), holding_fix(answers["holding_fix"], need)),
        "initial_track": F.lit(None).cast("string"),
        "turn_trigger": F.lit(None).cast("string"),
        "holding_details": F.lit(None).cast("struct<track:string,direction:string,leg_time:string>"),
    }

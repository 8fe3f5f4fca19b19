"""Rules that read fields out of an instruction's text, as columns.

Patterns and words are data; a ``Rules`` value with others changes the domain.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normalize import strip

#: Words that are no waypoints, markers of lines that are no instruction, and the patterns.
NO_FIX = tuple(
    """CLIMB CLIMBING DIRECT TURN LEFT RIGHT HOLD HOLDING THEN CROSS UNTIL RADAR CONTACT TOWER APPROACH MISSED PROCEDURE LEVEL
    IDENT VISUAL INBOUND OUTBOUND TRACK COURSE HEADING FEET KNOTS MILES ABOVE BELOW MSL AGL DME VOR NDB ILS RNAV GNSS GPS LOC
    GLIDE SLOPE FOR ALL AND CATS CAT INOP ALSF MALSR ATIS CENTER APP CON CTAF UNICOM NIGHT NA VIS RVR SM SYSTEMS AUTHORIZED
    SIMULTANEOUS VISIBILITY INCREASE CONTINUE REQUIRED ENTRY FROM CIRCLING RWY RW HELICOPTER LOCAL USING ALTIMETER SETTING
    RECEIVED REDUCTION""".split()
)
OTHER_LINES = ("ATIS", "TOWER", "GROUND", "GND CON", "UNICOM", "CENTER", "APP CON", "APPROACH CON", "CTAF", "DEPARTURE", "CLEARANCE")
CUT = r"(?i)\b(?:ATIS|TOWER|GROUND|GND CON|UNICOM|CENTER|APP CON|APPROACH CON|CTAF)\b"
HEADING = r"(?i)\bMISSED\s+AP(?:PROACH|CH)\b"
BROAD = r"(?i)(CLIMB(?:ING)?|MISSED\s+APPROACH)"
ACTION = r"(?i)\b(CLIMB(?:ING)?|TURN|DIRECT|HEADING|TRACK|COURSE|HOLD(?:ING)?|DME)\b"
FREQUENCY = r"\b\d{3}(?:\.\d{1,3})?\b"
FIX = r"\b([A-Z]{5})\b"
NAMED_FIX = r"\b(?:DIRECT|TO|OVER|AT)\s+([A-Z]{3,5})(?:/[A-Z]{3,5})?\b"
LEFT, RIGHT = r"(?i)\bLEFT\s*TURN\b|\bTURN\s*LEFT\b", r"(?i)\bRIGHT\s*TURN\b|\bTURN\s*RIGHT\b"
HOLD = r"(?i)\bHOLD(?:ING)?\b"
HOLD_FIXES = (
    r"\bDIRECT\s+([A-Z]{3,5})\s+AND\s+HOLD\b",
    r"\bDIRECT\s+([A-Z]{3,5})\s+(?:VORTAC|VOR/DME|VOR|NDB)\s+AND\s+HOLD\b",
    r"\bTO\s+([A-Z]{3,5})(?:/[A-Z]{3,5})?\s+\d+\s*DME\s+AND\s+HOLD\b",
    r"\bTO\s+([A-Z]{3,5})\s+AND\s+HOLD\b",
    r"\bHOLD(?:ING)?\s+(?:AT|OVER|IN\s+LIEU\s+OF)\s+([A-Z]{3,5})\b",
)


@dataclass(frozen=True)
class Rules:
    no_fix: Sequence[str] = NO_FIX
    other_lines: Sequence[str] = OTHER_LINES
    hold_fixes: Sequence[str] = HOLD_FIXES
    least_altitude: int = 500
    most_altitude: int = 99000


def clean_line(line: Column) -> Column:
    """Degree signs and their look-alikes become blanks, runs of white space one blank."""
    return strip(F.regexp_replace(F.translate(line, "°Å", "  "), r"(?U)\s+", " "))


def altitude(text: Column, rules: Rules = Rules()) -> Column:
    """The greatest number of three to five digits within the bounds; null without one."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{3,5})\b"), 1), lambda n: n.cast("int"))
    return F.array_max(F.filter(numbers, lambda n: n.between(rules.least_altitude, rules.most_altitude)))


def turn(text: Column) -> Column:
    """LEFT before RIGHT, else NONE."""
    return F.when(text.rlike(LEFT), "LEFT").when(text.rlike(RIGHT), "RIGHT").otherwise("NONE")


def holds(text: Column) -> Column:
    return text.rlike(HOLD)


def waypoints(text: Column, rules: Rules = Rules()) -> Column:
    """Five-letter fixes, those named after a direction word first, each once, no common words."""
    upper = F.upper(text)
    found = F.concat(F.regexp_extract_all(upper, F.lit(NAMED_FIX), 1), F.regexp_extract_all(upper, F.lit(FIX), 1))
    common = F.array(*[F.lit(w) for w in rules.no_fix])
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) == 5) & ~F.array_contains(common, w)))


def holding_fix(text: Column, rules: Rules = Rules(), points: Column | None = None) -> Column:
    """The first pattern's fix that is no common word, else the first waypoint; null without a hold.

    ``points`` are the text's waypoints where they are known already.
    """
    upper = F.upper(text)
    found = F.array(*[F.regexp_extract(upper, p, 1) for p in rules.hold_fixes])
    common = F.array(*[F.lit(w) for w in rules.no_fix])
    named = F.filter(found, lambda f: (f != "") & ~F.array_contains(common, f))
    first = F.try_element_at(F.concat(named, waypoints(text, rules) if points is None else points), F.lit(1))
    return F.when(holds(text), first)


def record(text: Column, rules: Rules = Rules()) -> dict[str, Column]:
    """The canonical record of an instruction; a null text reads as an empty one."""
    body = F.coalesce(text, F.lit(""))
    return {
        "raw_instruction": F.when(strip(body) == "", "unknown").otherwise(strip(body)),
        "climb_altitude": altitude(body, rules),
        "waypoints": waypoints(body, rules),
        "turn_direction": turn(body),
        "holding_required": holds(body),
        "holding_fix": holding_fix(body, rules),
    }


def other_line(line: Column, rules: Rules = Rules()) -> Column:
    """Blank, a frequency without an action, or a marker of other services."""
    upper = F.upper(line)
    marked = F.exists(F.array(*[F.lit(m) for m in rules.other_lines]), lambda m: F.contains(upper, m))
    return (upper == "") | (upper.rlike(FREQUENCY) & ~upper.rlike(ACTION)) | marked


def page_instructions(df: DataFrame, lines: Column, keep: Sequence[str], rules: Rules = Rules(), before: int = 2, after: int = 10) -> DataFrame:
    """``keep`` and ``instruction``, the instruction among a page's lines; empty if there is none.

    Each heading is an anchor (without any, the first line that mentions a climb); the
    lines around it that belong to the instruction are joined and cut at the first other
    service; the candidate with most headings, actions and fixes wins, the first of equals.
    Every line is matched once, in a step of its own.
    """
    clean = df.select(*keep, F.transform(lines, clean_line).alias("__fw_lines"))

    def marked(x: Column, i: Column) -> Column:
        upper = F.upper(x)
        return F.struct(i.alias("i"), x.alias("t"), upper.rlike(HEADING).alias("head"), upper.rlike(ACTION).alias("act"), upper.rlike(FIX).alias("fix"), other_line(x, rules).alias("other"))

    numbered = clean.select(*keep, F.transform("__fw_lines", marked).alias("__fw_n"))
    headed = F.filter("__fw_n", lambda x: x["head"])
    broad = F.slice(F.filter("__fw_n", lambda x: x["t"].rlike(BROAD)), 1, 1)
    anchors = F.transform(F.when(F.exists("__fw_n", lambda x: x["head"]), headed).otherwise(broad), lambda x: x["i"])
    anchored = numbered.select(*keep, "__fw_n", anchors.alias("__fw_a"))

    def candidate(at: Column) -> Column:
        near = F.slice("__fw_n", F.greatest(at - before, F.lit(0)) + 1, F.lit(before + after))
        own = F.filter(near, lambda x: ~x["other"] & (x["i"] < at + after) & ((x["i"] == at) | x["head"] | x["act"] | ((x["i"] > at) & x["fix"])))
        joined = F.array_join(F.transform(own, lambda x: x["t"]), " ")
        return strip(F.element_at(F.split(joined, CUT, 2), 1))

    texts = anchored.select(*keep, F.transform("__fw_a", candidate).alias("__fw_t"))

    def scored(text: Column, k: Column) -> Column:
        score = F.when(text.rlike(HEADING), 3).otherwise(0) + F.regexp_count(text, F.lit(ACTION)) + 2 * F.regexp_count(text, F.lit(FIX))
        return F.struct(score.alias("score"), (-k).alias("order"), text.alias("text"))

    best = F.array_max(F.transform("__fw_t", scored))["text"]
    return texts.select(*keep, F.coalesce(best, F.lit("")).alias("instruction"))


def rule_records(df: DataFrame, text: str, keep: Sequence[str], rules: Rules = Rules()) -> DataFrame:
    """``keep`` and the canonical record of each text; waypoints are found once for both uses."""
    made = record(F.coalesce(F.col(text), F.lit("")), rules)
    found = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__fw_text"), made["waypoints"].alias("waypoints"))
    made = record(F.col("__fw_text"), rules) | {"waypoints": F.col("waypoints"), "holding_fix": holding_fix(F.col("__fw_text"), rules, F.col("waypoints"))}
    return found.select(*keep, *[c.alias(n) for n, c in made.items()])

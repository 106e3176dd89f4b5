"""Spoken phrases, fact tokens, prompts, score extraction and id formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from apexframe import dims

c = F.col
# Spoken and displayed tyre names.
SPOKEN = {"S": "soft", "M": "medium", "H": "hard", "I": "intermediate", "W": "wet"}
PLURAL = {"S": "softs", "M": "mediums", "H": "hards", "I": "inters", "W": "wets"}
DISPLAY = {16: "Softs", 17: "Mediums", 18: "Hards", 7: "Inters", 8: "Wets"}
LETTER_CODES = {"S": 16, "M": 17, "H": 18, "I": 7, "W": 8}
METRES_PER_SECOND = 55


def round_tenth(x: Column) -> Column:
    return F.floor(x.cast("double") * 10 + 0.5) / 10


def tenths(x: Column) -> Column:
    """Half-up to one decimal, without a trailing .0."""
    r = round_tenth(x)
    return F.when(r == F.floor(r), F.format_string("%.0f", r)).otherwise(F.format_string("%.1f", r))


def seconds_phrase(x: Column) -> Column:
    return F.concat(tenths(x), F.when(round_tenth(x) == 1.0, " second").otherwise(" seconds"))


def lap_time(ms: Column) -> Column:
    minutes = F.floor(ms / 60000)
    rest = F.concat(tenths((ms % 60000) / 1000.0), F.lit(" seconds"))
    unit = F.when(minutes == 1, " minute ").otherwise(" minutes ")
    return F.when(minutes > 0, F.concat(minutes.cast("string"), unit, rest)).otherwise(rest)


def time_left(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    return (
        F.when(seconds <= 0, "").when(seconds < 60, "less than a minute left")
        .when(minutes == 1, "about a minute left").otherwise(F.concat(minutes.cast("string"), F.lit(" minutes left")))
    )


def capitalize(s: Column) -> Column:
    return F.concat(F.upper(F.left(s, F.lit(1))), F.substring(s, 2, 1 << 30))


def spoken_tyre(letter: Column) -> Column:
    return dims.lookup(SPOKEN, letter, F.lit("unknown"))


def plural_tyre(letter: Column) -> Column:
    return dims.lookup(PLURAL, letter, letter)


def display_tyre(code: Column) -> Column:
    return dims.lookup(DISPLAY, code, F.lit("Tyres"))


def letter_code(letter: Column) -> Column:
    return dims.lookup(LETTER_CODES, letter, F.lit(17))


def code_letter(code: Column) -> Column:
    return dims.lookup(dims.COMPOUND_LETTERS, code)


def sentence_marks(s: Column) -> Column:
    return F.regexp_replace(s, "([.!?]) +", "$1|")


PLACE, NUMBER = r"(?iU)\bP\d+\b", r"(?U)\d+(?:\.\d+)?"


def fact_tokens(s: Column) -> Column:
    """Distinct places (upper case) and the numbers outside them."""
    places = F.transform(F.regexp_extract_all(s, F.lit(PLACE), F.lit(0)), F.upper)
    numbers = F.regexp_extract_all(F.regexp_replace(s, PLACE, " "), F.lit(NUMBER), F.lit(0))
    return F.array_distinct(F.concat(places, numbers))


def dropped_facts(before: Column, after: Column) -> Column:
    return F.array_sort(F.array_except(fact_tokens(before), fact_tokens(after)))


def invented_facts(before: Column, after: Column) -> Column:
    return F.array_sort(F.array_except(fact_tokens(after), fact_tokens(before)))


def spoken_seconds(s: Column) -> Column:
    return F.size(F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")) / 2.5


def gap_seconds(other_lap: Column, other_m: Column, lap: Column, at_m: Column, track_m: Column) -> Column:
    """Seconds to a car ahead on the same lap by distance, -1 on another lap (single precision)."""
    gap = other_m - at_m
    metres = F.when(gap < 0, gap + track_m).otherwise(gap)
    return F.when(other_lap == lap, (metres / METRES_PER_SECOND).cast("float")).otherwise(F.lit(-1).cast("float"))


def gap_behind_seconds(delta_ms: Column, other_m: Column, at_m: Column, track_m: Column) -> Column:
    """Reported gap if there is one, else by distance (single precision)."""
    gap = at_m - other_m
    metres = F.when(gap < 0, gap + track_m).otherwise(gap)
    return F.when(delta_ms > 0, (delta_ms / 1000).cast("float")).otherwise((metres / METRES_PER_SECOND).cast("float"))


def signed_uid(hex_uid: Column) -> Column:
    """Unsigned hex to signed 64-bit; blank, '-' or not hex gives null."""
    t = F.trim(hex_uid)
    ok = t.rlike("^[0-9a-fA-F]{1,16}$")
    return F.when(ok, F.conv(t, 16, -10).cast("bigint"))


def hex_uid(uid: Column) -> Column:
    return F.lower(F.hex(uid))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def finish_text(pos: Column, grid: Column) -> Column:
    p = F.concat(F.lit("P"), pos.cast("string"))
    mid = F.greatest(F.lit(10), F.floor(grid * 3 / 4))
    return (
        F.when(pos <= 0, "Chequered flag. Box this lap.")
        .when(pos <= 3, F.concat(p, F.lit("! Brilliant drive. Cooldown lap, bring it home.")))
        .when(pos <= 10, F.concat(p, F.lit(". Solid points today. Good job.")))
        .when(pos <= mid, F.concat(p, F.lit(". We'll take it. Plenty to review.")))
        .when(pos < grid, F.concat(p, F.lit(". Tough one. We'll debrief and come back stronger.")))
        .otherwise(F.concat(p, F.lit(". Rough day at the office. Box this lap and we regroup.")))
    )


def retired_text(status: Column) -> Column:
    return (
        F.when(status.isin(4, 7), "That's our day done. Engine off, come back to the pits.")
        .when(status == 5, "Disqualified. We'll review and figure out what happened.")
        .when(status == 6, "Didn't make the classified distance. Tough one.")
    )


def fill(template: str, fields: list[str]) -> Column:
    """A template with {field} slots; null fields become empty text."""
    out, rest = [], template
    while rest:
        head, sep, tail = rest.partition("{")
        out.append(F.lit(head))
        if not sep:
            break
        name, _, rest = tail.partition("}")
        out.append(F.coalesce(c(name).cast("string"), F.lit("")) if name in fields else F.lit(""))
    return F.concat(*out)


def judge_scores(answer: Column, dims_: list[str]) -> Column:
    """Scores from the JSON object inside free text; null unless all are whole numbers 1 to 5."""
    obj = F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), ", ".join(f"{d} string" for d in dims_) + ", rationale string")
    good = F.lit(True)
    for d in dims_:
        good = good & F.coalesce(obj[d].rlike("^[1-5]$"), F.lit(False))
    return F.when(good, F.struct(*[obj[d].cast("bigint").alias(d) for d in dims_], F.coalesce(obj["rationale"], F.lit("")).alias("rationale")))

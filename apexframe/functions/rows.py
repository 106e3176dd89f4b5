"""Row-level predicates and projections over sector snapshots and state ticks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from apexframe import dims

c = F.col
DAMAGE_PARTS = (
    "front_wing_damage_l", "front_wing_damage_r", "rear_wing_damage",
    "floor_damage", "diffuser_damage", "sidepod_damage",
)
WHEELS = ("tyre_wear_fl", "tyre_wear_fr", "tyre_wear_rl", "tyre_wear_rr")


def is_race() -> Column:
    return c("session_type").isin(*dims.RACE_TYPES)


def standing_start() -> Column:
    return (c("lap_number") == 1) & (c("sector_number") == 0) & is_race()


def timed() -> Column:
    return c("sector_time_ms") > 0


def zero(*names: str) -> Column:
    out = c(names[0]) == 0
    for n in names[1:]:
        out = out & (c(n) == 0)
    return out


def outlier_input() -> Column:
    return zero("lap_invalid", "pit_status", "safety_car_status", *DAMAGE_PARTS) & timed() & ~standing_start()


def fit_input() -> Column:
    flags = zero("lap_invalid", "corner_cutting_warnings", "pit_status", "safety_car_status", "outlier")
    return flags & timed() & ~standing_start()


def baseline_input() -> Column:
    return fit_input() & ~c("session_type").isin(*dims.BASELINE_EXCLUDED_TYPES)


def pit_input() -> Column:
    """Row part of the pit filter; the car must also have pitted (semi join)."""
    return timed() & (c("lap_number") > 1) & zero("safety_car_status", "penalties_sec") & is_race()


def median_input() -> Column:
    flags = zero("pit_status", "lap_invalid", "safety_car_status", "outlier")
    return flags & (c("lap_number") > 1) & timed()


def history_input() -> Column:
    return zero("outlier", "lap_invalid", "pit_status") & timed()


def regime(ai: Column | None = None) -> Column:
    return F.when((c("ai_controlled") if ai is None else ai) == 1, "AI").otherwise("PLAYER")


def weather_class(weather: Column) -> Column:
    return F.when(weather >= 3, "wet").otherwise("dry")


def bucket_half_even(x: Column, width: int) -> Column:
    """Nearest bucket as the fits store it: ties go to the even multiple."""
    return (F.rint(x.cast("double") / width) * width).cast("bigint")


def bucket_half_up(x: Column, width: int) -> Column:
    """Nearest bucket as the lookups ask for it: ties go up."""
    return (F.floor(x.cast("double") / width + 0.5) * width).cast("bigint")


def bucketable() -> Column:
    known = c("ai_controlled").isNotNull() & c("fuel_in_tank_kg").isNotNull()
    known = known & c("weather").isNotNull() & c("track_temp").isNotNull()
    return known & c("tyre_compound_visual").isin(*dims.ALL_COMPOUNDS)


def most_worn() -> Column:
    return F.greatest(*[c(w) for w in WHEELS])


def most_worn_or_zero() -> Column:
    return F.greatest(*[F.coalesce(c(w), F.lit(0.0)) for w in WHEELS])


def damaged() -> Column:
    hit = c(DAMAGE_PARTS[0]) > 0
    for part in DAMAGE_PARTS[1:]:
        hit = hit | (c(part) > 0)
    return F.when(hit, 1).otherwise(0)


def quality() -> Column:
    """Why a sector row is not clean; the first reason that holds wins."""
    return (
        F.when(c("pit_status") != 0, "PIT")
        .when(c("safety_car_status") != 0, "SAFETY_CAR")
        .when(c("lap_invalid") != 0, "INVALID")
        .when(c("corner_cutting_warnings") != 0, "CORNER_CUT")
        .when(damaged() == 1, "DAMAGE")
        .when(standing_start(), "STANDING_START")
        .when(c("outlier") != 0, "OUTLIER")
        .when(c("sector_time_ms").isNull() | (c("sector_time_ms") <= 0), "INVALID")
        .otherwise("GOOD")
    )


def session_kind(code: Column) -> Column:
    return (
        F.when(code.between(1, 4), "PRACTICE")
        .when(code.between(5, 9) | (code == 14), "QUALIFYING")
        .when(code.between(10, 12) | code.between(15, 17), "RACE")
        .when(code == 13, "TIME_TRIAL")
        .otherwise("OTHER")
    )


def parts_to_ms(minutes: Column, ms: Column) -> Column:
    return minutes * 60000 + ms


def fuel_per_sector(fuel: Column, laps_left: Column) -> Column:
    return fuel / (F.greatest(laps_left, F.lit(1)) * 3)

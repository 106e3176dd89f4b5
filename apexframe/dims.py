"""Code tables and fixed model values."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Track names by track id.
TRACK_NAMES = {
    0: "Melbourne", 1: "Paul Ricard", 2: "Shanghai", 3: "Bahrain", 4: "Catalunya", 5: "Monaco",
    6: "Montreal", 7: "Silverstone", 8: "Hockenheim", 9: "Hungaroring", 10: "Spa", 11: "Monza",
    12: "Singapore", 13: "Suzuka", 14: "Abu Dhabi", 15: "Austin", 16: "Interlagos", 17: "Red Bull Ring",
    18: "Sochi", 19: "Mexico City", 20: "Baku", 21: "Sakhir Short", 22: "Silverstone Short",
    23: "Austin Short", 24: "Suzuka Short", 25: "Hanoi", 26: "Zandvoort", 27: "Imola", 28: "Portimao",
    29: "Jeddah", 30: "Miami", 31: "Las Vegas", 32: "Losail", 33: "Lusail",
}
# Session type names by session type code.
SESSION_TYPE_NAMES = {
    0: "Unknown", 1: "Practice 1", 2: "Practice 2", 3: "Practice 3", 4: "Short Practice",
    5: "Qualifying 1", 6: "Qualifying 2", 7: "Qualifying 3", 8: "Short Qualifying",
    9: "One-Shot Qualifying", 10: "Race", 11: "Race 2", 12: "Race 3", 13: "Time Trial",
    14: "Sprint Qualifying", 15: "Race", 16: "Race 2", 17: "Race 3",
}
# Visual tyre compound codes.
COMPOUND_NAMES = {16: "Soft", 17: "Medium", 18: "Hard", 7: "Intermediate", 8: "Wet"}
COMPOUND_LETTERS = {16: "S", 17: "M", 18: "H", 7: "I", 8: "W"}
DRY_COMPOUNDS, WET_COMPOUNDS = (16, 17, 18), (7, 8)
ALL_COMPOUNDS = DRY_COMPOUNDS + WET_COMPOUNDS
# Expected lap time per track in ms; other tracks count as 90 s.
CIRCUIT_LAP_MS = {
    0: 81400, 1: 94600, 2: 94000, 3: 93200, 4: 75500, 5: 74400, 6: 74600, 7: 88800, 8: 73200, 9: 78100,
    10: 105800, 11: 82600, 12: 96400, 13: 92700, 14: 87300, 15: 95900, 16: 71900, 17: 66900, 18: 96900,
    19: 79400, 20: 105100, 21: 56100, 22: 66000, 23: 66000, 24: 64000, 25: 100000, 26: 72500, 27: 77000,
    28: 80300, 29: 92500, 30: 91500, 31: 96800, 32: 85700, 33: 85700,
}
DEFAULT_LAP_MS = 90000
# Tyre lifespans in laps, wear at which a tyre gives up, race points.
LIFESPAN_LAPS, DEFAULT_LIFESPAN, CLIFF_WEAR = {16: 30, 17: 37, 18: 45, 7: 30, 8: 30}, 37, 80.0
RACE_POINTS = (25, 18, 15, 12, 10, 8, 6, 4, 2, 1)
DEFAULT_PIT_LOSS_MS = 22000.0
# Session type groups.
RACE_TYPES = (10, 11, 12, 15, 16, 17)
BASELINE_EXCLUDED_TYPES = (5, 6, 7, 8, 9)
# Cold-start knob defaults (ms, ms per lap, ms per kg, percent per lap).
KNOB_DEFAULTS = {
    "tyre_deg_soft": 50.0, "tyre_deg_medium": 30.0, "tyre_deg_hard": 20.0, "fuel_effect": 10.0,
    "pit_stop_time_loss": 22000.0, "tyre_wear_rate_soft": 2.67, "tyre_wear_rate_medium": 2.16,
    "tyre_wear_rate_hard": 1.78,
}
REGIMES = ("PLAYER", "AI")
COMPOUND_SUFFIX = {16: "soft", 17: "medium", 18: "hard"}
# Gates and clamps of the fits.
MIN_DEG, MIN_FUEL, MIN_PIT, MIN_WEAR, MIN_BASELINE, MIN_AGE_BIN, MIN_IQR = 10, 5, 3, 5, 3, 5, 10
MAX_DEG_SLOPE, MAX_FUEL_SLOPE, MAD_FACTOR = 300.0, 50.0, 2.5
PIT_INFLATION, MAX_PIT_SECTORS, WARMUP_END_AGE = 0.30, 4, 3
FUEL_BUCKET_KG, TEMP_BUCKET_C = 20, 10
IQR_FACTOR = {"AI": 1.5, "PLAYER": 2.0}


def lookup(table: dict, key: Column, fallback: Column | None = None) -> Column:
    """A code table as a map literal: no join, no shuffle."""
    pairs = [F.lit(v) for v in chain.from_iterable(table.items())]
    found = F.try_element_at(F.create_map(*pairs), key.cast("int") if isinstance(next(iter(table)), int) else key)
    return found if fallback is None else F.coalesce(found, fallback)


def track_name(track_id: Column) -> Column:
    return lookup(TRACK_NAMES, track_id, F.concat(F.lit("Track "), track_id.cast("string")))


def session_type_name(code: Column) -> Column:
    return lookup(SESSION_TYPE_NAMES, code, F.concat(F.lit("Type "), code.cast("string")))


def compound_name(code: Column) -> Column:
    return lookup(COMPOUND_NAMES, code, F.concat(F.lit("C"), code.cast("string")))

"""Data-readiness counts, charts and per-track summary documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexframe import dims
from apexframe.functions import rows, stats
from apexframe.operators import coefficients as co

c = F.col
REASONS = ("OUTLIER", "INVALID", "CORNER_CUT", "PIT", "SAFETY_CAR", "DAMAGE", "STANDING_START")


def coverage(snap: DataFrame) -> DataFrame:
    ok = rows.zero("outlier", "lap_invalid", "pit_status") & c("tyre_compound_visual").isin(*dims.ALL_COMPOUNDS)
    return (
        snap.where(ok & c("sector_number").isin(0, 1, 2))
        .groupBy("track_id", c("tyre_compound_visual").alias("compound"), rows.regime().alias("regime"), "sector_number")
        .agg(F.count("*").alias("n"))
    )


def coverage_level(n: Column) -> Column:
    return F.when(n >= 10, "ok").when(n >= 5, "thin").otherwise("low")


def coverage_matrix(cover: DataFrame) -> DataFrame:
    """One row per (track, compound, regime) with a count and a level per sector."""
    slot = [F.coalesce(F.sum(F.when(c("sector_number") == s, c("n"))), F.lit(0)) for s in range(3)]
    out = cover.groupBy("track_id", "compound", "regime").agg(*[e.alias(f"s{i}") for i, e in enumerate(slot)])
    for i in range(3):
        out = out.withColumn(f"level{i}", coverage_level(c(f"s{i}")))
    return out


def player_rows(snap: DataFrame) -> DataFrame:
    return snap.where(
        (c("ai_controlled") == 0) & c("tyre_compound_visual").isin(*dims.ALL_COMPOUNDS) & c("sector_number").isin(0, 1, 2)
    )


def sector_confidence(good: Column) -> Column:
    part = lambda least: F.least(good / least, F.lit(1.0))
    return 0.5 * part(dims.MIN_BASELINE) + 0.5 * part(dims.MIN_DEG)


def sector_tallies(snap: DataFrame) -> DataFrame:
    """Good, total and per-reason counts per (track, compound, sector), with empty slots.

    Dry compounds always appear with three sectors; wet ones only where they have rows.
    """
    seen = player_rows(snap).withColumn("reason", rows.quality()).withColumn("compound", c("tyre_compound_visual"))
    counts = seen.groupBy("track_id", "compound", "sector_number").agg(
        F.count("*").alias("total"), F.count(F.when(c("reason") == "GOOD", 1)).alias("good"),
        *[F.count(F.when(c("reason") == r, 1)).alias(r.lower()) for r in REASONS],
    )
    dry = snap.select("track_id").distinct().select("track_id", F.explode(F.array(*[F.lit(d) for d in dims.DRY_COMPOUNDS])).alias("compound"))
    wet = counts.where(c("compound").isin(*dims.WET_COMPOUNDS)).select("track_id", c("compound").cast("int")).distinct()
    spine = dry.unionByName(wet).withColumn("sector_number", F.explode(F.array(*[F.lit(s) for s in range(3)])))
    keys = ["track_id", "compound", "sector_number"]
    filled = spine.select(*[c(k).cast("bigint").alias(k) for k in keys]).join(counts, keys, "left")
    return filled.select(*keys, *[F.coalesce(c(n), F.lit(0)).alias(n) for n in counts.columns if n not in keys])


def compound_readiness(tallies: DataFrame) -> DataFrame:
    sums = [F.sum(n).alias(n) for n in ["total", "good", *[r.lower() for r in REASONS]]]
    mean = (F.sum(sector_confidence(c("good"))) / 3).alias("confidence")
    return tallies.groupBy("track_id", "compound").agg(*sums, mean)


def overall_confidence(compounds: DataFrame) -> DataFrame:
    with_data = F.when(c("total") > 0, c("confidence"))
    return compounds.groupBy("track_id").agg(F.coalesce(F.avg(with_data), F.lit(0.0)).alias("overall"))


def _knob_compound() -> Column:
    names = {"soft": 16, "medium": 17, "hard": 18, "intermediate": 7, "wet": 8}
    return dims.lookup(names, F.regexp_extract("knob_name", "_([a-z]+)$", 1))


def deg_diagnostics(coeffs: DataFrame) -> DataFrame:
    latest = co.latest_fitted(coeffs).where((c("calibration_regime") == "PLAYER") & c("knob_name").startswith("tyre_deg_"))
    out = latest.withColumn("compound", _knob_compound()).groupBy("track_id", "compound").agg(
        F.sum(F.coalesce("sample_count", F.lit(0))).alias("samples"), (F.max("clamped") == 1).alias("clamped"),
        F.min("r_squared").alias("_r"),
    )
    low = c("clamped") | F.coalesce(c("_r") < 0.3, F.lit(False))
    return out.withColumn("low_confidence", low).drop("_r")


def regime_degradation(coeffs: DataFrame) -> DataFrame:
    deg = co.latest_fitted(coeffs).where(c("knob_name").startswith("tyre_deg_"))
    return deg.groupBy("track_id", _knob_compound().alias("compound"), c("calibration_regime").alias("regime")).agg(
        F.avg("value").alias("slope"), F.sum("sample_count").alias("samples")
    )


def newest_session(sessions: DataFrame, keys: list[str]) -> DataFrame:
    pick = F.max_by("session_uid", F.struct("created_at", "session_uid")).alias("session_uid")
    return sessions.groupBy(*keys).agg(pick) if keys else sessions.agg(pick)


def default_track(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.max_by("track_id", F.struct("created_at", "session_uid")).alias("track_id"))


def scatter(snap: DataFrame, sessions: DataFrame) -> DataFrame:
    """Player tyre age against sector time with the used-by-fit and newest-session flags."""
    dry = (c("ai_controlled") == 0) & c("tyre_compound_visual").isin(*dims.DRY_COMPOUNDS) & rows.timed()
    newest = newest_session(sessions, ["track_id"]).select("track_id", c("session_uid").alias("_new"))
    used = rows.zero("lap_invalid", "outlier", "pit_status", "safety_car_status")
    out = snap.where(dry).join(newest, "track_id", "left")
    return out.select(
        "track_id", "session_uid", "lap_number", "sector_number", c("tyre_compound_visual").alias("compound"),
        c("tyre_age_laps").alias("age"), "sector_time_ms", used.alias("used"), (c("session_uid") == c("_new")).alias("current"),
    )


def scatter_lines(points: DataFrame) -> DataFrame:
    x, y = F.when(c("used"), c("age").cast("double")), F.when(c("used"), c("sector_time_ms").cast("double"))
    fit = points.groupBy("track_id", "sector_number", "compound").agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_sxx(y, x).alias("_sxx"), F.count(x).alias("n"),
    )
    none = (c("n") < 2) | (c("_sxx") == 0)
    return fit.select(
        "track_id", "sector_number", "compound", F.when(~none, c("slope")).alias("slope"),
        F.when(~none, c("intercept")).alias("intercept"), F.when(~none, c("n")).alias("n"),
    )


def wear_points(snap: DataFrame) -> DataFrame:
    ok = (c("ai_controlled") == 0) & rows.zero("outlier", "lap_invalid", "pit_status") & (c("sector_number") == 2)
    return snap.where(ok & c("tyre_compound_visual").isin(*dims.DRY_COMPOUNDS)).select(
        "track_id", "session_uid", "lap_number", c("tyre_compound_visual").alias("compound"),
        c("tyre_age_laps").alias("age"), rows.most_worn_or_zero().alias("wear"),
    )


def sector_times(snap: DataFrame) -> DataFrame:
    ok = (c("ai_controlled") == 0) & rows.zero("lap_invalid", "pit_status") & rows.timed()
    return snap.where(ok & c("tyre_compound_visual").isin(*dims.DRY_COMPOUNDS)).select(
        "track_id", "session_uid", "lap_number", "sector_number", c("tyre_compound_visual").alias("compound"),
        "sector_time_ms", (c("outlier") == 1).alias("outlier"),
    )


def histogram(df: DataFrame, keys: list[str], value: str, series: Column, bins: int) -> DataFrame:
    """Equal-width counts per (keys, bin, series); no spread falls into bin 0 with width 1."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.when(c("_hi") > c("_lo"), (c("_hi") - c("_lo")) / bins).otherwise(1.0)
    slot = F.least(F.lit(bins - 1), F.floor((c(value) - c("_lo")) / width))
    return df.join(ends, keys).groupBy(*keys, slot.cast("bigint").alias("bin"), series.alias("series")).agg(F.count("*").alias("n"))


def fitted_state(coeffs: DataFrame, baselines: DataFrame) -> DataFrame:
    """Which fits exist per track: compounds with wear, degradation and baselines, fuel, last run."""
    fitted = (c("is_default") == 0) & (c("calibration_regime") == "PLAYER")
    knob = lambda prefix: F.when(fitted & c("knob_name").startswith(prefix), _knob_compound())
    per = coeffs.groupBy("track_id").agg(
        F.array_sort(F.collect_set(knob("tyre_wear_rate_"))).alias("wear"),
        F.array_sort(F.collect_set(knob("tyre_deg_"))).alias("deg"),
        (F.count(F.when(fitted & (c("knob_name") == "fuel_effect"), 1)) > 0).alias("fuel_fitted"),
        F.date_format(F.max(F.when(c("is_default") == 0, c("trained_at"))), "yyyy-MM-dd'T'HH:mm:ss").alias("last_ran"),
    )
    base = baselines.where(c("regime") == "PLAYER").groupBy("track_id").agg(
        F.array_sort(F.collect_set("compound")).alias("baseline")
    )
    return per.join(base, "track_id", "left").withColumn("baseline", F.coalesce("baseline", F.array().cast("array<bigint>")))


def summary(snap: DataFrame, coeffs: DataFrame, baselines: DataFrame) -> DataFrame:
    """One document per track: confidence, fit flags and a list of compound entries."""
    tallies = sector_tallies(snap)
    comp = compound_readiness(tallies)
    state = fitted_state(coeffs, baselines)
    diag = deg_diagnostics(coeffs).withColumn("compound", c("compound").cast("bigint"))
    has = lambda arr: F.coalesce(F.array_contains(c(arr).cast("array<bigint>"), c("compound")), F.lit(False))
    entry = F.struct(
        "compound", dims.compound_name(c("compound")).alias("name"), "total", "good", "confidence",
        has("wear").alias("wear_fitted"), has("baseline").alias("baseline_fitted"), has("deg").alias("deg_fitted"),
        F.coalesce("samples", F.lit(0)).alias("deg_samples"), F.coalesce("clamped", F.lit(False)).alias("deg_clamped"),
        F.coalesce("low_confidence", F.lit(False)).alias("deg_low_confidence"),
    )
    rows_ = comp.join(state, "track_id", "left").join(diag, ["track_id", "compound"], "left")
    docs = rows_.groupBy("track_id").agg(
        F.array_sort(F.collect_list(entry)).alias("compounds"), F.first("fuel_fitted").alias("fuel_fitted"),
        F.first("last_ran").alias("last_ran"),
    )
    return docs.join(overall_confidence(comp), "track_id").withColumn("track_name", dims.track_name(c("track_id")))


def tracks_with_data(sessions: DataFrame, snap: DataFrame) -> DataFrame:
    known = snap.select("session_uid").distinct()  # a session has many sectors; only its id is sorted and joined
    used = sessions.join(known, "session_uid", "left_semi")
    return used.groupBy("track_id").agg(F.max("created_at").alias("_at")).select(
        "track_id", dims.track_name(c("track_id")).alias("track_name"),
        F.date_format("_at", "yyyy-MM-dd'T'HH:mm:ss").alias("last_at"),
    )

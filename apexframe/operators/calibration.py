"""Outlier flags, pace baselines, tyre-age offsets and coefficient fits over all tracks at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexframe import dims
from apexframe.functions import rows, stats
from apexframe.session import cut_lineage

c = F.col
SNAP_KEY = ["session_uid", "car_index", "lap_number", "sector_number"]
BUCKET = [
    "track_id", "sector_number", "compound", "regime", "fuel_bucket_kg", "weather", "track_temp_bucket_c",
]


def enrich(snapshots: DataFrame, participants: DataFrame, sessions: DataFrame) -> DataFrame:
    """Snapshots with driver regime and track; sides are broadcast only if measured small."""
    snap = snapshots.drop("track_id", "session_type", "ai_controlled")
    who = participants.select("session_uid", "car_index", "ai_controlled", "driver_name")
    where = sessions.select("session_uid", "track_id", "session_type")
    return snap.join(who, ["session_uid", "car_index"]).join(where, "session_uid")


def iqr_fences(snap: DataFrame) -> DataFrame:
    """Lower and upper fence per (regime, track, sector, compound, wet or dry)."""
    keys = ["regime", "track_id", "sector_number", "tyre_compound_visual", "weather_class"]
    counts = stats.value_counts(outlier_rows(snap), keys, "sector_time_ms")
    q = stats.quantiles(counts, keys, "sector_time_ms", q1=0.25, q3=0.75).where(c("n_rows") >= dims.MIN_IQR)
    q = q.withColumn("q1", F.rint("q1")).withColumn("q3", F.rint("q3")).withColumn("iqr", c("q3") - c("q1"))
    k = F.when(c("regime") == "AI", dims.IQR_FACTOR["AI"]).otherwise(dims.IQR_FACTOR["PLAYER"])
    return q.where(c("iqr") != 0).select(
        *keys, (c("q1") - k * c("iqr")).alias("low"), (c("q3") + k * c("iqr")).alias("high")
    )


def outlier_rows(snap: DataFrame) -> DataFrame:
    """Rows the outlier test looks at; rows without weather cannot be grouped and drop out."""
    return (
        snap.where(rows.outlier_input() & c("weather").isNotNull())
        .withColumn("regime", rows.regime())
        .withColumn("weather_class", rows.weather_class(c("weather")))
    )


def outliers(snap: DataFrame) -> DataFrame:
    keys = ["regime", "track_id", "sector_number", "tyre_compound_visual", "weather_class"]
    return (
        outlier_rows(snap)
        .select(*SNAP_KEY, *[k for k in keys if k not in SNAP_KEY], "sector_time_ms")
        .join(iqr_fences(snap), keys)
        .where((c("sector_time_ms") < c("low")) | (c("sector_time_ms") > c("high")))
        .select(*SNAP_KEY, "track_id", "regime", "sector_time_ms")
    )


def flag_outliers(snap: DataFrame) -> DataFrame:
    """Recompute the outlier column from scratch: reset to 0, then 1 for flagged keys."""
    hit = outliers(snap).select(*SNAP_KEY, F.lit(1).alias("_hit"))
    return snap.drop("outlier").join(hit, SNAP_KEY, "left").withColumn(
        "outlier", F.coalesce(c("_hit"), F.lit(0))
    ).drop("_hit")


def bucketed(snap: DataFrame) -> DataFrame:
    return (
        snap.where(rows.bucketable())
        .withColumn("regime", rows.regime())
        .withColumn("compound", c("tyre_compound_visual"))
        .withColumn("fuel_bucket_kg", rows.bucket_half_even(c("fuel_in_tank_kg"), dims.FUEL_BUCKET_KG))
        .withColumn("track_temp_bucket_c", rows.bucket_half_even(c("track_temp"), dims.TEMP_BUCKET_C))
    )


def baselines(snap: DataFrame) -> DataFrame:
    """Mean, deviation and best sector per bucket after the median filter, at least 3 rows left."""
    counts = stats.value_counts(bucketed(snap.where(rows.baseline_input())), BUCKET, "sector_time_ms")
    kept = stats.mad_keep(counts, BUCKET, "sector_time_ms", dims.MAD_FACTOR)
    return (
        kept.groupBy(*BUCKET)
        .agg(
            F.rint(stats.weighted_mean("sector_time_ms")).cast("bigint").alias("mean_sector_ms"),
            F.rint(stats.weighted_stddev_pop("sector_time_ms")).cast("bigint").alias("stddev_sector_ms"),
            F.min("sector_time_ms").alias("perfect_sector_ms"),
            F.sum("n").alias("sample_count"),
        )
        .where(c("sample_count") >= dims.MIN_BASELINE)
    )


def residuals(snap: DataFrame, base: DataFrame) -> DataFrame:
    """Sector time minus the exact-bucket baseline; rows without a baseline drop out."""
    fit = bucketed(snap.where(rows.fit_input() & c("tyre_compound_visual").isin(*dims.DRY_COMPOUNDS)))
    return (
        fit.select(*[k for k in SNAP_KEY if k not in BUCKET], *BUCKET, "tyre_age_laps", "sector_time_ms")
        .join(base.select(*BUCKET, "mean_sector_ms"), BUCKET)
        .withColumn("residual_ms", c("sector_time_ms") - c("mean_sector_ms"))
    )


AGE_CURVE = ["track_id", "regime", "compound", "sector_number"]


def age_bins(snap: DataFrame, base: DataFrame) -> DataFrame:
    keys = [*AGE_CURVE, "tyre_age_laps"]
    rest = residuals(snap, base).where(c("tyre_age_laps") >= 1)
    kept = stats.mad_keep(stats.value_counts(rest, keys, "residual_ms"), keys, "residual_ms", dims.MAD_FACTOR)
    return (
        kept.groupBy(*keys)
        .agg(
            stats.weighted_mean("residual_ms").alias("offset_ms"),
            stats.weighted_stddev_pop("residual_ms").alias("stddev_ms"),
            F.sum("n").alias("sample_count"),
        )
        .where(c("sample_count") >= dims.MIN_AGE_BIN)
    )


def fill_age_gaps(bins: DataFrame) -> DataFrame:
    """Linear fill of the missing ages inside each curve, marked as extrapolated.

    A curve has at most one row per tyre age, so its window is short by construction.
    """
    w = Window.partitionBy(*AGE_CURVE).orderBy("tyre_age_laps")
    span = bins.select(
        *AGE_CURVE, c("tyre_age_laps").alias("a0"), c("offset_ms").alias("o0"),
        F.lead("tyre_age_laps").over(w).alias("a1"), F.lead("offset_ms").over(w).alias("o1"),
    ).where(c("a1") > c("a0") + 1)
    age = F.explode(F.sequence(c("a0") + 1, c("a1") - 1))
    return span.withColumn("tyre_age_laps", age).select(
        *AGE_CURVE, "tyre_age_laps",
        (c("o0") + (c("tyre_age_laps") - c("a0")) / (c("a1") - c("a0")) * (c("o1") - c("o0"))).alias("offset_ms"),
        F.lit(None).cast("double").alias("stddev_ms"),
        F.lit(0).cast("bigint").alias("sample_count"),
        F.lit(1).alias("is_extrapolation"),
    )


def age_offsets(snap: DataFrame, base: DataFrame) -> DataFrame:
    bins = age_bins(snap, base)
    return bins.withColumn("is_extrapolation", F.lit(0)).unionByName(fill_age_gaps(bins))


def knob(prefix: str, compound: Column) -> Column:
    return F.concat(F.lit(prefix), dims.lookup(dims.COMPOUND_SUFFIX, compound))


def _coefficients(df: DataFrame, method: str) -> DataFrame:
    have = set(df.columns)
    null = lambda t: F.lit(None).cast(t)
    return df.select(
        "track_id", "knob_name", "regime",
        (c("sector_number") if "sector_number" in have else null("bigint")).alias("sector_number"),
        F.lit(method).alias("method_name"), "value", "sample_count",
        (c("r_squared") if "r_squared" in have else null("double")).alias("r_squared"),
        (c("slope_std_error") if "slope_std_error" in have else null("double")).alias("slope_std_error"),
        (c("clamped") if "clamped" in have else F.lit(0)).alias("clamped"),
    )


def tail_slopes(bins: DataFrame) -> DataFrame:
    """Degradation slope per curve from ages past the warm-up, clamped to a plausible range."""
    late = F.when(c("tyre_age_laps") >= dims.WARMUP_END_AGE, c("tyre_age_laps"))
    fit = (
        bins.withColumn("_late", late)
        .groupBy(*AGE_CURVE)
        .agg(stats.regression("offset_ms", "_late").alias("f"))
        .withColumn("knob_name", knob("tyre_deg_", c("compound")))
    )
    few = c("f.n") < 2
    fixed = F.least(F.greatest(c("f.slope"), F.lit(0.0)), F.lit(dims.MAX_DEG_SLOPE))
    out = fit.select(
        "track_id", "regime", "sector_number", "knob_name", c("f.n").alias("sample_count"),
        F.when(few, dims.lookup(dims.KNOB_DEFAULTS, c("knob_name"))).otherwise(fixed).alias("value"),
        F.when(~few, c("f.r2")).alias("r_squared"),
        F.when(few | (fixed != c("f.slope")), 1).otherwise(0).alias("clamped"),
    )
    return _coefficients(out, "tail_slope")


def fit_by(df: DataFrame, keys: list[str], y: str, x: str, least: int) -> DataFrame:
    return df.groupBy(*keys).agg(stats.regression(y, x).alias("f")).where(c("f.n") >= least)


def fit_rows(snap: DataFrame) -> DataFrame:
    return (
        snap.where(rows.fit_input())
        .withColumn("regime", rows.regime())
        .withColumn("most_worn", rows.most_worn())
    )


def wear_rates(snap: DataFrame) -> DataFrame:
    dry = fit_rows(snap).where(c("tyre_compound_visual").isin(*dims.DRY_COMPOUNDS) & c("most_worn").isNotNull())
    dry = dry.withColumn("knob_name", knob("tyre_wear_rate_", c("tyre_compound_visual")))
    fit = fit_by(dry, ["track_id", "regime", "knob_name"], "most_worn", "tyre_age_laps", dims.MIN_WEAR)
    out = fit.select(
        "track_id", "regime", "knob_name", F.greatest(c("f.slope"), F.lit(0.0)).alias("value"),
        c("f.n").alias("sample_count"), c("f.r2").alias("r_squared"), c("f.se").alias("slope_std_error"),
        F.when(c("f.slope") < 0, 1).otherwise(0).alias("clamped"),
    )
    return _coefficients(out, "linear_regression")


def fuel_effects(snap: DataFrame) -> DataFrame:
    fuelled = fit_rows(snap).where(c("fuel_in_tank_kg") > 0)
    fit = fit_by(fuelled, ["track_id", "regime", "sector_number"], "sector_time_ms", "fuel_in_tank_kg", dims.MIN_FUEL)
    fine = c("f.slope").between(0.0, dims.MAX_FUEL_SLOPE)
    out = fit.select(
        "track_id", "regime", "sector_number", F.lit("fuel_effect").alias("knob_name"),
        F.when(fine, c("f.slope")).otherwise(dims.KNOB_DEFAULTS["fuel_effect"]).alias("value"),
        c("f.n").alias("sample_count"), c("f.r2").alias("r_squared"), c("f.se").alias("slope_std_error"),
        F.when(fine, 0).otherwise(1).alias("clamped"),
    )
    return _coefficients(out, "linear_regression")


def sector_medians(snap: DataFrame) -> DataFrame:
    keys = ["track_id", "sector_number", "ai_controlled"]
    counts = stats.value_counts(snap.where(rows.median_input()), keys, "sector_time_ms")
    return stats.quantiles(counts, keys, "sector_time_ms", median_ms=0.5)


def pit_rows(snap: DataFrame) -> DataFrame:
    pitted = snap.where(c("pit_status") == 1).select("session_uid", "car_index")
    return snap.where(rows.pit_input()).join(pitted, ["session_uid", "car_index"], "left_semi")


def pit_losses(snap: DataFrame, medians: DataFrame) -> DataFrame:
    """Time lost per stop: excess over the normal sector at entry and while clearly inflated.

    A car's rows in one session are unique by (lap, sector) with a one-byte lap number, so the
    ordered list folded here has at most 768 entries.
    """
    base = medians.select("track_id", "sector_number", "ai_controlled", "median_ms")
    walk = pit_rows(snap).join(base, ["track_id", "sector_number", "ai_controlled"], "left")
    row = F.struct(
        "lap_number", "sector_number", c("pit_status").alias("pit"),
        (c("median_ms") > 0).alias("known"), (c("sector_time_ms") - c("median_ms")).alias("excess"),
        (c("sector_time_ms") - c("median_ms") > c("median_ms") * dims.PIT_INFLATION).alias("slow"),
    )
    per_car = walk.groupBy("track_id", "session_uid", "car_index", "ai_controlled").agg(
        F.array_sort(F.collect_list(row)).alias("r")
    )
    empty = F.struct(
        F.lit(0).alias("open"), F.lit(True).alias("ok"), F.lit(0.0).alias("loss"),
        F.array().cast("array<double>").alias("done"),
    )

    def closed(a: Column) -> Column:
        good = (a["open"] > 0) & a["ok"] & (a["loss"] > 0)
        return F.when(good, F.array_append(a["done"], a["loss"])).otherwise(a["done"])

    def step(a: Column, r: Column) -> Column:
        known, joins = F.coalesce(r["known"], F.lit(False)), F.coalesce(r["slow"], F.lit(False))
        inside = (a["open"] > 0) & (a["open"] < dims.MAX_PIT_SECTORS)
        goes_on = inside & known & joins
        voided = inside & ~known
        # A row that ends a stop is looked at again as a possible new entry.
        entry = ~goes_on & (r["pit"] == 1)
        kept = F.when(goes_on, a["done"]).when(voided, a["done"]).otherwise(closed(a))
        return F.struct(
            F.when(goes_on, a["open"] + 1).when(entry & known, 1).otherwise(0).alias("open"),
            F.lit(True).alias("ok"),
            F.when(goes_on, a["loss"] + r["excess"]).when(entry & known, r["excess"]).otherwise(0.0).alias("loss"),
            kept.alias("done"),
        )

    stops = F.aggregate("r", empty, step, closed)
    return per_car.select(
        "track_id", "session_uid", "car_index", rows.regime().alias("regime"), F.posexplode(stops).alias("stop", "loss_ms")
    )


def pit_loss_knob(losses: DataFrame) -> DataFrame:
    mean = losses.groupBy("track_id", "regime").agg(F.avg("loss_ms").alias("value"), F.count("*").alias("sample_count"))
    mean = mean.where(c("sample_count") >= dims.MIN_PIT).withColumn("knob_name", F.lit("pit_stop_time_loss"))
    return _coefficients(mean, "mean")


def calibrate(snap: DataFrame) -> DataFrame:
    """Every coefficient of every track and regime from enriched snapshots.

    The flagged rows feed every fit, so they are written to the shared folder once.
    """
    clean = cut_lineage(flag_outliers(snap))
    bins = age_bins(clean, baselines(clean))
    out = tail_slopes(bins).unionByName(wear_rates(clean)).unionByName(fuel_effects(clean))
    return out.unionByName(pit_loss_knob(pit_losses(clean, sector_medians(clean))))


def r2_by_knob(snap: DataFrame) -> DataFrame:
    """Per-knob fit quality on raw times: degradation, fuel and wear."""
    data = fit_rows(snap)
    dry = data.where(c("tyre_compound_visual").isin(*dims.DRY_COMPOUNDS))
    deg = fit_by(
        dry.withColumn("knob_name", knob("tyre_deg_", c("tyre_compound_visual"))),
        ["track_id", "regime", "knob_name", "sector_number"], "sector_time_ms", "tyre_age_laps", dims.MIN_DEG,
    )
    fuel = fit_by(
        data.where(c("fuel_in_tank_kg") > 0).withColumn("knob_name", F.lit("fuel_effect")),
        ["track_id", "regime", "knob_name", "sector_number"], "sector_time_ms", "fuel_in_tank_kg", dims.MIN_FUEL,
    )
    wear = fit_by(
        dry.where(c("most_worn").isNotNull())
        .withColumn("knob_name", knob("tyre_wear_rate_", c("tyre_compound_visual")))
        .withColumn("sector_number", F.lit(None).cast("int")),
        ["track_id", "regime", "knob_name", "sector_number"], "most_worn", "tyre_age_laps", dims.MIN_WEAR,
    )
    every = deg.unionByName(fuel).unionByName(wear)
    return every.select(
        "track_id", "regime", "knob_name", "sector_number",
        c("f.slope").alias("slope"), c("f.r2").alias("r_squared"), c("f.n").alias("n"),
    )


def r2_summary(by_knob: DataFrame) -> DataFrame:
    timed = by_knob.where(c("knob_name").startswith("tyre_deg_") | (c("knob_name") == "fuel_effect"))
    return timed.groupBy("track_id", "regime").agg(
        (F.sum(c("r_squared") * c("n")) / F.sum("n")).alias("weighted_r2"), F.sum("n").alias("n")
    )

"""Latest-wins coefficient views, defaults, fallback chains and baseline lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apexframe import dims
from apexframe.functions import rows, stats

c = F.col
GROUP = ["track_id", "knob_name", "calibration_regime", "sector_number"]
NO_SECTOR = -1


def _newest(df: DataFrame, keys: list[str], *order: Column, payload: list[str]) -> DataFrame:
    """One row per key, the greatest by ``order``; a max_by combines map-side, unlike a ranked window."""
    best = F.max_by(F.struct(*payload), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[c(f"_r.{p}").alias(p) for p in payload])


def latest_fitted(coeffs: DataFrame) -> DataFrame:
    """Newest fitted row per (track, knob, regime, sector); a null sector is its own group."""
    fitted = coeffs.where(c("is_default") == 0)
    return _newest(
        fitted, GROUP, c("trained_at"), c("coefficient_id"),
        payload=["coefficient_id", "value", "sample_count", "r_squared", "clamped", "trained_at"],
    )


def effective(coeffs: DataFrame) -> DataFrame:
    """Newest row per knob slot, any fitted row ahead of a default one."""
    slot = coeffs.withColumn("sector", F.coalesce(c("sector_number"), F.lit(NO_SECTOR)))
    return _newest(
        slot, ["track_id", "knob_name", "calibration_regime", "sector"],
        -c("is_default"), c("trained_at"), c("coefficient_id"), payload=["value", "is_default"],
    )


def default_knobs(spark: SparkSession) -> DataFrame:
    data = [(k, r, v) for k, v in dims.KNOB_DEFAULTS.items() for r in dims.REGIMES]
    return spark.createDataFrame(data, "knob_name string, calibration_regime string, default_value double")


def with_defaults(effective_rows: DataFrame, tracks: DataFrame) -> DataFrame:
    """Stored values over the code defaults: every track has every track-wide knob."""
    slots = _default_slots(tracks).withColumn("sector", F.lit(NO_SECTOR).cast("bigint"))
    keys = ["track_id", "knob_name", "calibration_regime", "sector"]
    both = effective_rows.withColumn("sector", c("sector").cast("bigint")).join(slots, keys, "full_outer")
    return both.select(*keys, F.coalesce("value", "default_value").alias("value"))


def _default_slots(tracks: DataFrame) -> DataFrame:
    """Tracks times the sixteen fixed default knobs, as an explode of a literal."""
    entries = [
        F.struct(F.lit(k).alias("knob_name"), F.lit(r).alias("calibration_regime"), F.lit(v).alias("default_value"))
        for k, v in dims.KNOB_DEFAULTS.items()
        for r in dims.REGIMES
    ]
    return tracks.select("track_id").distinct().select("track_id", F.inline(F.array(*entries)))


def resolve_knob(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """Fallback chain per wanted (track, knob, regime, sector): own sector, own track-wide value,
    the AI regime's two, then 0. One aggregate over one join instead of four joins."""
    s = store.select("track_id", "knob_name", c("calibration_regime").alias("_reg"), c("sector").alias("_sec"), "value")
    per_knob = s.groupBy("track_id", "knob_name").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "_reg", "_sec"), "value"))).alias("_m")
    )
    keyed = wanted.join(per_knob, ["track_id", "knob_name"], "left")
    pick = lambda reg, sec: F.try_element_at("_m", F.concat_ws("|", reg, sec.cast("string")))
    wide, ai = F.lit(NO_SECTOR), F.lit("AI")
    value = F.coalesce(
        pick(c("calibration_regime"), c("sector")), pick(c("calibration_regime"), wide),
        pick(ai, c("sector")), pick(ai, wide), F.lit(0.0),
    )
    return keyed.withColumn("value", value).drop("_m")


def pit_loss_by_regime(effective_rows: DataFrame) -> DataFrame:
    """Pit loss per track; the player borrows the AI fit while its own is still the default."""
    pit = effective_rows.where((c("knob_name") == "pit_stop_time_loss") & (c("sector") == NO_SECTOR))
    at = lambda reg, col: F.max(F.when(c("calibration_regime") == reg, c(col)))
    wide = pit.groupBy("track_id").agg(
        at("PLAYER", "value").alias("pv"), at("PLAYER", "is_default").alias("pd"),
        at("AI", "value").alias("av"), at("AI", "is_default").alias("ad"),
    )
    default = F.lit(dims.KNOB_DEFAULTS["pit_stop_time_loss"])
    own_default = F.coalesce(c("pd"), F.lit(1)) == 1
    ai_fitted = F.coalesce(c("ad"), F.lit(1)) == 0
    player = F.when(own_default & ai_fitted, c("av")).otherwise(F.coalesce("pv", default))
    return wide.select("track_id", player.alias("player_ms"), F.coalesce("av", default).alias("ai_ms"))


def refresh_defaults(stored: DataFrame, tracks: DataFrame) -> DataFrame:
    """What a cold start changes: default rows to insert and stored defaults that have drifted."""
    keys = ["track_id", "knob_name", "calibration_regime"]
    have = stored.where((c("is_default") == 1) & c("sector_number").isNull())
    have = _newest(have, keys, c("trained_at"), c("coefficient_id"), payload=["value"])
    both = _default_slots(tracks).join(have, keys, "left")
    action = F.when(c("value").isNull(), "insert").when(F.abs(c("value") - c("default_value")) > 1e-9, "refresh")
    return both.withColumn("action", action).where(c("action").isNotNull()).select(*keys, "default_value", "action")


def nearest_baseline(requests: DataFrame, baselines: DataFrame) -> DataFrame:
    """Closest bucket per request: fuel distance, then same weather, then temperature distance.

    ``requests`` carries request_id, track_id, sector_number, compound, regime, fuel_kg, weather,
    track_temp. The four equality keys make it a hash join; the pick is an aggregate.
    """
    keys = ["track_id", "sector_number", "compound", "regime"]
    b = baselines.select(
        *keys, "fuel_bucket_kg", c("weather").alias("b_weather"), "track_temp_bucket_c",
        "mean_sector_ms", "perfect_sector_ms",
    )
    # A slot's buckets are few and bounded by the bucket grid, so they ride along as one array.
    slot = b.groupBy(*keys).agg(
        F.collect_list(
            F.struct("fuel_bucket_kg", "b_weather", "track_temp_bucket_c", "mean_sector_ms", "perfect_sector_ms")
        ).alias("_b")
    )
    # Requests repeat the same few grid cells: the ranking runs once per cell, rows then join it.
    unknown = F.lit(-999).cast("bigint")
    asked = requests.withColumn("_fuel", F.coalesce(rows.bucket_half_up(c("fuel_kg"), dims.FUEL_BUCKET_KG), unknown))
    asked = asked.withColumn("_temp", F.coalesce(rows.bucket_half_up(c("track_temp"), dims.TEMP_BUCKET_C), unknown))
    asked = asked.withColumn("_weather", F.coalesce(c("weather").cast("bigint"), unknown))
    cell = [*keys, "_fuel", "_weather", "_temp"]
    known = lambda v: F.when(v != unknown, v)
    ranked = F.array_min(
        F.transform(
            "_b",
            lambda e: F.struct(
                F.abs(e["fuel_bucket_kg"] - known(c("_fuel"))).alias("d0"),
                F.when(e["b_weather"] == known(c("_weather")), 0).otherwise(1).alias("d1"),
                F.abs(e["track_temp_bucket_c"] - known(c("_temp"))).alias("d2"),
                e["fuel_bucket_kg"].alias("d3"), e["b_weather"].alias("d4"), e["track_temp_bucket_c"].alias("d5"),
                e["mean_sector_ms"].alias("mean_ms"), e["perfect_sector_ms"].alias("perfect_ms"),
            ),
        )
    )
    cells = asked.select(*cell).distinct().join(slot, keys).withColumn("_n", ranked)
    found = cells.select(*cell, c("_n.mean_ms").alias("_mean"), c("_n.perfect_ms").alias("_perfect"))
    return asked.join(found, cell, "left").select(
        *requests.columns, F.coalesce("_mean", F.lit(0)).alias("baseline_ms"), F.coalesce("_perfect", F.lit(0)).alias("perfect_ms")
    )


def recent_times(snap: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` newest clean times per (track, car, compound, sector), newest first.
    """
    keys = ["track_id", "car_index", "tyre_compound_visual", "sector_number"]
    order = [F.desc("created_at"), F.desc("session_uid"), F.desc("lap_number")]
    slim = snap.where(rows.history_input()).select(*keys, "session_uid", "lap_number", "created_at", "sector_time_ms")
    top = stats.top_per_group(slim, keys, order, n)
    times = F.transform(F.array_sort(F.collect_list(F.struct("rn", "sector_time_ms"))), lambda e: e["sector_time_ms"])
    return top.groupBy(*keys).agg(times.alias("recent_ms"))


def laps_recorded(snap: DataFrame) -> DataFrame:
    clean = rows.zero("sector_number", "outlier", "lap_invalid", "pit_status")
    return snap.where(clean).groupBy("track_id", "car_index").agg(F.count("*").alias("laps"))


def data_gate(laps: DataFrame, slots: DataFrame, requests: DataFrame) -> DataFrame:
    """A car may be evaluated with two recorded laps or any baseline of its regime and compound."""
    have = slots.select("track_id", "compound", "regime").distinct().withColumn("_b", F.lit(True))
    out = requests.join(laps, ["track_id", "car_index"], "left").join(have, ["track_id", "compound", "regime"], "left")
    return out.withColumn("ready", (F.coalesce(c("laps"), F.lit(0)) >= 2) | F.coalesce(c("_b"), F.lit(False))).drop("_b")

"""Row filters, joins and the calibration fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from apexframe import dims
from apexframe.functions import rows, stats
from apexframe.operators import calibration as cal
from apexframe.plans.registry import query, shared

c = F.col
KEY = "session_uid, car_index, lap_number, sector_number"
RACE = "session_type IN (10,11,12,15,16,17)"
START = f"(lap_number = 1 AND sector_number = 0 AND {RACE})"
DMG0 = " AND ".join(f"{p} = 0" for p in rows.DAMAGE_PARTS)
DMG1 = " OR ".join(f"{p} > 0" for p in rows.DAMAGE_PARTS)
FIT = (
    "lap_invalid = 0 AND corner_cutting_warnings = 0 AND pit_status = 0 AND safety_car_status = 0 "
    f"AND outlier = 0 AND sector_time_ms > 0 AND NOT {START}"
)
OUT = f"lap_invalid = 0 AND pit_status = 0 AND safety_car_status = 0 AND sector_time_ms > 0 AND {DMG0} AND NOT {START}"
MED = "pit_status = 0 AND lap_invalid = 0 AND safety_car_status = 0 AND lap_number > 1 AND sector_time_ms > 0 AND outlier = 0"
PIT = f"sector_time_ms > 0 AND lap_number > 1 AND safety_car_status = 0 AND penalties_sec = 0 AND {RACE}"
HIST = "outlier = 0 AND lap_invalid = 0 AND pit_status = 0 AND sector_time_ms > 0"
REGIME = "CASE WHEN ai_controlled = 1 THEN 'AI' ELSE 'PLAYER' END"
PITTED = "(session_uid, car_index) IN (SELECT session_uid, car_index FROM snap WHERE pit_status = 1)"


def _filter(name: str, cond, sql: str) -> None:
    @query(name, f"SELECT {KEY}, track_id, sector_time_ms FROM snap WHERE {sql}")
    def _(x):
        return x.snap.where(cond()).select(*cal.SNAP_KEY, "track_id", "sector_time_ms")


_filter("P1_outlier_input", rows.outlier_input, OUT)
_filter("P2_baseline_input", rows.baseline_input, f"{FIT} AND session_type NOT IN (5,6,7,8,9)")
_filter("P3_fit_input", rows.fit_input, FIT)
_filter("P5_median_input", rows.median_input, MED)
_filter("P6_history_input", rows.history_input, HIST)


@query("P4_pit_input", f"SELECT {KEY}, pit_status, sector_time_ms FROM snap WHERE {PIT} AND {PITTED}")
def _(x):
    return cal.pit_rows(x.snap).select(*cal.SNAP_KEY, "pit_status", "sector_time_ms")


@query("P7_regime", f"SELECT session_uid, {REGIME} AS regime, count(*) AS n FROM participants GROUP BY 1, 2")
def _(x):
    return x.participants.groupBy("session_uid", rows.regime().alias("regime")).agg(F.count("*").alias("n"))


@query("P8_weather_class", """
SELECT session_uid, CASE WHEN weather >= 3 THEN 'wet' ELSE 'dry' END AS weather_class, count(*) AS n
FROM snap GROUP BY 1, 2""")
def _(x):
    return x.snap.groupBy("session_uid", rows.weather_class(c("weather")).alias("weather_class")).agg(F.count("*").alias("n"))


@query("P9_fit_buckets", f"""
SELECT {KEY}, cast(round_even(fuel_in_tank_kg / 20.0, 0) * 20 AS bigint) AS fuel_bucket,
  cast(round_even(track_temp / 10.0, 0) * 10 AS bigint) AS temp_bucket FROM snap""")
def _(x):
    return x.snap.select(
        *cal.SNAP_KEY, rows.bucket_half_even(c("fuel_in_tank_kg"), 20).alias("fuel_bucket"),
        rows.bucket_half_even(c("track_temp"), 10).alias("temp_bucket"),
    )


@query("P10_lookup_buckets", f"""
SELECT {KEY}, cast(floor(fuel_in_tank_kg / 20.0 + 0.5) * 20 AS bigint) AS fuel_bucket,
  cast(floor(track_temp / 10.0 + 0.5) * 10 AS bigint) AS temp_bucket FROM snap""")
def _(x):
    return x.snap.select(
        *cal.SNAP_KEY, rows.bucket_half_up(c("fuel_in_tank_kg"), 20).alias("fuel_bucket"),
        rows.bucket_half_up(c("track_temp"), 10).alias("temp_bucket"),
    )


@query("P11_bucket_guard", """
SELECT track_id, tyre_compound_visual, count(*) AS n FROM snap
WHERE ai_controlled IS NOT NULL AND fuel_in_tank_kg IS NOT NULL AND weather IS NOT NULL AND track_temp IS NOT NULL
  AND tyre_compound_visual IN (7,8,16,17,18) GROUP BY 1, 2""")
def _(x):
    return x.snap.where(rows.bucketable()).groupBy("track_id", "tyre_compound_visual").agg(F.count("*").alias("n"))


@query("P18_most_worn", f"SELECT {KEY}, greatest(tyre_wear_fl, tyre_wear_fr, tyre_wear_rl, tyre_wear_rr) AS most_worn FROM snap")
def _(x):
    return x.snap.select(*cal.SNAP_KEY, rows.most_worn().alias("most_worn"))


@query("P19_most_worn_zero", f"""
SELECT {KEY}, greatest(coalesce(tyre_wear_fl, 0), coalesce(tyre_wear_fr, 0), coalesce(tyre_wear_rl, 0),
  coalesce(tyre_wear_rr, 0)) AS most_worn FROM snap""")
def _(x):
    return x.snap.select(*cal.SNAP_KEY, rows.most_worn_or_zero().alias("most_worn"))


QUALITY = f"""CASE WHEN pit_status <> 0 THEN 'PIT' WHEN safety_car_status <> 0 THEN 'SAFETY_CAR' WHEN lap_invalid <> 0 THEN 'INVALID'
  WHEN corner_cutting_warnings <> 0 THEN 'CORNER_CUT' WHEN {DMG1} THEN 'DAMAGE' WHEN {START} THEN 'STANDING_START'
  WHEN outlier <> 0 THEN 'OUTLIER' WHEN sector_time_ms IS NULL OR sector_time_ms <= 0 THEN 'INVALID' ELSE 'GOOD' END"""


@query("P20_row_quality", f"SELECT {KEY}, {QUALITY} AS reason FROM snap")
def _(x):
    return x.snap.select(*cal.SNAP_KEY, rows.quality().alias("reason"))


@query("P21_damaged", f"SELECT {KEY}, CASE WHEN {DMG1} THEN 1 ELSE 0 END AS damaged FROM snap")
def _(x):
    return x.snap.select(*cal.SNAP_KEY, rows.damaged().alias("damaged"))


@query("P17_front_wing", f"SELECT {KEY}, greatest(front_wing_damage_l, front_wing_damage_r) AS front_wing FROM snap")
def _(x):
    return x.snap.select(*cal.SNAP_KEY, F.greatest("front_wing_damage_l", "front_wing_damage_r").alias("front_wing"))


@query("J1_enrich", f"""
SELECT s.session_uid, s.car_index, s.lap_number, s.sector_number, p.ai_controlled, p.driver_name, e.track_id, e.session_type, s.sector_time_ms
FROM snap s JOIN participants p ON p.session_uid = s.session_uid AND p.car_index = s.car_index
JOIN sessions e ON e.session_uid = s.session_uid""")
def _(x):
    return cal.enrich(x.snap, x.participants, x.sessions).select(
        *cal.SNAP_KEY, "ai_controlled", "driver_name", "track_id", "session_type", "sector_time_ms"
    )


@query("J2_pitted_cars", f"SELECT session_uid, car_index FROM participants WHERE {PITTED}")
def _(x):
    pitted = x.snap.where(c("pit_status") == 1).select("session_uid", "car_index")
    return x.participants.join(pitted, ["session_uid", "car_index"], "left_semi").select("session_uid", "car_index")


GROUP = "regime, track_id, sector_number, tyre_compound_visual, weather_class"
shared("o_iqr_rows", f"""
SELECT *, {REGIME} AS regime, CASE WHEN weather >= 3 THEN 'wet' ELSE 'dry' END AS weather_class FROM snap WHERE {OUT}""")
shared("o_fences", f"""
SELECT {GROUP}, q1 - k * (q3 - q1) AS low, q3 + k * (q3 - q1) AS high FROM (
  SELECT {GROUP}, count(*) AS n, round_even(quantile_cont(sector_time_ms, 0.25), 0) AS q1,
    round_even(quantile_cont(sector_time_ms, 0.75), 0) AS q3, CASE WHEN regime = 'AI' THEN 1.5 ELSE 2.0 END AS k
  FROM o_iqr_rows GROUP BY {GROUP}) g WHERE n >= 10 AND q3 <> q1""")
shared("o_outliers", f"""
SELECT r.session_uid, r.car_index, r.lap_number, r.sector_number, r.track_id, r.regime, r.sector_time_ms
FROM o_iqr_rows r JOIN o_fences f USING ({GROUP}) WHERE r.sector_time_ms < f.low OR r.sector_time_ms > f.high""")
shared("o_bucket_rows", f"""
SELECT *, {REGIME} AS regime, tyre_compound_visual AS compound,
  cast(round_even(fuel_in_tank_kg / 20.0, 0) * 20 AS bigint) AS fuel_bucket_kg,
  cast(round_even(track_temp / 10.0, 0) * 10 AS bigint) AS track_temp_bucket_c
FROM snap WHERE fuel_in_tank_kg IS NOT NULL AND tyre_compound_visual IN (7,8,16,17,18)""")
BK = "track_id, sector_number, compound, regime, fuel_bucket_kg, weather, track_temp_bucket_c"
shared("o_base_mad", f"""
SELECT * FROM (SELECT *, median(abs(sector_time_ms - med)) OVER (PARTITION BY {BK}) AS mad FROM (
  SELECT *, median(sector_time_ms) OVER (PARTITION BY {BK}) AS med, count(*) OVER (PARTITION BY {BK}) AS cnt
  FROM o_bucket_rows WHERE {FIT} AND session_type NOT IN (5,6,7,8,9)) a) b
WHERE cnt < 3 OR mad = 0 OR abs(sector_time_ms - med) <= 2.5 * mad""")
shared("o_baselines", f"""
SELECT {BK}, cast(round_even(avg(sector_time_ms), 0) AS bigint) AS mean_sector_ms,
  cast(round_even(stddev_pop(sector_time_ms), 0) AS bigint) AS stddev_sector_ms,
  min(sector_time_ms) AS perfect_sector_ms, count(*) AS sample_count
FROM o_base_mad GROUP BY {BK} HAVING count(*) >= 3""")
shared("o_resid", f"""
SELECT r.session_uid, r.car_index, r.lap_number, r.sector_number, r.track_id, r.regime, r.compound, r.tyre_age_laps,
  r.sector_time_ms - b.mean_sector_ms AS residual_ms
FROM (SELECT * FROM o_bucket_rows WHERE {FIT} AND compound IN (16,17,18)) r JOIN o_baselines b USING ({BK})""")
CURVE = "track_id, regime, compound, sector_number"
shared("o_bins", f"""
SELECT {CURVE}, tyre_age_laps, avg(residual_ms) AS offset_ms, stddev_pop(residual_ms) AS stddev_ms, count(*) AS sample_count
FROM (SELECT *, median(abs(residual_ms - med)) OVER (PARTITION BY {CURVE}, tyre_age_laps) AS mad FROM (
  SELECT *, median(residual_ms) OVER (PARTITION BY {CURVE}, tyre_age_laps) AS med,
    count(*) OVER (PARTITION BY {CURVE}, tyre_age_laps) AS cnt FROM o_resid WHERE tyre_age_laps >= 1) a) b
WHERE cnt < 3 OR mad = 0 OR abs(residual_ms - med) <= 2.5 * mad GROUP BY {CURVE}, tyre_age_laps HAVING count(*) >= 5""")


@query("A1_outliers", "SELECT * FROM o_outliers")
def _(x):
    return cal.outliers(x.snap)


@query("A2_mad_filter", f"SELECT {BK}, sector_time_ms, count(*) AS n FROM o_base_mad GROUP BY {BK}, sector_time_ms")
def _(x):
    counts = stats.value_counts(cal.bucketed(x.snap.where(rows.baseline_input())), cal.BUCKET, "sector_time_ms")
    return stats.mad_keep(counts, cal.BUCKET, "sector_time_ms", dims.MAD_FACTOR)


@query("A3_sector_baselines", "SELECT * FROM o_baselines")
def _(x):
    return cal.baselines(x.snap)


shared("o_medians", f"SELECT track_id, sector_number, ai_controlled, median(sector_time_ms) AS median_ms, count(*) AS n_rows FROM snap WHERE {MED} GROUP BY ALL")


@query("A4_sector_medians", "SELECT * FROM o_medians")
def _(x):
    return cal.sector_medians(x.snap)


def fit_sql(y: str, x: str) -> str:
    """Regression with the same special cases: slope, r2, se, n (rounded)."""
    sxx, syy, sxy = f"regr_sxx({y}, {x})", f"regr_syy({y}, {x})", f"regr_sxy({y}, {x})"
    slope = f"CASE WHEN {sxx} = 0 THEN 0 ELSE {sxy} / {sxx} END"
    rest = f"({syy} - {sxy} / nullif({sxx}, 0) * {sxy})"
    return (
        f"cast({slope} AS double) AS slope, "
        f"cast(CASE WHEN {sxx} = 0 OR {syy} <= 0 THEN 0 ELSE {sxy} * {sxy} / ({sxx} * {syy}) END AS double) AS r2, "
        f"cast(CASE WHEN {sxx} > 0 AND count(*) > 2 AND {rest} > 0 THEN sqrt({rest} / (count(*) - 2) / {sxx}) ELSE 0 END AS double) AS se, "
        "count(*) AS n"
    )


@query("A5_regression", f"""
SELECT track_id, sector_number, tyre_compound_visual, round(slope, 4) AS slope, round(r2, 4) AS r2, round(se, 4) AS se, n FROM (
  SELECT track_id, sector_number, tyre_compound_visual, {fit_sql('sector_time_ms', 'tyre_age_laps')} FROM snap GROUP BY ALL) f""")
def _(x):
    fit = x.snap.groupBy("track_id", "sector_number", "tyre_compound_visual").agg(
        stats.regression("sector_time_ms", "tyre_age_laps").alias("f")
    )
    return fit.select(
        "track_id", "sector_number", "tyre_compound_visual", F.round("f.slope", 4).alias("slope"),
        F.round("f.r2", 4).alias("r2"), F.round("f.se", 4).alias("se"), c("f.n").alias("n"),
    )


def coef(df):
    return df.select(
        "track_id", "knob_name", "regime", "sector_number", F.round("value", 4).alias("value"), "sample_count",
        F.round("r_squared", 4).alias("r_squared"), F.round("slope_std_error", 4).alias("slope_std_error"), "clamped",
    )


SUFFIX = "CASE {c} WHEN 16 THEN 'soft' WHEN 17 THEN 'medium' ELSE 'hard' END"
shared("o_fit_rows", f"""
SELECT *, {REGIME} AS regime, greatest(tyre_wear_fl, tyre_wear_fr, tyre_wear_rl, tyre_wear_rr) AS most_worn FROM snap WHERE {FIT}""")
shared("o_wear", f"""
SELECT track_id, regime, concat('tyre_wear_rate_', {SUFFIX.format(c='tyre_compound_visual')}) AS knob_name, {fit_sql('most_worn', 'tyre_age_laps')}
FROM o_fit_rows WHERE tyre_compound_visual IN (16,17,18) AND most_worn IS NOT NULL GROUP BY ALL HAVING count(*) >= 5""")
shared("o_fuel", f"""
SELECT track_id, regime, sector_number, {fit_sql('sector_time_ms', 'fuel_in_tank_kg')}
FROM o_fit_rows WHERE fuel_in_tank_kg > 0 GROUP BY ALL HAVING count(*) >= 5""")
shared("o_deg_raw", f"""
SELECT track_id, regime, sector_number, concat('tyre_deg_', {SUFFIX.format(c='tyre_compound_visual')}) AS knob_name, {fit_sql('sector_time_ms', 'tyre_age_laps')}
FROM o_fit_rows WHERE tyre_compound_visual IN (16,17,18) GROUP BY ALL HAVING count(*) >= 10""")
COEF = (
    "track_id, knob_name, regime, sector_number, round(value, 4) AS value, sample_count, "
    "round(r_squared, 4) AS r_squared, round(slope_std_error, 4) AS slope_std_error, clamped"
)
shared("o_c_wear", """
SELECT track_id, knob_name, regime, cast(NULL AS bigint) AS sector_number, greatest(slope, 0) AS value, n AS sample_count, r2 AS r_squared,
  se AS slope_std_error, CASE WHEN slope < 0 THEN 1 ELSE 0 END AS clamped FROM o_wear""")
shared("o_c_fuel", """
SELECT track_id, 'fuel_effect' AS knob_name, regime, sector_number, CASE WHEN slope BETWEEN 0 AND 50 THEN slope ELSE 10 END AS value,
  n AS sample_count, r2 AS r_squared, se AS slope_std_error, CASE WHEN slope BETWEEN 0 AND 50 THEN 0 ELSE 1 END AS clamped FROM o_fuel""")
shared("o_c_tail", f"""
SELECT track_id, concat('tyre_deg_', {SUFFIX.format(c='compound')}) AS knob_name, regime, sector_number,
  CASE WHEN n < 2 THEN CASE compound WHEN 16 THEN 50.0 WHEN 17 THEN 30.0 ELSE 20.0 END ELSE least(greatest(slope, 0), 300) END AS value,
  n AS sample_count, CASE WHEN n >= 2 THEN r2 END AS r_squared, cast(NULL AS double) AS slope_std_error,
  CASE WHEN n < 2 OR least(greatest(slope, 0), 300) <> slope THEN 1 ELSE 0 END AS clamped
FROM (SELECT {CURVE}, {fit_sql('offset_ms', 'age')} FROM (
    SELECT *, CASE WHEN tyre_age_laps >= 3 THEN tyre_age_laps END AS age FROM o_bins) b WHERE age IS NOT NULL GROUP BY {CURVE}) f""")


@query("A6_wear_rate", f"SELECT {COEF} FROM o_c_wear")
def _(x):
    return coef(cal.wear_rates(x.snap))


@query("A7_fuel_effect", f"SELECT {COEF} FROM o_c_fuel")
def _(x):
    return coef(cal.fuel_effects(x.snap))


@query("A8_age_residual_bins", f"""
SELECT {CURVE}, tyre_age_laps, round(offset_ms, 4) AS offset_ms, round(stddev_ms, 4) AS stddev_ms, sample_count FROM o_bins""")
def _(x):
    bins = cal.age_bins(x.snap, cal.baselines(x.snap))
    return bins.withColumn("offset_ms", F.round("offset_ms", 4)).withColumn("stddev_ms", F.round("stddev_ms", 4))


@query("A9_gap_interpolation", f"""
SELECT {CURVE}, tyre_age_laps, round(offset_ms, 4) AS offset_ms, is_extrapolation FROM (
  SELECT {CURVE}, tyre_age_laps, offset_ms, 0 AS is_extrapolation FROM o_bins
  UNION ALL
  SELECT {CURVE}, age, o0 + (age - a0) / cast(a1 - a0 AS double) * (o1 - o0), 1 FROM (
    SELECT *, unnest(generate_series(a0 + 1, a1 - 1)) AS age FROM (
      SELECT {CURVE}, tyre_age_laps AS a0, offset_ms AS o0, lead(tyre_age_laps) OVER w AS a1, lead(offset_ms) OVER w AS o1
      FROM o_bins WINDOW w AS (PARTITION BY {CURVE} ORDER BY tyre_age_laps)) g) e) u""")
def _(x):
    bins = cal.age_bins(x.snap, cal.baselines(x.snap))
    every = bins.withColumn("is_extrapolation", F.lit(0)).unionByName(cal.fill_age_gaps(bins))
    return every.select(*cal.AGE_CURVE, "tyre_age_laps", F.round("offset_ms", 4).alias("offset_ms"), "is_extrapolation")


@query("A10_tail_slope", f"SELECT {COEF} FROM o_c_tail")
def _(x):
    return coef(cal.tail_slopes(cal.age_bins(x.snap, cal.baselines(x.snap))))


shared("o_pit_walk", f"""
SELECT s.session_uid, s.car_index, s.track_id, s.ai_controlled, s.pit_status, m.median_ms, s.sector_time_ms - m.median_ms AS excess,
  row_number() OVER (PARTITION BY s.session_uid, s.car_index ORDER BY s.lap_number, s.sector_number) AS rn
FROM snap s LEFT JOIN o_medians m USING (track_id, sector_number, ai_controlled) WHERE {PIT} AND {PITTED}""")
# Independent walk: each entry looks ahead with leads; an entry inside an earlier stop is skipped by recursion.
shared("o_pit_stops", """
WITH RECURSIVE look AS (
  SELECT *, CASE WHEN x1 > 0.3 * m1 THEN CASE WHEN x2 > 0.3 * m2 THEN CASE WHEN x3 > 0.3 * m3 THEN 4 ELSE 3 END ELSE 2 END ELSE 1 END AS len
  FROM (SELECT *, lead(excess, 1) OVER w AS x1, lead(excess, 2) OVER w AS x2, lead(excess, 3) OVER w AS x3,
      lead(median_ms, 1) OVER w AS m1, lead(median_ms, 2) OVER w AS m2, lead(median_ms, 3) OVER w AS m3
    FROM o_pit_walk WINDOW w AS (PARTITION BY session_uid, car_index ORDER BY rn)) l),
stops AS (
  SELECT session_uid, car_index, min(rn) AS rn FROM look WHERE pit_status = 1 GROUP BY session_uid, car_index
  UNION ALL
  SELECT s.session_uid, s.car_index, (SELECT min(n.rn) FROM look n WHERE n.session_uid = s.session_uid AND n.car_index = s.car_index
      AND n.pit_status = 1 AND n.rn >= s.rn + k.len)
  FROM stops s JOIN look k ON k.session_uid = s.session_uid AND k.car_index = s.car_index AND k.rn = s.rn)
SELECT k.track_id, k.session_uid, k.car_index, CASE WHEN k.ai_controlled = 1 THEN 'AI' ELSE 'PLAYER' END AS regime,
  k.excess + CASE WHEN len > 1 THEN x1 ELSE 0 END + CASE WHEN len > 2 THEN x2 ELSE 0 END + CASE WHEN len > 3 THEN x3 ELSE 0 END AS loss_ms
FROM stops s JOIN look k ON k.session_uid = s.session_uid AND k.car_index = s.car_index AND k.rn = s.rn""")


@query("A11_pit_losses", "SELECT track_id, session_uid, car_index, regime, loss_ms FROM o_pit_stops WHERE loss_ms > 0")
def _(x):
    return cal.pit_losses(x.snap, cal.sector_medians(x.snap)).drop("stop")


shared("o_c_pit", """
SELECT track_id, 'pit_stop_time_loss' AS knob_name, regime, cast(NULL AS bigint) AS sector_number, avg(loss_ms) AS value, count(*) AS sample_count,
  cast(NULL AS double) AS r_squared, cast(NULL AS double) AS slope_std_error, 0 AS clamped
FROM o_pit_stops WHERE loss_ms > 0 GROUP BY track_id, regime HAVING count(*) >= 3""")


@query("A12_pit_loss_knob", f"SELECT {COEF} FROM o_c_pit")
def _(x):
    return coef(cal.pit_loss_knob(cal.pit_losses(x.snap, cal.sector_medians(x.snap))))


shared("o_r2", """
SELECT track_id, regime, knob_name, sector_number, slope, r2, n FROM o_deg_raw
UNION ALL SELECT track_id, regime, 'fuel_effect', sector_number, slope, r2, n FROM o_fuel
UNION ALL SELECT track_id, regime, knob_name, NULL, slope, r2, n FROM o_wear""")


@query("A13_r2_by_knob", """
SELECT track_id, regime, knob_name, sector_number, round(slope, 4) AS slope, round(r2, 4) AS r_squared, n FROM o_r2""")
def _(x):
    return cal.r2_by_knob(x.snap).withColumn("slope", F.round("slope", 4)).withColumn("r_squared", F.round("r_squared", 4))


@query("A13_r2_summary", """
SELECT track_id, regime, round(sum(r2 * n) / sum(n), 4) AS weighted_r2, cast(sum(n) AS bigint) AS n FROM o_r2
WHERE knob_name LIKE 'tyre_deg_%' OR knob_name = 'fuel_effect' GROUP BY track_id, regime""")
def _(x):
    return cal.r2_summary(cal.r2_by_knob(x.snap)).withColumn("weighted_r2", F.round("weighted_r2", 4))


@query("J7_exact_baseline_residuals", """
SELECT session_uid, car_index, lap_number, sector_number, track_id, regime, compound, tyre_age_laps, residual_ms FROM o_resid""")
def _(x):
    return cal.residuals(x.snap, cal.baselines(x.snap)).select(
        *cal.SNAP_KEY, "track_id", "regime", "compound", "tyre_age_laps", "residual_ms"
    )


@query("K4_flag_outliers", f"""
SELECT s.session_uid, s.car_index, s.lap_number, s.sector_number, CASE WHEN o.session_uid IS NULL THEN 0 ELSE 1 END AS outlier
FROM snap s LEFT JOIN o_outliers o USING ({KEY})""")
def _(x):
    return cal.flag_outliers(x.snap).select(*cal.SNAP_KEY, "outlier")

"""Coefficient views, lookups, readiness and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from apexframe import dims
from apexframe.operators import calibration as cal
from apexframe.operators import coefficients as co
from apexframe.operators import dashboards as dash
from apexframe.operators import readiness as rd
from apexframe.plans.calibration import BK, DMG1, HIST, KEY, QUALITY, REGIME  # noqa: F401
from apexframe.plans.registry import query, shared

c = F.col
TRACKS = "CASE track_id " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in dims.TRACK_NAMES.items()) + " ELSE concat('Track ', track_id) END"
TYPES = "CASE session_type " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in dims.SESSION_TYPE_NAMES.items()) + " ELSE concat('Type ', session_type) END"
NAMES = "CASE compound WHEN 16 THEN 'Soft' WHEN 17 THEN 'Medium' WHEN 18 THEN 'Hard' WHEN 7 THEN 'Intermediate' WHEN 8 THEN 'Wet' ELSE concat('C', compound) END"
COMP = "CASE regexp_extract(knob_name, '_([a-z]+)$', 1) WHEN 'soft' THEN 16 WHEN 'medium' THEN 17 WHEN 'hard' THEN 18 END"

shared("o_latest", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, knob_name, calibration_regime, sector_number
  ORDER BY trained_at DESC, coefficient_id DESC) AS rn FROM coeffs WHERE is_default = 0) l WHERE rn = 1""")
shared("o_effective", """
SELECT track_id, knob_name, calibration_regime, coalesce(sector_number, -1) AS sector, value, is_default FROM (
  SELECT *, row_number() OVER (PARTITION BY track_id, knob_name, calibration_regime, coalesce(sector_number, -1)
    ORDER BY is_default, trained_at DESC, coefficient_id DESC) AS rn FROM coeffs) l WHERE rn = 1""")
DEFAULTS = ", ".join(f"('{k}', '{r}', {v})" for k, v in dims.KNOB_DEFAULTS.items() for r in dims.REGIMES)
shared("o_slots", f"""
SELECT track_id, k.* FROM (SELECT DISTINCT track_id FROM sessions) t
CROSS JOIN (VALUES {DEFAULTS}) k(knob_name, calibration_regime, default_value)""")


@query("W1_latest_fitted", "SELECT track_id, knob_name, calibration_regime, sector_number, coefficient_id, value, sample_count, r_squared, clamped FROM o_latest")
def _(x):
    return co.latest_fitted(x.coeffs).drop("trained_at")


@query("W2_effective_coefficients", """
SELECT track_id, knob_name, calibration_regime, sector, cast(coalesce(e.value, s.default_value) AS double) AS value
FROM o_effective e FULL OUTER JOIN (SELECT *, -1 AS sector FROM o_slots) s USING (track_id, knob_name, calibration_regime, sector)""")
def _(x):
    return co.with_defaults(co.effective(x.coeffs), x.sessions)


shared("o_wanted", """
SELECT DISTINCT s.track_id, k.knob_name, s.regime AS calibration_regime, s.sector_number AS sector
FROM (SELECT DISTINCT track_id, sector_number, CASE WHEN ai_controlled = 1 THEN 'AI' ELSE 'PLAYER' END AS regime FROM snap) s
CROSS JOIN (VALUES ('tyre_deg_soft'), ('fuel_effect'), ('pit_stop_time_loss'), ('tyre_wear_rate_hard')) k(knob_name)""")


@query("J14_knob_fallback", """
SELECT w.track_id, w.knob_name, w.calibration_regime, cast(w.sector AS bigint) AS sector, cast(coalesce(a.value, b.value, d.value, e.value, 0) AS double) AS value
FROM o_wanted w
LEFT JOIN o_effective a ON a.track_id = w.track_id AND a.knob_name = w.knob_name AND a.calibration_regime = w.calibration_regime AND a.sector = w.sector
LEFT JOIN o_effective b ON b.track_id = w.track_id AND b.knob_name = w.knob_name AND b.calibration_regime = w.calibration_regime AND b.sector = -1
LEFT JOIN o_effective d ON d.track_id = w.track_id AND d.knob_name = w.knob_name AND d.calibration_regime = 'AI' AND d.sector = w.sector
LEFT JOIN o_effective e ON e.track_id = w.track_id AND e.knob_name = w.knob_name AND e.calibration_regime = 'AI' AND e.sector = -1""")
def _(x):
    from apexframe.functions import rows

    knobs = F.array(*[F.lit(k) for k in ("tyre_deg_soft", "fuel_effect", "pit_stop_time_loss", "tyre_wear_rate_hard")])
    wanted = x.snap.select("track_id", c("sector_number").cast("bigint").alias("sector"), rows.regime().alias("calibration_regime")).distinct()
    wanted = wanted.withColumn("knob_name", F.explode(knobs))
    return co.resolve_knob(wanted, co.effective(x.coeffs))


@query("J15_pit_loss_borrow", """
SELECT track_id, cast(CASE WHEN coalesce(pd, 1) = 1 AND coalesce(ad, 1) = 0 THEN av ELSE coalesce(pv, 22000) END AS double) AS player_ms,
  cast(coalesce(av, 22000) AS double) AS ai_ms
FROM (SELECT track_id, max(value) FILTER (WHERE calibration_regime = 'PLAYER') AS pv, max(is_default) FILTER (WHERE calibration_regime = 'PLAYER') AS pd,
    max(value) FILTER (WHERE calibration_regime = 'AI') AS av, max(is_default) FILTER (WHERE calibration_regime = 'AI') AS ad
  FROM o_effective WHERE knob_name = 'pit_stop_time_loss' AND sector = -1 GROUP BY track_id) p""")
def _(x):
    return co.pit_loss_by_regime(co.effective(x.coeffs))


@query("K6_cold_start_defaults", """
SELECT s.track_id, s.knob_name, s.calibration_regime, cast(s.default_value AS double) AS default_value,
  CASE WHEN h.value IS NULL THEN 'insert' ELSE 'refresh' END AS action
FROM o_slots s LEFT JOIN (
  SELECT track_id, knob_name, calibration_regime, arg_max(value, coefficient_id) AS value FROM (
    SELECT *, rank() OVER (PARTITION BY track_id, knob_name, calibration_regime ORDER BY trained_at DESC) AS r
    FROM coeffs WHERE is_default = 1 AND sector_number IS NULL) d WHERE r = 1 GROUP BY ALL) h
  USING (track_id, knob_name, calibration_regime)
WHERE h.value IS NULL OR abs(h.value - s.default_value) > 1e-9""")
def _(x):
    return co.refresh_defaults(x.coeffs, x.sessions)


shared("o_requests", f"""
SELECT session_uid, car_index, lap_number, sector_number, track_id, tyre_compound_visual AS compound, {REGIME} AS regime,
  fuel_in_tank_kg AS fuel_kg, weather, track_temp FROM snap""")


def requests(x):
    from apexframe.functions import rows

    return x.snap.select(
        *cal.SNAP_KEY, "track_id", c("tyre_compound_visual").alias("compound"), rows.regime().alias("regime"),
        c("fuel_in_tank_kg").alias("fuel_kg"), "weather", "track_temp",
    )


@query("J6_nearest_baseline", f"""
SELECT {KEY}, coalesce(mean_sector_ms, 0) AS baseline_ms, coalesce(perfect_sector_ms, 0) AS perfect_ms FROM (
  SELECT r.*, b.mean_sector_ms, b.perfect_sector_ms, row_number() OVER (PARTITION BY {', '.join('r.' + k.strip() for k in KEY.split(','))}
    ORDER BY abs(b.fuel_bucket_kg - floor(r.fuel_kg / 20.0 + 0.5) * 20) NULLS FIRST, CASE WHEN b.weather = r.weather THEN 0 ELSE 1 END,
      abs(b.track_temp_bucket_c - floor(r.track_temp / 10.0 + 0.5) * 10), b.fuel_bucket_kg, b.weather, b.track_temp_bucket_c) AS rn
  FROM o_requests r LEFT JOIN o_baselines b ON b.track_id = r.track_id AND b.sector_number = r.sector_number
    AND b.compound = r.compound AND b.regime = r.regime) n WHERE rn = 1""")
def _(x):
    near = co.nearest_baseline(requests(x), cal.baselines(x.snap))
    return near.select(*cal.SNAP_KEY, "baseline_ms", "perfect_ms")


@query("W3_recent_times", f"""
SELECT track_id, car_index, tyre_compound_visual, sector_number, list(sector_time_ms ORDER BY rn) AS recent_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY track_id, car_index, tyre_compound_visual, sector_number
    ORDER BY created_at DESC, session_uid DESC, lap_number DESC) AS rn FROM snap WHERE {HIST}) r WHERE rn <= 3 GROUP BY ALL""")
def _(x):
    return co.recent_times(x.snap)


@query("A36_laps_recorded", """
SELECT track_id, car_index, count(*) AS laps FROM snap
WHERE sector_number = 0 AND outlier = 0 AND lap_invalid = 0 AND pit_status = 0 GROUP BY 1, 2""")
def _(x):
    return co.laps_recorded(x.snap)


@query("R17_data_gate", f"""
SELECT q.*, coalesce(l.laps, 0) AS laps, coalesce(l.laps, 0) >= 2 OR b.compound IS NOT NULL AS ready
FROM (SELECT DISTINCT track_id, car_index, tyre_compound_visual AS compound, {REGIME} AS regime FROM snap) q
LEFT JOIN (SELECT track_id, car_index, count(*) AS laps FROM snap
  WHERE sector_number = 0 AND outlier = 0 AND lap_invalid = 0 AND pit_status = 0 GROUP BY 1, 2) l USING (track_id, car_index)
LEFT JOIN (SELECT DISTINCT track_id, compound, regime FROM o_baselines) b
  ON b.track_id = q.track_id AND b.compound = q.compound AND b.regime = q.regime""")
def _(x):
    asked = requests(x).select("track_id", "car_index", "compound", "regime").distinct()
    return co.data_gate(co.laps_recorded(x.snap), cal.baselines(x.snap), asked).withColumn("laps", F.coalesce("laps", F.lit(0)))


COVER = f"""SELECT track_id, tyre_compound_visual AS compound, {REGIME} AS regime, sector_number, count(*) AS n FROM snap
WHERE outlier = 0 AND lap_invalid = 0 AND pit_status = 0 AND tyre_compound_visual IN (7,8,16,17,18) AND sector_number IN (0,1,2) GROUP BY ALL"""


@query("A14_coverage", COVER)
def _(x):
    return rd.coverage(x.snap)


LEVEL = "CASE WHEN s{i} >= 10 THEN 'ok' WHEN s{i} >= 5 THEN 'thin' ELSE 'low' END AS level{i}"


@query("A15_coverage_matrix", f"""
SELECT *, {', '.join(LEVEL.format(i=i) for i in range(3))} FROM (SELECT track_id, compound, regime,
  {', '.join(f'cast(coalesce(sum(n) FILTER (WHERE sector_number = {i}), 0) AS bigint) AS s{i}' for i in range(3))} FROM ({COVER}) v GROUP BY ALL) m""")
def _(x):
    return rd.coverage_matrix(rd.coverage(x.snap))


shared("o_quality", f"SELECT track_id, tyre_compound_visual AS compound, sector_number, {QUALITY} AS reason FROM snap WHERE ai_controlled = 0 AND tyre_compound_visual IN (7,8,16,17,18)")
shared("o_tallies", f"""
SELECT s.track_id, s.compound, cast(s.sector_number AS bigint) AS sector_number, count(q.reason) AS total, count(*) FILTER (WHERE reason = 'GOOD') AS good,
  {', '.join(f"count(*) FILTER (WHERE reason = '{r}') AS {r.lower()}" for r in rd.REASONS)}
FROM (SELECT track_id, compound, sector_number FROM (
    SELECT DISTINCT track_id, unnest([16, 17, 18]) AS compound FROM snap
    UNION SELECT DISTINCT track_id, compound FROM o_quality WHERE compound IN (7, 8)) d, (VALUES (0), (1), (2)) v(sector_number)) s
LEFT JOIN o_quality q ON q.track_id = s.track_id AND q.compound = s.compound AND q.sector_number = s.sector_number GROUP BY ALL""")
CONF = "(0.5 * least(good / 3.0, 1) + 0.5 * least(good / 10.0, 1))"
shared("o_compounds", f"""
SELECT track_id, compound, cast(sum(total) AS bigint) AS total, cast(sum(good) AS bigint) AS good,
  {', '.join(f'cast(sum({r.lower()}) AS bigint) AS {r.lower()}' for r in rd.REASONS)}, round(cast(sum({CONF}) / 3 AS double), 6) AS confidence
FROM o_tallies GROUP BY ALL""")


@query("A16_readiness_tallies", "SELECT * FROM o_tallies")
def _(x):
    return rd.sector_tallies(x.snap)


@query("A17_readiness_confidence", """
SELECT c.track_id, c.compound, c.total, c.good, c.confidence, round(coalesce(o.overall, 0), 6) AS overall FROM o_compounds c
LEFT JOIN (SELECT track_id, avg(confidence) AS overall FROM o_compounds WHERE total > 0 GROUP BY track_id) o USING (track_id)""")
def _(x):
    comp = rd.compound_readiness(rd.sector_tallies(x.snap)).withColumn("confidence", F.round("confidence", 6))
    both = comp.join(rd.overall_confidence(comp), "track_id")
    return both.select("track_id", "compound", "total", "good", "confidence", F.round("overall", 6).alias("overall"))


shared("o_diag", f"""
SELECT track_id, {COMP} AS compound, cast(sum(coalesce(sample_count, 0)) AS bigint) AS samples, max(clamped) = 1 AS clamped,
  max(clamped) = 1 OR coalesce(min(r_squared) < 0.3, false) AS low_confidence
FROM o_latest WHERE calibration_regime = 'PLAYER' AND knob_name LIKE 'tyre_deg_%' GROUP BY 1, 2""")


@query("A18_degradation_diagnostics", "SELECT * FROM o_diag")
def _(x):
    return rd.deg_diagnostics(x.coeffs)


@query("A19_regime_degradation", f"""
SELECT track_id, {COMP} AS compound, calibration_regime AS regime, round(avg(value), 6) AS slope, cast(sum(sample_count) AS bigint) AS samples
FROM o_latest WHERE knob_name LIKE 'tyre_deg_%' GROUP BY 1, 2, 3""")
def _(x):
    return rd.regime_degradation(x.coeffs).withColumn("slope", F.round("slope", 6))


shared("o_newest", "SELECT track_id, arg_max(session_uid, created_at::varchar || lpad(session_uid::varchar, 12, '0')) AS newest FROM sessions GROUP BY track_id")
shared("o_scatter", """
SELECT s.track_id, session_uid, lap_number, sector_number, tyre_compound_visual AS compound, tyre_age_laps AS age, sector_time_ms,
  lap_invalid = 0 AND outlier = 0 AND pit_status = 0 AND safety_car_status = 0 AS used, session_uid = newest AS current
FROM snap s LEFT JOIN o_newest n ON n.track_id = s.track_id
WHERE ai_controlled = 0 AND tyre_compound_visual IN (16,17,18) AND sector_time_ms > 0""")


@query("A20_scatter_points", "SELECT * FROM o_scatter")
def _(x):
    return rd.scatter(x.snap, x.sessions)


@query("A20_scatter_lines", """
SELECT track_id, sector_number, compound, CASE WHEN n >= 2 AND sxx > 0 THEN round(slope, 4) END AS slope,
  CASE WHEN n >= 2 AND sxx > 0 THEN round(icpt, 3) END AS intercept, CASE WHEN n >= 2 AND sxx > 0 THEN n END AS n FROM (
  SELECT track_id, sector_number, compound, count(*) FILTER (WHERE used) AS n, regr_sxx(sector_time_ms, age) FILTER (WHERE used) AS sxx,
    regr_slope(sector_time_ms, age) FILTER (WHERE used) AS slope, regr_intercept(sector_time_ms, age) FILTER (WHERE used) AS icpt
  FROM o_scatter GROUP BY ALL) f""")
def _(x):
    lines = rd.scatter_lines(rd.scatter(x.snap, x.sessions))
    return lines.withColumn("slope", F.round("slope", 4)).withColumn("intercept", F.round("intercept", 3))


@query("A21_wear_scatter", """
SELECT track_id, session_uid, lap_number, tyre_compound_visual AS compound, tyre_age_laps AS age,
  greatest(coalesce(tyre_wear_fl, 0), coalesce(tyre_wear_fr, 0), coalesce(tyre_wear_rl, 0), coalesce(tyre_wear_rr, 0)) AS wear
FROM snap WHERE ai_controlled = 0 AND outlier = 0 AND lap_invalid = 0 AND pit_status = 0 AND sector_number = 2
  AND tyre_compound_visual IN (16,17,18)""")
def _(x):
    return rd.wear_points(x.snap)


shared("o_times", """
SELECT track_id, session_uid, lap_number, sector_number, tyre_compound_visual AS compound, sector_time_ms, outlier = 1 AS outlier
FROM snap WHERE ai_controlled = 0 AND lap_invalid = 0 AND pit_status = 0 AND sector_time_ms > 0 AND tyre_compound_visual IN (16,17,18)""")


@query("A22_sector_times", "SELECT * FROM o_times")
def _(x):
    return rd.sector_times(x.snap)


@query("A22_sector_histogram", f"""
SELECT track_id, sector_number, least(23, cast(floor((sector_time_ms - lo) / CASE WHEN hi > lo THEN (hi - lo) / 24.0 ELSE 1 END) AS bigint)) AS bin,
  CASE WHEN outlier THEN 'outlier' ELSE {NAMES} END AS series, count(*) AS n
FROM (SELECT *, min(sector_time_ms) OVER w AS lo, max(sector_time_ms) OVER w AS hi FROM o_times WINDOW w AS (PARTITION BY track_id, sector_number)) t
GROUP BY ALL""")
def _(x):
    series = F.when(c("outlier"), "outlier").otherwise(dims.compound_name(c("compound")))
    return rd.histogram(rd.sector_times(x.snap), ["track_id", "sector_number"], "sector_time_ms", series, 24)


@query("A23_pit_loss_histogram", """
SELECT track_id, least(15, cast(floor((ms - lo) / CASE WHEN hi > lo THEN (hi - lo) / 16.0 ELSE 1 END) AS bigint)) AS bin, regime AS series, count(*) AS n
FROM (SELECT *, min(ms) OVER w AS lo, max(ms) OVER w AS hi FROM (SELECT track_id, regime, floor(loss_ms + 0.5) AS ms FROM o_pit_stops WHERE loss_ms > 0) p
  WINDOW w AS (PARTITION BY track_id)) t GROUP BY ALL""")
def _(x):
    losses = cal.pit_losses(x.snap, cal.sector_medians(x.snap)).withColumn("ms", F.floor(c("loss_ms") + 0.5))
    return rd.histogram(losses, ["track_id"], "ms", c("regime"), 16)


shared("o_state", f"""
SELECT k.*, coalesce(b.baseline, []) AS baseline FROM (SELECT track_id,
  coalesce(list(DISTINCT {COMP} ORDER BY {COMP}) FILTER (WHERE is_default = 0 AND calibration_regime = 'PLAYER' AND knob_name LIKE 'tyre_wear_rate_%'), []) AS wear,
  coalesce(list(DISTINCT {COMP} ORDER BY {COMP}) FILTER (WHERE is_default = 0 AND calibration_regime = 'PLAYER' AND knob_name LIKE 'tyre_deg_%'), []) AS deg,
  count(*) FILTER (WHERE knob_name = 'fuel_effect' AND is_default = 0 AND calibration_regime = 'PLAYER') > 0 AS fuel_fitted,
  strftime(max(trained_at) FILTER (WHERE is_default = 0), '%Y-%m-%dT%H:%M:%S') AS last_ran FROM coeffs GROUP BY track_id) k
LEFT JOIN (SELECT track_id, list(DISTINCT compound ORDER BY compound) AS baseline FROM o_baselines WHERE regime = 'PLAYER' GROUP BY track_id) b USING (track_id)""")


@query("A24_fitted_state", "SELECT * FROM o_state")
def _(x):
    return rd.fitted_state(x.coeffs, cal.baselines(x.snap))


@query("A25_readiness_summary", f"""
SELECT c.track_id, {TRACKS.replace('track_id', 'c.track_id')} AS track_name, round(coalesce(any_value(o.overall), 0), 6) AS overall,
  any_value(s.fuel_fitted) AS fuel_fitted, any_value(s.last_ran) AS last_ran,
  string_agg(concat_ws('/', c.compound, {NAMES.replace('compound', 'c.compound')}, c.total, c.good, printf('%.4f', c.confidence),
    list_contains(s.wear, c.compound)::int, list_contains(s.baseline, c.compound)::int, list_contains(s.deg, c.compound)::int,
    coalesce(d.samples, 0), coalesce(d.clamped, false)::int, coalesce(d.low_confidence, false)::int), ';' ORDER BY c.compound) AS compounds
FROM o_compounds c LEFT JOIN o_state s USING (track_id) LEFT JOIN o_diag d ON d.track_id = c.track_id AND d.compound = c.compound
LEFT JOIN (SELECT track_id, avg(confidence) AS overall FROM o_compounds WHERE total > 0 GROUP BY track_id) o ON o.track_id = c.track_id
GROUP BY c.track_id""")
def _(x):
    docs = rd.summary(x.snap, x.coeffs, cal.baselines(x.snap))
    flat = F.transform(
        "compounds",
        lambda e: F.concat_ws(
            "/", e["compound"], e["name"], e["total"], e["good"], F.format_string("%.4f", e["confidence"]),
            *[e[f].cast("int") for f in ("wear_fitted", "baseline_fitted", "deg_fitted")], e["deg_samples"],
            e["deg_clamped"].cast("int"), e["deg_low_confidence"].cast("int"),
        ),
    )
    return docs.select(
        "track_id", "track_name", F.round("overall", 6).alias("overall"), "fuel_fitted", "last_ran",
        F.array_join(flat, ";").alias("compounds"),
    )


@query("J3_tracks_with_data", f"""
SELECT track_id, {TRACKS} AS track_name, strftime(max(created_at), '%Y-%m-%dT%H:%M:%S') AS last_at FROM sessions s
WHERE EXISTS (SELECT 1 FROM snap n WHERE n.session_uid = s.session_uid) GROUP BY track_id""")
def _(x):
    return rd.tracks_with_data(x.sessions, x.snap)


@query("J16_dimension_names", f"""
SELECT session_uid, {TRACKS} AS track_name, {TYPES} AS type_name FROM (SELECT session_uid, track_id * 17 AS track_id, session_type + session_uid % 5 AS session_type FROM sessions) s""")
def _(x):
    s = x.sessions.select("session_uid", (c("track_id") * 17).alias("track_id"), (c("session_type") + c("session_uid") % 5).alias("session_type"))
    return s.select("session_uid", dims.track_name(c("track_id")).alias("track_name"), dims.session_type_name(c("session_type")).alias("type_name"))


@query("T1_newest_session", """
SELECT track_id, newest AS session_uid, newest = (SELECT session_uid FROM sessions ORDER BY created_at DESC, session_uid DESC LIMIT 1) AS default_track FROM o_newest""")
def _(x):
    top = rd.newest_session(x.sessions, []).scalar()
    per = rd.newest_session(x.sessions, ["track_id"])
    return per.select("track_id", "session_uid", (c("session_uid") == top).alias("default_track"))


AS_OF = "(SELECT max({at})::date FROM {t})"


def as_of(df, at):
    """The newest day in the data stands in for today."""
    return df.agg(F.to_date(F.max(at)).alias("_today"))


def days(df, at):
    return dash.per_day(df, at, as_of(df, at).scalar())


@query("A26_run_stats", """
SELECT count(*) AS total, round(coalesce(avg(duration_ms) FILTER (WHERE status = 'completed'), 0), 4) AS avg_duration_ms,
  round(coalesce(avg(iterations) FILTER (WHERE status = 'completed'), 0), 4) AS avg_iterations FROM sim_runs""")
def _(x):
    s = dash.run_stats(x.sim_runs)
    return s.select("total", F.round("avg_duration_ms", 4).alias("avg_duration_ms"), F.round("avg_iterations", 4).alias("avg_iterations"))


@query("A26_runs_per_day", """
SELECT strftime(started_at, '%Y-%m-%d') AS day, count(*) AS n FROM sim_runs
WHERE started_at::date >= (SELECT max(started_at)::date FROM sim_runs) - 30 GROUP BY 1""")
def _(x):
    return days(x.sim_runs, "started_at")


@query("A26_runs_by_status", "SELECT status, count(*) AS n FROM sim_runs GROUP BY 1")
def _(x):
    return x.sim_runs.groupBy("status").agg(F.count("*").alias("n"))


@query("A27_radio_split", """
SELECT count(*) AS total, count(*) FILTER (WHERE nullif(rendered_text, '') <> message_text) AS rendered,
  count(*) FILTER (WHERE nullif(rendered_text, '') IS NULL OR rendered_text = message_text) AS fallback FROM radio""")
def _(x):
    return dash.radio_split(x.radio)


@query("A27_radio_by_priority", "SELECT priority, count(*) AS n FROM radio GROUP BY 1")
def _(x):
    return x.radio.groupBy("priority").agg(F.count("*").alias("n"))


@query("A27_radio_per_day", """
SELECT strftime(sent_day, '%Y-%m-%d') AS day, count(*) AS n FROM radio WHERE sent_day::date >= (SELECT max(sent_day)::date FROM radio) - 30 GROUP BY 1""")
def _(x):
    return days(x.radio, "sent_day")


@query("A28_rolling_accuracy", """
SELECT round(avg(abs_error), 6) AS mean_abs_error, (SELECT count(*) FROM accuracy) AS races
FROM (SELECT abs_error FROM accuracy ORDER BY evaluated_seq DESC LIMIT 20) t""")
def _(x):
    return dash.rolling_accuracy(x.accuracy).withColumn("mean_abs_error", F.round("mean_abs_error", 6))


@query("A28_today_counts", """
SELECT (SELECT count(*) FROM sim_runs WHERE started_at::date = (SELECT max(started_at)::date FROM sim_runs)) AS simulations,
  (SELECT count(*) FROM radio WHERE sent_day::date = (SELECT max(sent_day)::date FROM radio)) AS messages""")
def _(x):
    def today(df, at, name):
        per = df.groupBy(F.to_date(at).alias("d")).agg(F.count("*").alias("n"))
        return per.agg(F.max_by("n", "d").alias(name))

    messages = today(x.radio, "sent_day", "messages").scalar()
    return today(x.sim_runs, "started_at", "simulations").withColumn("messages", messages)


@query("A29_calibration_stats", "SELECT count(*) AS rows_, count(DISTINCT trained_at) AS runs FROM coeffs")
def _(x):
    return x.coeffs.agg(F.count("*").alias("rows_"), F.countDistinct("trained_at").alias("runs"))


@query("A29_calibration_per_day", """
SELECT strftime(trained_at, '%Y-%m-%d') AS day, count(*) AS n FROM coeffs
WHERE trained_at::date >= (SELECT max(trained_at)::date FROM coeffs) - 30 GROUP BY 1""")
def _(x):
    return days(x.coeffs, "trained_at")


shared("o_predictions", """
SELECT r.session_uid, i.player_car_index, i.player_mean_position AS predicted_position, r.lap_number AS predicted_at_lap, r.job_id, r.sent_seq
FROM radio r JOIN sim_io i ON i.job_id = r.job_id WHERE i.player_mean_position IS NOT NULL""")
shared("o_accuracy_eval", """
SELECT p.session_uid, p.player_car_index, p.predicted_position, p.predicted_at_lap, p.job_id, f.position AS actual_position,
  round(abs(p.predicted_position - f.position), 6) AS abs_error, abs(p.predicted_position - f.position) > 5 AS large_error
FROM (SELECT *, row_number() OVER (PARTITION BY session_uid ORDER BY sent_seq DESC, job_id DESC) AS rn FROM o_predictions) p
JOIN final_class f ON f.session_uid = p.session_uid AND f.car_index = p.player_car_index WHERE rn = 1""")


@query("A30_accuracy_evaluation", "SELECT * FROM o_accuracy_eval")
def _(x):
    out = dash.evaluate_accuracy(x.radio, x.sim_io, x.final_class)
    return out.withColumn("abs_error", F.round("abs_error", 6))


@query("J9_predictions_with_result", """
SELECT p.session_uid, p.job_id, p.predicted_position, f.position AS actual_position FROM o_predictions p
JOIN final_class f ON f.session_uid = p.session_uid AND f.car_index = p.player_car_index""")
def _(x):
    io = x.sim_io.where(c("player_mean_position").isNotNull()).drop("session_uid")
    final = x.final_class.select("session_uid", c("car_index").alias("player_car_index"), c("position").alias("actual_position"))
    return x.radio.join(io, "job_id").join(final, ["session_uid", "player_car_index"]).select(
        "session_uid", "job_id", c("player_mean_position").alias("predicted_position"), "actual_position"
    )


TOP50 = """SELECT accuracy_id, predicted_position, actual_position, round(abs_error, 6) AS abs_error FROM accuracy
WHERE predicted_position IS NOT NULL AND actual_position IS NOT NULL ORDER BY evaluated_seq DESC LIMIT 50"""


@query("A31_accuracy_listing", TOP50)
def _(x):
    known = x.accuracy.where(c("predicted_position").isNotNull() & c("actual_position").isNotNull())
    top = known.orderBy(F.desc("evaluated_seq")).limit(50)
    return top.select("accuracy_id", "predicted_position", "actual_position", F.round("abs_error", 6).alias("abs_error"))


@query("T2_newest_twenty", "SELECT accuracy_id, round(abs_error, 6) AS abs_error FROM accuracy ORDER BY evaluated_seq DESC LIMIT 20")
def _(x):
    return x.accuracy.orderBy(F.desc("evaluated_seq")).limit(20).select("accuracy_id", F.round("abs_error", 6).alias("abs_error"))


@query("A35_driver_names", """
SELECT session_uid, max(driver_name) AS driver_name FROM participants WHERE ai_controlled = 0 AND trim(driver_name) <> '' GROUP BY 1""")
def _(x):
    return dash.driver_names(x.participants)


@query("S6_snapshots_by_regime", f"""
SELECT s.session_uid, s.car_index, s.lap_number, s.sector_number, s.sector_time_ms, p.ai_controlled FROM snap s
JOIN participants p ON p.session_uid = s.session_uid AND p.car_index = s.car_index WHERE p.ai_controlled = 0""")
def _(x):
    who = x.participants.where(c("ai_controlled") == 0).select("session_uid", "car_index", "ai_controlled")
    return x.snap.drop("ai_controlled").join(who, ["session_uid", "car_index"]).select(
        *cal.SNAP_KEY, "sector_time_ms", "ai_controlled"
    ).repartition("session_uid").sortWithinPartitions(*cal.SNAP_KEY)  # a session's rows are bounded: 768 a car


@query("S7_sessions_for_track", "SELECT session_uid, track_id, session_type FROM sessions WHERE track_id = 2 ORDER BY created_at DESC")
def _(x):
    return x.sessions.where(c("track_id") == 2).orderBy(F.desc("created_at")).select("session_uid", "track_id", "session_type")


@query("S8_final_classification", "SELECT session_uid, position, car_index, result_status FROM final_class")
def _(x):
    by_session = x.final_class.repartition("session_uid").sortWithinPartitions("session_uid", "position")
    return by_session.select("session_uid", "position", "car_index", "result_status")


@query("S9_available_sets", "SELECT session_uid, car_index, set_index, visual_compound FROM tyre_sets WHERE available = 1 AND fitted = 0")
def _(x):
    free = x.tyre_sets.where((c("available") == 1) & (c("fitted") == 0))
    return free.repartition("session_uid").sortWithinPartitions("session_uid", "car_index", "set_index").select("session_uid", "car_index", "set_index", "visual_compound")


@query("S10_sets_per_car", """
SELECT session_uid, car_index, list(set_index ORDER BY set_index) AS sets, list(visual_compound ORDER BY set_index) AS compounds,
  list(wear ORDER BY set_index) AS wear FROM tyre_sets GROUP BY 1, 2""")
def _(x):
    entry = F.array_sort(F.collect_list(F.struct("set_index", "visual_compound", "wear"))).alias("s")
    per = x.tyre_sets.groupBy("session_uid", "car_index").agg(entry)
    return per.select(
        "session_uid", "car_index", c("s.set_index").alias("sets"), c("s.visual_compound").alias("compounds"), c("s.wear").alias("wear")
    )


shared("o_events_log", "SELECT user_id AS session_uid, event_id, CASE event_type WHEN 'signup' THEN 'SEND' WHEN 'error' THEN 'PENA' WHEN 'click' THEN 'SCAR' WHEN 'view' THEN 'RTMT' ELSE 'BUTN' END AS event_code FROM events")


def event_log(x):
    code = (
        F.when(c("event_type") == "signup", "SEND").when(c("event_type") == "error", "PENA")
        .when(c("event_type") == "click", "SCAR").when(c("event_type") == "view", "RTMT").otherwise("BUTN")
    )
    return x.events.select(c("user_id").alias("session_uid"), "event_id", code.alias("event_code"))


@query("J4_open_newest_session", """
SELECT s.session_uid, s.track_id, s.session_type FROM sessions s WHERE s.created_at = (SELECT max(created_at) FROM sessions)
  AND NOT EXISTS (SELECT 1 FROM o_events_log e WHERE e.session_uid = s.session_uid + 1000000 AND e.event_code = 'SEND')""")
def _(x):
    ended = event_log(x).where(c("event_code") == "SEND").select((c("session_uid") - 1000000).alias("session_uid"))
    newest = x.sessions.agg(F.max("created_at").alias("created_at"))
    return x.sessions.join(newest, "created_at").join(ended, "session_uid", "left_anti").select("session_uid", "track_id", "session_type")


@query("R20_forwarded_events", """
SELECT session_uid, event_id, event_code FROM o_events_log WHERE event_code IN ('SCAR','RTMT','COLL','PENA','CHQF','FLBK')""")
def _(x):
    return event_log(x).where(c("event_code").isin("SCAR", "RTMT", "COLL", "PENA", "CHQF", "FLBK"))


shared("o_done", "SELECT job_id, status, duration_ms, iterations FROM sim_runs WHERE status <> 'running'")


@query("K11_run_log", """
SELECT r.job_id, r.session_uid, coalesce(d.status, 'running') AS status, d.duration_ms, d.iterations FROM sim_runs r LEFT JOIN o_done d USING (job_id)""")
def _(x):
    ends = x.sim_runs.where(c("status") != "running").withColumn("completed_seq", c("started_at"))
    return dash.run_log(x.sim_runs.select("job_id", "session_uid"), ends)

"""Race patterns and end-of-session work."""

from __future__ import annotations

from pyspark.sql import functions as F

from apexframe.operators import patterns as pa
from apexframe.plans.calibration import BK, FIT
from apexframe.plans.registry import query, shared

c = F.col


@query("O1_overtakes", """
SELECT session_uid, car_index, lap_number, sector_number, was, car_position, was - car_position AS gained FROM (
  SELECT *, lag(car_position) OVER (PARTITION BY session_uid, car_index ORDER BY lap_number, sector_number) AS was FROM snap) s WHERE car_position < was""")
def _(x):
    return pa.overtakes(x.snap)


@query("O2_incident_rates", """
SELECT s.session_uid, round(s.sc, 6) AS safety_car_share, f.race_laps, round(f.r, 6) AS retired_share
FROM (SELECT session_uid, count(*) FILTER (WHERE safety_car_status > 0) / count(*) AS sc FROM snap GROUP BY 1) s
JOIN (SELECT session_uid, max(num_laps) AS race_laps, count(*) FILTER (WHERE result_status IN (4, 7)) / count(*) AS r FROM final_class GROUP BY 1) f USING (session_uid)""")
def _(x):
    out = pa.incident_rates(x.snap, x.final_class)
    return out.withColumn("safety_car_share", F.round("safety_car_share", 6)).withColumn("retired_share", F.round("retired_share", 6))


@query("O3_air_and_drs", f"""
SELECT track_id, sector_number, round(avg(sector_time_ms) FILTER (WHERE d) - avg(sector_time_ms) FILTER (WHERE NOT d), 4) AS dirty_air_ms,
  round(avg(sector_time_ms) FILTER (WHERE drs_allowed = 1) - avg(sector_time_ms) FILTER (WHERE drs_allowed <> 1), 4) AS drs_ms, count(*) FILTER (WHERE d) AS dirty_n, count(*) FILTER (WHERE drs_allowed = 1) AS drs_n
FROM (SELECT *, gap_to_car_ahead_ms > 0 AND gap_to_car_ahead_ms < 1500 AS d FROM snap WHERE {FIT}) s GROUP BY 1, 2""")
def _(x):
    out = pa.air_effects(x.snap)
    return out.withColumn("dirty_air_ms", F.round("dirty_air_ms", 4)).withColumn("drs_ms", F.round("drs_ms", 4))


@query("O4_stints", """
SELECT session_uid, car, cast(stint AS bigint) AS stint, arg_min(tyre, tick) AS tyre, min(lap) AS from_lap, max(lap) AS to_lap FROM (
  SELECT *, sum(n) OVER (PARTITION BY session_uid, car ORDER BY tick) AS stint FROM (
    SELECT *, CASE WHEN lag(tyre) OVER w IS NULL OR lag(tyre) OVER w <> tyre OR pits > lag(pits) OVER w THEN 1 ELSE 0 END AS n FROM cars WINDOW w AS (PARTITION BY session_uid, car ORDER BY tick)) a) b GROUP BY 1, 2, 3""")
def _(x):
    return pa.stints(x.cars)


@query("O5_executed_strategy", """
SELECT session_uid, car_index, 1 AS stint, stint1 AS compound, end1 AS end_lap FROM final_class WHERE stint1 > 0
UNION ALL SELECT session_uid, car_index, 2, stint2, end2 FROM final_class WHERE stint2 > 0""")
def _(x):
    return pa.executed_strategy(x.final_class)


@query("O6_holdout", f"""
WITH m AS (SELECT * FROM (SELECT *, median(abs(sector_time_ms - med)) OVER (PARTITION BY {BK}) AS mad FROM (
    SELECT *, median(sector_time_ms) OVER (PARTITION BY {BK}) AS med, count(*) OVER (PARTITION BY {BK}) AS cnt FROM o_bucket_rows WHERE {FIT} AND session_type NOT IN (5,6,7,8,9) AND session_uid % 5 <> 0) a) b
  WHERE cnt < 3 OR mad = 0 OR abs(sector_time_ms - med) <= 2.5 * mad),
b AS (SELECT {BK}, cast(round_even(avg(sector_time_ms), 0) AS bigint) AS mean_sector_ms FROM m GROUP BY {BK} HAVING count(*) >= 3)
SELECT track_id, regime, count(*) AS n, round(avg(sector_time_ms - mean_sector_ms), 4) AS bias_ms, round(avg(abs(sector_time_ms - mean_sector_ms)), 4) AS mae_ms
FROM (SELECT * FROM o_bucket_rows WHERE {FIT} AND compound IN (16,17,18) AND session_uid % 5 = 0) r JOIN b USING ({BK}) GROUP BY track_id, regime""")
def _(x):
    out = pa.holdout(x.snap)
    return out.withColumn("bias_ms", F.round("bias_ms", 4)).withColumn("mae_ms", F.round("mae_ms", 4))


shared("o_races", "SELECT session_uid FROM sessions WHERE session_type BETWEEN 10 AND 12 OR session_type BETWEEN 15 AND 17")


@query("R19_end_of_session", """
SELECT p.session_uid, 'evaluate' AS action, round(abs(p.predicted_position - f.position), 6) AS abs_error FROM (
  SELECT *, row_number() OVER (PARTITION BY session_uid ORDER BY sent_seq DESC, job_id DESC) AS rn FROM o_predictions WHERE session_uid IN (SELECT session_uid FROM o_races)) p
JOIN final_class f ON f.session_uid = p.session_uid AND f.car_index = p.player_car_index WHERE rn = 1
UNION ALL SELECT session_uid, 'recalibrate', NULL FROM sessions WHERE session_type BETWEEN 1 AND 4""")
def _(x):
    done = pa.evaluate_races(x.sessions, x.radio, x.sim_io, x.final_class)
    again = pa.end_actions(x.sessions).where(c("action") == "recalibrate")
    return done.select("session_uid", F.lit("evaluate").alias("action"), F.round("abs_error", 6).alias("abs_error")).unionByName(
        again.select("session_uid", "action", F.lit(None).cast("double").alias("abs_error"))
    )

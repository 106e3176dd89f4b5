"""Sector transitions, rewinds, excursions, pit states and session lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from apexframe.functions import stats
from apexframe.operators import feed, motion
from apexframe.plans.registry import query, shared
from apexframe.sources import packets as pk

c = F.col
S = ["session_uid"]
W = "WINDOW w AS (PARTITION BY session_uid ORDER BY seq)"
PRIOR = "OVER (PARTITION BY session_uid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

shared("o_trans", f"""
SELECT *, CASE WHEN completed = 2 THEN prev_lap ELSE lap END AS snap_lap FROM (
  SELECT *, (prev_sector + i) % 3 AS completed FROM (
    SELECT *, unnest(generate_series(0, (sector - prev_sector + 3) % 3 - 1)) AS i FROM (
      SELECT *, lag(sector) OVER w AS prev_sector, lag(lap) OVER w AS prev_lap,
        last_value(nullif(s1_ms, 0) IGNORE NULLS) {PRIOR} AS cached_s1, last_value(nullif(s2_ms, 0) IGNORE NULLS) {PRIOR} AS cached_s2
      FROM lap_feed {W}) a WHERE prev_sector IS NOT NULL AND sector <> prev_sector) b) d""")
HS1, HS2, HS3 = "26000 + lap * 83 % 900", "28000 + lap * 61 % 900", "27500 + lap * 43 % 900"
HL = {k: v.replace("lap", "snap_lap") for k, v in {"s1": HS1, "s2": HS2, "s3": HS3}.items()}
shared("o_hist", f"""
SELECT t.*, CASE WHEN snap_lap >= 1 AND snap_lap <= h.num_laps AND snap_lap > h.num_laps - 5 AND snap_lap % 6 <> 0 THEN
  CASE completed WHEN 0 THEN {HL['s1']} WHEN 1 THEN {HL['s2']} ELSE {HL['s3']} END
  WHEN snap_lap >= 1 AND snap_lap <= h.num_laps AND snap_lap > h.num_laps - 5 THEN 0 END AS history_ms
FROM o_trans t ASOF LEFT JOIN history h ON h.session_uid = t.session_uid AND h.seq <= t.seq""")
shared("o_recover", """
SELECT *, CASE WHEN tier <= 1 THEN CASE WHEN completed = 0 THEN s1_ms WHEN completed = 1 THEN s2_ms
    WHEN last_lap_ms > 0 AND cached_s1 > 0 AND cached_s2 > 0 AND last_lap_ms - cached_s1 - cached_s2 > 0 THEN last_lap_ms - cached_s1 - cached_s2
    WHEN last_lap_ms > 0 THEN last_lap_ms - s1_ms - s2_ms ELSE 0 END
  WHEN tier = 2 THEN history_ms ELSE 0 END AS sector_ms
FROM (SELECT *, CASE WHEN completed = prev_sector THEN 0 WHEN (completed = 0 AND s1_ms > 0) OR (completed = 1 AND s2_ms > 0) THEN 1
  WHEN history_ms > 0 THEN 2 ELSE 3 END AS tier FROM o_hist) t""")


def history(x):
    """History packets carry every lap so far; only the last five count (every sixth lap is blank)."""
    lap = lambda i: F.struct(
        *[
            F.when(i % 6 == 0, F.lit(0)).otherwise(base + i * k % 900).alias(n)
            for n, base, k in (("s1", 26000, 83), ("s2", 28000, 61), ("s3", 27500, 43))
        ]
    )
    one = F.sequence(F.lit(1).cast("bigint"), F.greatest(c("num_laps"), F.lit(1)))
    return x.history.withColumn("laps", F.transform(one, lap))


TCOLS = ["session_uid", "seq", "snap_lap", "completed"]


@query("W4_sector_transitions", f"SELECT {', '.join(TCOLS)}, prev_sector FROM o_trans")
def _(x):
    return feed.transitions(x.lap_feed, S).select(*TCOLS, "prev_sector")


@query("W5_third_sector", """
SELECT session_uid, seq, snap_lap, completed, CASE WHEN last_lap_ms > 0 AND cached_s1 > 0 AND cached_s2 > 0 AND last_lap_ms - cached_s1 - cached_s2 > 0
  THEN last_lap_ms - cached_s1 - cached_s2 ELSE -1 END AS third_ms FROM o_trans WHERE completed = 2""")
def _(x):
    t = feed.transitions(x.lap_feed, S).where(c("completed") == 2)
    return t.select(*TCOLS, feed.third_sector(c("last_lap_ms"), c("cached_s1"), c("cached_s2")).alias("third_ms"))


@query("W7_history_lookup", f"SELECT {', '.join(TCOLS)}, history_ms FROM o_hist")
def _(x):
    return feed.with_history(feed.transitions(x.lap_feed, S), history(x), S).select(*TCOLS, "history_ms")


@query("W6_recovery_tier", f"SELECT {', '.join(TCOLS)}, tier, sector_ms FROM o_recover")
def _(x):
    t = feed.recover(feed.with_history(feed.transitions(x.lap_feed, S), history(x), S))
    return t.select(*TCOLS, "tier", "sector_ms")


ASOF = "ASOF LEFT JOIN (SELECT session_uid, seq, {v} AS {n} FROM ticks WHERE seq % {k} = {r}) {n}_t ON {n}_t.session_uid = r.session_uid AND {n}_t.seq <= r.seq"


@query("R4_sector_snapshot_stream", f"""
SELECT r.session_uid, r.seq, r.snap_lap, r.completed, tier, sector_ms, CASE WHEN tier < 3 THEN coalesce(track_temp, 0) ELSE 0 END AS track_temp,
  CASE WHEN tier < 3 THEN coalesce(brake_temp, 0) ELSE 0 END AS brake_temp FROM o_recover r
{ASOF.format(v='seq % 40', n='track_temp', k=5, r=2)} {ASOF.format(v='speed', n='brake_temp', k=4, r=1)}""")
def _(x):
    def packets(k, r, value):
        return x.ticks.where(c("seq") % k == r).select("session_uid", "seq", value.alias("value"))

    ctx = {"track_temp": packets(5, 2, c("seq") % 40), "brake_temp": packets(4, 1, c("speed"))}
    out = feed.sector_snapshots(x.lap_feed, history(x), ctx, S)
    return out.select(*TCOLS, "tier", "sector_ms", "track_temp", "brake_temp")


KINDS = {"lap": "click", "telemetry": "view", "damage": "error", "status": "signup"}


@query("J5_latest_state_as_of", """
SELECT l.session_uid, l.event_id, t.value AS telemetry, d.value AS damage, s.value AS status
FROM (SELECT user_id AS session_uid, event_id FROM events WHERE event_type = 'click') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') t ON t.user_id = l.session_uid AND t.event_id <= l.event_id
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') d ON d.user_id = l.session_uid AND d.event_id <= l.event_id
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON s.user_id = l.session_uid AND s.event_id <= l.event_id""")
def _(x):
    ev = x.events.withColumnRenamed("user_id", "session_uid")
    # All kinds share one walk: the newest non-null value of each kind so far.
    running = {k: ("last", F.when(c("event_type") == t, c("value"))) for k, t in KINDS.items() if k != "lap"}
    seen = stats.along(ev, S, "event_id", running=running, span=65536)
    return seen.where(c("event_type") == "click").select("session_uid", "event_id", "telemetry", "damage", "status")


@query("W8_pit_entries", f"""
SELECT session_uid, seq FROM (SELECT *, lag(pit_status) OVER w AS p FROM ticks {W}) t WHERE pit_status > 0 AND coalesce(p, 0) = 0""")
def _(x):
    return feed.pit_entries(x.ticks, S).select("session_uid", "seq")


# A fixture log: every tick is a written row, every 'signup' tick rewinds some frames back.
@query("J13_rewind_invalidation", """
SELECT r.session_uid, r.seq, r.frame_identifier FROM (SELECT session_uid, seq, seq * 3 % 500 AS frame_identifier FROM ticks WHERE event_type <> 'signup') r
WHERE NOT EXISTS (SELECT 1 FROM ticks f WHERE f.session_uid = r.session_uid AND f.event_type = 'signup' AND f.seq > r.seq
  AND r.frame_identifier > f.seq * 3 % 500 - f.speed % 40)""")
def _(x):
    rows_ = x.ticks.where(c("event_type") != "signup").select("session_uid", "seq", (c("seq") * 3 % 500).alias("frame_identifier"))
    rewinds = x.ticks.where(c("event_type") == "signup").select("session_uid", "seq", (c("seq") * 3 % 500 - c("speed") % 40).alias("target_frame"))
    return feed.valid_rows(rows_, rewinds, S)


@query("K5_rewind_delete_and_record", """
SELECT session_uid, seq, 'ROW' AS kind FROM (SELECT session_uid, seq, seq * 3 % 500 AS fr FROM ticks WHERE event_type <> 'signup') r
WHERE NOT EXISTS (SELECT 1 FROM ticks f WHERE f.session_uid = r.session_uid AND f.event_type = 'signup' AND f.seq > r.seq AND r.fr > f.seq * 3 % 500 - f.speed % 40)
UNION ALL SELECT session_uid, seq, 'FLBK' FROM ticks WHERE event_type = 'signup'""")
def _(x):
    rows_ = x.ticks.where(c("event_type") != "signup").select("session_uid", "seq", (c("seq") * 3 % 500).alias("frame_identifier"))
    rewinds = x.ticks.where(c("event_type") == "signup").select("session_uid", "seq", (c("seq") * 3 % 500 - c("speed") % 40).alias("target_frame"))
    kept = feed.valid_rows(rows_, rewinds, S).select("session_uid", "seq", F.lit("ROW").alias("kind"))
    return kept.unionByName(rewinds.select("session_uid", "seq", F.lit("FLBK").alias("kind")))


EV = (
    "session_uid", "event_type", "lap", "sector", "start_m", "end_m", "detail", "peak_intensity", "duration_ms",
    "entry_speed", "intensity_signal",
    "brake_peak", "throttle_peak", "steer_peak", "brake_at_peak", "throttle_at_peak", "steer_at_peak", "frame_identifier",
)
ISLANDS = """
SELECT session_uid, '{kind}' AS event_type, o.lap AS lap, o.sector AS sector, o.lap_distance AS start_m, e.lap_distance AS end_m, p.detail AS detail,
  p.intensity AS peak_intensity, e.t_ms - o.t_ms AS duration_ms, o.speed AS entry_speed,
  CASE '{kind}' WHEN 'LOCKUP' THEN 'wheel_slip_ratio' WHEN 'WHEELSPIN' THEN 'wheel_slip_ratio' WHEN 'SLIDE' THEN 'wheel_slip_angle' WHEN 'BRAKING' THEN 'brake' END AS intensity_signal,
  brake_peak, throttle_peak, steer_peak, p.brake AS brake_at_peak, p.throttle AS throttle_at_peak, p.steer AS steer_at_peak, e.frame_identifier AS frame_identifier
FROM (SELECT session_uid, run, arg_min(f, seq) FILTER (WHERE active) AS o, arg_max(f, struct_pack(a := intensity, b := -seq)) FILTER (WHERE active) AS p,
    arg_min(f, seq) FILTER (WHERE NOT active) AS e, max(brake) FILTER (WHERE active) AS brake_peak, max(throttle) FILTER (WHERE active) AS throttle_peak,
    max(abs(steer)) FILTER (WHERE active) AS steer_peak
  FROM (SELECT *, sum(CASE WHEN active AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER w AS run FROM (
      SELECT *, struct_pack(lap, sector, lap_distance, detail, intensity, t_ms, speed, brake, throttle, steer, frame_identifier) AS f,
        lag(active) OVER w AS was FROM ({flags}) m WINDOW w AS (PARTITION BY {part} ORDER BY seq)) g
    WINDOW w AS (PARTITION BY {part} ORDER BY seq)) r WHERE run > 0 GROUP BY {part}, run) i
WHERE e IS NOT NULL AND e.t_ms - o.t_ms >= 50"""
LOW4, HIGH2 = "least(ratio_rl, ratio_rr, ratio_fl, ratio_fr)", "greatest(ratio_rl, ratio_rr)"
FLAGS = {
    "LOCKUP": f"""SELECT *, forward_ms >= 8 AND brake > 0.15 AND {LOW4} < 0.8 AS active,
  CASE {LOW4} WHEN ratio_rl THEN 'RL' WHEN ratio_rr THEN 'RR' WHEN ratio_fl THEN 'FL' ELSE 'FR' END AS detail,
  CASE {LOW4} WHEN ratio_rl THEN slip_rl WHEN ratio_rr THEN slip_rr WHEN ratio_fl THEN slip_fl ELSE slip_fr END AS intensity FROM motion""",
    "WHEELSPIN": f"""SELECT *, forward_ms >= 8 AND throttle > 0.5 AND {HIGH2} > 1.1 AS active, CASE {HIGH2} WHEN ratio_rl THEN 'RL' ELSE 'RR' END AS detail,
  CASE {HIGH2} WHEN ratio_rl THEN slip_rl ELSE slip_rr END AS intensity FROM motion""",
    "SLIDE": """SELECT *, forward_ms >= 8 AND abs(yaw) > 0.1 AS active, CASE WHEN slip_front >= slip_rear THEN 'FRONT' ELSE 'REAR' END AS detail,
  greatest(slip_front, slip_rear) AS intensity FROM motion""",
    "BRAKING": """SELECT *, coalesce(last_value(CASE WHEN brake > 0.15 THEN 1 WHEN brake <= 0.05 THEN 0 END IGNORE NULLS) OVER
    (PARTITION BY session_uid ORDER BY seq) = 1, false) AS active, cast(NULL AS varchar) AS detail, brake AS intensity FROM motion""",
}


def islands(kind, flags, part="session_uid"):
    return ISLANDS.format(kind=kind, flags=flags, part=part)


# Every 97th frame is a rewind: an event open at it is discarded.
@query("R5_excursions", islands(
    "FAST", "SELECT *, speed > 25 AS active, 'any' AS detail, speed AS intensity, cast(floor(seq / 97e0) AS bigint) AS epoch FROM motion", "session_uid, epoch"))
def _(x):
    fast = x.motion.withColumn("active", c("speed") > 25).withColumn("detail", F.lit("any")).withColumn("intensity", c("speed"))
    return feed.excursions(fast.withColumn("again", c("seq") % 97 == 0), S, "FAST", reset="again").select(*EV)


@query("R6_lockup", islands("LOCKUP", FLAGS["LOCKUP"]))
def _(x):
    return feed.excursions(feed.lockup(x.motion), S, "LOCKUP").select(*EV)


@query("R7_wheelspin", islands("WHEELSPIN", FLAGS["WHEELSPIN"]))
def _(x):
    return feed.excursions(feed.wheelspin(x.motion), S, "WHEELSPIN").select(*EV)


@query("R8_slide", islands("SLIDE", FLAGS["SLIDE"]))
def _(x):
    return feed.excursions(feed.slide(x.motion), S, "SLIDE").select(*EV)


@query("R9_braking", islands("BRAKING", FLAGS["BRAKING"]))
def _(x):
    return feed.excursions(feed.braking(x.motion), S, "BRAKING").select(*EV)


@query("R10_frame_enrichment", """
SELECT m.session_uid, m.event_id, l.value AS lap_value, t.value AS telemetry_value,
  (SELECT count(*) FROM events z WHERE z.user_id = m.session_uid AND z.event_type = 'signup' AND z.event_id <= m.event_id) AS epoch
FROM (SELECT user_id AS session_uid, event_id FROM events WHERE event_type = 'error') m
ASOF JOIN (SELECT * FROM events WHERE event_type = 'click') l ON l.user_id = m.session_uid AND l.event_id <= m.event_id
ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') t ON t.user_id = m.session_uid AND t.event_id <= m.event_id""")
def _(x):
    ev = x.events.withColumnRenamed("user_id", "session_uid")
    is_ = lambda t: F.when(c("event_type") == t, c("value"))
    seen = stats.along(
        ev, S, "event_id", span=65536,
        running={
            "lap_value": ("last", is_("click")), "telemetry_value": ("last", is_("view")),
            "epoch": ("count", F.when(c("event_type") == "signup", 1)),
        },
    )
    ready = (c("event_type") == "error") & c("lap_value").isNotNull() & c("telemetry_value").isNotNull()
    return seen.where(ready).select("session_uid", "event_id", "lap_value", "telemetry_value", "epoch")


# Packets of the player, whose slot is 19: motion in every frame, the others now and then, a rewind every 97 frames.
RATIOS = {w: f"cast(cast(ratio_{w} * forward_ms AS float) AS double) / cast(cast(forward_ms AS float) AS double)" for w in ("rl", "rr", "fl", "fr")}
F4 = "cast(cast({} AS float) AS double) AS {}"
shared("o_player_frames", f"""
SELECT m.session_uid, m.seq * 8 + 3 AS seq, cast(floor((m.seq - 1) / 97e0) AS bigint) AS epoch, m.frame_identifier, 19 AS car_index, m.session_uid % 30 AS track_id, 1 + (m.seq - 3 - (m.seq - 3) % 50) % 12 AS session_type,
  cast(cast(m.t_ms / 1000e0 AS float) AS double) * 1000e0 AS t_ms, l.lap AS lap, l.sector AS sector, l.lap_distance AS lap_distance, t.speed AS speed, t.brake AS brake, t.throttle AS throttle, t.steer AS steer,
  m.forward_ms, {F4.format('m.yaw', 'yaw')}, {', '.join(f"CASE WHEN m.forward_ms >= 8 THEN {RATIOS[w]} END AS ratio_{w}, {F4.format('slip_' + w, 'slip_' + w)}" for w in RATIOS)},
  {F4.format('slip_front', 'slip_front')}, {F4.format('slip_rear', 'slip_rear')}
FROM motion m JOIN (SELECT session_uid, seq, lap % 256 AS lap, sector, lap_distance FROM motion) l ON l.session_uid = m.session_uid AND l.seq = m.seq - m.seq % 2
JOIN (SELECT session_uid, seq, speed, {F4.format('brake', 'brake')}, {F4.format('throttle', 'throttle')}, {F4.format('steer', 'steer')} FROM motion) t
  ON t.session_uid = m.session_uid AND t.seq = m.seq - CASE WHEN m.seq % 3 = 1 THEN 1 ELSE 0 END
WHERE m.seq >= 3""")
FRAME = (
    "session_uid", "seq", "epoch", "frame_identifier", "car_index", "track_id", "session_type", "t_ms", "lap", "sector", "lap_distance", "speed", "brake", "throttle", "steer", "forward_ms", "yaw",
    *[f"{k}_{w}" for w in ("rl", "rr", "fl", "fr") for k in ("ratio", "slip")], "slip_front", "slip_rear",
)


def player_packets(x):
    m = x.motion
    slot = F.lit(19)
    four = lambda *cols: F.array(*[e.cast("float") for e in cols])
    wheels = ("rl", "rr", "fl", "fr")
    car = lambda **f: F.array(F.struct(slot.alias("car_slot"), *[e.alias(n) for n, e in f.items()]))
    axle = four(c("slip_rear"), -c("slip_rear") / 2, c("slip_front") / 2, -c("slip_front"))
    kinds = {
        "session": F.when(c("seq") % 50 == 3, F.struct((c("session_uid") % 30).alias("track_id"), (1 + (c("seq") - 3) % 12).alias("session_type"))),
        "lap": F.when(c("seq") % 2 == 0, car(lap_distance=c("lap_distance").cast("float"), current_lap_num=c("lap") % 256, sector=c("sector"))),
        "telemetry": F.when(c("seq") % 3 != 1, car(speed=c("speed").cast("int"), **{n: c(n).cast("float") for n in ("brake", "throttle", "steer")})),
        "motion": F.struct(
            four(*[c(f"ratio_{w}") * c("forward_ms") for w in wheels]).alias("wheel_speed"), four(*[c(f"slip_{w}") for w in wheels]).alias("slip_ratio"), axle.alias("slip_angle"),
            c("forward_ms").cast("float").alias("velocity_x"), c("yaw").cast("float").alias("yaw")),
        "event": F.when(c("seq") % 97 == 0, F.struct(F.lit("FLBK").alias("event_code"), c("seq").alias("rewind_frame"))),
    }
    rows = m.select(
        (c("seq") * 8).alias("recv_seq"), "session_uid", "frame_identifier", (c("t_ms") / 1000.0).cast("float").alias("session_time"),
        slot.alias("player_car_index"), *[body.alias(kind) for kind, body in kinds.items()])
    return pk.pack_kinds(rows, tuple(kinds))


@query("R10_player_frames", f"SELECT {', '.join(FRAME)} FROM o_player_frames")
def _(x):
    return motion.frames(pk.player_stream(player_packets(x))).select(*FRAME)


@query("R6_R9_events_from_packets", " UNION ALL ".join(islands(kind, text.replace("FROM motion", "FROM o_player_frames").replace("PARTITION BY session_uid", "PARTITION BY session_uid, epoch"), "session_uid, epoch")
    .replace("e.t_ms - o.t_ms", "cast(trunc(e.t_ms - o.t_ms) AS bigint)").replace("e.frame_identifier AS frame_identifier", "e.frame_identifier AS frame_identifier, session_uid % 30 AS track_id") for kind, text in FLAGS.items()))
def _(x):
    ev = motion.driving_events(motion.frames(pk.player_stream(player_packets(x))))
    return ev.select(*EV, "track_id")


# Pit status codes spread over the tick feed so that every state is reached.
PITCODE = "CASE WHEN seq % 17 < 6 THEN 0 WHEN seq % 17 = 11 AND seq % 3 = 0 THEN 2 ELSE 1 END"
shared("o_pit_feed", f"SELECT session_uid, seq, {PITCODE} AS pit_status, CASE WHEN seq % 5 < 2 THEN speed % 5 ELSE speed END AS speed FROM ticks")


def pit_feed(x):
    code = F.when(c("seq") % 17 < 6, 0).when((c("seq") % 17 == 11) & (c("seq") % 3 == 0), 2).otherwise(1)
    speed = F.when(c("seq") % 5 < 2, c("speed") % 5).otherwise(c("speed"))
    return x.ticks.select("session_uid", "seq", code.alias("pit_status"), speed.alias("speed"))


@query("R11_pit_states", """
WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY session_uid ORDER BY seq) AS rn FROM o_pit_feed),
st AS (SELECT session_uid, rn, CASE pit_status WHEN 0 THEN 'ON_TRACK' ELSE 'PIT_STOPPED' END AS pit_state FROM f WHERE rn = 1
  UNION ALL SELECT f.session_uid, f.rn, CASE WHEN f.pit_status = 0 THEN 'ON_TRACK' WHEN f.pit_status = 2 THEN 'PIT_STOPPED'
    WHEN st.pit_state = 'ON_TRACK' THEN 'PIT_ENTRY' WHEN st.pit_state = 'PIT_ENTRY' THEN CASE WHEN f.speed < 5 THEN 'PIT_STOPPED' ELSE 'PIT_ENTRY' END
    WHEN st.pit_state = 'PIT_STOPPED' THEN CASE WHEN f.speed >= 5 THEN 'PIT_EXIT' ELSE 'PIT_STOPPED' END ELSE 'PIT_EXIT' END
  FROM st JOIN f ON f.session_uid = st.session_uid AND f.rn = st.rn + 1)
SELECT f.session_uid, f.seq, st.pit_state FROM st JOIN f USING (session_uid, rn)""")
def _(x):
    return feed.pit_states(pit_feed(x), S).select("session_uid", "seq", "pit_state")


# One feed per user; the session id changes every 40 ticks, a 'signup' tick classifies it.
@query("R2_session_lifecycle", """
WITH t AS (SELECT session_uid AS feed, seq, session_uid * 1000 + cast(floor((seq - 1) / 40) AS bigint) AS uid, event_type = 'signup' AS fin FROM ticks),
r AS (SELECT feed, uid, min(seq) AS s, min(seq) FILTER (WHERE fin) AS e FROM t GROUP BY ALL),
n AS (SELECT *, lead(s) OVER (PARTITION BY feed ORDER BY s) AS nx FROM r)
SELECT feed, uid, 'started' AS kind, s AS seq FROM n UNION ALL SELECT feed, uid, 'ended', coalesce(e, nx) FROM n WHERE coalesce(e, nx) IS NOT NULL""")
def _(x):
    t = x.ticks.select(
        c("session_uid").alias("feed"), "seq", (c("session_uid") * 1000 + F.floor((c("seq") - 1) / 40)).alias("uid"),
        (c("event_type") == "signup").alias("classified"),
    )
    return feed.lifecycle(t)


@query("R3_first_packets", """
WITH p AS (SELECT user_id AS session_uid, event_id AS seq, event_type AS kind FROM events),
k AS (SELECT session_uid, min(seq) AS known FROM p WHERE kind = 'view' GROUP BY 1)
SELECT p.session_uid, p.kind, min(p.seq) AS seq FROM p JOIN k ON k.session_uid = p.session_uid AND p.seq >= k.known GROUP BY 1, 2""")
def _(x):
    p = x.events.select(c("user_id").alias("session_uid"), c("event_id").alias("seq"), c("event_type").alias("kind"))
    return feed.first_packets(p, opening="view")


shared("o_broken", """
SELECT session_uid, car_index, lap_number, sector_number, lap_time_ms, outlier, CASE WHEN sector_number = 2 AND (lap_number + car_index) % 7 = 0 THEN lap_time_ms
  WHEN sector_number = 0 AND (lap_number + car_index) % 14 = 0 THEN 0 ELSE sector_time_ms END AS sector_time_ms FROM snap""")


@query("C11_third_sector_repair", """
SELECT b.session_uid, b.car_index, b.lap_number, b.sector_number,
  CASE WHEN b.sector_number = 2 AND b.sector_time_ms >= b.lap_time_ms AND a.t > 0 AND d.t > 0 AND b.lap_time_ms - a.t - d.t > 0
    THEN b.lap_time_ms - a.t - d.t ELSE b.sector_time_ms END AS sector_time_ms,
  CASE WHEN b.sector_number = 2 AND b.sector_time_ms >= b.lap_time_ms AND NOT coalesce(a.t > 0 AND d.t > 0 AND b.lap_time_ms - a.t - d.t > 0, false)
    THEN 1 ELSE b.outlier END AS outlier
FROM o_broken b LEFT JOIN (SELECT session_uid, car_index, lap_number, sector_time_ms AS t FROM o_broken WHERE sector_number = 0) a USING (session_uid, car_index, lap_number)
LEFT JOIN (SELECT session_uid, car_index, lap_number, sector_time_ms AS t FROM o_broken WHERE sector_number = 1) d USING (session_uid, car_index, lap_number)""")
def _(x):
    mix = c("lap_number") + c("car_index")
    t = F.when((c("sector_number") == 2) & (mix % 7 == 0), c("lap_time_ms")).when((c("sector_number") == 0) & (mix % 14 == 0), 0)
    broken = x.snap.withColumn("sector_time_ms", t.otherwise(c("sector_time_ms")))
    fixed = feed.repair_third_sectors(broken)
    return fixed.select("session_uid", "car_index", "lap_number", "sector_number", "sector_time_ms", "outlier")


@query("J8_sibling_sectors", """
SELECT t.session_uid, t.car_index, t.lap_number, a.sector_time_ms AS s1, b.sector_time_ms AS s2 FROM snap t
LEFT JOIN snap a ON a.session_uid = t.session_uid AND a.car_index = t.car_index AND a.lap_number = t.lap_number AND a.sector_number = 0
LEFT JOIN snap b ON b.session_uid = t.session_uid AND b.car_index = t.car_index AND b.lap_number = t.lap_number AND b.sector_number = 1
WHERE t.sector_number = 2""")
def _(x):
    pick = lambda s: F.max(F.when(c("sector_number") == s, c("sector_time_ms")))
    per = x.snap.groupBy("session_uid", "car_index", "lap_number").agg(
        pick(0).alias("s1"), pick(1).alias("s2"), F.max(F.when(c("sector_number") == 2, 1)).alias("_third")
    )
    return per.where(c("_third") == 1).drop("_third")

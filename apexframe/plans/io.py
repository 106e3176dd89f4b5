"""Packet decoding, file sources and sinks, read back after writing."""

from __future__ import annotations

from pyspark.sql import functions as F

from apexframe.operators import calibration as cal
from apexframe.operators import dashboards as dash
from apexframe.operators import rewrites as rw
from apexframe.plans.registry import query
from apexframe.plans.text import DIMS
from apexframe.plans.ticks import zones
from apexframe.session import cut_lineage
from apexframe.sources import keyed
from apexframe.sources import packets as pk
from apexframe.sources import tables as tb

c = F.col


def ints(*names):
    """Decoded fields narrowed to the width of the source columns."""
    return [c(n).cast("int").alias(n) for n in names]


SEQ = "session_uid * 1000 + tick"


def car_packets(x, kind, fields, src=None):
    """One packet per tick from the car table, a struct per slot."""
    s = F.struct(c("car").cast("int").alias("car_slot"), *[e.alias(n) for n, e in fields.items()])
    per = (x.cars if src is None else src).groupBy("session_uid", "tick").agg(F.collect_list(s).alias("body"))  # 22 slots
    return pk.pack(per.select(F.expr(SEQ).alias("recv_seq"), "session_uid", c("tick").alias("frame_identifier"), "body"), kind, slots=True)


@query("S1_packet_headers", "SELECT event_id AS recv_seq, user_id - 7 AS session_uid, event_id AS frame_identifier, 2025 AS packet_format, true AS known_format FROM events WHERE event_id % 5 <> 0")
def _(x):
    rows = x.events.select(c("event_id").alias("recv_seq"), (c("user_id") - 7).alias("session_uid"), c("event_id").alias("frame_identifier"))
    p = pk.pack(rows, "header")
    cut = F.when(c("recv_seq") % 5 == 0, F.substring("payload", 1, 20)).otherwise(c("payload"))  # short packets are dropped
    h = pk.headers(p.withColumn("payload", cut))
    return h.select("recv_seq", "session_uid", "frame_identifier", *ints("packet_format"), "known_format")


@query("S2_lap_packets", f"""
SELECT {SEQ} AS recv_seq, session_uid, car AS car_slot, last_lap_ms, s1_ms, s2_ms, cast(lap_distance AS float) AS lap_distance, pos AS car_position, lap AS current_lap_num, sector, pit_status, result_status FROM cars""")
def _(x):
    p = car_packets(x, "lap", {
        "last_lap_ms": c("last_lap_ms"), "s1_part_ms": c("s1_ms") % 60000, "s1_part_min": F.floor(c("s1_ms") / 60000), "s2_part_ms": c("s2_ms") % 60000,
        "s2_part_min": F.floor(c("s2_ms") / 60000), "lap_distance": c("lap_distance").cast("float"), "car_position": c("pos"), "current_lap_num": c("lap"),
        "sector": c("sector"), "pit_status": c("pit_status"), "result_status": c("result_status"),
    })
    d = pk.cars(p, "lap")
    ms = lambda n: (c(f"{n}_part_min") * 60000 + c(f"{n}_part_ms")).alias(f"{n}_ms")
    return d.select("recv_seq", "session_uid", "car_slot", "last_lap_ms", ms("s1"), ms("s2"), "lap_distance", "car_position", "current_lap_num", *ints("sector", "pit_status", "result_status"))


@query("S2_participant_packets", f"SELECT {SEQ} AS recv_seq, car AS car_slot, ai AS ai_controlled, car + 1 AS race_number, name FROM cars")
def _(x):
    p = car_packets(x, "participant", {"ai_controlled": c("ai"), "race_number": c("car") + 1, "name": c("name")})
    return pk.cars(p, "participant").select("recv_seq", "car_slot", *ints("ai_controlled"), "race_number", "name")


@query("S2_telemetry_packets", f"SELECT {SEQ} AS recv_seq, car AS car_slot, speed, cast(throttle AS float) AS throttle, -(tick % 3) AS gear, [tick % 90, car, 7, 9] AS inner_temp FROM cars")
def _(x):
    p = car_packets(x, "telemetry", {
        "speed": c("speed"), "throttle": c("throttle").cast("float"), "gear": -(c("tick") % 3),
        "tyres_inner_temp": F.array(c("tick") % 90, c("car"), F.lit(7), F.lit(9)),
    })
    return pk.cars(p, "telemetry").select("recv_seq", "car_slot", "speed", "throttle", "gear", c("tyres_inner_temp").alias("inner_temp"))


@query("S2_status_packets", f"SELECT {SEQ} AS recv_seq, car AS car_slot, cast(fuel AS float) AS fuel_in_tank, tyre AS visual_compound, tyre_age AS tyres_age_laps, drs_allowed, ers_mode FROM cars")
def _(x):
    p = car_packets(x, "status", {
        "fuel_in_tank": c("fuel").cast("float"), "visual_compound": c("tyre"), "tyres_age_laps": c("tyre_age"), "drs_allowed": c("drs_allowed"), "ers_mode": c("ers_mode"),
    })
    return pk.cars(p, "status").select("recv_seq", "car_slot", "fuel_in_tank", "visual_compound", "tyres_age_laps", *ints("drs_allowed"), "ers_mode")


@query("S2_damage_packets", f"""
SELECT {SEQ} AS recv_seq, car AS car_slot, [cast(wear_rl AS float), cast(wear_rr AS float), cast(wear_fl AS float), cast(wear_fr AS float)] AS tyres_wear, fw_dmg AS front_wing_l, fl_dmg AS floor, sp_dmg AS sidepod FROM cars""")
def _(x):
    wear = F.array(*[c(f"wear_{w}").cast("float") for w in ("rl", "rr", "fl", "fr")])
    p = car_packets(x, "damage", {"tyres_wear": wear, "front_wing_l": c("fw_dmg"), "floor": c("fl_dmg"), "sidepod": c("sp_dmg")})
    return pk.cars(p, "damage").select("recv_seq", "car_slot", "tyres_wear", "front_wing_l", "floor", "sidepod")


@query("S2_classification_packets", "SELECT session_uid, car_index AS car_slot, position, grid_position, num_laps, result_status, [16 + car_index % 3, stint2, 0, 0, 0, 0, 0, 0] AS stints_visual FROM final_class")
def _(x):
    src = x.final_class.withColumn("car", c("car_index")).withColumn("tick", F.lit(1).cast("bigint"))
    zero = [F.lit(0).cast("bigint")] * 6
    p = car_packets(x, "classification", {
        "position": c("position"), "grid_position": c("grid_position"), "num_laps": c("num_laps"), "result_status": c("result_status"),
        "stints_visual": F.array(c("stint1").cast("bigint"), c("stint2").cast("bigint"), *zero),
    }, src)
    d = pk.cars(p, "classification")
    return d.select("session_uid", "car_slot", "position", "grid_position", *ints("num_laps", "result_status"), "stints_visual")


@query("S3_session_packets", f"""
SELECT {SEQ} AS recv_seq, max(weather) AS weather, -5 AS track_temp, 5000 AS track_length, max(session_type) AS session_type, list(zone_flag ORDER BY car) AS zone_flags,
  list(car * 5 ORDER BY car) FILTER (WHERE car < 3) AS offsets, max(safety_car) AS safety_car_status, cast(1700.5 AS float) AS sector2_start_m, cast(3500.25 AS float) AS sector3_start_m FROM cars GROUP BY session_uid, tick""")
def _(x):
    zone = F.array_sort(F.collect_list(F.struct("car", c("zone_start").cast("float").alias("zone_start"), "zone_flag")))
    per = x.cars.groupBy("session_uid", "tick").agg(
        F.transform(zone, lambda z: F.struct(z["zone_start"].alias("zone_start"), z["zone_flag"].alias("zone_flag"))).alias("z"),
        F.max("weather").alias("w"), F.max("session_type").alias("t"), F.max("safety_car").alias("sc"),
        F.array_sort(F.collect_list(F.when(c("car") < 3, F.struct((c("car") * 5).alias("offset_min"))))).alias("f"),
    )
    body = F.struct(
        c("w").alias("weather"), F.lit(-5).alias("track_temp"), F.lit(5000).alias("track_length"), c("t").alias("session_type"),
        F.size("z").alias("num_marshal_zones"), c("z").alias("marshal_zones"), c("sc").alias("safety_car_status"), F.size("f").alias("num_forecast"),
        c("f").alias("forecast"), F.lit(1700.5).alias("sector2_start_m"), F.lit(3500.25).alias("sector3_start_m"),
    )
    p = pk.pack(per.select(F.expr(SEQ).alias("recv_seq"), "session_uid", c("tick").alias("frame_identifier"), body.alias("body")), "session")
    return pk.singles(p, "session").select(
        "recv_seq", *ints("weather", "track_temp", "track_length", "session_type"), c("marshal_zones.zone_flag").cast("array<int>").alias("zone_flags"),
        c("forecast.offset_min").alias("offsets"), *ints("safety_car_status"), "sector2_start_m", "sector3_start_m",
    )


@query("S3_history_packets", "SELECT session_uid * 100 + car_index AS recv_seq, car_index, count(*) AS num_laps, list(lap_time_ms ORDER BY lap_number) AS laps, list(lap_invalid = 0 ORDER BY lap_number) AS valid FROM snap WHERE sector_number = 0 GROUP BY session_uid, car_index")
def _(x):
    lap = F.array_sort(F.collect_list(F.struct("lap_number", c("lap_time_ms").alias("lap_ms"), (1 - c("lap_invalid")).alias("valid_flags"))))
    per = x.snap.where(c("sector_number") == 0).groupBy("session_uid", "car_index").agg(lap.alias("l"))  # 255 laps at most
    laps = F.transform("l", lambda e: F.struct(e["lap_ms"].alias("lap_ms"), e["valid_flags"].alias("valid_flags")))
    body = F.struct(c("car_index"), F.size("l").alias("num_laps"), laps.alias("laps"))
    p = pk.pack(per.select((c("session_uid") * 100 + c("car_index")).alias("recv_seq"), "session_uid", F.lit(0).alias("frame_identifier"), body.alias("body")), "history")
    d = pk.singles(p, "history")
    return d.select("recv_seq", "car_index", "num_laps", c("laps.lap_ms").alias("laps"), F.transform("laps", lambda e: e["valid_flags"].bitwiseAND(1) != 0).alias("valid"))


@query("S3_tyre_set_packets", "SELECT session_uid, car_index, list(visual_compound ORDER BY set_index) AS compounds, list(lap_delta_time_ms ORDER BY set_index) AS deltas FROM tyre_sets GROUP BY 1, 2")
def _(x):
    s = F.array_sort(F.collect_list(F.struct("set_index", "visual_compound", c("lap_delta_time_ms").alias("lap_delta_ms"))))
    per = x.tyre_sets.groupBy("session_uid", "car_index").agg(s.alias("s"))  # at most 20 sets per car
    sets = F.transform("s", lambda e: F.struct(e["visual_compound"].alias("visual_compound"), e["lap_delta_ms"].alias("lap_delta_ms")))
    body = F.struct(c("car_index"), sets.alias("sets"))
    p = pk.pack(per.select((c("session_uid") * 100 + c("car_index")).alias("recv_seq"), "session_uid", F.lit(0).alias("frame_identifier"), body.alias("body")), "tyre_sets")
    held = F.filter("sets", lambda e: e["visual_compound"] != 0)  # places of the packet without a set are all zero
    return pk.singles(p, "tyre_sets").select(
        "session_uid", "car_index", F.transform(held, lambda e: e["visual_compound"]).alias("compounds"), F.transform(held, lambda e: e["lap_delta_ms"]).alias("deltas"))


@query("S3_motion_packets", "SELECT session_uid, seq, cast(forward_ms AS float) AS velocity_x, cast(yaw AS float) AS yaw, [cast(slip_rl AS float), cast(slip_rr AS float), cast(slip_fl AS float), cast(slip_fr AS float)] AS slip_ratio FROM motion")
def _(x):
    slip = F.array(*[c(f"slip_{w}").cast("float") for w in ("rl", "rr", "fl", "fr")])
    body = F.struct(c("forward_ms").cast("float").alias("velocity_x"), c("yaw").cast("float").alias("yaw"), slip.alias("slip_ratio"))
    p = pk.pack(x.motion.select(c("seq").alias("recv_seq"), "session_uid", c("seq").alias("frame_identifier"), body.alias("body")), "motion")
    return pk.singles(p, "motion").select("session_uid", c("recv_seq").alias("seq"), "velocity_x", "yaw", "slip_ratio")


CODE = "CASE event_id % 6 WHEN 0 THEN 'FTLP' WHEN 1 THEN 'PENA' WHEN 2 THEN 'FLBK' WHEN 3 THEN 'OVTK' WHEN 4 THEN 'SEND' ELSE 'SCAR' END"


@query("S4_event_packets", f"""
SELECT event_id AS recv_seq, event_code, CASE WHEN event_code IN ('FTLP', 'PENA') THEN event_id % 22 END AS vehicle_idx, CASE WHEN event_code = 'FTLP' THEN cast(value AS float) END AS lap_time,
  CASE WHEN event_code = 'PENA' THEN event_id % 30 END AS time_s, CASE WHEN event_code = 'FLBK' THEN event_id END AS rewind_frame, CASE WHEN event_code = 'OVTK' THEN event_id % 20 END AS vehicle1_idx,
  CASE WHEN event_code = 'SCAR' THEN event_id % 4 END AS safety_car_type FROM (SELECT *, {CODE} AS event_code FROM events) e""")
def _(x):
    body = F.struct(
        F.expr(CODE).alias("event_code"), (c("event_id") % 22).alias("vehicle_idx"), c("value").cast("float").alias("lap_time"), (c("event_id") % 30).alias("time_s"),
        c("event_id").alias("rewind_frame"), (c("event_id") % 20).alias("vehicle1_idx"), (c("event_id") % 4).alias("safety_car_type"),
    )
    p = pk.pack(x.events.select(c("event_id").alias("recv_seq"), c("user_id").alias("session_uid"), c("event_id").alias("frame_identifier"), body.alias("body")), "event")
    return pk.events(p).select("recv_seq", "event_code", "vehicle_idx", "lap_time", "time_s", "rewind_frame", "vehicle1_idx", "safety_car_type")


@query("S5_tick_json", "SELECT lower(printf('%x', session_uid)) AS session_uid, tick AS current_lap, car AS idx, name, pos, last_lap_ms FROM cars WHERE tick % 4 <> 3")
def _(x):
    car = F.struct(c("car").alias("idx"), "name", "pos", c("last_lap_ms").alias("lastLapTimeMs"), F.lit(1).alias("unknownField"))
    docs = x.cars.groupBy("session_uid", "tick").agg(F.collect_list(car).alias("cars"))  # 22 cars at most
    kind = F.when(c("tick") % 4 == 3, "event").otherwise("state")
    from apexframe.functions import text as tx

    line = F.to_json(F.struct(kind.alias("type"), tx.hex_uid(c("session_uid")).alias("sessionUid"), c("tick").alias("currentLap"), "cars"))
    cars = tb.tick_cars(tb.route(docs.select(line.alias("value"))))
    return cars.select(c("sessionUid").alias("session_uid"), c("currentLap").alias("current_lap"), "idx", "name", "pos", c("lastLapTimeMs").alias("last_lap_ms"))


@query("S11_circuit_zones", "SELECT DISTINCT t.track_id, z.zone_idx, z.from_m, z.to_m FROM (SELECT DISTINCT track_id FROM snap) t JOIN o_zones z ON z.track_id = t.track_id")
def _(x):
    zone = F.struct("zone_idx", c("from_m").alias("fromMetres"), c("to_m").alias("toMetres"))
    docs = zones(x).groupBy(c("track_id").alias("trackId")).agg(F.array_sort(F.collect_list(zone)).alias("safeZones"))
    path = tb.scratch(x.spark, "circuits")
    docs.write.option("maxRecordsPerFile", 1).json(path)  # one file per circuit
    return tb.read_circuits(x.spark, path).select("track_id", "zone_idx", "from_m", "to_m")


def export(x):
    r = x.radio.withColumn("track_id", c("session_uid") % 36).withColumn("sent_at", c("sent_day").cast("timestamp")).withColumn("player_position", c("race_position"))
    n = c("message_id")
    r = r.withColumns({
        "session_type": 1 + n % 12, "total_laps": 20 + n % 40, "tyre_compound": F.when(n % 6 > 0, 15 + n % 6), "tyre_age_laps": n % 30, "sector": n % 3,
        "best_strategies": F.when(n % 5 > 0, F.concat(F.lit('[{"label": "Plan ", "laps": '), n % 7, F.lit("}]")))})
    return tb.radio_export(r, dash.driver_names(x.participants))


EXPORT = """
SELECT cast(message_id AS varchar) AS message_id, cast(r.session_uid AS varchar) AS session_uid, strftime(sent_day, '%Y-%m-%d %H:%M:%S') AS sent_at, priority, cast(1 + message_id % 12 AS varchar) AS session_type,
  cast(track_id AS varchar) AS track_id, {tracks} AS circuit_name, cast(lap_number AS varchar) AS lap_number, cast(20 + message_id % 40 AS varchar) AS total_laps, cast(race_position AS varchar) AS player_position,
  coalesce(d.driver_name, '') AS driver_name, CASE WHEN message_id % 6 > 0 THEN cast(15 + message_id % 6 AS varchar) ELSE '' END AS tyre_compound, cast(message_id % 30 AS varchar) AS tyre_age_laps,
  cast(message_id % 3 AS varchar) AS sector, message_text, CASE WHEN message_id % 5 > 0 THEN concat('[{{"label": "Plan ", "laps": ', message_id % 7, '}}]') ELSE '' END AS best_strategies,
  coalesce(rendered_text, '') AS rendered_text FROM (SELECT *, session_uid % 36 AS track_id FROM radio) r
LEFT JOIN (SELECT session_uid, max(driver_name) AS driver_name FROM participants WHERE ai_controlled = 0 AND trim(driver_name) <> '' GROUP BY 1) d ON d.session_uid = r.session_uid"""
from apexframe.plans.readiness import TRACKS  # noqa: E402


@query("K8_radio_export", EXPORT.format(tracks=TRACKS))
def _(x):
    return export(x)


@query("S12_radio_csv", EXPORT.format(tracks=TRACKS))
def _(x):
    path = tb.scratch(x.spark, "radio-csv")
    tb.write_csv(export(x), path)
    back = tb.read_csv(x.spark, path, list(tb.RADIO_HEADER))
    return back.select(*[F.coalesce(n, F.lit("")).alias(n) for n in tb.RADIO_HEADER])


@query("S13_jsonl_runs", "SELECT row_id, model, variant, output, error, total_ms FROM runs")
def _(x):
    path = tb.scratch(x.spark, "runs-jsonl")
    runs = x.runs.select("row_id", "model", "variant", "output", "error", "total_ms")
    tb.append_jsonl(runs, path)
    return tb.read_jsonl(x.spark, path, "row_id bigint, model string, variant string, output string, error string, total_ms double")


@query("K10_jsonl_append", "SELECT row_id, judge, tone FROM judgements WHERE row_id % 2 = 0 UNION ALL SELECT row_id, judge, tone FROM judgements WHERE row_id % 2 = 1")
def _(x):
    path = tb.scratch(x.spark, "judgements-jsonl")
    for part in (0, 1):
        tb.append_jsonl(x.judgements.where(c("row_id") % 2 == part).select("row_id", "judge", "tone"), path)
    return tb.read_jsonl(x.spark, path, "row_id bigint, judge string, tone bigint")


@query("K1_insert_if_absent", """
SELECT session_uid, car_index, lap_number, sector_number, CASE WHEN session_uid % 2 = 0 THEN sector_time_ms ELSE sector_time_ms + 1 END AS sector_time_ms FROM snap""")
def _(x):
    keys = tb.TABLE_KEYS["sector_snapshots"]
    rows = x.snap.select(*keys, "sector_time_ms")
    target = rows.where(c("session_uid") % 2 == 0)
    # The batch repeats every key: the copy written first carries the smaller order number.
    late = rows.withColumn("sector_time_ms", c("sector_time_ms") + 2).withColumn("seq", F.lit(2))
    batch = rows.withColumn("sector_time_ms", c("sector_time_ms") + 1).withColumn("seq", F.lit(1)).unionByName(late)
    return target.unionByName(tb.insert_absent(target, batch, keys, "seq").drop("seq"))


@query("K2_upsert", """
SELECT session_uid, car_index, set_index, CASE WHEN p % 3 = 0 THEN 99 ELSE visual_compound END AS visual_compound, CASE WHEN p % 3 < 2 THEN wear + 10 ELSE wear END AS wear
FROM (SELECT *, session_uid + car_index + set_index AS p FROM tyre_sets) t""")
def _(x):
    keys = tb.TABLE_KEYS["tyre_sets"]
    t = x.tyre_sets.select(*keys, "visual_compound", "wear").withColumn("p", (c("session_uid") + c("car_index") + c("set_index")) % 3)
    target = t.where(c("p") > 0).drop("p")  # p = 0 is new, p = 1 is updated, p = 2 stays
    batch = t.where(c("p") < 2).select(*keys, F.lit(99).cast("bigint").alias("visual_compound"), (c("wear") + 10).alias("wear"), F.lit(1).alias("seq"))
    older = batch.withColumn("wear", F.lit(0)).withColumn("seq", F.lit(0))
    path = tb.scratch(x.spark, "tyre-sets")
    tb.replace(target, path)
    tb.replace(tb.upsert(tb.current(x.spark, path), batch.unionByName(older), keys, "seq", keep=("visual_compound",)), path)
    return tb.current(x.spark, path)


@query("K1_merge_by_bucket", """
SELECT session_uid, car_index, lap_number, sector_number, CASE WHEN lap_number % 2 = 0 THEN sector_time_ms ELSE sector_time_ms + 1 END AS sector_time_ms FROM snap""")
def _(x):
    """Every even lap, then all laps twice and the replay of that batch, into a table by session buckets."""
    keys = tb.TABLE_KEYS["sector_snapshots"]
    rows = x.snap.select(*keys, "sector_time_ms")
    path = tb.scratch(x.spark, "snapshots-by-key")
    put = lambda df, n: keyed.merge(df, path, keys, "seq", update=False, writer="laps", batch_id=n)
    put(rows.where(c("lap_number") % 2 == 0).withColumn("seq", F.lit(0)), 0)
    late = rows.withColumn("sector_time_ms", c("sector_time_ms") + 2).withColumn("seq", F.lit(2))
    batch = rows.withColumn("sector_time_ms", c("sector_time_ms") + 1).withColumn("seq", F.lit(1)).unionByName(late)
    put(batch, 1)
    put(late, 1)  # comes again, is known
    return keyed.read(x.spark, path)


@query("K2_merge_by_bucket", """
SELECT session_uid, car_index, set_index, CASE WHEN p % 3 = 0 THEN 99 ELSE visual_compound END AS visual_compound, CASE WHEN p % 3 < 2 THEN wear + 10 ELSE wear END AS wear
FROM (SELECT *, session_uid + car_index + set_index AS p FROM tyre_sets) t""")
def _(x):
    keys = tb.TABLE_KEYS["tyre_sets"]
    t = x.tyre_sets.select(*keys, "visual_compound", "wear").withColumn("p", (c("session_uid") + c("car_index") + c("set_index")) % 3)
    path = tb.scratch(x.spark, "tyre-sets-by-key")
    put = lambda df, n: keyed.merge(df, path, keys, "seq", update=True, writer="sets", batch_id=n, keep=("visual_compound",))
    put(t.where(c("p") > 0).drop("p").withColumn("seq", F.lit(0)), 0)
    batch = t.where(c("p") < 2).select(*keys, F.lit(99).cast("bigint").alias("visual_compound"), (c("wear") + 10).alias("wear"), F.lit(1).alias("seq"))
    put(batch.unionByName(batch.withColumn("wear", F.lit(0).cast("bigint")).withColumn("seq", F.lit(0))), 1)
    return keyed.read(x.spark, path)


@query("K3_append_with_id", "SELECT event_id AS source_id, user_id AS session_uid, true AS has_id, 1 AS copies, 1 AS owners FROM events")
def _(x):
    path = tb.scratch(x.spark, "events")
    ev = x.events.select(c("event_id").alias("source_id"), c("user_id").alias("session_uid"))
    tb.append(tb.with_id(ev.where(c("source_id") % 2 == 0), "event_id", ["session_uid", "source_id"]), path)
    tb.append(tb.with_id(ev.where(c("source_id") % 2 == 1), "event_id", ["session_uid", "source_id"]), path)
    back = x.spark.read.parquet(path)
    owners = back.groupBy("event_id").agg(F.count("*").alias("owners"))  # an id belongs to one row
    return back.join(owners, "event_id", "left").groupBy("source_id", "session_uid").agg(
        (F.max("event_id").isNotNull()).alias("has_id"), F.count("*").alias("copies"), F.max("owners").alias("owners"))


# The tables in the order of their foreign keys: where their check SQL reads them, and the number that tells the lost rows.
TABLES = {
    "sessions": ("sessions", "session_uid"), "participants": ("participants", "car_index"), "sector_snapshots": ("snap", "lap_number"), "session_events": ("events", "event_id"),
    "tyre_sets": ("tyre_sets", "set_index"), "final_classifications": ("final_class", "car_index"), "calibration_coefficients": ("coeffs", "coefficient_id"),
    "sector_pace_baselines": ("o_baselines", "sector_number"), "tyre_age_pace_offsets": ("o_bins", "tyre_age_laps"), "radio_messages": ("radio", "message_id"),
    "simulation_runs": ("(SELECT cast(substring(job_id, 5) AS bigint) AS run_id FROM sim_runs)", "run_id"), "simulation_accuracy": ("accuracy", "accuracy_id"),
}


def live_tables(x):
    base = cut_lineage(cal.baselines(x.snap))
    made = {"sector_pace_baselines": base, "tyre_age_pace_offsets": cut_lineage(cal.age_bins(x.snap, base)), "simulation_runs": x.sim_runs.withColumn("run_id", F.substring("job_id", 5, 20).cast("bigint"))}
    return {name: made[name] if name in made else getattr(x, view) for name, (view, _) in TABLES.items()}


@query("K7_backup_restore", " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS restored, 0 AS changed FROM {view} v WHERE {n} % 2 = 1" for t, (view, n) in TABLES.items()))
def _(x):
    """Rows that are missing from each table after a loss, given back whole."""
    live = live_tables(x)
    path = tb.scratch(x.spark, "backup")
    tb.backup(live, path)
    back = tb.restore(x.spark, path, {name: df.where(c(TABLES[name][1]) % 2 == 0) for name, df in live.items()})
    out = None
    for name, df in back.items():
        lost = tb.summary(live[name].where(c(TABLES[name][1]) % 2 == 1).select(*df.columns)).select(c("mark").alias("lost"))
        one = tb.summary(df).crossJoin(lost).select(F.lit(name).alias("t"), c("rows").alias("restored"), (c("mark") != c("lost")).cast("int").alias("changed"))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


@query("K9_report_rows", "SELECT track_id, regime, knob_name, coalesce(cast(sector_number AS varchar), '') AS sector, printf('%.4f', round(r2, 6)) AS r_squared, n FROM o_r2")
def _(x):
    r = cal.r2_by_knob(x.snap)
    return r.select("track_id", "regime", "knob_name", F.coalesce(c("sector_number").cast("string"), F.lit("")).alias("sector"), tb.fixed(F.round("r_squared", 6)).alias("r_squared"), "n")


@query("K9_summary_markdown", "SELECT concat('| ', model, '/', variant, ' | ', n_runs, ' | ', printf('%.4f', overall), ' | ', printf('%.4f', fact_invented_rate), ' |') AS line FROM o_scorecard")
def _(x):
    s = rw.scorecard(x.runs, x.judgements, DIMS)
    cells = [F.concat_ws("/", "model", "variant"), c("n_runs"), tb.fixed(c("overall")), tb.fixed(c("fact_invented_rate"))]
    return s.select(tb.markdown_row(cells).alias("line"))


@query("K12_run_io_pairs", """
SELECT job_id, CASE WHEN o_orderkey % 5 <> 0 THEN session_uid END AS session_uid, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN player_mean_position END AS player_mean_position
FROM (SELECT *, cast(substring(job_id, 5) AS bigint) AS o_orderkey FROM sim_io) s WHERE o_orderkey % 5 <> 0 OR o_orderkey % 7 <> 0""")
def _(x):
    n = F.substring("job_id", 5, 20).cast("bigint")
    io = x.sim_io.withColumn("n", n)
    req = io.where(c("n") % 5 != 0).select("job_id", "session_uid", "player_car_index")
    cars = F.array(F.struct(F.lit(3).alias("car_index"), F.lit(9.5).alias("mean_position")), F.struct(F.lit(0).alias("car_index"), c("player_mean_position").cast("double").alias("mean_position")))
    res = io.where(c("n") % 7 != 0).select("job_id", cars.alias("cars"))
    return tb.pair_run_io(req, res).select("job_id", "session_uid", "player_mean_position")


@query("K13_radio_log", "SELECT message_id, CASE WHEN message_id % 10 = 0 THEN NULL ELSE session_uid - 9 END AS session_uid, priority FROM radio")
def _(x):
    from apexframe.functions import text as tx

    sent = F.when(c("message_id") % 10 == 0, "-").otherwise(tx.hex_uid(c("session_uid") - 9))
    path = tb.scratch(x.spark, "radio-log")
    tb.append(tb.radio_log(x.radio.select("message_id", "priority", sent.alias("session_hex"))), path)
    return x.spark.read.parquet(path).select("message_id", "session_uid", "priority")

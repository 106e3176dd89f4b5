"""Streams drained over files give what the batch operators give."""

from pyspark.sql import functions as F

from apexframe.operators import dashboards as dash
from apexframe.operators import feed
from apexframe.operators import latched_rules as lr
from apexframe.operators import rules as ru
from apexframe.operators import ticks as tk
from apexframe.operators.memory import count, lag, last, remembered, spoken
from apexframe.plans.feed import history
from apexframe.plans.latched import YELLOW, stops
from apexframe.plans.registry import Inputs
from apexframe.plans.rules import plans, rain_in
from apexframe.plans.ticks import zones
from apexframe.streaming import jobs
from apexframe.streaming import memory as sm
from apexframe.streaming import timers

c = F.col
S = ["session_uid"]


def land(df, path, order, parts=3):
    """Rows in arrival order over several files, so state crosses micro-batches."""
    n = df.count()
    df.withColumn("_p", F.floor(F.row_number().over(__import__("pyspark").sql.Window.orderBy(order)) * parts / (n + 1))).coalesce(1).createOrReplaceTempView("_land")
    for p in range(parts):
        df.sparkSession.table("_land").where(c("_p") == p).drop("_p").coalesce(1).write.parquet(f"{path}/part-{p}")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_transitions_stream_equals_batch(spark, x, tmp_path):
    batch = feed.recover(feed.with_history(feed.transitions(x.lap_feed, S), history(x), S))
    five = F.slice(F.transform("laps", lambda e: F.array(e["s1"], e["s2"], e["s3"])), -5, 5)
    hist = history(x).select(
        "session_uid", "seq", F.lit(True).alias("is_history"), "num_laps",
        F.when(F.size("laps") >= 5, five).otherwise(F.transform("laps", lambda e: F.array(e["s1"], e["s2"], e["s3"]))).alias("last_laps"),
    )
    laps = x.lap_feed.select("session_uid", "seq", F.lit(False).alias("is_history"), "lap", "sector", "s1_ms", "s2_ms", "last_lap_ms")
    both = hist.unionByName(laps, allowMissingColumns=True).fillna(0)
    both = both.withColumn("last_laps", F.coalesce("last_laps", F.array().cast("array<array<bigint>>")))
    both = both.withColumn("seq", c("seq") * 2 + (~c("is_history")).cast("int"))  # history first on equal arrival
    twin = both.withColumn("car_index", F.lit(1)).unionByName(both.where("seq % 3 > 0").withColumn("car_index", F.lit(0)))  # another car in between
    out = jobs.sector_snapshots(land(twin, f"{tmp_path}/in", ["seq", "session_uid"])).where("car_index = 1")
    jobs.drain(out, f"{tmp_path}/cp", path=f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out").withColumn("seq", F.floor(c("seq") / 2))
    cols = ["session_uid", "seq", "completed", "snap_lap", "tier", "sector_ms"]
    want = rows(batch.select(*cols))
    assert want and rows(got.select(*cols)) == want


def rule_ticks(docs, zones, engine=None):
    """Ticks with all that the rules need, from one row per tick with its cars."""
    t = rain_in(ru.from_documents(docs)).withColumn("yellow", F.expr(YELLOW)).withColumn("chequered", c("tick") >= 150).withColumn("track_id", c("session_uid") % 3)
    t = t.withColumn("plan", plans(t)).withColumn("stop", stops(t))
    held = lambda on: (yield {"plan": last("plan", prior=False), "stop": last("stop", prior=False)})
    out, found = remembered(t, {"pit": (ru.pit_state, F.lit(True)), "held": (held, F.lit(True))}, engine)
    state, prev = found["pit"]
    out = out.withColumns({"pit_state": state, "prev_pit_state": prev, **{n: found["held"].plan[n] for n in ("p1", "p2")}, **{n: found["held"].stop[n] for n in ("target", "compound")}})
    return lr.with_zones(out, zones)


def documents(x):
    docs = x.cars.groupBy("session_uid", "tick").agg(F.collect_list(F.struct(*[n for n in x.cars.columns if n not in S + ["tick"]])).alias("cars"))
    return docs.withColumn("ts", F.timestamp_millis(3_600_000 + c("tick") * 1500))


def test_all_rules_in_one_stream(spark, tmp_path):
    """Ticks arrive up to six seconds out of order; messages and their delivery are those of the batch."""
    x = Inputs(spark, "/root/testdata/sf0.01")
    docs = documents(x)
    z = zones(x).cache()
    batch = rule_ticks(docs.drop("ts"), z)
    want = rows(ru.said(batch))
    assert len({r[2] for r in want}) >= 25
    closing = docs.limit(1).withColumn("session_uid", F.lit(-1).cast("bigint")).withColumn("ts", c("ts") + F.expr("interval 1 day"))
    fed = docs.withColumn("_o", c("tick") + F.pmod(F.hash("session_uid", "tick"), F.lit(5)))
    fed = fed.unionByName(closing.withColumn("_o", F.lit(10**6)))
    source = land(fed, f"{tmp_path}/in", ["_o", "session_uid"])
    stream = rule_ticks(sm.in_order(source.drop("_o")), z, sm.Stateful())
    out, messages = ru.evaluated(stream, engine=sm.Stateful())
    jobs.drain(spoken(out, messages), f"{tmp_path}/cp", path=f"{tmp_path}/out")
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == want


def test_late_ticks_wait_for_the_watermark(spark, tmp_path):
    """A late tick takes its place; one behind the watermark is dropped; nothing is given on before the watermark."""
    put = lambda *ticks: spark.createDataFrame([(1, t, 10 * t) for t in ticks], "session_uid int, tick bigint, v bigint").withColumn("ts", F.timestamp_seconds("tick")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []
    for ticks in ((3, 1), (2, 20), (12, 5), (15,)):
        put(*ticks)
        source = spark.readStream.schema("session_uid int, tick bigint, v bigint, ts timestamp").parquet(f"{tmp_path}/in")
        out, found = remembered(sm.in_order(source), {"r": (lambda on: (yield {"was": lag("v")}), F.lit(True))}, sm.Stateful())
        jobs.drain(out.select("tick", found["r"].was.alias("was")), f"{tmp_path}/cp", path=f"{tmp_path}/out")
        seen.append(sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()))
    assert seen[0] == []
    assert seen[1] == [(1, None), (2, 10), (3, 20)]
    assert seen[3] == seen[1]  # tick 5 came behind the watermark; 12, 15 and 20 still wait


def test_memory_ends_with_the_session(spark, tmp_path):
    data = [(1, t, t, t == 3) for t in range(6)]
    df = spark.createDataFrame(data, "session_uid int, tick bigint, v bigint, ended boolean")
    out, found = remembered(land(df, f"{tmp_path}/in", ["tick"], parts=2), {"r": (lambda on: (yield {"was": lag("v"), "n": count(F.lit(True))}), F.lit(True))}, sm.Stateful())
    jobs.drain(out.select("tick", found["r"].was.alias("was"), found["r"].n.alias("n")), f"{tmp_path}/cp", path=f"{tmp_path}/out")
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == [(0, None, 0), (1, 0, 1), (2, 1, 2), (3, 2, 3), (4, None, 0), (5, 4, 1)]


def test_delivery_in_a_stream(spark, tmp_path):
    ticks = [(1, t, t * 1500, t // 10, (t // 7) % 3 - 1, t in (30, 31)) for t in range(60)]
    said = [(1, t, t * 1500, t // 10, 10 * t + k, ("IMMEDIATE", "HIGH", "NORMAL")[(t + k) % 3], 2) for t in range(0, 60, 2) for k in range(t % 3)]
    t = spark.createDataFrame(ticks, "session_uid int, tick bigint, at_ms bigint, lap bigint, zone int, quiet boolean")
    m = spark.createDataFrame(said, "session_uid int, tick bigint, at_ms bigint, lap bigint, message_no bigint, priority string, ttl_laps int")
    want = rows(lr.delivered(t, m))
    feed = t.withColumn("present", F.lit(True)).join(lr.waiting(m), ["session_uid", "tick"], "left")
    jobs.drain(lr.handed_out(land(feed, f"{tmp_path}/in", ["tick"]), sm.Stateful()), f"{tmp_path}/cp", path=f"{tmp_path}/out")
    assert want and rows(spark.read.parquet(f"{tmp_path}/out")) == want


def test_triggers_are_those_of_the_batch_operators(spark, tmp_path):
    x = Inputs(spark, "/root/testdata/sf0.01")
    t = ru.from_documents(documents(x).drop("ts"))
    assert rows(ru.projection_triggers(t)) == rows(tk.projection_triggers(x.cars))
    strategy = tk.strategy_triggers(x.cars)
    assert rows(ru.strategy_triggers(t)) == rows(strategy)
    want = rows(tk.throttle(strategy).select("session_uid", "tick", "at_ms", "lap", "severity"))
    assert len(want) < strategy.count() and rows(ru.strategy_triggers(t, cap=2)) == want
    stream = ru.from_documents(land(documents(x).drop("ts"), f"{tmp_path}/in", ["tick", "session_uid"]))
    jobs.drain(ru.strategy_triggers(stream, sm.Stateful(), cap=2), f"{tmp_path}/cp", path=f"{tmp_path}/out")
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == want


def test_rewinds_silence_in_a_stream(spark, x, tmp_path):
    m = x.ticks.select("session_uid", (c("seq") * 1000).alias("at_ms"), (c("event_type") == "signup").alias("is_rewind"))
    want = rows(tk.outside_rewind(m.where(~c("is_rewind")).drop("is_rewind"), m.where("is_rewind").drop("is_rewind")))
    assert rows(ru.outside_rewind(m).drop("is_rewind")) == want
    jobs.drain(ru.outside_rewind(land(m, f"{tmp_path}/in", ["at_ms", "session_uid"]), engine=sm.Stateful()).drop("is_rewind"), f"{tmp_path}/cp", path=f"{tmp_path}/out")
    assert want and rows(spark.read.parquet(f"{tmp_path}/out")) == want


def test_runs_by_timers(spark, x, tmp_path):
    """Bursts and idle runs of all sessions at the times of the batch; only a row of another session moves the clock on."""
    base = 3_600_000
    trig = tk.strategy_triggers(x.cars).where(c("severity") == "CRITICAL").withColumn("at_ms", c("at_ms") + base)
    ends = x.cars.groupBy("session_uid").agg((F.max("at_ms") + 20000 + base).alias("end_ms"))
    burst = tk.debounce(trig)
    want = rows(tk.idle_floor(burst, ends).select("session_uid", "fire_ms", "cause"))
    feed = trig.select("session_uid", "at_ms", F.lit(False).alias("ends")).unionByName(ends.select("session_uid", c("end_ms").alias("at_ms"), F.lit(True).alias("ends")))
    late = feed.withColumn("_o", c("at_ms") + F.pmod(F.hash("at_ms"), F.lit(5)) * 1000)
    closing = spark.createDataFrame([(-1, 10 * base, True, 1 << 60)], "session_uid bigint, at_ms bigint, ends boolean, _o bigint")
    source = land(late.unionByName(closing), f"{tmp_path}/in", ["_o", "session_uid"])
    jobs.drain(timers.runs(source.drop("_o")), f"{tmp_path}/cp", path=f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert rows(got.select("session_uid", "fire_ms", "cause")) == want and {r[2] for r in want} == {"trigger", "idle"}
    assert rows(got.where("triggers > 0").select("session_uid", "fire_ms", "triggers")) == rows(burst)


def test_liveness_by_timers(spark, tmp_path):
    put = lambda *rows_: spark.createDataFrame([(s, 3_600_000 + at) for s, at in rows_], "session_uid int, at_ms bigint").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for rows_ in (((1, 0), (1, 4000)), ((2, 8000), (1, 9500)), ((2, 40_000),), ((1, 60_000), (3, 90_000)), ((3, 120_000),)):
        put(*rows_)
        source = spark.readStream.schema("session_uid int, at_ms bigint").parquet(f"{tmp_path}/in")
        jobs.drain(timers.liveness(source), f"{tmp_path}/cp", path=f"{tmp_path}/out")
    got = sorted((r.session_uid, r.at_ms - 3_600_000, r.live) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert [g for g in got if g[0] == 1] == [(1, 0, True), (1, 9000, False), (1, 9500, True), (1, 14_500, False), (1, 60_000, True), (1, 65_000, False)]
    assert [g for g in got if g[0] == 2] == [(2, 8000, True), (2, 13_000, False), (2, 40_000, True), (2, 45_000, False)]


def test_rules_take_one_fact_shuffle(spark, x):
    """All rules over player ticks: sessions are dealt once, and once more no tick moves."""
    t = ru.player_ticks(x.cars.repartition("session_uid"))
    t = rain_in(t).withColumns({"yellow": F.expr(YELLOW), "chequered": c("tick") >= 150, "p1": plans(t)["p1"], "p2": plans(t)["p2"], "target": stops(t)["target"], "compound": stops(t)["compound"], "zone_idx": F.lit(0), "final_zone": F.lit(0)})
    plan = ru.said(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(session_uid") == 1 and plan.count("Exchange") <= 2  # the other numbers the fixture's events


def test_downsample_stream_equals_batch(spark, x, tmp_path):
    st = x.events.select(c("user_id").alias("session_uid"), c("ts").cast("timestamp").alias("ts"), c("event_id").alias("recv_seq"), "value")
    end = st.agg(F.max("ts")).first()[0]
    want = rows(tk.downsample(st).where(c("second") < F.lit(end) - F.expr("interval 11 seconds")))
    out = jobs.downsample(land(st, f"{tmp_path}/in", ["recv_seq"]))
    jobs.drain(out, f"{tmp_path}/cp", path=f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out").where(c("second") < F.lit(end) - F.expr("interval 11 seconds"))
    assert want and rows(got.select("session_uid", "second", "recv_seq", "value")) == want


def test_debounce_stream_equals_batch(spark, x, tmp_path):
    trig = tk.strategy_triggers(x.cars).where(c("severity") == "CRITICAL")
    closing = trig.agg(F.max("at_ms").alias("at_ms")).select(F.lit(-1).cast("bigint").alias("session_uid"), (c("at_ms") + 600000).alias("at_ms"))
    ev = trig.select("session_uid", "at_ms").unionByName(closing).select("session_uid", F.timestamp_millis("at_ms").alias("ts"))
    out = jobs.debounce(land(ev, f"{tmp_path}/in", ["ts"]))
    jobs.drain(out, f"{tmp_path}/cp", path=f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out").where(c("session_uid") >= 0).select("session_uid", F.unix_millis("fire_at").alias("fire_ms"), "triggers")
    want = rows(tk.debounce(trig))
    assert want and rows(got) == want


def test_packet_stats_update_mode(spark, x, tmp_path):
    p = x.events.select(c("user_id").alias("session_uid"), c("event_type").alias("packet_id"), (c("value") + 29).alias("size"), c("event_id").alias("recv_ms"))
    newest = {}

    def keep(batch, batch_id):
        newest.update({(r.session_uid, r.packet_id): (r.packets, round(r.avg_size, 6), round(r.per_second, 6)) for r in batch.collect()})

    jobs.drain(jobs.packet_stats(land(p, f"{tmp_path}/in", ["recv_ms"])), f"{tmp_path}/cp", mode="update", sink=keep)
    want = {(r.session_uid, r.packet_id): (r.packets, round(r.avg_size, 6), round(r.per_second, 6)) for r in dash.packet_stats(p).collect()}
    assert newest == want


def test_first_packets_and_insert_absent_sink(spark, x, tmp_path):
    p = x.events.select(c("user_id").alias("session_uid"), c("event_type").alias("kind"), c("ts").cast("timestamp").alias("ts"), c("event_id").alias("seq"))
    stream = jobs.first_packets(land(p, f"{tmp_path}/in", ["seq"]), late="400 days")
    sink = jobs.insert_absent_sink(f"{tmp_path}/out", ["session_uid", "kind"], "seq")
    jobs.drain(stream, f"{tmp_path}/cp", sink=sink)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == p.select("session_uid", "kind").distinct().count()
    sink(p, 99)  # a replayed batch adds nothing
    assert spark.read.parquet(f"{tmp_path}/out").count() == got.select("session_uid", "kind").distinct().count()


def test_upsert_sink_last_write_wins(spark, tmp_path):
    make = lambda v, q: spark.createDataFrame([(1, v, 10 * v, q), (2, v, 10 * v, q)], "k int, fixed int, v int, q int")
    sink = jobs.upsert_sink(f"{tmp_path}/t", ["k"], "q", keep=("fixed",))
    from apexframe.sources import tables as tb

    sink(make(1, 1), 0)
    sink(make(2, 2).where("k = 1"), 1)
    assert rows(tb.current(spark, f"{tmp_path}/t").select("k", "fixed", "v")) == [(1, 1, 20), (2, 1, 10)]


def test_session_end_sink_routes_by_kind(spark):
    seen = {}
    sink = jobs.session_end_sink(lambda d: seen.update(tracks=rows(d)), lambda d: seen.update(races=rows(d)))
    data = [(1, "ended", "PRACTICE", 3), (2, "ended", "RACE", 4), (3, "started", "RACE", 5), (4, "ended", "QUALIFYING", 6)]
    sink(spark.createDataFrame(data, "session_uid int, kind string, session_kind string, track_id int"), 0)
    assert seen == {"tracks": [(3,)], "races": [(2,)]}


def test_packets_decode_in_a_stream(spark, x, tmp_path):
    from apexframe.plans.io import car_packets
    from apexframe.sources import packets as pk

    p = car_packets(x, "lap", {"last_lap_ms": c("last_lap_ms"), "car_position": c("pos"), "sector": c("sector")})
    p.write.parquet(f"{tmp_path}/raw")
    landed = spark.read.parquet(f"{tmp_path}/raw")
    cols = ["recv_seq", "session_uid", "car_slot", "last_lap_ms", "car_position", "sector"]
    out = pk.cars(land(landed, f"{tmp_path}/in", ["recv_seq"]), "lap").select(*cols)
    jobs.drain(out, f"{tmp_path}/cp", path=f"{tmp_path}/out")
    want = rows(pk.cars(landed, "lap").select(*cols))
    assert want and rows(spark.read.parquet(f"{tmp_path}/out")) == want


def test_stream_resumes_from_its_checkpoint(spark, tmp_path):
    schema = "session_uid int, tick bigint, fw_dmg int, rw_dmg int, fl_dmg int, diff_dmg int, sp_dmg int, pit_state string, kind string"
    part = lambda t, v: spark.createDataFrame([(1, t, v, 0, 0, 0, 0, "ON_TRACK", "RACE")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for t, v in ((0, 35), (1, 36), (2, 65)):
        part(t, v)
        stream = jobs.read_parquet(spark, f"{tmp_path}/in", schema)
        jobs.drain(ru.said(stream, "Damage", engine=sm.Stateful()), f"{tmp_path}/cp", path=f"{tmp_path}/out")
    got = [(r.tick, r.text) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("tick").collect()]
    assert got == [(0, "Front wing is damaged."), (2, "Front wing is heavily damaged.")]

"""Tick analytics: gaps, rankings, best laps, triggers, debounce, throttle, zones.

State ticks come once per second (see ``downsample``) and the session clock is a 16-bit count of
seconds, so one car's walk through a session has at most 65,536 rows. These walks therefore use one
window per car or session; pass a ``span`` to cut them up anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexframe.functions import stats

c = F.col
TICK = ["session_uid", "tick"]
CAR = ["session_uid", "car"]


def by_pos():
    """A tick has at most 22 cars, so windows inside one tick are short by construction."""
    return Window.partitionBy(*TICK).orderBy("pos")


def racing() -> Column:
    return (c("result_status") > 1) & (c("result_status") < 4)


def gap_to_leader(cars: DataFrame) -> DataFrame:
    """Running sum of the gaps ahead in position order; one second per place if the feed has none."""
    front = F.greatest(c("delta_front_ms"), F.lit(0))
    run = F.sum(front).over(by_pos().rowsBetween(Window.unboundedPreceding, 0))
    any_gap = F.max(front).over(Window.partitionBy(*TICK)) > 0
    out = cars.where(racing()).withColumn("_run", run).withColumn("_any", any_gap)
    return out.withColumn("gap_ms", F.when(c("_any"), c("_run")).otherwise((c("pos") - 1) * 1000)).drop("_run", "_any")


def session_bests(cars: DataFrame, span: int = 0) -> DataFrame:
    lap = F.when(c("last_lap_ms") > 0, c("last_lap_ms"))
    return stats.along(cars, CAR, "tick", running={"best_ms": ("min", lap)}, span=span)


def pace_rank(cars: DataFrame) -> DataFrame:
    """Rank of each car's best lap so far within its tick; null while it has none."""
    best = session_bests(cars)
    rank = F.rank().over(Window.partitionBy(*TICK).orderBy(F.asc_nulls_last("best_ms")))
    return best.withColumn("pace_rank", F.when(c("best_ms").isNotNull(), rank))


def timesheet_gap(cars: DataFrame) -> DataFrame:
    """The leader's gap to second, everyone else's gap to the car one place up the timesheet."""
    w = Window.partitionBy(*TICK).orderBy("best_ms", "car")
    timed = session_bests(cars).where(c("best_ms").isNotNull())
    ahead, behind = F.lag("best_ms").over(w), F.lead("best_ms").over(w)
    place = F.row_number().over(w)
    gap = F.when(place == 1, behind - c("best_ms")).otherwise(c("best_ms") - ahead)
    return timed.withColumn("place", place).withColumn("gap_ms", gap)


def completed_laps(cars: DataFrame, span: int = 0) -> DataFrame:
    """Rollover ticks whose lap splits into three positive sectors."""
    seen = stats.along(cars, CAR, "tick", lags={"p1": "s1_ms", "p2": "s2_ms", "plap": "lap"}, span=span)
    ok = (c("last_lap_ms") > 0) & (c("lap") > c("plap")) & (c("p1") > 0) & (c("p2") > 0)
    ok = ok & (c("last_lap_ms") > c("p1") + c("p2"))
    return seen.where(ok).withColumn("p3", c("last_lap_ms") - c("p1") - c("p2"))


def best_laps(cars: DataFrame) -> DataFrame:
    """Best whole lap per car with the sectors of that lap, running cars ranked first."""
    best = completed_laps(cars).groupBy(*CAR).agg(
        F.min_by(F.struct("last_lap_ms", "p1", "p2", "p3"), F.struct("last_lap_ms", "tick")).alias("b")
    )
    last = cars.groupBy(*CAR).agg(F.max_by(F.struct("pos", "result_status"), "tick").alias("l"))
    every = last.join(best, CAR, "left").where(c("l.result_status") >= 2)
    out = c("l.result_status") >= 4
    order = Window.partitionBy("session_uid").orderBy(out, F.asc_nulls_last("b.last_lap_ms"), "l.pos", "car")  # 22 cars at most
    return every.select(
        *CAR, F.when(~out, F.row_number().over(order)).alias("place"), out.alias("out"), c("b.last_lap_ms").alias("best_lap"),
        c("b.p1").alias("s1"), c("b.p2").alias("s2"), c("b.p3").alias("s3"),
    )


def overall_bests(cars: DataFrame) -> DataFrame:
    """Fastest sectors and lap of the whole field; sectors may come from any lap."""
    laps = completed_laps(cars).groupBy("session_uid").agg(F.min("p3").alias("s3"), F.min("last_lap_ms").alias("lap"))
    pos = lambda n: F.min(F.when(c(n) > 0, c(n)))
    live = cars.groupBy("session_uid").agg(pos("s1_ms").alias("s1"), pos("s2_ms").alias("s2"))
    return live.join(laps, "session_uid", "left")


def last_player_laps(cars: DataFrame, n: int = 5) -> DataFrame:
    done = cars.where((c("ai") == 0) & (c("last_lap_ms") > 0) & (c("lap") >= 2)).withColumn("done_lap", c("lap") - 1)
    seen = stats.along(done, ["session_uid"], "tick", running={"_top": ("max", c("done_lap"), "prior")})
    new = seen.where(c("_top").isNull() | (c("done_lap") > c("_top"))).select("session_uid", "done_lap", "last_lap_ms", "tyre")
    return stats.top_per_group(new, ["session_uid"], [F.desc("done_lap")], n).drop("rn")


def sector_history(cars: DataFrame, n: int = 6) -> DataFrame:
    """Each car's newest completed sectors (own times)."""
    seen = stats.along(cars, CAR, "tick", lags={"p1": "s1_ms", "p2": "s2_ms", "psec": "sector", "plap": "lap"}, span=0)
    ms = (
        F.when((c("psec") == 0) & (c("sector") == 1), c("s1_ms"))
        .when((c("psec") == 1) & (c("sector") == 2), c("s2_ms"))
        .when((c("psec") == 2) & (c("sector") == 0) & (c("last_lap_ms") > 0) & (c("p2") > 0), c("last_lap_ms") - c("p1") - c("p2"))
    )
    done = seen.withColumn("ms", ms).where(c("ms") > 0).select(
        *CAR, "tick", F.when(c("psec") == 2, c("plap")).otherwise(c("lap")).alias("lap"), c("psec").alias("sector"), "ms"
    )
    return stats.top_per_group(done, CAR, [F.desc("tick")], n)


def neighbour_deltas(cars: DataFrame) -> DataFrame:
    """Player against the cars directly ahead and behind over their newest common sectors."""
    last = cars.groupBy("session_uid").agg(F.max("tick").alias("tick"))
    now = cars.join(last, TICK).where(c("result_status") < 4)
    near = now.select(
        "session_uid", "car", "ai", "name", F.lag("car").over(by_pos()).alias("ahead"), F.lead("car").over(by_pos()).alias("behind"),
        F.lag("name").over(by_pos()).alias("n_ahead"), F.lead("name").over(by_pos()).alias("n_behind"),
    ).where(c("ai") == 0)
    pair = near.select(
        "session_uid", "car",
        F.inline(F.array(
            F.struct(F.lit("ahead").alias("side"), c("ahead").alias("other"), c("n_ahead").alias("other_name")),
            F.struct(F.lit("behind").alias("side"), c("behind").alias("other"), c("n_behind").alias("other_name")),
        )),
    ).where(c("other").isNotNull())
    hist = sector_history(cars)
    mine = hist.select("session_uid", "car", "lap", "sector", c("ms").alias("mine"), "rn")
    theirs = hist.select("session_uid", c("car").alias("other"), "lap", "sector", c("ms").alias("theirs"))
    common = pair.join(mine, CAR).join(theirs, ["session_uid", "other", "lap", "sector"])
    per = common.groupBy("session_uid", "side", "other_name").agg(
        F.array_sort(F.collect_list(F.struct("rn", (c("theirs") - c("mine")).alias("d")))).alias("a")  # six at most
    )
    newest = F.reverse(F.slice("a", 1, 3))
    code = F.upper(F.left("other_name", F.lit(3)))
    return per.select("session_uid", "side", code.alias("code"), F.transform(newest, lambda e: e["d"]).alias("deltas"))


def neighbours(cars: DataFrame) -> DataFrame:
    return cars.withColumn("ahead", F.lag("car").over(by_pos())).withColumn("behind", F.lead("car").over(by_pos()))


def _tick_summary(cars: DataFrame) -> DataFrame:
    """One row per tick: leader lap, player values and shared state."""
    player = lambda n: F.max(F.when(c("ai") == 0, c(n)))
    return cars.groupBy(*TICK).agg(
        F.coalesce(F.max(F.when(c("pos") == 1, c("lap"))), F.lit(0)).alias("leader_lap"),
        *[player(n).alias(f"p_{n}") for n in ("lap", "sector", "pos", "pit_status")],
        F.max("safety_car").alias("safety_car"), F.max("weather").alias("weather"), F.max("at_ms").alias("at_ms"),
        F.bool_or(c("_entry")).alias("entry"), F.bool_or(c("_count_up") & (c("ai") == 0)).alias("own_stop"),
        F.bool_or(c("_count_up") & (c("ai") != 0)).alias("ai_stop"),
    )


def _with_changes(cars: DataFrame, span: int) -> DataFrame:
    seen = stats.along(cars, CAR, "tick", lags={"_pit": "pit_status", "_pits": "pits"}, span=span)
    seen = seen.withColumn("_entry", (c("pit_status") > 0) & (F.coalesce("_pit", F.lit(0)) == 0))
    seen = seen.withColumn("_count_up", c("pits") > F.coalesce("_pits", F.lit(0)))
    prior = {f"q_{n}": ("last", c(f"p_{n}"), "prior") for n in ("lap", "sector", "pos", "pit_status")}
    return stats.along(
        _tick_summary(seen), ["session_uid"], "tick",
        lags={"q_leader": "leader_lap", "q_sc": "safety_car", "q_weather": "weather"}, running=prior, span=span,
    )


def _moved(name: str) -> Column:
    return F.coalesce(c(f"p_{name}") != c(f"q_{name}"), F.lit(False))


def projection_triggers(cars: DataFrame, span: int = 0) -> DataFrame:
    """Ticks that start a new projection in a race."""
    t = _with_changes(cars, span)
    leader = F.coalesce((c("leader_lap") > c("q_leader")) & (c("q_leader") > 0), F.lit(False))
    rejoined = F.coalesce((c("q_pit_status") > 0) & (c("p_pit_status") == 0), F.lit(False))
    sc = c("safety_car") != F.coalesce("q_sc", F.lit(0))
    fire = leader | c("entry") | _moved("sector") | _moved("pos") | rejoined | sc
    return t.where(fire).select(*TICK, "at_ms", leader.alias("leader_lap"), "entry", rejoined.alias("rejoined"), sc.alias("safety_car"))


def strategy_triggers(cars: DataFrame, span: int = 0) -> DataFrame:
    """Ticks that start a strategy run, with the severity that decides throttling."""
    t = _with_changes(cars, span)
    lap = F.coalesce((c("p_lap") > c("q_lap")) & (c("q_lap") > 0), F.lit(False))
    rejoined = F.coalesce((c("q_pit_status") > 0) & (c("p_pit_status") == 0), F.lit(False))
    sc = c("safety_car") != F.coalesce("q_sc", F.lit(0))
    weather = F.coalesce(c("weather") != c("q_weather"), F.lit(False))
    critical = lap | rejoined | c("own_stop") | sc | weather
    normal = _moved("sector") | _moved("pos") | c("ai_stop")
    level = F.when(critical, "CRITICAL").when(normal, "NORMAL")
    return t.withColumn("severity", level).where(c("severity").isNotNull()).select(*TICK, "at_ms", c("p_lap").alias("lap"), "severity")


def throttle(triggers: DataFrame, cap: int = 2, span: int = 0) -> DataFrame:
    """At most ``cap`` NORMAL triggers per player lap; CRITICAL ones always pass."""
    n = {"_n": ("count", F.when(c("severity") == "NORMAL", 1))}
    seen = stats.along(triggers, ["session_uid", "lap"], "tick", running=n, span=span)
    return seen.where((c("severity") == "CRITICAL") | (c("_n") <= cap)).drop("_n")


def debounce(triggers: DataFrame, seconds: int = 3) -> DataFrame:
    """One firing per burst: each trigger restarts the timer, the run starts when it expires."""
    timed = triggers.withColumn("ts", F.timestamp_millis("at_ms"))
    w = F.session_window("ts", f"{seconds} seconds")
    per = timed.groupBy("session_uid", w).agg(F.count("*").alias("triggers"))
    return per.select("session_uid", F.unix_millis("session_window.end").alias("fire_ms"), "triggers")


def idle_floor(runs: DataFrame, ends: DataFrame, floor_ms: int = 5000, span: int = 1 << 22) -> DataFrame:
    """Extra runs every five seconds wherever nothing ran, up to the end of the session."""
    nxt = stats.along(runs.withColumn("_back", -c("fire_ms")), ["session_uid"], "_back", lags={"_next": "fire_ms"}, span=span)
    gap = nxt.join(ends, "session_uid").withColumn("_until", F.coalesce("_next", "end_ms"))
    times = F.sequence(c("fire_ms") + floor_ms, c("_until") - 1, F.lit(floor_ms).cast("bigint"))
    fills = gap.where(c("_until") - c("fire_ms") > floor_ms)
    idle = fills.select("session_uid", F.explode(times).alias("fire_ms"), F.lit("idle").alias("cause"))
    return runs.select("session_uid", "fire_ms", F.lit("trigger").alias("cause")).unionByName(idle)


def downsample(states: DataFrame) -> DataFrame:
    """The newest state of each second per session (one-second tumbling windows)."""
    names = [n for n in states.columns if n not in ("session_uid", "ts")]
    per = states.groupBy("session_uid", F.window("ts", "1 second").alias("_w")).agg(
        F.max_by(F.struct("ts", *names), F.struct("ts", "recv_seq")).alias("s")
    )
    return per.select("session_uid", c("_w.start").alias("second"), *[c(f"s.{n}").alias(n) for n in names])


def liveness(states: DataFrame, as_of: Column, seconds: float = 5.0) -> DataFrame:
    last = states.groupBy("session_uid").agg(F.max("ts").alias("last_ts"))
    return last.withColumn("live", F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(c("last_ts").cast("timestamp")) < int(seconds * 1_000_000))


def outside_rewind(messages: DataFrame, rewinds: DataFrame, quiet_ms: int = 4000) -> DataFrame:
    """Messages not sent within four seconds after a rewind."""
    seen = stats.asof(messages, rewinds, ["session_uid"], "at_ms", {"_rewind": "at_ms"}, span=1 << 22)
    return seen.where(c("_rewind").isNull() | (c("at_ms") - c("_rewind") >= quiet_ms)).drop("_rewind")


def relevant_retirements(cars: DataFrame) -> DataFrame:
    """Retirements within two places of the player; an unknown place counts as relevant."""
    gone = stats.along(cars, CAR, "tick", lags={"_was": "result_status"}, span=0).where(
        (c("result_status") == 4) & (F.coalesce("_was", F.lit(0)) != 4)
    )
    player = cars.where(c("ai") == 0).select(*TICK, c("pos").alias("player_pos"))
    near = (F.abs(c("pos") - c("player_pos")) <= 2) | c("player_pos").isNull() | (c("pos") <= 0)
    return gone.join(player, TICK, "left").where(near).select(*TICK, "car", "pos", "player_pos")


def zone_of(rows_: DataFrame, zones: DataFrame, lead_s: float = 3.0) -> DataFrame:
    """First zone holding the car, each zone opening three seconds of travel early.

    A track's zones ride along as one short array, joined on the track. -1 means outside every zone;
    a track without zones counts as zone 0 throughout.
    """
    per = zones.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("zone_idx", "from_m", "to_m"))).alias("_z"))
    early = c("speed") / 3.6 * lead_s
    hit = F.filter("_z", lambda z: (c("lap_distance") >= z["from_m"] - early) & (c("lap_distance") <= z["to_m"]))
    out = rows_.join(per, "track_id", "left")
    found = F.coalesce(F.get(hit, F.lit(0))["zone_idx"], F.lit(-1))
    return out.withColumn("zone_idx", F.when(c("_z").isNull(), 0).otherwise(found)).drop("_z")


def yellow_sectors(zones: Column, track_m: Column, s2: Column, s3: Column) -> Column:
    """Sectors with a yellow marshal zone, by real boundaries or even thirds where unknown."""
    real = (s2 > 0) & (s3 > s2)

    def sector(z: Column) -> Column:
        m = z["zone_start"] * track_m
        third = F.least(F.lit(2), F.greatest(F.lit(0), F.floor(z["zone_start"] * 3))).cast("int")
        return F.when(real, F.when(m < s2, 0).when(m < s3, 1).otherwise(2)).otherwise(third)

    return F.array_sort(F.array_distinct(F.transform(F.filter(zones, lambda z: z["zone_flag"] == 3), sector)))


def current_lap(cars: DataFrame) -> DataFrame:
    lap = F.coalesce(F.max(F.when(c("pos") == 1, c("lap"))), F.max("lap"))
    return cars.groupBy(*TICK).agg(lap.alias("current_lap"))


# Display labels.
WEATHER_LABELS = ("Clear", "Light Cloud", "Overcast", "Light Rain", "Heavy Rain", "Storm")


def session_labels(ticks: DataFrame) -> DataFrame:
    """Header fields: m:ss remaining, whether to show it, weather and safety-car names."""
    left = c("time_left")
    weather = F.lit(None).cast("string")
    for i, name in enumerate(WEATHER_LABELS):
        weather = F.when(c("weather") == i, name).otherwise(weather)
    sc = F.when(c("safety_car") == 1, "Full SC").when(c("safety_car") == 2, "VSC").when(c("safety_car") == 3, "Formation Lap")
    return ticks.select(
        "session_uid", "seq", F.format_string("%d:%02d", F.floor(left / 60), left % 60).alias("remaining"),
        (c("session_type").between(1, 9) | (c("session_type") == 14)).alias("show_remaining"),
        F.coalesce(weather, F.concat(F.lit("Weather "), c("weather").cast("string"))).alias("weather_label"),
        sc.otherwise("SC").alias("safety_car_label"),
    )

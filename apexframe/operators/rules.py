"""Alert rules over player ticks, written as what they remember of earlier ticks.

A rule is a generator (see ``memory``): it is handed the condition under which a tick counts for it, its gate, asks
for look-backs, and returns messages. A gated-out tick never touches its look-backs. ``said`` runs any set of rules
in one pass over the ticks, in a batch or a stream, and gives (session_uid, tick, rule, priority, ttl_laps, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexframe.functions import rows
from apexframe.functions import text as tx
from apexframe.operators import ticks as tk
from apexframe.operators.memory import Engine, Message, count, lag, last, latch, least, most, remembered, spoken
from apexframe.streaming import latches as lt

c = F.col
# Fixed values throughout this module: message texts, priorities, lifetimes in laps and thresholds.
OUT = ["session_uid", "tick", "rule", "priority", "ttl_laps", "text"]
PRACTICE, QUALIFYING, RACE = "PRACTICE", "QUALIFYING", "RACE"
# Pit states and session kinds each rule applies to (None means every one).
ON = ("ON_TRACK",)
GATES = {
    "SessionStartGreeting": (ON, None), "FlagChanges": (None, None), "YellowFlag": (None, None),
    "FastestLapByRival": (None, (PRACTICE, QUALIFYING, RACE)), "Penalties": (None, None), "TyreCondition": (None, None),
    "PerCornerWear": (None, None), "Damage": (None, None), "Drs": (None, None), "ErsMode": (None, None),
    "Weather": (None, None), "InvalidLap": (ON, (PRACTICE, QUALIFYING, RACE)), "CarBehind": (ON, (RACE,)),
    "CarAhead": (ON, (RACE,)), "LapCountdown": (None, (RACE,)), "PositionChange": (ON, (RACE,)),
    "PitStopCompleted": (None, (RACE,)), "PitWindowMessages": (None, (RACE,)), "StrategySummary": (ON, (RACE,)),
    "PeriodicSituationalAwareness": (ON, (RACE,)), "RaceLapComplete": (ON, (RACE,)), "RaceFinish": (None, (RACE,)),
    "QualifyingSectorDelta": (None, (QUALIFYING,)), "QualifyingLapComplete": (None, (QUALIFYING,)),
    "PracticeTyreFuelSummary": (ON, (PRACTICE,)), "PracticeLapComplete": (ON, (PRACTICE,)),
    "PracticeSectorComparison": (ON, (PRACTICE,)), "PracticeSpeedTrap": (ON, (PRACTICE,)),
    "TrackTrafficExit": (("PIT_EXIT",), (PRACTICE, QUALIFYING)), "SlowLapTrafficWarning": (ON, (PRACTICE,)),
}


STOP_KMH = 5
BEFORE_ALL = -(2**62)
NEAR = ("car", "name", "lap", "lap_distance", "delta_front_ms", "result_status", "pit_status", "speed", "tyre", "tyre_age", "worn")
FIELD = ("car", "name", "ai", "pos", "lap", "sector", "s1_ms", "s2_ms", "last_lap_ms", "speed_trap", "pit_status", "pits", "lap_distance", "result_status")


def around(cars: DataFrame) -> DataFrame:
    """One row per tick: the player, the cars one place ahead and behind, and the field of at most 22 cars.

    Everything of a tick comes from its own rows, which lie together once sessions do.
    """
    from pyspark.sql import Window

    wide = cars.withColumn("worn", F.greatest("wear_rl", "wear_rr", "wear_fl", "wear_fr"))
    side = F.struct("pos", *NEAR)
    whole = Window.partitionBy(*tk.TICK)
    both = wide.withColumns({
        "_a": F.lag(side).over(tk.by_pos()), "_b": F.lead(side).over(tk.by_pos()), "field": F.collect_list(F.struct(*FIELD)).over(whole)})
    player = both.where(c("ai") == 0)
    player = player.withColumn("ahead", F.when(c("_a.pos") == c("pos") - 1, c("_a"))).withColumn(
        "behind", F.when(c("_b.pos") == c("pos") + 1, c("_b"))
    )
    return labelled(player.drop("_a", "_b"))


def from_documents(ticks: DataFrame, cars: str = "cars") -> DataFrame:
    """As ``around``, from one row per tick holding its cars as an array; needs no shuffle, so it serves streams."""
    worn = F.transform(cars, lambda x: x.withField("worn", F.greatest(x["wear_rl"], x["wear_rr"], x["wear_fl"], x["wear_fr"])))
    t = ticks.withColumn(cars, worn).withColumn("_me", F.get(F.filter(cars, lambda x: x["ai"] == 0), F.lit(0))).where(c("_me").isNotNull())
    side = lambda place: F.get(F.transform(
        F.filter(cars, lambda x: x["pos"] == c("_me.pos") + place), lambda x: F.struct(x["pos"].alias("pos"), *[x[n].alias(n) for n in NEAR])), F.lit(0))
    field = F.transform(cars, lambda x: F.struct(*[x[n].alias(n) for n in FIELD]))
    own = [n for n in ticks.columns if n != cars]
    return labelled(t.select(*own, *[c(f"_me.{n}").alias(n) for n in t.select("_me.*").columns if n not in own], side(-1).alias("ahead"), side(1).alias("behind"), field.alias("field")))


def labelled(player: DataFrame) -> DataFrame:
    return player.withColumns({
        "kind": rows.session_kind(c("session_type")), "letter": tx.code_letter(c("tyre")), "track_m": F.lit(5000), "total_laps": F.lit(20)})


def player_ticks(cars: DataFrame) -> DataFrame:
    """One row per tick: the player, the cars around, the field, pit state and kind."""
    return with_pit_state(around(cars))


def pit_state(on: Column):
    """The state of a tick and of the one before.

    Status 0 and 2 decide alone. In a run of status 1 the car enters, has stopped from its first slow tick on, and
    exits from the first fast tick after that; a run that starts from a stop, or with the session, has already
    stopped. After an entry from the track, or at the begin, speed counts only from the run's second tick on.
    """
    lane = c("pit_status") == 1
    q = yield {"was": lag("pit_status"), "came": last("pit_status", ~lane), "since": last("tick", ~lane)}
    later = lane & F.coalesce(q.was == 1, F.lit(False))
    stopped_before = q.came.isNull() | (q.came != 0)
    since = F.coalesce(q.since, F.lit(BEFORE_ALL))
    fast = (later | (lane & (q.came == 2))) & (c("speed") >= STOP_KMH)
    s = yield {"slow": last("tick", later & (c("speed") < STOP_KMH), prior=False)}
    stopped = stopped_before | F.coalesce(s.slow > since, F.lit(False))
    e = yield {"left": last("tick", fast & stopped, prior=False)}
    state = (
        F.when(c("pit_status") == 0, "ON_TRACK").when(c("pit_status") == 2, "PIT_STOPPED")
        .when(F.coalesce(e.left > since, F.lit(False)), "PIT_EXIT").when(stopped, "PIT_STOPPED").otherwise("PIT_ENTRY")
    )
    p = yield {"prev": lag(state)}
    return state, F.coalesce(p.prev, state)


def with_pit_state(ticks: DataFrame, engine: Engine | None = None) -> DataFrame:
    out, found = remembered(ticks, {"pit": (pit_state, F.lit(True))}, engine)
    state, prev = found["pit"]
    return out.select(*ticks.columns, state.alias("pit_state"), prev.alias("prev_pit_state"))


def gate(rule: str) -> Column:
    """Ticks that count for a rule."""
    states, kinds = GATES[rule]
    on = F.lit(True)
    if states:
        on = on & c("pit_state").isin(*states)
    return on & c("kind").isin(*kinds) if kinds else on


def said(ticks: DataFrame, *names: str, engine: Engine | None = None) -> DataFrame:
    """Messages of the rules ``names`` (all of ``RULES`` if none are given) from one pass over the ticks."""
    out, messages = evaluated(ticks, *names, engine=engine)
    return spoken(out, messages)


def evaluated(ticks: DataFrame, *names: str, engine: Engine | None = None) -> tuple[DataFrame, list[Message]]:
    """The ticks with all that the rules remember, and the rules' messages over them."""
    wanted = {n: (RULES[n], F.coalesce(gate(n), F.lit(False))) for n in names or RULES}
    out, found = remembered(ticks, wanted, engine)
    return out, [m for each in found.values() for m in each]


def gated_counts(ticks: DataFrame) -> DataFrame:
    """How many ticks each rule is evaluated on, from one pass over the ticks."""
    names = lambda v: F.array(*[F.lit(s) for s in v]) if v else F.array().cast("array<string>")
    shaped = [
        F.struct(F.lit(r).alias("rule"), names(states).alias("states"), names(kinds).alias("kinds"))
        for r, (states, kinds) in GATES.items()
    ]
    ok = lambda e: (
        ((F.size(e["states"]) == 0) | F.array_contains(e["states"], c("pit_state")))
        & ((F.size(e["kinds"]) == 0) | F.array_contains(e["kinds"], c("kind")))
    )
    rule = F.explode(F.transform(F.filter(F.array(*shaped), ok), lambda e: e["rule"]))
    return ticks.select("session_uid", rule.alias("rule")).groupBy("session_uid", "rule").agg(F.count("*").alias("n"))


def say(df: DataFrame, rule: str, priority: str | Column, ttl: int | Column, text: Column) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = df.withColumn("rule", F.lit(rule)).withColumn("priority", lit(priority)).withColumn("ttl_laps", lit(ttl))
    return out.withColumn("text", text).where(c("text").isNotNull()).select(*OUT)


def cat(*parts: str | Column) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _or_no(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def greeting(on: Column):
    start = on & (c("speed") >= 30)
    q = yield {"said": count(start)}
    tyres = tx.capitalize(cat(tx.spoken_tyre(c("letter")), "s"))
    tyres = F.when(c("letter").isNull(), "Tyres").otherwise(tyres)
    # Handling notes and session labels.
    notes = {
        "S": "peak grip after a single warm-up lap, watch for graining", "M": "balanced grip, settles after a couple of laps",
        "H": "slow warm-up, expect understeer for the first few laps",
        "I": "intermediate compound, treat them gently in the dry sections", "W": "full wet compound, aquaplaning risk above 200",
    }
    labels = {1: "P1", 2: "P2", 3: "P3", 5: "Q1", 6: "Q2", 7: "Q3", 8: "Short qualifying", 9: "One-shot qualifying", 14: "Sprint qualifying"}
    from apexframe.dims import lookup

    note = lookup(notes, c("letter"))
    label = lookup(labels, c("session_type"), F.when(c("kind") == PRACTICE, "Practice").otherwise("Qualifying"))
    fitted = cat(tyres, " fitted", F.coalesce(cat(" — ", note), F.lit("")))
    text = (
        F.when(c("kind") == PRACTICE, cat(label, " underway. ", fitted, ". Push when you have a window."))
        .when(c("kind") == QUALIFYING, cat(label, " underway. ", fitted, ". Send it on a clear lap."))
        .when(c("kind") == RACE, cat("Clutch paddle in position. You start on ", F.lower(tyres), ". Settle in, we'll talk strategy."))
        .when(c("kind") == "TIME_TRIAL", cat("Time trial. ", tyres, " on. Push for a clean lap."))
        .otherwise("Radio check. All systems go.")
    )
    return [Message("SessionStartGreeting", start & (q.said == 0), "NORMAL", 3, text)]


def flag_changes(on: Column):
    q = yield {"was": lag("safety_car", on)}
    over = on & (q.was > 0) & (c("safety_car") == 0)
    return [Message("FlagChanges", over, "IMMEDIATE", 2, "Safety car coming in. Green flag next lap. Push now, push now.")]


def penalties(on: Column):
    u = c("unserved_dt") + c("unserved_sg")
    q = yield {"u": lag(u, on), "dt": lag("unserved_dt", on), "w": lag("warnings", on), "p": lag("pen", on)}
    was = lambda n: F.coalesce(n, F.lit(0))
    kind = F.when(c("unserved_dt") > was(q.dt), "drive-through").otherwise("stop-go")
    unserved, warned, added = u > was(q.u), c("warnings") > was(q.w), c("pen") > was(q.p)
    text = (
        F.when(unserved, cat("You have an unserved ", kind, " penalty. Box this lap."))
        .when(warned, cat("Track limits warning. That's warning number ", c("warnings"), ". Be careful."))
        .when(added, cat("Penalty received. ", c("pen") - was(q.p), " seconds added. We'll talk strategy."))
    )
    high = ~unserved & ~warned
    return [Message("Penalties", on, F.when(high, "HIGH").otherwise("IMMEDIATE"), F.when(high, 3).otherwise(2), text)]


def tyre_condition(on: Column):
    """Each age limit once per set; a younger age than before is a new set."""
    q = yield {"was": lag("tyre_age", on)}
    new = on & (c("tyre_age") < F.coalesce(q.was, F.lit(0)))
    old, aged = on & ~new & (c("tyre_age") >= 30), on & ~new & (c("tyre_age") >= 20)
    s = yield {"fitted": last("tick", new, prior=False), "old": last("tick", old), "aged": last("tick", aged)}
    once = lambda at: ~_or_no(at >= F.coalesce(s.fitted, F.lit(BEFORE_ALL)))
    spoken_tyre = tx.spoken_tyre(c("letter"))
    done, worn = old & once(s.old), aged & (c("tyre_age") < 30) & once(s.aged)
    text = (
        F.when(new, cat("New ", spoken_tyre, "s on, easy on the exit."))
        .when(done, cat("Tyres are ", c("tyre_age"), " laps old and degrading. Box soon."))
        .when(worn, cat(tx.capitalize(spoken_tyre), " tyres are ", c("tyre_age"), " laps old. Consider a pit stop."))
    )
    return [Message("TyreCondition", on, F.when(done, "HIGH").otherwise("NORMAL"), F.when(new, 1).when(done, 2).otherwise(3), text)]


def drs(on: Column):
    """Silent, and without memory, while the driver has the DRS assist."""
    on = on & (F.coalesce("drs_assist", F.lit(0)) == 0)
    q = yield {"was": lag("drs_allowed", on)}
    return [Message("Drs", on & (c("drs_allowed") > 0) & (F.coalesce(q.was, F.lit(0)) == 0), "NORMAL", 1, "DRS enabled.")]


def ers_mode(on: Column):
    """Silent, and without memory, while the driver has the ERS assist."""
    on = on & (F.coalesce("ers_assist", F.lit(0)) == 0) & _or_no(c("ers_mode") >= 0)
    q = yield {"was": lag("ers_mode", on)}
    return [Message("ErsMode", on & (q.was != c("ers_mode")), "NORMAL", 1, cat("ERS mode ", c("ers_mode"), ". Go to strat ", c("ers_mode"), "."))]


def weather(on: Column):
    """Needs ``rain_in``: minutes to the first forecast sample above 30 % rain, null if none. Once per spell of weather;
    the tick at which the weather turns still belongs to the old one."""
    q = yield {"was": lag("weather", on)}
    turned = on & _or_no(q.was != c("weather"))
    hit = on & (c("weather") == 0) & c("rain_in").isNotNull()
    s = yield {"turned": last("tick", turned), "said": last("tick", hit)}
    again = _or_no(s.said > F.coalesce(s.turned, F.lit(BEFORE_ALL)))
    return [Message("Weather", hit & ~again, "NORMAL", 3, cat("Rain expected in ", c("rain_in"), " minutes. Stay out for now."))]


def invalid_lap(on: Column):
    q = yield {"was": lag("lap_invalid", on)}
    hit = on & (c("lap_invalid") != 0) & (F.coalesce(q.was, F.lit(0)) == 0)
    more = F.when(c("corner_cutting") > 0, cat(" That's warning number ", c("corner_cutting"), ".")).otherwise("")
    return [Message("InvalidLap", hit, "IMMEDIATE", 1, cat("That lap's deleted — track limits.", more))]


def _ahead_gap() -> Column:
    return tx.gap_seconds(c("ahead.lap"), c("ahead.lap_distance"), c("lap"), c("lap_distance"), c("track_m"))


def _behind_distance_gap() -> Column:
    return tx.gap_behind_seconds(F.lit(0), c("behind.lap_distance"), c("lap_distance"), c("track_m"))


def car_ahead(on: Column):
    """Crossing into DRS range; ticks on another lap leave the remembered gap alone."""
    none = (c("drs_allowed") <= 0) | (c("pos") <= 1) | c("ahead").isNull()
    gap = F.when(none, F.lit(-1).cast("float")).otherwise(F.when(_ahead_gap() >= 0, _ahead_gap()))
    q = yield {"was": last(gap, on)}
    hit = on & ~none & _or_no((gap >= 0) & (gap < 1)) & ~_or_no((q.was >= 0) & (q.was < 1))
    return [Message("CarAhead", hit, "HIGH", 1, "You have DRS. Attack.")]


def lap_countdown(on: Column):
    on = on & (c("total_laps") > 0)
    q = yield {"was": lag("lap", on)}
    left = c("total_laps") - c("lap") + 1
    text = (
        F.when(left == 10, "10 laps remaining. Keep it clean, manage your tyres.")
        .when(left == 3, "3 laps to go. Bring it home.").when(left == 1, "Last lap. Give it everything you've got.")
    )
    return [Message("LapCountdown", on & (q.was.isNull() | (c("lap") > q.was)), F.when(left == 10, "NORMAL").otherwise("HIGH"), 1, text)]


def position_change(on: Column, quiet_ms: int = 5000):
    """Net change once the position has been steady for five seconds.

    A burst of changes keeps the position from before its first change. Laps right after a stop,
    the opening lap and the first tick start afresh.
    """
    pitted = c("prev_pit_state") != "ON_TRACK"
    q = yield {"pos": lag("pos", on), "ms": lag("at_ms", on), "until": last(c("lap") + 1, on & pitted)}
    fresh = on & (pitted | q.pos.isNull() | (c("lap") <= 1) | _or_no(c("lap") < q.until))
    moved = on & ~fresh & (c("pos") != q.pos)
    s = yield {"fresh": last("tick", fresh, prior=False), "moved": last("tick", moved), "moved_ms": last("at_ms", moved)}
    start = F.coalesce(s.fresh, F.lit(BEFORE_ALL))
    since = F.when(s.moved >= start, s.moved_ms)
    opens = moved & (since.isNull() | (q.ms >= since + quiet_ms))
    b = yield {"base": last(q.pos, opens, prior=False)}
    due = on & ~fresh & ~moved & _or_no((c("at_ms") >= since + quiet_ms) & (q.ms < since + quiet_ms))
    net = b.base - c("pos")
    name = F.coalesce("ahead.name", F.lit("Car ahead"))
    gap = F.when(c("ahead").isNotNull() & (_ahead_gap() >= 0), cat(name, " is next, ", tx.tenths(_ahead_gap()), " seconds up the road."))
    tail = F.coalesce(gap, cat(name, " is next."))
    text = (
        F.when((net > 0) & (c("pos") <= 1), "P1. Leading now.")
        .when(net == 1, cat("P", c("pos"), ". ", tail))
        .when(net > 1, cat("Up ", net, " places. P", c("pos"), ". ", tail))
        .when(net == -1, cat("Lost a place. P", c("pos"), ". ", name, " is now ahead."))
        .when(net < -1, cat("Lost ", -net, " places. P", c("pos"), ". ", name, " is now ahead."))
    )
    return [Message("PositionChange", due, F.when(net > 0, "IMMEDIATE").otherwise("HIGH"), 1, text)]


def _gaps_text() -> Column:
    """Distance gaps to the car ahead and the car behind, each as a sentence or nothing."""
    a = F.when(c("ahead").isNotNull() & (_ahead_gap() >= 0), cat(" ", tx.tenths(_ahead_gap()), " seconds to ", c("ahead.name"), "."))
    b = F.when(c("behind.lap") == c("lap"), cat(" ", tx.tenths(_behind_distance_gap()), " seconds to ", c("behind.name"), "."))
    return cat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def pit_stop_completed(on: Column):
    q = yield {"st": lag("pit_status", on), "n": lag("pits", on)}
    was = F.coalesce(q.st, F.lit(0))
    s = yield {"into": last("at_ms", on & (c("pit_status") > 0) & (was == 0))}
    out = on & (c("pit_status") == 0) & (was > 0) & (c("pits") > F.coalesce(q.n, F.lit(0)))
    took = F.coalesce(((c("at_ms") - s.into) / 1000).cast("float"), F.lit(0).cast("float"))
    return [
        Message("PitStopCompleted", out, "HIGH", 1, cat("Good stop. ", tx.tenths(took), " seconds. Push now.")),
        Message("PitStopRecap", out, "HIGH", 2, cat("Out of the pits in P", c("pos"), ".", _gaps_text())),
    ]


def situational(on: Column):
    """Every third lap once: the previous eligible tick's lap is the lap last spoken about."""
    on = on & (c("lap") > 1) & (c("lap") < c("total_laps")) & (c("lap") % 3 == 0) & (c("ahead").isNotNull() | c("behind").isNotNull())
    q = yield {"was": lag("lap", on)}
    return [Message("PeriodicSituationalAwareness", on & (q.was.isNull() | (q.was != c("lap"))), "NORMAL", 2, cat("P", c("pos"), ".", _gaps_text()))]


def race_lap_complete(on: Column):
    """Each new lap from the second on. A lap going back clears the memory without speaking; of laps going back one
    after the other each second one meets a cleared memory."""
    on = on & (c("lap") >= 2)
    q = yield {"was": lag("lap", on), "i": count(on, prior=False)}
    back = on & _or_no(c("lap") < q.was)
    f = yield {"forward": last(q.i, on & ~back, prior=False)}
    cleared = back & ((q.i - F.coalesce(f.forward, F.lit(0))) % 2 == 1)
    m = yield {"cleared": lag(cleared, on)}
    memo = q.was.isNotNull() & ~_or_no(m.cleared)
    new = on & ~cleared & (~memo | (c("lap") > q.was))
    left = F.greatest(c("total_laps") - c("lap") + 1, F.lit(0))
    runs = lambda side: c(f"{side}.result_status").isin(2, 3)
    own_gap = F.when(c("result_status").isin(2, 3), c("delta_front_ms"))
    ahead = F.when((c("pos") > 1) & (own_gap > 0) & runs("ahead"), cat(" ", c("ahead.name"), " ahead at ", tx.seconds_phrase(own_gap / 1000), "."))
    gap_b = c("behind.delta_front_ms")
    behind = F.when(runs("behind") & (gap_b > 0), cat(" ", c("behind.name"), " behind at ", tx.seconds_phrase(gap_b / 1000), "."))
    place = F.when(c("pos") == 1, "Leading the race.").otherwise(cat("You are P", c("pos"), "."))
    togo = F.when(left == 1, " Last lap.").when(left > 0, cat(" ", left, " laps to go.")).otherwise("")
    text = cat("Lap ", c("lap") - 1, " done. ", place, togo, F.coalesce(ahead, F.lit("")), F.coalesce(behind, F.lit("")))
    return [Message("RaceLapComplete", new, "NORMAL", 2, text)]


def race_finish(on: Column):
    """First retired, disqualified or finished tick; needs ``chequered``."""
    over = on & (c("result_status").isin(3, 4, 5, 6, 7) | c("chequered"))
    q = yield {"said": count(over)}
    grid = F.size(F.filter("field", lambda x: x["result_status"] >= 2))
    text = F.coalesce(tx.retired_text(c("result_status")), tx.finish_text(c("pos"), grid))
    return [Message("RaceFinish", over & (q.said == 0), "IMMEDIATE", 5, text)]


def qualifying_sector(on: Column):
    q = yield {"was": lag("sector", on)}
    done = F.when((q.was == 0) & (c("sector") == 1), 0).when((q.was == 1) & (c("sector") == 2), 1)
    ms = F.when(done == 0, c("s1_ms")).when(done == 1, c("s2_ms"))
    on = on & _or_no(ms > 0)
    b = yield {f"b{s}": least(ms, on & (done == s)) for s in (0, 1)}
    top = F.when(done == 0, b.b0).otherwise(b.b1)
    text = F.when(top.isNull() | (ms < top), cat("Purple sector ", done + 1, ". ", tx.lap_time(ms), ".")).otherwise(
        cat("Sector ", done + 1, " down ", tx.tenths((ms - top) / 1000), " seconds.")
    )
    return [Message("QualifyingSectorDelta", on, "NORMAL", 2, text)]


def qualifying_lap(on: Column):
    """New lap of the player against the best of everyone's current last laps."""
    q = yield {"top": most("lap", on)}
    own = c("last_lap_ms")
    best = F.array_min(F.transform(F.filter("field", lambda x: x["last_lap_ms"] > 0), lambda x: x["last_lap_ms"]))
    text = F.when(best.isNull() | (own <= best), cat("Provisional pole. ", tx.lap_time(own), ".")).otherwise(
        cat("P", c("pos"), ", ", tx.tenths((own - best) / 1000), " seconds off pole. ", tx.lap_time(own), ".")
    )
    left = tx.time_left(c("time_left"))
    text = cat(text, F.when(left != "", cat(" ", tx.capitalize(left), ".")).otherwise(""))
    return [Message("QualifyingLapComplete", on & (q.top.isNull() | (c("lap") > q.top)) & (own > 0), "NORMAL", 2, text)]


def sector_comparison(on: Column):
    """Player's new best sector against the fastest rival sector so far, once per lap and sector."""
    q = yield {"was": lag(F.transform("field", lambda x: F.struct(x["car"].alias("car"), x["sector"].alias("sector"))), on)}

    def finished(x: Column) -> Column:
        was = F.coalesce(F.get(F.filter(q.was, lambda p: p["car"] == x["car"]), F.lit(0))["sector"], F.lit(0))
        done = F.when((was == 0) & (x["sector"] == 1), 0).when((was == 1) & (x["sector"] == 2), 1)
        return F.struct(x["car"].alias("car"), x["ai"].alias("ai"), x["lap"].alias("lap"), done.alias("done"), F.when(done == 0, x["s1_ms"]).when(done == 1, x["s2_ms"]).alias("ms"))

    fin = F.filter(F.transform("field", finished), lambda x: x["ms"] > 0)
    me = F.get(F.filter(fin, lambda x: x["ai"] == 0), F.lit(0))
    mine = lambda s: F.when(me["done"] == s, me["ms"])
    code = lambda s, near: F.array_min(F.transform(  # noqa: E731 - the lower car number wins a tie
        F.filter(fin, lambda x: (x["ai"] != 0) & (x["done"] == s) & ((x["car"] < c("car")) if near else F.lit(True))), lambda x: x["ms"] * 100 + x["car"]))
    b = yield {f"p{s}": least(mine(s), on) for s in (0, 1)} | {f"r{s}": least(code(s, False), on) for s in (0, 1)}
    pick = lambda first, second: F.when(me["done"] == 0, first).otherwise(second)
    best, fast = pick(b.p0, b.p1), F.least(pick(b.r0, b.r1), pick(code(0, True), code(1, True)))
    fast_ms = F.floor(fast / 100)
    short = on & _or_no((best.isNull() | (me["ms"] < best)) & (me["ms"] - fast_ms >= 100))
    k = yield {f"l{s}": most(me["lap"], short & (me["done"] == s)) for s in (0, 1)}
    new = short & (me["lap"] > F.coalesce(pick(k.l0, k.l1), F.lit(0)))
    name = F.get(F.filter("field", lambda x: x["car"] == fast % 100), F.lit(0))["name"]
    text = cat(F.coalesce(name, F.lit("Rival")), " is ", tx.tenths((me["ms"] - fast_ms) / 1000), " seconds faster in Sector ", me["done"] + 1, ".")
    return [Message("PracticeSectorComparison", new, "NORMAL", 3, text)]


def traffic_exit(on: Column):
    """Clear or hold on the way out, once per outing."""
    rival = F.filter("field", lambda x: (x["ai"] != 0) & (x["pit_status"] == 0))
    gap = lambda x: tx.gap_behind_seconds(F.lit(0), x["lap_distance"], c("lap_distance"), c("track_m"))
    first = F.array_min(F.transform(rival, lambda x: F.struct(gap(x).alias("s"), x["car"].alias("car"), x["name"].alias("name"))))
    hit = on & _or_no(first["name"].isNotNull() & ((first["s"] > 15) | (first["s"] < 8)))
    q = yield {"out": last("tick", on & (c("prev_pit_state") == "PIT_STOPPED"), prior=False), "said": last("tick", hit)}
    again = _or_no(q.said >= F.coalesce(q.out, F.lit(BEFORE_ALL)))
    text = F.when(first["s"] > 15, "Track is clear, go now.").otherwise(cat("Hold position, ", first["name"], " about to pass."))
    return [Message("TrackTrafficExit", hit & ~again, "HIGH", 2, text)]


def held_plans(on: Column):
    """Plans arrive as ``plan`` now and then and hold until replaced."""
    q = yield {"plan": last("plan", prior=False)}
    return q.plan


def strategy_summary(on: Column, settle_ms: int = 12000):
    """Spoken when the visible plan changes; needs the stop arrays ``p1`` and ``p2`` of the plan that holds.

    The last spoken signature is the one of the previous eligible tick.
    """
    on = on & c("p1").isNotNull() & (c("lap") > 1)
    q = yield {"pit": last("at_ms", on & (c("prev_pit_state") != "ON_TRACK"), prior=False)}
    on = on & (q.pit.isNull() | (c("at_ms") >= q.pit + settle_ms))
    nxt = lambda p: F.get(F.filter(c(p), lambda s: s["on_lap"] >= c("lap")), F.lit(0))
    n1, n2 = nxt("p1"), nxt("p2")
    sig = lambda n: F.when(n.isNull(), "end").otherwise(cat(n["on_lap"], ":", n["compound"]))
    runner = c("p2").isNotNull() & n1.isNotNull() & (sig(n1) != sig(n2))
    near = F.when(runner, F.least(n1["on_lap"], n2["on_lap"])).otherwise(n1["on_lap"])
    on = on & (n1.isNull() | (near - c("lap") <= 2))
    whole = cat(sig(n1), "|", F.when(runner, sig(n2)).otherwise("none"))
    s = yield {"said": lag(whole, on)}
    box = lambda n: cat("box lap ", n["on_lap"], " for ", tx.display_tyre(n["compound"]), ".")
    plan = F.when(n1.isNull(), cat("stay out to the end on ", tx.spoken_tyre(c("letter")), ".")).otherwise(box(n1))
    alt = F.when(~runner, "").when(n2.isNull(), " Next best: stay out to the end.").otherwise(cat(" Next best: ", box(n2)))
    return [Message("StrategySummary", on & (s.said.isNull() | (s.said != whole)), "NORMAL", 2, cat("Current plan: ", plan, alt))]


def changes(on: Column):
    """What sets off projections and strategy runs at a tick; needs the tick's ``field``.

    Returns the conditions by name; a car or player not seen before counts as off the pits and without stops.
    """
    was_of = lambda x, name: F.coalesce(F.get(F.filter(q.cars, lambda p: p["car"] == x["car"]), F.lit(0))[name], F.lit(0))
    first = F.get(F.filter("field", lambda x: x["pos"] == 1), F.lit(0))["lap"]
    leader = F.coalesce(first, F.lit(0))
    own = ("lap", "sector", "pos", "pit_status")
    q = yield {
        "cars": lag(F.transform("field", lambda x: F.struct(x["car"].alias("car"), x["pit_status"].alias("pit_status"), x["pits"].alias("pits"))), on),
        "leader": lag(leader, on), "sc": lag("safety_car", on), "weather": lag("weather", on), **{n: last(n, on) for n in own}}
    moved = lambda n: _or_no(c(n) != getattr(q, n))
    entry = F.exists("field", lambda x: (x["pit_status"] > 0) & (was_of(x, "pit_status") == 0))
    stop = lambda own_car: F.exists("field", lambda x: ((x["ai"] == 0) == own_car) & (x["pits"] > was_of(x, "pits")))
    return {
        "leader_lap": _or_no((leader > q.leader) & (q.leader > 0)), "entry": entry, "sector": moved("sector"), "pos": moved("pos"),
        "rejoined": _or_no((q.pit_status > 0) & (c("pit_status") == 0)), "safety_car": c("safety_car") != F.coalesce(q.sc, F.lit(0)),
        "lap": _or_no((c("lap") > q.lap) & (q.lap > 0)), "own_stop": stop(F.lit(True)), "ai_stop": stop(F.lit(False)), "weather": _or_no(c("weather") != q.weather),
    }


def projection_triggers(ticks: DataFrame, engine: Engine | None = None) -> DataFrame:
    """As ``ticks.projection_triggers``, from one row per tick with its field, in a batch or a stream."""
    out, found = remembered(ticks, {"changes": (changes, F.lit(True))}, engine)
    at = found["changes"]
    names = ("leader_lap", "entry", "rejoined", "safety_car")
    fire = at["sector"] | at["pos"]
    for n in names:
        fire = fire | at[n]
    return out.where(fire).select(*tk.TICK, "at_ms", *[at[n].alias(n) for n in names])


def strategy_triggers(ticks: DataFrame, engine: Engine | None = None, cap: int | None = None) -> DataFrame:
    """As ``ticks.strategy_triggers``, and with a ``cap`` as ``ticks.throttle`` of them, in a batch or a stream."""

    def triggers(on: Column):
        at = yield from changes(on)
        critical = at["lap"] | at["rejoined"] | at["own_stop"] | at["safety_car"] | at["weather"]
        level = F.when(critical, "CRITICAL").when(at["sector"] | at["pos"] | at["ai_stop"], "NORMAL")
        if cap is None:
            return level, level.isNotNull()
        q = yield {"pass": latch(lt.per_lap(cap), level == "NORMAL", lap=c("lap"))}
        return level, (level == "CRITICAL") | getattr(q, "pass").isNotNull()

    out, found = remembered(ticks, {"triggers": (triggers, F.lit(True))}, engine)
    level, fire = found["triggers"]
    return out.where(fire).select(*tk.TICK, "at_ms", "lap", level.alias("severity"))


def outside_rewind(rows_: DataFrame, quiet_ms: int = 4000, engine: Engine | None = None) -> DataFrame:
    """As ``ticks.outside_rewind``, of messages and rewinds in one feed (session_uid, at_ms, is_rewind), in a batch or a
    stream; a rewind comes before a message of the same time."""

    def rewinds(on: Column):
        q = yield {"at": last("at_ms", c("is_rewind"))}
        return q.at

    feed = rows_.withColumn("tick", c("at_ms") * 2 + (~c("is_rewind")).cast("int"))
    out, found = remembered(feed, {"rewinds": (rewinds, F.lit(True))}, engine)
    quiet = found["rewinds"].isNull() | (c("at_ms") - found["rewinds"] >= quiet_ms)
    return out.where(~c("is_rewind") & quiet).select(*rows_.columns)


def event_messages(events: DataFrame, relevant: DataFrame | None = None) -> DataFrame:
    """Safety-car and retirement calls from the event stream (session_uid, tick, event_code, name, near)."""
    text = (
        F.when(c("event_code") == "SCAR", "Safety car deployed. Bunch up, stay within ten car lengths. We'll talk strategy.")
        .when((c("event_code") == "RTMT") & c("near"), cat(F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit("A car")), " has retired."))
    )
    sc = c("event_code") == "SCAR"
    return say(events, "Event", F.when(sc, "IMMEDIATE").otherwise("NORMAL"), F.when(sc, 3).otherwise(2), text)


RULES = {
    "SessionStartGreeting": greeting, "FlagChanges": flag_changes, "Penalties": penalties, "TyreCondition": tyre_condition, "Drs": drs, "ErsMode": ers_mode,
    "Weather": weather, "InvalidLap": invalid_lap, "CarAhead": car_ahead, "LapCountdown": lap_countdown, "PositionChange": position_change,
    "PitStopCompleted": pit_stop_completed, "StrategySummary": strategy_summary, "PeriodicSituationalAwareness": situational,
    "RaceLapComplete": race_lap_complete, "RaceFinish": race_finish, "QualifyingSectorDelta": qualifying_sector,
    "QualifyingLapComplete": qualifying_lap, "PracticeSectorComparison": sector_comparison, "TrackTrafficExit": traffic_exit,
}

"""Rules whose next firing depends on their last one, and message delivery.

What can be read off a tick or its look-backs is prepared as columns; a latch (``memory.latch``) keeps the few values that
firing itself changes. The rules run beside those of ``rules``, in the same pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexframe.functions import text as tx
from apexframe.operators import rules as ru
from apexframe.operators import ticks as tk
from apexframe.operators.memory import Engine, Message, count, lag, last, latch, least, mean, remembered
from apexframe.operators.rules import BEFORE_ALL, cat
from apexframe.streaming import latches as lt

c = F.col
SLOTS = 22  # cars of a session, numbered from 0
# Fixed values throughout this module: message texts, priorities, lifetimes in laps and thresholds.


def yellow_flag(on: Column):
    """Needs ``yellow``: one bit per sector under yellow."""
    q = yield {"f": latch(lt.yellow, on, sector=c("sector"), yellow=c("yellow"))}
    return [Message("YellowFlag", q.f.isNotNull(), "HIGH", 2, cat("Yellow flag in sector ", q.f["n1"], "."))]


def fastest_lap(on: Column):
    """A session best that beats the last one announced; the first is taken silently."""
    timed = F.filter("field", lambda x: x["last_lap_ms"] > 0)
    code = F.array_min(F.transform(timed, lambda x: x["last_lap_ms"] * 100 + x["car"]))
    mine = F.array_min(F.transform(F.filter(timed, lambda x: x["car"] == c("car")), lambda x: x["last_lap_ms"]))
    q = yield {"code": least(code, on, prior=False), "own": least(mine, on, prior=False)}
    best, car = F.floor(q.code / 100), (q.code % 100).cast("bigint")
    f = yield {"f": latch(lt.record(20_000, silent=True), on & q.code.isNotNull(), mark=-best, at=c("at_ms"))}
    name = F.get(F.filter("field", lambda x: x["car"] == car), F.lit(0))["name"]
    time = tx.lap_time(best)
    gap = F.when(q.own > 0, cat(" You're ", tx.tenths((q.own - best) / 1000), " seconds off the pace.")).otherwise("")
    rival = cat(F.coalesce(name, cat("Car ", car)), " sets the fastest lap, ", time, ".", gap)
    text = F.when(car == c("car"), cat("Fastest lap of the session, ", time, ". Nice one.")).otherwise(rival)
    return [Message("FastestLapByRival", f.f.isNotNull(), "NORMAL", 2, text)]


def _wear() -> list[Column]:
    return [c(f"wear_{w}").cast("int") for w in ("rl", "rr", "fl", "fr")]


def corner_wear(on: Column):
    q = yield {"f": latch(lt.corner_wear, on, readings=F.array(*_wear()))}
    done = q.f["n2"] == 37
    text = cat(lt.label(lt.CORNERS, q.f["n1"]), F.when(done, " is finished, manage it.").otherwise(" starting to degrade."))
    return [Message("PerCornerWear", q.f.isNotNull(), F.when(done, "HIGH").otherwise("NORMAL"), F.when(done, 2).otherwise(3), text)]


def damage(on: Column):
    q = yield {"f": latch(lt.damage, on, readings=F.array(*[f"{p}_dmg" for p in ("fw", "rw", "fl", "diff", "sp")]))}
    fixed, tier = q.f["code"] == "restored", q.f["n2"]
    words = F.when(tier == 60, " is heavily damaged.").when(tier == 30, " is damaged.").otherwise(" has minor damage.")
    text = F.when(fixed, "Front wing replaced, good to go.").otherwise(cat(lt.label(lt.PARTS, q.f["n1"]), words))
    level = F.when(fixed, "NORMAL").when(tier == 60, "IMMEDIATE").otherwise("HIGH")
    return [Message("Damage", q.f.isNotNull(), level, F.when(fixed | (tier == 60), 2).otherwise(3), text)]


def car_behind(on: Column):
    """The same car behind comes within two seconds of the player in the same place."""
    no = F.lit(False)
    pitted = c("prev_pit_state") != "ON_TRACK"
    q = yield {"until": last(c("lap") + 1, on & pitted)}
    held = ~pitted & F.coalesce(c("lap") < q.until, no)
    seen = ~pitted & ~held & F.coalesce(c("behind.lap") == c("lap"), no)
    near = tx.gap_behind_seconds(c("behind.delta_front_ms"), c("behind.lap_distance"), c("lap_distance"), c("track_m"))
    gap = F.when(seen, near).otherwise(F.lit(-1).cast("float"))
    who = F.when(seen, c("behind.car")).otherwise(-1)
    w = yield {"gap": lag(gap, on), "who": last(who, on & ~held), "pos": last("pos", on & ~held)}
    same = F.coalesce((w.who == c("behind.car")) & (w.pos == c("pos")), no)
    crossing = on & seen & same & (gap < 2) & ~F.coalesce((w.gap > 0) & (w.gap < 2), no)
    f = yield {"f": latch(lt.cooldown(30_000), crossing, rival=c("behind.car"), at=c("at_ms"))}
    name = F.coalesce("behind.name", F.lit("Car behind"))
    rival_tyre = tx.code_letter(c("behind.tyre"))
    state = F.when(c("behind.tyre_age").between(0, 3), "new ").when(c("behind.worn") >= 50, "worn ").otherwise("")
    tyres = F.when(rival_tyre != c("letter"), cat(" ", name, " on ", state, tx.plural_tyre(rival_tyre), ", you're on ", tx.plural_tyre(c("letter")), "."))
    whole = F.floor(gap.cast("double") + 0.5)
    close = cat(name, " closing from behind. Gap of ", whole, F.when(whole == 1, " second.").otherwise(" seconds."), F.coalesce(tyres, F.lit("")))
    return [Message("CarBehind", f.f.isNotNull(), "HIGH", 1, F.when(gap < 1, cat("Defend from ", name, ".")).otherwise(close))]


def slow_lap_traffic(on: Column, throttle_below: float = 0.30):
    """A car closing within four seconds while the player is on a slow lap, by the last twelve ticks."""
    q = yield {"throttle": mean("throttle", 12, on), "speed": mean("speed", 12, on)}
    near = (q.throttle < throttle_below) & (q.speed < 160) & (c("behind.pit_status") == 0) & (c("behind.speed") >= 50) & (c("behind.lap") == c("lap"))
    seconds = tx.gap_behind_seconds(F.lit(0), c("behind.lap_distance"), c("lap_distance"), c("track_m"))
    gap = F.when(F.coalesce(near, F.lit(False)), seconds).otherwise(F.lit(-1).cast("float"))
    w = yield {"gap": lag(gap, on)}
    closing = on & F.coalesce((gap >= 0) & (gap < 4) & (w.gap > 0) & (gap < w.gap), F.lit(False))
    f = yield {"f": latch(lt.cooldown(15_000), closing, rival=c("behind.car"), at=c("at_ms"))}
    return [Message("SlowLapTrafficWarning", f.f.isNotNull(), "HIGH", 2, cat(c("behind.name"), " closing fast behind, let them through."))]


def pit_window(on: Column):
    """Needs ``target`` and ``compound`` of the recommended stop that holds."""
    worn = F.greatest(*_wear()) >= 37
    on = on & F.coalesce((c("target") > 0) & (c("target") >= c("lap")), F.lit(False))
    q = yield {"old": lag("target", on)}
    moved = on & (q.old.isNull() | (q.old != c("target")))
    p = yield {"pits": last("pits", moved)}
    ahead, last_sector = c("target") - c("lap"), (c("pit_state") == "ON_TRACK") & (c("sector") >= 2)
    due = F.when((ahead == 5) & ~worn, 1).when(ahead == 1, 2).when((ahead == 0) & last_sector, 3).otherwise(0)
    stopped = moved & (c("pits") != F.coalesce(p.pits, F.lit(0)))
    put_off = F.coalesce(c("target") > q.old, F.lit(False)) & ~stopped
    f = yield {"f": latch(lt.pit_calls, on, target=c("target"), due=due, stopped=stopped, put_off=put_off)}
    code, tyres = f.f["code"], tx.display_tyre(c("compound"))
    text = (
        F.when(code == "missed", cat("We've missed that window. New plan, box lap ", f.f["n1"], ", ", tyres, " ready."))
        .when(code == "five", cat("Box window opens in 5 laps. ", tyres, " ready."))
        .when(code == "next", cat("Box next lap. ", tyres, " ready."))
        .otherwise(cat("Box this lap. ", tyres, " ready."))
    )
    level = F.when(code == "five", "NORMAL").when(code == "box", "IMMEDIATE").otherwise("HIGH")
    return [Message("PitWindowMessages", f.f.isNotNull(), level, F.when(code.isin("missed", "five"), 2).otherwise(1), text)]


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def _lows(on: Column) -> dict:
    """Best lap of each car so far; a session has 22 slots."""
    lap = lambda i: F.get(F.filter("field", lambda x: (x["car"] == i) & (x["last_lap_ms"] > 0)), F.lit(0))["last_lap_ms"]
    return {f"b{i}": least(lap(i), on, prior=False) for i in range(SLOTS)}


def _sheet(q) -> Column:
    """Cars of the tick with their best laps, those without one left out."""
    lows = F.array(*[getattr(q, f"b{i}") for i in range(SLOTS)])
    each = F.transform("field", lambda x: F.struct(F.get(lows, x["car"].cast("int")).alias("best_ms"), x["car"].alias("car"), x["name"].alias("name")))
    return F.filter(each, lambda x: x["best_ms"].isNotNull())


def tyre_fuel_summary(on: Column):
    """Axle wear and fuel in the last zone of the lap, at least four laps apart; needs ``zone_idx`` and ``final_zone``."""
    q = yield _lows(on)
    sheet = _sheet(q)
    me = F.get(F.filter(sheet, lambda x: x["car"] == c("car")), F.lit(0))["best_ms"]
    rank = F.when(me.isNotNull(), F.size(F.filter(sheet, lambda x: x["best_ms"] < me)) + 1)
    fuel = F.when(
        c("fuel_laps") > 0,
        cat("fuel for ", half_up(c("fuel_laps")), F.when(half_up(c("fuel_laps")) == 1, " more lap").otherwise(" more laps")),
    ).when(half_up(c("fuel")) >= 0, cat("fuel ", half_up(c("fuel")), " kilograms"))
    front, rear = half_up((c("wear_fl") + c("wear_fr")) / 2), half_up((c("wear_rl") + c("wear_rr")) / 2)
    text = cat("Fronts at ", front, "% wear, rears at ", rear, "%, ", fuel, ".", F.coalesce(cat(" P", rank, " on pace."), F.lit("")))
    there = on & (c("lap") >= 2) & (c("final_zone").isNull() | (c("zone_idx") == c("final_zone"))) & text.isNotNull()
    f = yield {"f": latch(lt.lap_gap(4), there, lap=c("lap"))}
    return [Message("PracticeTyreFuelSummary", f.f.isNotNull(), "NORMAL", 3, text)]


def practice_lap(on: Column):
    """Lap time against the player's best, place on the timesheet and time left.

    A lap counts once it has a new number and a new time. The time left is told until the clock has once not fallen.
    """
    ms = c("last_lap_ms")
    q = yield {"f": latch(lt.changed, on & (ms > 0), lap=c("lap"), value=ms)} | _lows(on)
    new, running = q.f.isNotNull(), c("time_left") > 0
    b = yield {"best": least(ms, new), "left": last("time_left", new & running)}
    o = yield {"stood": count(new & running & F.coalesce(c("time_left") >= b.left, F.lit(False)), prior=False)}
    best = F.least(ms, b.best)
    own = F.when(b.best.isNull() | (ms < b.best), ". Personal best.").otherwise(cat(", ", tx.tenths((ms - best) / 1000), " seconds off your best."))
    sheet = F.array_sort(_sheet(q))
    place = F.array_position(F.transform(sheet, lambda x: x["car"]), c("car"))
    up, down = F.get(sheet, (place - 2).cast("int")), F.get(sheet, place.cast("int"))
    lead = F.when(down.isNull(), "P1 on the time sheet.").otherwise(
        cat("P1 on the time sheet, ", tx.tenths((down["best_ms"] - best) / 1000), " seconds clear of ", down["name"], ".")
    )
    back = cat("P", place, " on the time sheet, ", tx.tenths((best - up["best_ms"]) / 1000), " seconds behind ", up["name"], ".")
    at = F.when(place == 1, cat(" ", lead)).when(place > 1, cat(" ", back)).otherwise("")
    left = tx.time_left(c("time_left"))
    clock = F.when((o.stood == 0) & (left != ""), cat(" ", tx.capitalize(left), ".")).otherwise("")
    return [Message("PracticeLapComplete", new, "NORMAL", 2, cat(tx.lap_time(ms), own, at, clock))]


def speed_trap(on: Column):
    v = c("speed_trap")
    f = yield {"f": latch(lt.record(60_000), on & (v > 0), mark=v, at=c("at_ms"))}
    place = F.size(F.filter("field", lambda x: x["speed_trap"] > v)) + 1
    return [Message("PracticeSpeedTrap", f.f.isNotNull(), "NORMAL", 3, cat("P", place, " in the speed trap, ", v, " kilometres per hour."))]


LATCHED = {
    "YellowFlag": yellow_flag, "FastestLapByRival": fastest_lap, "PerCornerWear": corner_wear, "Damage": damage, "CarBehind": car_behind,
    "PitWindowMessages": pit_window, "PracticeTyreFuelSummary": tyre_fuel_summary, "PracticeLapComplete": practice_lap,
    "PracticeSpeedTrap": speed_trap, "SlowLapTrafficWarning": slow_lap_traffic,
}
ru.RULES |= LATCHED


def with_zones(ticks: DataFrame, zones: DataFrame) -> DataFrame:
    """``ticks`` with the zone they are in and the last zone of their track."""
    final = zones.groupBy("track_id").agg(F.max_by("zone_idx", "from_m").alias("final_zone"))
    return tk.zone_of(ticks, zones).join(final, "track_id", "left")


def waiting(messages: DataFrame) -> DataFrame:
    """``messages(session_uid, tick, at_ms, lap, message_no, priority, ttl_laps)`` as one list for each tick."""
    rank = F.when(c("priority") == "IMMEDIATE", 0).when(c("priority") == "HIGH", 1).otherwise(2)
    each = F.struct(rank.alias("rank"), c("at_ms").cast("long").alias("born"), c("message_no").cast("long").alias("no"), (c("lap") + c("ttl_laps")).cast("long").alias("last_lap"))
    return messages.groupBy("session_uid", "tick").agg(F.collect_list(each).alias("fresh"))


def delivered(ticks: DataFrame, messages: DataFrame, engine: Engine | None = None) -> DataFrame:
    """``ticks``: session_uid, tick, at_ms, lap, zone, quiet. A tick's messages are queued before its delivery; those of
    no tick wait for the next."""
    own = ticks.select("session_uid", "tick", "at_ms", "lap", "zone", "quiet", F.lit(True).alias("present"))
    return handed_out(own.join(waiting(messages), ["session_uid", "tick"], "full"), engine)


def handed_out(feed: DataFrame, engine: Engine | None = None) -> DataFrame:
    """As ``delivered``, of ticks that carry their messages as ``fresh``; needs no join, so it serves streams."""

    def queue(on: Column):
        q = yield {"f": latch(lt.deliver, on, fresh=c("fresh"), here=F.coalesce("present", F.lit(False)), quiet=F.coalesce("quiet", F.lit(False)), zone=c("zone"), lap=c("lap"), at=c("at_ms"))}
        return q.f

    out, found = remembered(feed, {"queue": (queue, F.lit(True))}, engine)
    return out.where(found["queue"].isNotNull()).select("session_uid", "tick", "at_ms", found["queue"]["n1"].alias("message_no"))

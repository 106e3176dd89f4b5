"""Change detection over ordered feeds: sector transitions, rewinds, excursions, pit states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexframe.functions import stats

c = F.col


def transitions(feed: DataFrame, keys: list[str], span: int = 4096) -> DataFrame:
    """One row per completed sector, including the ones a dropped packet skipped over.

    ``feed`` holds lap packets (seq, lap, sector, s1_ms, s2_ms, last_lap_ms). A sector 2 belongs to
    the lap before the change, the others to the current lap. The first packet emits nothing.
    """
    seen = stats.along(
        feed, keys, "seq",
        lags={"prev_sector": "sector", "prev_lap": "lap"},
        running={
            "cached_s1": ("last", F.when(c("s1_ms") > 0, c("s1_ms")), "prior"),
            "cached_s2": ("last", F.when(c("s2_ms") > 0, c("s2_ms")), "prior"),
        },
        span=span,
    )
    return _expand(seen)


def _expand(seen: DataFrame) -> DataFrame:
    """Rows where the sector changed, one per completed sector."""
    seen = seen.where(c("prev_sector").isNotNull() & (c("sector") != c("prev_sector")))
    steps = F.pmod(c("sector") - c("prev_sector"), F.lit(3))
    out = seen.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), steps - 1)))
    out = out.withColumn("completed", F.pmod(c("prev_sector") + c("_i"), F.lit(3)))
    return out.withColumn("snap_lap", F.when(c("completed") == 2, c("prev_lap")).otherwise(c("lap"))).drop("_i")


def third_sector(last_lap: Column, s1: Column, s2: Column) -> Column:
    """Lap time less the two cached sectors, or -1 when it cannot be derived."""
    third = last_lap - s1 - s2
    return F.when((last_lap > 0) & (s1 > 0) & (s2 > 0) & (third > 0), third).otherwise(-1)


def with_history(trans: DataFrame, history: DataFrame, keys: list[str], span: int = 4096) -> DataFrame:
    """The newest history packet's time for the completed lap, if it is one of its last five laps.

    ``history`` holds packets (seq, num_laps, laps) with laps an array of structs s1, s2, s3.
    """
    joined = stats.asof(trans, history, keys, "seq", {"_n": "num_laps", "_laps": "laps"}, span)
    return joined.withColumn("history_ms", _history_ms(c("_n"), c("_laps"))).drop("_n", "_laps")


def _history_ms(n: Column, laps: Column) -> Column:
    lap = F.get(laps, (c("snap_lap") - 1).cast("int"))
    ms = F.when(c("completed") == 0, lap["s1"]).when(c("completed") == 1, lap["s2"]).otherwise(lap["s3"])
    return F.when((c("snap_lap") >= 1) & (c("snap_lap") <= n) & (c("snap_lap") > n - 5), ms)


def recover(trans: DataFrame) -> DataFrame:
    """Recovery tier and sector time of each transition.

    0 expected change, 1 the packet's own cumulative time, 2 history packet, 3 nothing to go by.
    """
    live = F.when(c("completed") == 0, c("s1_ms")).when(c("completed") == 1, c("s2_ms")).otherwise(-1)
    tier = (
        F.when(c("completed") == c("prev_sector"), 0).when(live > 0, 1)
        .when(c("history_ms") > 0, 2).otherwise(3)
    )
    third = third_sector(c("last_lap_ms"), c("cached_s1"), c("cached_s2"))
    own = (
        F.when(c("completed") < 2, live).when(third > 0, third)
        .when(c("last_lap_ms") > 0, c("last_lap_ms") - c("s1_ms") - c("s2_ms")).otherwise(0)
    )
    ms = F.when(c("tier") <= 1, own).when(c("tier") == 2, c("history_ms")).otherwise(0)
    lap_ms = F.when(c("completed") == 2, c("last_lap_ms")).otherwise(c("lap_time_ms"))
    return trans.withColumn("tier", tier).withColumn("sector_ms", ms).withColumn("snap_lap_ms", lap_ms)


def sector_snapshots(
    feed: DataFrame, history: DataFrame, context: dict[str, DataFrame], keys: list[str], span: int = 4096
) -> DataFrame:
    """Sector rows with the newest context of each kind; rows without any source get none of it.

    ``context`` maps a name to a frame of (keys, seq, value). Lap, history and context packets form
    one ordered stream, so the whole job is a single walk.
    """
    lap_cols = [n for n in feed.columns if n not in (*keys, "seq")]
    both = feed.withColumn("_lap", F.lit(True)).unionByName(
        history.select(*keys, "seq", F.struct("num_laps", "laps").alias("_h"), F.lit(False).alias("_lap")), allowMissingColumns=True
    )
    for name, packets in context.items():
        both = both.unionByName(packets.select(*keys, "seq", c("value").alias(name), F.lit(False).alias("_lap")), allowMissingColumns=True)
    both = both.withColumn("_at", c("seq") * 2 + c("_lap").cast("int"))  # other packets first on equal arrival
    on_lap = lambda e: F.when(c("_lap"), e)
    seen = stats.along(
        both, keys, "_at",
        running={
            "_prev": ("last", on_lap(F.struct("sector", "lap")), "prior"),
            "cached_s1": ("last", on_lap(F.when(c("s1_ms") > 0, c("s1_ms"))), "prior"),
            "cached_s2": ("last", on_lap(F.when(c("s2_ms") > 0, c("s2_ms"))), "prior"),
            "_hist": ("last", c("_h")), **{name: ("last", c(name)) for name in context},
        },
        span=2 * span,
    ).where("_lap")
    seen = seen.withColumn("prev_sector", c("_prev.sector")).withColumn("prev_lap", c("_prev.lap"))
    out = recover(_expand(seen).withColumn("history_ms", _history_ms(c("_hist.num_laps"), c("_hist.laps"))))
    known = {name: F.when(c("tier") < 3, F.coalesce(c(name), F.lit(0))).otherwise(0) for name in context}
    return out.withColumns(known).select(*keys, "seq", *lap_cols, "prev_sector", "completed", "snap_lap", "tier", "sector_ms", "snap_lap_ms", *context)


def pit_entries(feed: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    seen = stats.along(feed, keys, order, lags={"prev_pit": "pit_status"})
    return seen.where((c("pit_status") > 0) & (F.coalesce("prev_pit", F.lit(0)) == 0))


def valid_rows(rows_: DataFrame, rewinds: DataFrame, keys: list[str], span: int = 4096) -> DataFrame:
    """Rows no later rewind has taken back.

    A rewind to frame f removes every row written before it with a frame beyond f, so a row stands
    when the smallest target frame among the rewinds still to come is not below its own frame.
    Walking the append log backwards gives that minimum without a range join.
    """
    a = rows_.withColumn("_target", F.lit(None).cast("bigint"))
    b = rewinds.select(*keys, "seq", c("target_frame").alias("_target"), F.lit(True).alias("_rewind"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_back", -c("seq"))
    seen = stats.along(both, keys, "_back", running={"_low": ("min", c("_target"), "prior")}, span=span)
    keep = c("_rewind").isNull() & (c("_low").isNull() | (c("frame_identifier") <= c("_low")))
    return seen.where(keep).select(*rows_.columns)


# Driving-event gates.
MIN_SPEED, BRAKE_GATE, LOCK_RATIO, THROTTLE_GATE, SPIN_RATIO, YAW_GATE = 8.0, 0.15, 0.80, 0.50, 1.10, 0.10
BRAKE_ON, BRAKE_OFF, MIN_EVENT_MS = 0.15, 0.05, 50
# What the intensity of a kind of event measures.
SIGNAL = {"LOCKUP": "wheel_slip_ratio", "WHEELSPIN": "wheel_slip_ratio", "SLIDE": "wheel_slip_angle", "BRAKING": "brake"}


def _extreme(ratios: list[tuple[str, Column]], low: bool) -> Column:
    """Name of the wheel with the lowest (or highest) ratio; the earlier wheel wins a tie."""
    best = F.least(*[r for _, r in ratios]) if low else F.greatest(*[r for _, r in ratios])
    out = F.lit(None).cast("string")
    for name, r in reversed(ratios):
        out = F.when(r == best, name).otherwise(out)
    return out


def lockup(motion: DataFrame) -> DataFrame:
    ratios = [(w, c(f"ratio_{w.lower()}")) for w in ("RL", "RR", "FL", "FR")]
    hit = (c("forward_ms") >= MIN_SPEED) & (c("brake") > BRAKE_GATE) & (F.least(*[r for _, r in ratios]) < LOCK_RATIO)
    wheel = _extreme(ratios, low=True)
    slip = F.lit(0.0)
    for w, _ in ratios:
        slip = F.when(wheel == w, F.abs(f"slip_{w.lower()}")).otherwise(slip)
    return motion.withColumn("active", F.coalesce(hit, F.lit(False))).withColumn("detail", wheel).withColumn("intensity", slip)


def wheelspin(motion: DataFrame) -> DataFrame:
    ratios = [(w, c(f"ratio_{w.lower()}")) for w in ("RL", "RR")]
    hit = (c("forward_ms") >= MIN_SPEED) & (c("throttle") > THROTTLE_GATE) & (F.greatest(*[r for _, r in ratios]) > SPIN_RATIO)
    wheel = _extreme(ratios, low=False)
    slip = F.when(wheel == "RL", F.abs("slip_rl")).otherwise(F.abs("slip_rr"))
    return motion.withColumn("active", F.coalesce(hit, F.lit(False))).withColumn("detail", wheel).withColumn("intensity", slip)


def slide(motion: DataFrame) -> DataFrame:
    front = c("slip_front") >= c("slip_rear")
    hit = (c("forward_ms") >= MIN_SPEED) & (F.abs("yaw") > YAW_GATE)
    return (
        motion.withColumn("active", F.coalesce(hit, F.lit(False)))
        .withColumn("detail", F.when(front, "FRONT").otherwise("REAR"))
        .withColumn("intensity", F.greatest("slip_front", "slip_rear"))
    )


def braking(motion: DataFrame) -> DataFrame:
    """On above one threshold, off at or below a lower one; between them the state holds."""
    active = F.when(c("brake") > BRAKE_ON, True).when(c("brake") <= BRAKE_OFF, False)
    return motion.withColumn("active", active).withColumn("detail", F.lit(None).cast("string")).withColumn("intensity", c("brake"))


def excursions(frames: DataFrame, keys: list[str], kind: str, span: int = 4096, reset: str | None = None) -> DataFrame:
    """Closed runs of active frames of at least 50 ms.

    A null ``active`` holds the state of the frame before. Place and entry speed come from the opening
    frame, the peak from the strongest (earliest on ties), end distance and frame from the first frame
    after. An open run emits nothing, and frames marked by the boolean column ``reset`` (a rewind, a new
    session) discard one. A run is named by the frame that closed the one before, so one walk finds all.
    """
    again = F.coalesce(c(reset), F.lit(False)) if reset else F.lit(False)
    mark = F.when(again, F.coalesce("active", F.lit(False))).otherwise(c("active"))
    seen = stats.along(
        frames, keys, "seq",
        running={
            "_now": ("last", mark), "_was": ("last", mark, "prior"), "_run": ("last", F.when(~mark, c("seq")), "prior"),
            "_epoch": ("count", F.when(again, 1)),
        },
        span=span,
    )
    now = F.coalesce("_now", F.lit(False))
    runs = seen.withColumn("active", now).where(now | (F.coalesce("_was", F.lit(False)) & ~again))
    return closed(runs.withColumn("event_type", F.lit(kind)), [*keys, "_epoch"]).drop("_epoch")


def closed(runs: DataFrame, keys: list[str], closing: tuple[str, ...] = ()) -> DataFrame:
    """Events of the frames of runs (named by ``_run`` within keys and ``event_type``) and of the frame after each;
    ``closing`` columns come from that frame."""
    on, off = F.when(c("active"), c("seq")), F.when(~c("active"), c("seq"))
    first = F.min_by(F.struct("t_ms", "lap", "sector", "lap_distance", "speed"), on)
    peak = F.max_by(F.struct("detail", "intensity", "brake", "throttle", "steer"), F.when(c("active"), F.struct("intensity", -c("seq"))))
    last = F.min_by(F.struct("t_ms", "lap_distance", "frame_identifier", *closing), off)
    ev = runs.groupBy(*keys, "event_type", "_run").agg(
        first.alias("o"), peak.alias("p"), last.alias("e"), F.max(F.when(c("active"), c("brake"))).alias("brake_peak"),
        F.max(F.when(c("active"), c("throttle"))).alias("throttle_peak"), F.max(F.when(c("active"), F.abs("steer"))).alias("steer_peak"),
    )
    dur = (c("e.t_ms") - c("o.t_ms")).cast("bigint")
    signal = F.lit(None).cast("string")
    for kind, name in SIGNAL.items():
        signal = F.when(c("event_type") == kind, name).otherwise(signal)
    return ev.where(c("o").isNotNull() & c("e").isNotNull() & (dur >= MIN_EVENT_MS)).select(
        *keys, "event_type", c("o.lap").alias("lap"), c("o.sector").alias("sector"),
        c("o.lap_distance").alias("start_m"), c("e.lap_distance").alias("end_m"), c("p.detail").alias("detail"),
        c("p.intensity").alias("peak_intensity"), dur.alias("duration_ms"), c("o.speed").alias("entry_speed"),
        signal.alias("intensity_signal"),
        "brake_peak", "throttle_peak", "steer_peak", c("p.brake").alias("brake_at_peak"), c("p.throttle").alias("throttle_at_peak"), c("p.steer").alias("steer_at_peak"),
        c("e.frame_identifier").alias("frame_identifier"), *[c(f"e.{n}").alias(n) for n in closing],
    )


STOP_KMH = 5
BEFORE_ALL = -(1 << 62)  # an order value before any tick


def pit_states(feed: DataFrame, keys: list[str], span: int = 4096) -> DataFrame:
    """ON_TRACK, PIT_ENTRY, PIT_STOPPED or PIT_EXIT per tick.

    Status 0 and 2 decide alone. In a run of status 1 the car enters, has stopped from its first
    slow tick on, and exits from the first fast tick after that; a run that starts from a stop (or
    with the feed) has already stopped.
    """
    other = F.when(c("pit_status") != 1, F.struct(c("seq").alias("at"), c("pit_status").alias("status")))
    seen = stats.along(feed, keys, "seq", lags={"_prev": "pit_status"}, running={"_other": ("last", other, "prior")}, span=span)
    # A run of status 1 is named by the tick before it and came from that tick's status, or began the feed.
    seen = seen.withColumn("_came", c("_other.status")).withColumn("_at", F.coalesce("_other.at", F.lit(BEFORE_ALL))).drop("_other")
    # After an entry from the track, or at the feed's begin, speed counts only from the run's second tick on.
    later = (c("pit_status") == 1) & (c("_prev") == 1)
    counted = later | ((c("pit_status") == 1) & (c("_came") == 2))
    out = stats.along(
        seen, [*keys, "_at"], "seq",
        running={
            "_slow": ("min", F.when(later & (c("speed") < STOP_KMH), c("seq"))),
            "_fast": ("max", F.when(counted & (c("speed") >= STOP_KMH), c("seq"))),
        },
        span=span,
    )
    # A run that did not come from the track has stopped already.
    stopped = F.when(F.coalesce(c("_came") == 0, F.lit(False)), c("_slow")).otherwise(BEFORE_ALL)
    state = (
        F.when(c("pit_status") == 0, "ON_TRACK").when(c("pit_status") == 2, "PIT_STOPPED")
        .when(stopped.isNull(), "PIT_ENTRY").when(c("_fast") > stopped, "PIT_EXIT").otherwise("PIT_STOPPED")
    )
    return out.withColumn("pit_state", state).select(*feed.columns, "pit_state")


def lifecycle(feed: DataFrame, span: int = 4096) -> DataFrame:
    """Session starts and ends per feed: one start per session, ended by its classification or by
    the next session taking over."""
    seen = stats.along(feed, ["feed"], "seq", lags={"_prev": "uid"}, span=span)
    new = c("_prev").isNull() | (c("_prev") != c("uid"))
    marks = seen.withColumn("_new", new).where(c("_new") | c("classified"))  # all that matters, few of the packets
    runs = stats.along(marks, ["feed"], "seq", running={"_run": ("sum", c("_new").cast("int"))}, span=span)
    per = runs.groupBy("feed", "_run").agg(
        F.min_by("uid", "seq").alias("uid"), F.min("seq").alias("start_seq"),
        F.min(F.when(c("classified"), c("seq"))).alias("final_seq"),
    )
    # a session lasts minutes, so a feed has few of them
    after = stats.along(per.withColumn("_back", -c("_run")), ["feed"], "_back", lags={"next_seq": "start_seq"}, span=0)
    started = after.select("feed", "uid", F.lit("started").alias("kind"), c("start_seq").alias("seq"))
    ended = after.select("feed", "uid", F.lit("ended").alias("kind"), F.coalesce("final_seq", "next_seq").alias("seq"))
    return started.unionByName(ended.where(c("seq").isNotNull()))


def first_packets(packets: DataFrame, opening: str = "session") -> DataFrame:
    """The first packet of each kind per session, once the session itself is known."""
    known = packets.where(c("kind") == opening).groupBy("session_uid").agg(F.min("seq").alias("_known"))
    gated = packets.join(known, "session_uid").where(c("seq") >= c("_known"))
    return gated.groupBy("session_uid", "kind").agg(F.min("seq").alias("seq"))


def repair_third_sectors(snap: DataFrame) -> DataFrame:
    """Third-sector rows as long as their lap get lap - S1 - S2, or are quarantined."""
    keys = ["session_uid", "car_index", "lap_number"]
    pick = lambda s: F.max(F.when(c("sector_number") == s, c("sector_time_ms")))
    sib = snap.groupBy(*keys).agg(pick(0).alias("_s0"), pick(1).alias("_s1"))
    bad = (c("sector_number") == 2) & (c("lap_time_ms") > 0) & (c("sector_time_ms") >= c("lap_time_ms"))
    third = c("lap_time_ms") - c("_s0") - c("_s1")
    ok = F.coalesce((c("_s0") > 0) & (c("_s1") > 0) & (third > 0), F.lit(False))
    return (
        snap.join(sib, keys)
        .withColumn("outlier", F.when(bad & ~ok, 1).otherwise(c("outlier")))
        .withColumn("sector_time_ms", F.when(bad & ok, third).otherwise(c("sector_time_ms")))
        .drop("_s0", "_s1")
    )

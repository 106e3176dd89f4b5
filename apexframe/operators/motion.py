"""Driving events from decoded packets: motion frames with the newest state, all kinds of events in one walk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexframe.functions import stats
from apexframe.operators import feed

c = F.col
WHEELS = ("rl", "rr", "fl", "fr")  # order of the wheels in a packet
KINDS = {"LOCKUP": feed.lockup, "WHEELSPIN": feed.wheelspin, "SLIDE": feed.slide, "BRAKING": feed.braking}


def _number(x: Column) -> Column:
    """As double; what is no number decides nothing."""
    return F.nanvl(x.cast("double"), F.lit(0.0))


def frames(stream: DataFrame, keys: list[str] = ["session_uid"], span: int = 65_536) -> DataFrame:  # noqa: B006
    """A row for each motion packet with the newest session, lap and car state of its player.

    ``stream`` is what ``packets.player_stream`` gives. The kinds and the rewinds are one ordered stream, so the
    many-sided look-up is one walk; ``epoch`` counts the rewinds so far. Motion packets before the first session, lap
    or telemetry packet give no row. Wheel ratios are null at a crawl and where a reading is no number.
    """
    kinds = ("session", "lap", "telemetry")
    running = {k: ("last", c(k)) for k in kinds} | {"epoch": ("count", F.when(c("rewind"), 1))}
    seen = stats.along(stream, keys, "recv_seq", running=running, span=span)
    seen = seen.where(c("motion").isNotNull() & c("session").isNotNull() & c("lap").isNotNull() & c("telemetry").isNotNull())
    forward = c("motion.velocity_x").cast("double")
    made = {}
    for i, w in enumerate(WHEELS):
        ratio = F.when(forward >= feed.MIN_SPEED, c("motion.wheel_speed")[i].cast("double") / forward)
        made[f"ratio_{w}"] = F.when(~F.isnan(ratio), ratio)
        made[f"slip_{w}"] = _number(c("motion.slip_ratio")[i])
    angle = [F.abs(_number(c("motion.slip_angle")[i])) for i in range(4)]
    return seen.select(
        *keys, "epoch", c("recv_seq").alias("seq"), "frame_identifier", c("player_car_index").alias("car_index"),
        c("session.track_id").alias("track_id"), c("session.session_type").alias("session_type"),
        (c("session_time").cast("double") * 1000.0).alias("t_ms"), c("lap.current_lap_num").alias("lap"), c("lap.sector").alias("sector"),
        c("lap.lap_distance").cast("double").alias("lap_distance"), c("telemetry.speed").cast("double").alias("speed"),
        *[_number(c(f"telemetry.{n}")).alias(n) for n in ("brake", "throttle", "steer")],
        F.nanvl(forward, F.lit(0.0)).alias("forward_ms"), _number(c("motion.yaw")).alias("yaw"),
        *[e.alias(n) for n, e in made.items()],
        F.greatest(angle[2], angle[3]).alias("slip_front"), F.greatest(angle[0], angle[1]).alias("slip_rear"),
    )


def driving_events(frames_: DataFrame, keys: list[str] = ["session_uid"], span: int = 65_536) -> DataFrame:  # noqa: B006
    """Lock-ups, wheelspins, slides and brakings of the frames, from one walk over them.

    A rewind begins a new epoch: events open at it are discarded, and so is one open at the end of a session.
    """
    walk = [*keys, "epoch"]
    marked = frames_
    for kind, mark in KINDS.items():
        marked = mark(marked).withColumn(kind, F.struct("active", "detail", "intensity")).drop("active", "detail", "intensity")
    running = {}
    for kind in KINDS:
        active = c(f"{kind}.active")
        running |= {
            f"{kind}_now": ("last", active), f"{kind}_was": ("last", active, "prior"),
            f"{kind}_run": ("last", F.when(~active, c("seq")), "prior"),
        }
    seen = stats.along(marked, walk, "seq", running=running, span=span)
    false = F.lit(False)
    each = [
        F.struct(
            F.lit(kind).alias("event_type"), F.coalesce(f"{kind}_now", false).alias("active"), F.coalesce(f"{kind}_was", false).alias("_was"),
            c(f"{kind}_run").alias("_run"), c(f"{kind}.detail").alias("detail"), c(f"{kind}.intensity").alias("intensity"),
        )
        for kind in KINDS
    ]
    inside = F.filter(F.array(*each), lambda e: e["active"] | e["_was"])  # few frames are in an event
    runs = seen.withColumn("_e", F.explode(inside)).select(*frames_.columns, "_e.*")
    return feed.closed(runs, walk, closing=("car_index", "track_id", "session_type")).drop("epoch")

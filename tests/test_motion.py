"""Packets to driving events against a plain frame-by-frame account."""

import random

from pyspark.sql import functions as F

from apexframe.operators import motion
from apexframe.sources import packets as pk

c = F.col
PLAYER = 4
EDGE = [0.0, 0.05, 0.1, 0.15, 0.3, 0.9]
HEAD = "recv_seq bigint, session_uid bigint, frame_identifier bigint, session_time float, player_car_index int"
BODIES = {
    "session": "struct<track_id:int,session_type:int>", "lap": "array<struct<car_slot:int,lap_distance:float,current_lap_num:int,sector:int>>",
    "telemetry": "array<struct<car_slot:int,speed:int,throttle:float,steer:float,brake:float>>",
    "motion": "struct<wheel_speed:array<float>,slip_ratio:array<float>,slip_angle:array<float>,velocity_x:float,yaw:float>",
    "event": "struct<event_code:string>",
}


def drawn(seed, n=1200):
    """A stream of packets: (kind, seq, session, time, body), two sessions mixed."""
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        kind = rng.choices(list(BODIES), [1, 4, 8, 20, 1])[0]
        body = {
            "session": lambda: (rng.randrange(20), rng.randrange(1, 12)),
            "lap": lambda: [(slot, rng.random() * 5000, rng.randrange(9), rng.randrange(3)) for slot in (0, PLAYER)],
            "telemetry": lambda: [(slot, rng.randrange(300), rng.choice(EDGE), rng.uniform(-1, 1), rng.choice(EDGE)) for slot in (0, PLAYER)],
            "motion": lambda: (
                [rng.choice([0.0, 20.0, 30.0, 30.0, 40.0]) for _ in range(4)], [rng.choice([-0.9, 0.2, 0.5]) for _ in range(4)],
                [rng.choice([-0.7, 0.1, 0.3]) for _ in range(4)], rng.choice([5.0, 30.0, 30.0, 30.0]), rng.choice([0.0, 0.05, -0.2, 0.2])),
            "event": lambda: (rng.choice(["FLBK", "SEND"]),),
        }[kind]()
        out.append((kind, seq, 1 + seq % 2, seq * 0.01, body))
    return out


def packed(spark, stream):
    out = None
    for kind, body in BODIES.items():
        rows = [(seq, uid, seq, t, PLAYER, b) for k, seq, uid, t, b in stream if k == kind]
        p = pk.pack(spark.createDataFrame(rows, f"{HEAD}, body {body}"), kind)
        out = p if out is None else out.unionByName(p)
    return out


def account(stream, single):
    """Events by feeding one frame after the other; ``single`` rounds as a packet does."""
    found, frames = [], 0
    for uid in (1, 2):
        know, open_, holding = {}, {}, False
        for kind, seq, of, t, body in stream:
            if of != uid:
                continue
            if kind == "event":
                if body[0] == "FLBK":
                    open_, holding = {}, False
                continue
            if kind != "motion":
                know[kind] = body
                continue
            if len(know) < 3:
                continue
            frames += 1
            _, dist, lap, sector = know["lap"][1]
            _, speed, throttle, steer, brake = know["telemetry"][1]
            throttle, steer, brake, dist = map(single, (throttle, steer, brake, dist))
            wheels, slip, angle, v, yaw = body
            slip, angle = [abs(single(s)) for s in slip], [abs(single(a)) for a in angle]
            ratio = [w / v for w in wheels]
            low, high = ratio.index(min(ratio)), ratio.index(max(ratio[:2]))
            front, rear = max(angle[2:]), max(angle[:2])
            holding = brake > 0.15 or (holding and brake > 0.05)
            now = {
                "LOCKUP": (v >= 8 and brake > 0.15 and ratio[low] < 0.8, ("RL", "RR", "FL", "FR")[low], slip[low]),
                "WHEELSPIN": (v >= 8 and throttle > 0.5 and ratio[high] > 1.1, ("RL", "RR", "FL", "FR")[high], slip[high]),
                "SLIDE": (v >= 8 and abs(single(yaw)) > 0.1, "FRONT" if front >= rear else "REAR", max(front, rear)),
                "BRAKING": (holding, None, brake),
            }
            ms = single(t) * 1000.0
            for name, (active, detail, strength) in now.items():
                if active:
                    e = open_.setdefault(name, dict(at=ms, m=dist, speed=speed, lap=lap, sector=sector, best=-1.0, brake=0.0))
                    e["brake"] = max(e["brake"], brake)
                    if strength > e["best"]:
                        e.update(best=strength, detail=detail, steer=steer)
                elif name in open_:
                    e = open_.pop(name)
                    took = int(ms - e["at"])
                    if took >= 50:
                        found.append((uid, name, e["lap"], e["sector"], e["m"], dist, e["detail"], e["best"], took, float(e["speed"]), e["brake"], e["steer"], seq, know["session"][0]))
    return sorted(found, key=str), frames


def test_events_from_packets(spark):
    import numpy as np

    stream = drawn(5)
    want, frames = account(stream, lambda v: float(np.float32(v)))
    tagged = pk.player_stream(packed(spark, stream))
    for span in (16, 65_536):
        made = motion.frames(tagged, span=span)
        assert made.count() == frames
        got = motion.driving_events(made, span=span).select(
            "session_uid", "event_type", "lap", "sector", "start_m", "end_m", "detail", "peak_intensity", "duration_ms", "entry_speed", "brake_peak", "steer_at_peak", "frame_identifier", "track_id")
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert {e[1] for e in want} == set(motion.KINDS) and len(want) > 40


def test_missing_and_damaged_packets(spark):
    """Without a session nothing is ready; short packets, spectators and readings that are no numbers decide nothing."""
    stream = [p for p in drawn(6, 200) if p[0] != "session"]
    bad = packed(spark, stream + [("session", 999, 1, 9.0, (1, 1))])
    assert motion.frames(pk.player_stream(bad.where("recv_seq < 999"))).count() == 0
    cut = bad.withColumn("payload", F.expr("substring(payload, 1, length(payload) - 4)"))
    assert {r.rewind for r in pk.player_stream(cut).collect()} <= {True}
    nan = float("nan")
    rows = [("session", 1, 1, 0.0, (1, 1)), ("lap", 2, 1, 0.0, [(PLAYER, 1.0, 1, 0)]), ("telemetry", 3, 1, 0.0, [(PLAYER, 9, nan, nan, nan)])]
    rows += [("motion", 4 + i, 1, i * 0.1, ([nan] * 4, [nan] * 4, [nan] * 4, 30.0, nan)) for i in range(5)] + [("event", 0, 1, 0.0, ("SEND",))]
    made = motion.frames(pk.player_stream(packed(spark, rows)))
    assert made.count() == 5 and motion.driving_events(made).count() == 0
    assert motion.driving_events(made.limit(0)).count() == 0


def test_one_scan_of_the_packets(spark, tmp_path):
    path = f"{tmp_path}/packets"
    packed(spark, drawn(7, 100)).write.parquet(path)
    plan = pk.player_stream(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("MapInArrow") == 1
    assert "Exchange" not in plan


def test_mixed_sizes_are_gathered(spark):
    """Headers of packets of different sizes, from a slice of a buffer."""
    stream = drawn(8, 300)
    got = {r.recv_seq: r.session_uid for r in pk.headers(packed(spark, stream).repartition(1, "recv_seq")).collect()}
    assert got == {seq: uid for _, seq, uid, _, _ in stream}

"""Cut-up walks give the same as one window per key."""

import random

from pyspark.sql import functions as F

from apexframe.functions import stats
from apexframe.operators import feed

c = F.col


def sample(spark, n=400, keys=2, seed=3):
    rng = random.Random(seed)
    seqs = {k: sorted(rng.sample(range(1, 5 * n), n)) for k in range(keys)}
    data = [(k, q, rng.choice([None, 1, 2, 3, 5, 8]), rng.random()) for k, qs in seqs.items() for q in qs]
    return spark.createDataFrame(data, "k int, seq bigint, v bigint, w double")


def spec():
    return dict(
        lags={"before": "v", "pair": F.struct("seq", "v")},
        running={
            "total": ("sum", c("v")), "low": ("min", c("v"), "prior"), "high": ("max", c("v")), "seen": ("count", c("v"), "prior"),
            "newest": ("last", c("v")), "newest_prior": ("last", c("v"), "prior"), "oldest": ("first", c("v")),
        },
    )


def test_spans_equal_plain_windows(spark):
    df = sample(spark)
    want = sorted(stats.along(df, ["k"], "seq", span=0, **spec()).collect(), key=lambda r: (r.k, r.seq))
    for span in (1, 7, 64, 100000):
        got = sorted(stats.along(df, ["k"], "seq", span=span, **spec()).collect(), key=lambda r: (r.k, r.seq))
        assert [tuple(r) for r in got] == [tuple(r) for r in want], span


def test_asof_spans_and_ties(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 3)], "k int, seq bigint")
    right = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 4, "z")], "k int, seq bigint, v string")
    for span in (0, 1, 3, 1000):
        got = {(r.k, r.seq): r.v for r in stats.asof(left, right, ["k"], "seq", {"v": "v"}, span).collect()}
        assert got == {(1, 5): "a", (1, 10): "b", (2, 3): None}


def test_rolling_spans(spark):
    df = spark.createDataFrame([(k, i, float(i * i % 17)) for k in (1, 2) for i in range(1, 200)], "k int, seq bigint, v double")
    exprs = lambda: {"m": F.avg("v"), "n": F.count("v")}
    want = sorted(map(tuple, stats.rolling(df, ["k"], "seq", 12, exprs(), span=100000).collect()))
    for span in (12, 13, 50):
        assert sorted(map(tuple, stats.rolling(df, ["k"], "seq", 12, exprs(), span=span).collect())) == want


def test_top_per_group_keeps_every_tied_position(spark):
    df = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 7)], "k int, v int")
    got = sorted((r.k, r.v, r.rn) for r in stats.top_per_group(df, ["k"], [F.desc("v")], 3).collect())
    assert got == [(1, 497, 3), (1, 498, 2), (1, 499, 1), (2, 7, 1)]


def test_rewinds_against_brute_force(spark):
    rng = random.Random(11)
    log = [(1, i, rng.choice(["row", "row", "row", "rewind"]), rng.randrange(60)) for i in range(300)]
    alive = []
    for _, seq, kind, frame in log:
        if kind == "rewind":
            alive = [(s, f) for s, f in alive if f <= frame]
        else:
            alive.append((seq, frame))
    df = spark.createDataFrame(log, "session_uid int, seq bigint, kind string, frame bigint")
    rows_ = df.where("kind = 'row'").select("session_uid", "seq", c("frame").alias("frame_identifier"))
    rew = df.where("kind = 'rewind'").select("session_uid", "seq", c("frame").alias("target_frame"))
    for span in (5, 4096):
        got = sorted((r.seq, r.frame_identifier) for r in feed.valid_rows(rows_, rew, ["session_uid"], span).collect())
        assert got == sorted(alive)


def pit_state(prev, status, speed):
    if status != 1:
        return "ON_TRACK" if status == 0 else "PIT_STOPPED"
    if prev is None:
        return "PIT_STOPPED"
    if prev == "ON_TRACK":
        return "PIT_ENTRY"
    if prev == "PIT_ENTRY":
        return "PIT_STOPPED" if speed < 5 else "PIT_ENTRY"
    if prev == "PIT_STOPPED":
        return "PIT_EXIT" if speed >= 5 else "PIT_STOPPED"
    return "PIT_EXIT"


def test_pit_states_against_state_machine(spark):
    rng = random.Random(2)
    data, want = [], []
    for k in range(30):
        prev, status = None, rng.choice([0, 1, 2])
        for i in range(40):
            status = rng.choice([status, status, status, 0, 1, 2])
            speed = rng.choice([0, 3, 4, 5, 60])
            data.append((k, i, status, speed))
            prev = pit_state(prev, status, speed)
            want.append((k, i, prev))
    df = spark.createDataFrame(data, "k int, seq bigint, pit_status int, speed int")
    for span in (0, 6, 4096):
        got = sorted((r.k, r.seq, r.pit_state) for r in feed.pit_states(df, ["k"], span).collect())
        assert got == want


def test_excursions_against_tracker(spark):
    rng = random.Random(9)
    frames, want = [], []
    for k in range(10):
        opened = None
        active = False
        for i in range(120):
            active = rng.random() < (0.85 if active else 0.2)
            f = (k, i, i * 20, i // 30, i % 3, float(i), rng.random(), rng.random(), 50.0 + i, i, active, "d%d" % (i % 4), float(rng.randrange(5)))
            frames.append(f)
            if active:
                if opened is None:
                    opened = [f, f]
                elif f[12] > opened[1][12]:
                    opened[1] = f
            elif opened is not None:
                if f[2] - opened[0][2] >= 50:
                    want.append((k, opened[0][3], opened[0][5], f[5], opened[1][11], opened[1][12], f[2] - opened[0][2], f[9]))
                opened = None
    df = spark.createDataFrame(
        frames,
        "k int, seq bigint, t_ms bigint, lap int, sector int, lap_distance double, brake double, throttle double, speed double, "
        "frame_identifier bigint, active boolean, detail string, intensity double",
    )
    for span in (9, 4096):
        ev = feed.excursions(df.withColumn("steer", F.lit(0.1)), ["k"], "X", span)
        got = sorted(tuple(r) for r in ev.select("k", "lap", "start_m", "end_m", "detail", "peak_intensity", "duration_ms", "frame_identifier").collect())
        assert got == sorted(want)


def test_excursions_hold_and_reset(spark):
    rng = random.Random(21)
    frames, want = [], []
    for k in range(12):
        state, opened = False, None
        for i in range(150):
            mark, reset = rng.choice([True, True, None, None, False]), rng.random() < 0.04
            frames.append((k, i, i * 20, 1, 0, float(i), 0.5, 0.5, 50.0, i, mark, "d", float(i % 7), reset))
            if reset:
                state, opened = False, None
            state = state if mark is None else mark
            if state and opened is None:
                opened = i
            elif not state and opened is not None:
                if (i - opened) * 20 >= 50:
                    want.append((k, float(opened), float(i)))
                opened = None
    df = spark.createDataFrame(
        frames,
        "k int, seq bigint, t_ms bigint, lap int, sector int, lap_distance double, brake double, throttle double, speed double, "
        "frame_identifier bigint, active boolean, detail string, intensity double, reset boolean",
    )
    for span in (0, 9, 4096):
        ev = feed.excursions(df.withColumn("steer", F.lit(0.1)), ["k"], "X", span, reset="reset")
        assert sorted(tuple(r) for r in ev.select("k", "start_m", "end_m").collect()) == want


def test_pit_states_of_a_hot_key_with_sparse_order(spark):
    rng = random.Random(31)
    data, want = [], []
    for k, n in ((0, 600), (1, 300), (2, 300)):  # one car holds half of all ticks
        prev, at, status = None, 0, 0
        for _ in range(n):
            at += rng.choice([1, 50_000, 900_000])  # microseconds of arrival
            status = rng.choice([status, status, 0, 1, 1, 2])
            speed = rng.choice([0, 4, 5, 60])
            data.append((k, at, status, speed))
            prev = pit_state(prev, status, speed)
            want.append((k, at, prev))
    df = spark.createDataFrame(data, "k int, seq bigint, pit_status int, speed int")
    got = sorted((r.k, r.seq, r.pit_state) for r in feed.pit_states(df, ["k"]).collect())
    assert got == want

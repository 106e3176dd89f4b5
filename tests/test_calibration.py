"""Fits on small hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from apexframe.functions import stats
from apexframe.operators import calibration as cal

c = F.col
SNAP = (
    "session_uid bigint, car_index bigint, lap_number bigint, sector_number bigint, sector_time_ms bigint, pit_status int, ai_controlled int, "
    "track_id bigint, session_type int, safety_car_status int, penalties_sec int"
)


def pit_snap(spark, rows):
    return spark.createDataFrame([(s, car, lap, sec, ms, pit, 1, 3, 15, 0, 0) for s, car, lap, sec, ms, pit in rows], SNAP)


def losses(spark, rows, base=((0, 23500.0), (1, 32500.0), (2, 24000.0))):
    med = spark.createDataFrame([(3, s, 1, m) for s, m in base], "track_id bigint, sector_number bigint, ai_controlled int, median_ms double")
    return [r.loss_ms for r in cal.pit_losses(pit_snap(spark, rows), med).orderBy("session_uid", "car_index", "stop").collect()]


def test_pit_loss_takes_entry_and_out_lap(spark):
    assert losses(spark, [(1, 5, 10, 2, 27494, 1), (1, 5, 11, 0, 44020, 0), (1, 5, 11, 1, 32600, 0)]) == [24014.0]


def test_pit_loss_keeps_a_normal_follower_out(spark):
    assert losses(spark, [(1, 5, 10, 2, 27494, 1), (1, 5, 11, 0, 23600, 0)]) == [3494.0]


def test_pit_loss_stops_at_the_next_car(spark):
    assert losses(spark, [(1, 5, 10, 2, 27494, 1), (1, 6, 11, 0, 44020, 0), (1, 6, 12, 2, 27494, 1)]) == [3494.0, 3494.0]


def test_pit_loss_void_without_baseline(spark):
    rows = [(1, 5, 10, 1, 45000, 1), (1, 5, 10, 2, 40000, 0), (1, 5, 11, 0, 44020, 1), (1, 5, 11, 1, 33000, 0)]
    # Sector 2 has no baseline: the first stop is void, the row after it starts a new one.
    assert losses(spark, rows, base=((0, 23500.0), (1, 32500.0))) == [20520.0]


def walk(rows, base):
    """Plain walk over one car's rows, written independently of the fold."""
    out, i = [], 0
    while i < len(rows):
        if rows[i][2] != 1:
            i += 1
            continue
        loss, ok, j = 0.0, True, i
        while j < len(rows) and j - i < 4:
            b = base.get(rows[j][0])
            if not b or b <= 0:
                ok = False
                break
            extra = rows[j][1] - b
            if j > i and not extra > b * 0.30:
                break
            loss, j = loss + extra, j + 1
        if ok and loss > 0:
            out.append(loss)
        i = max(j, i + 1)
    return out


def test_pit_loss_equals_plain_walk(spark):
    rng = random.Random(5)
    base = {0: 23500.0, 1: 32500.0}
    rows, want = [], []
    for car in range(40):
        mine = []
        for k in range(6, 36):
            mine.append((k // 3, k % 3, rng.choice([20000, 24000, 33000, 44000, 50000]), rng.choice([0, 0, 0, 1])))
        mine[0] = (*mine[0][:3], 1)
        rows += [(1, car, lap, sec, ms, pit) for lap, sec, ms, pit in mine]
        want += walk([(sec, ms, pit) for _, sec, ms, pit in mine], base)
    assert losses(spark, rows, base=tuple(base.items())) == pytest.approx(want)


@pytest.mark.parametrize(
    "times, kept",
    [
        ([80000, 80000, 80010, 80010, 80020, 130000], [80000, 80000, 80010, 80010, 80020]),
        ([80000] * 5, [80000] * 5),
        ([80000, 130000], [80000, 130000]),
    ],
)
def test_mad_filter(spark, times, kept):
    df = spark.createDataFrame([(1, t) for t in times], "k int, v bigint")
    out = stats.mad_keep(stats.value_counts(df, ["k"], "v"), ["k"], "v", 2.5)
    got = sorted(v for r in out.collect() for v in [r.v] * r.n)
    assert got == kept


def fit(spark, pairs):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "x double, y double")
    return df.agg(stats.regression("y", "x").alias("f")).select("f.*").first()


def test_regression_exact_line_and_flat_cases(spark):
    line = fit(spark, [(1, 5), (2, 7), (3, 9)])
    assert (line.slope, line.intercept, line.r2, line.n) == pytest.approx((2.0, 3.0, 1.0, 3)) and line.se == pytest.approx(0, abs=1e-6)
    same_x = fit(spark, [(2, 4), (2, 6), (2, 8)])
    assert (same_x.slope, same_x.intercept, same_x.r2, same_x.se) == (0.0, 6.0, 0.0, 0.0)
    same_y = fit(spark, [(1, 4), (2, 4), (3, 4)])
    assert (same_y.slope, same_y.r2) == (0.0, 0.0)


def test_gap_fill_and_tail_slope(spark):
    bins = spark.createDataFrame(
        [(3, "AI", 16, 0, 1, 90.0, 1.0, 9), (3, "AI", 16, 0, 4, 0.0, 1.0, 9)],
        "track_id bigint, regime string, compound bigint, sector_number bigint, tyre_age_laps bigint, offset_ms double, stddev_ms double, sample_count bigint",
    )
    got = {r.tyre_age_laps: r.offset_ms for r in cal.fill_age_gaps(bins).collect()}
    assert got == {2: 60.0, 3: 30.0}
    tail = cal.tail_slopes(bins.withColumn("compound", F.lit(18).cast("bigint"))).first()
    assert (tail.value, tail.clamped, tail.sample_count, tail.r_squared) == (20.0, 1, 1, None)


def test_iqr_needs_ten_rows_and_uses_regime_factor(spark, x):
    flagged = cal.outliers(x.snap)
    assert flagged.count() > 0
    few = x.snap.where("session_uid = 0 AND car_index = 1 AND lap_number < 3")
    assert cal.outliers(few).count() == 0


def test_calibrate_writes_every_knob(spark, x):
    out = cal.calibrate(x.snap)
    names = {r.knob_name for r in out.select("knob_name").distinct().collect()}
    assert "fuel_effect" in names and any(n.startswith("tyre_wear_rate_") for n in names)


def test_missing_sources_of_pace_and_curves(spark):
    """Rows that lack recent times, baselines, perfect sectors or bins."""
    from pyspark.sql import functions as F

    from apexframe.operators import calibration as cal
    from apexframe.operators import strategy as st

    rows = spark.createDataFrame([(1, [90_000, 91_000, 95_000], 80_000, 70_000), (1, [], 80_000, 0), (1, [], 0, 0)], "track_id long, recent array<bigint>, b long, p long")
    pace = st.base_pace(F.col("recent"), F.col("b"), F.col("track_id"))
    got = rows.select(pace.alias("pace"), st.pace_floor(F.col("p"), pace).alias("floor")).collect()
    assert (got[0].pace, got[0].floor) == (91_000, 70_000)
    assert (got[1].pace, got[1].floor) == (80_000, 72_000)
    assert got[2].pace > 0 and abs(got[2].floor - 0.9 * got[2].pace) < 1e-6
    bins = spark.createDataFrame([(1, 16, 0, "AI", a, float(a * a)) for a in (1, 4, 5)], "track_id long, compound long, sector_number long, regime string, tyre_age_laps long, offset_ms double")
    filled = {r.tyre_age_laps: r.offset_ms for r in cal.fill_age_gaps(bins).collect()}
    assert filled == {2: 6.0, 3: 11.0}

"""Race-pattern queries over sector rows: overtakes, incident rates, air and DRS effects, stints, hold-out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.functions import rows, stats
from apexframe.operators import calibration as cal
from apexframe.operators import dashboards as dash

c = F.col
CAR = ["session_uid", "car_index"]


def overtakes(snap: DataFrame) -> DataFrame:
    """Places gained between consecutive sectors of a car (at most 768 rows per car and session)."""
    s = snap.withColumn("_o", c("lap_number") * 3 + c("sector_number"))
    seen = stats.along(s, CAR, "_o", lags={"was": "car_position"}, span=0)
    return seen.where(c("car_position") < c("was")).select(*cal.SNAP_KEY, "was", "car_position", (c("was") - c("car_position")).alias("gained"))


def incident_rates(snap: DataFrame, classification: DataFrame) -> DataFrame:
    """Share of safety-car sectors and of retirements per session and race distance."""
    sc = snap.groupBy("session_uid").agg((F.count_if(c("safety_car_status") > 0) / F.count("*")).alias("safety_car_share"))
    out = classification.groupBy("session_uid").agg(
        F.max("num_laps").alias("race_laps"), (F.count_if(c("result_status").isin(4, 7)) / F.count("*")).alias("retired_share")
    )
    return sc.join(out, "session_uid")


def air_effects(snap: DataFrame) -> DataFrame:
    """Mean sector time in dirty air and with DRS against the sectors without either."""
    clean = snap.where(rows.fit_input())
    dirty, drs = (c("gap_to_car_ahead_ms") > 0) & (c("gap_to_car_ahead_ms") < 1500), c("drs_allowed") == 1
    mean = lambda cond: F.avg(F.when(cond, c("sector_time_ms")))
    return clean.groupBy("track_id", "sector_number").agg(
        (mean(dirty) - mean(~dirty)).alias("dirty_air_ms"), (mean(drs) - mean(~drs)).alias("drs_ms"), F.count_if(dirty).alias("dirty_n"), F.count_if(drs).alias("drs_n")
    )


def stints(cars: DataFrame) -> DataFrame:
    """Runs on one set: a new stint where the compound changes or the stop count rises."""
    key = ["session_uid", "car"]
    seen = stats.along(cars, key, "tick", lags={"_tyre": "tyre", "_pits": "pits"}, span=0)
    new = c("_tyre").isNull() | (c("_tyre") != c("tyre")) | (c("pits") > c("_pits"))
    runs = stats.along(seen.withColumn("_new", new.cast("int")), key, "tick", running={"stint": ("sum", c("_new"))}, span=0)
    return runs.groupBy(*key, "stint").agg(F.min_by("tyre", "tick").alias("tyre"), F.min("lap").alias("from_lap"), F.max("lap").alias("to_lap"))


def executed_strategy(classification: DataFrame) -> DataFrame:
    """Flat stint columns as rows; unused stints drop out."""
    each = F.posexplode(F.array(*[F.struct(c(f"stint{i}").alias("compound"), c(f"end{i}").alias("end_lap")) for i in (1, 2)])).alias("i", "s")
    return classification.select("session_uid", "car_index", each).where(c("s.compound") > 0).select(
        "session_uid", "car_index", (c("i") + 1).alias("stint"), c("s.compound").alias("compound"), c("s.end_lap").alias("end_lap")
    )


def holdout(snap: DataFrame, parts: int = 5) -> DataFrame:
    """Baselines fitted on four fifths of the sessions, scored on the rest."""
    test = c("session_uid") % parts == 0
    base = cal.baselines(snap.where(~test))
    left = cal.residuals(snap.where(test), base)
    return left.groupBy("track_id", "regime").agg(
        F.count("*").alias("n"), F.avg("residual_ms").alias("bias_ms"), F.avg(F.abs("residual_ms")).alias("mae_ms")
    )


def end_actions(sessions: DataFrame) -> DataFrame:
    """What the end of a session sets off: practice recalibrates its track, a race is evaluated."""
    kind = rows.session_kind(c("session_type"))
    action = F.when(kind == "PRACTICE", "recalibrate").when(kind == "RACE", "evaluate")
    return sessions.select("session_uid", "track_id", action.alias("action")).where(c("action").isNotNull())


def recalibrate(ended: DataFrame, snap: DataFrame) -> DataFrame:
    """Fresh coefficients of the tracks whose practice sessions ended."""
    tracks = end_actions(ended).where(c("action") == "recalibrate").select("track_id").distinct()
    return cal.calibrate(snap.join(tracks, "track_id", "left_semi"))


def evaluate_races(ended: DataFrame, radio: DataFrame, sim_io: DataFrame, classification: DataFrame) -> DataFrame:
    """Accuracy rows of the races that ended."""
    races = end_actions(ended).where(c("action") == "evaluate").select("session_uid")
    return dash.evaluate_accuracy(radio.join(races, "session_uid", "left_semi"), sim_io, classification)

"""Latches, delivery and texts on hand-made rows."""

import random

from pyspark.sql import functions as F

from apexframe.functions import text as tx
from apexframe.operators import latched_rules as lr
from apexframe.operators import rules as ru
from apexframe.operators import strategy as st

c = F.col


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


def test_phrases(spark):
    lit = F.lit
    assert [one(spark, tx.tenths(lit(v))) for v in (1.0, 1.04, 1.05, 2.96, 0.25)] == ["1", "1", "1.1", "3", "0.3"]
    assert one(spark, tx.seconds_phrase(lit(1.02))) == "1 second" and one(spark, tx.seconds_phrase(lit(1.1))) == "1.1 seconds"
    assert one(spark, tx.lap_time(lit(83456))) == "1 minute 23.5 seconds" and one(spark, tx.lap_time(lit(59000))) == "59 seconds"
    assert [one(spark, tx.time_left(lit(v))) for v in (0, 30, 65, 300)] == ["", "less than a minute left", "about a minute left", "5 minutes left"]
    assert one(spark, tx.capitalize(lit("soft TYRE"))) == "Soft TYRE"
    assert one(spark, tx.sentence_marks(lit("Box now. P1! Gap 1.5 s."))) == "Box now.|P1!|Gap 1.5 s."


def test_facts_and_scores(spark):
    f = F.lit
    assert sorted(one(spark, tx.fact_tokens(f("p8 gap 1.5, P8 in 3 laps")))) == ["1.5", "3", "P8"]
    assert one(spark, tx.invented_facts(f("P8 gap 2"), f("P9 gap 2.5"))) == ["2.5", "P9"]
    assert one(spark, tx.dropped_facts(f("P8 gap 2"), f("P9"))) == ["2", "P8"]
    good = one(spark, tx.judge_scores(f('x {"tone": 4, "wit": 5, "rationale": "r"} y'), ["tone", "wit"]))
    assert (good.tone, good.wit, good.rationale) == (4, 5, "r")
    for bad in ('{"tone": 6, "wit": 1}', '{"tone": 4.0, "wit": 1}', '{"tone": 4}', "none"):
        assert one(spark, tx.judge_scores(f(bad), ["tone", "wit"])) is None


def test_session_uids(spark):
    assert one(spark, tx.signed_uid(F.lit("ffffffffffffffff"))) == -1
    assert one(spark, tx.signed_uid(F.lit(" 1f "))) == 31
    assert [one(spark, tx.signed_uid(F.lit(v))) for v in ("-", " ", "xyz")] == [None, None, None]


def test_damage_one_message_per_tick(spark):
    data = [(1, t, *d) for t, d in enumerate([(65, 35, 0, 0, 0), (65, 35, 0, 0, 0), (66, 35, 12, 0, 0), (0, 35, 12, 0, 0), (12, 35, 12, 0, 0)])]
    t = spark.createDataFrame(data, "session_uid int, tick int, fw_dmg int, rw_dmg int, fl_dmg int, diff_dmg int, sp_dmg int")
    t = t.withColumn("pit_state", F.lit("ON_TRACK")).withColumn("kind", F.lit("RACE"))
    got = [(r.tick, r.priority, r.text) for r in ru.said(t, "Damage").orderBy("tick").collect()]
    assert got == [
        (0, "IMMEDIATE", "Front wing is heavily damaged."), (1, "HIGH", "Rear wing is damaged."), (2, "HIGH", "Floor has minor damage."),
        (3, "NORMAL", "Front wing replaced, good to go."), (4, "HIGH", "Front wing has minor damage."),
    ]


def test_assists_silence_drs_and_ers(spark):
    data = [(1, 0, 0, 1, 0, 0), (1, 1, 1, 1, 2, 1), (1, 2, 1, 0, 0, 0), (1, 3, 1, 0, 3, 0)]
    t = spark.createDataFrame(data, "session_uid int, tick int, drs_allowed int, drs_assist int, ers_mode int, ers_assist int")
    t = t.withColumn("pit_state", F.lit("ON_TRACK")).withColumn("kind", F.lit("RACE"))
    assert [r.tick for r in ru.said(t, "Drs").collect()] == [2] and [r.tick for r in ru.said(t, "ErsMode").collect()] == [3]


def plain_delivery(ticks, messages):
    """Queue walked tick by tick, written independently of the step."""
    rank, keep = {"IMMEDIATE": 0, "HIGH": 1, "NORMAL": 2}, {"IMMEDIATE": 8000, "HIGH": 30000, "NORMAL": 60000}
    waiting, zone, used, out = [], -1, 0, []
    for tick, at, lap, z, quiet in ticks:
        waiting += [m for m in messages if m[0] == tick]
        if quiet:
            waiting = []
            continue
        if z != zone:
            zone, used = z, 0
        waiting = [m for m in waiting if lap <= m[2] + m[5] and at - m[1] <= keep[m[4]]]
        waiting.sort(key=lambda m: (rank[m[4]], m[1], m[3]))
        if not waiting:
            continue
        p = waiting[0][4]
        if p == "IMMEDIATE" or (z >= 0 and (p == "HIGH" or used < 2)):
            used += p == "NORMAL"
            out.append((tick, waiting.pop(0)[3]))
    return out


def test_delivery_against_plain_queue(spark):
    rng = random.Random(4)
    want, td, md = [], [], []
    for s in range(12):
        zone, ticks, messages = -1, [], []
        for t in range(150):
            zone = rng.choice([zone] * 6 + [-1, 0, 1])
            ticks.append((t, t * 1500, t // 30, zone, rng.random() < 0.03))
            for _ in range(rng.choice([0, 0, 1, 2])):
                messages.append((t, t * 1500, t // 30, len(messages), rng.choice(["IMMEDIATE", "HIGH", "NORMAL"]), rng.choice([0, 1, 2])))
        want += [(s, *o) for o in plain_delivery(ticks, messages)]
        td += [(s, *t) for t in ticks]
        md += [(s, *m) for m in messages]
    t = spark.createDataFrame(td, "session_uid int, tick bigint, at_ms bigint, lap bigint, zone int, quiet boolean")
    m = spark.createDataFrame(md, "session_uid int, tick bigint, at_ms bigint, lap bigint, message_no bigint, priority string, ttl_laps int")
    got = sorted((r.session_uid, r.tick, r.message_no) for r in lr.delivered(t, m).collect())
    assert got == sorted(want)


def test_feasibility_reason(spark):
    stops = F.array(*[F.struct(F.lit(lap).alias("on_lap"), F.lit(k).alias("compound")) for lap, k in ((10, 17), (20, 17), (30, 7))])
    have = F.create_map(F.lit(17), F.lit(1))
    assert one(spark, st.first_shortage(stops, have)) == "Need 2 Medium set(s) but only 1 available"
    assert one(spark, st.first_shortage(stops, F.create_map(F.lit(17), F.lit(2)))) == "Need 1 Compound-7 set(s) but only 0 available"
    assert one(spark, st.first_shortage(stops, F.create_map(F.lit(17), F.lit(2), F.lit(7), F.lit(1)))) is None


def test_curve_and_pace(spark):
    curve = F.array(*[F.struct(F.lit(a).alias("age"), F.lit(float(v)).alias("ms")) for a, v in ((2, 10), (4, 30), (5, 20))])
    assert [one(spark, st.curve_offset(curve, F.lit(a), F.lit(5.0))) for a in (1, 2, 3, 4, 5, 8)] == [10.0, 10.0, 20.0, 30.0, 20.0, 35.0]
    arr = lambda *v: F.array(*[F.lit(i) for i in v]).cast("array<bigint>")
    assert one(spark, st.base_pace(arr(5, 1, 9, 7), F.lit(0), F.lit(3))) == 7.0
    assert one(spark, st.base_pace(arr(0), F.lit(4), F.lit(3))) == 4.0
    assert one(spark, st.base_pace(arr(), F.lit(0), F.lit(99))) == 30000.0
    assert one(spark, st.top_two_phrase(F.lit('[{"rank":2,"label":"B","meanPosition":2.25},{"rank":1,"label":"A","meanPosition":1.75}]'))) == "A (~P1.8); B (~P2.2)"
    assert one(spark, st.top_two_phrase(F.lit("oops"))) == ""


def test_folds_send_their_inputs_alone(spark, capsys):
    """Wide columns of a tick stay in the JVM; a fold beyond one batch of rows goes on with the same memory."""
    from apexframe.operators import memory as mm

    ticks = spark.range(30_000, numPartitions=4).select(
        (F.col("id") % 2).alias("session_uid"), F.floor(F.col("id") / 2).alias("tick"), F.col("id").alias("x"), F.concat(F.lit("wide"), "id").alias("wide"))
    even = mm.Windows()(ticks, {"avg": mm.mean("x", 2)})
    out = even.where("session_uid = 1")
    out.explain()
    sent = [line for line in capsys.readouterr().out.splitlines() if "MapInArrow" in line or "ArrowEvalPython" in line]
    assert sent and not any("wide" in line for line in sent) and not any("MapInArrow" in line for line in sent)
    rows = out.orderBy("tick").collect()
    assert [r.avg for r in rows] == [None] + [2.0 * t for t in range(1, 15_000)]
    assert rows[-1].wide == "wide29999"

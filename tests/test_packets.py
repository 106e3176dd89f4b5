"""Packet decoding: lengths, kinds, event details."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from apexframe.sources import packets as pk

c = F.col


def test_layout_sizes():
    sizes = {k: pk.layout(v[1]).itemsize for k, v in pk.CAR_KINDS.items()}
    assert sizes == {"lap": 57, "participant": 57, "telemetry": 60, "status": 55, "classification": 46, "damage": 46}
    assert pk.HEAD.itemsize == pk.HEADER_SIZE
    assert pk.SINGLE_KINDS["session"][1].itemsize + pk.HEADER_SIZE <= 753
    assert pk.layout(pk.TYRE_SET).itemsize == 10 and pk.layout(pk.HISTORY_LAP).itemsize == 14


def test_short_packets_give_no_rows(spark):
    body = F.array(F.struct(F.lit(0).alias("car_slot"), F.lit(7).alias("sector")))
    rows = spark.range(2).select(c("id").alias("recv_seq"), F.lit(-5).cast("bigint").alias("session_uid"), F.lit(9).alias("frame_identifier"), body.alias("body"))
    p = pk.pack(rows, "lap")
    d = pk.cars(p, "lap")
    assert d.count() == 44 and d.where("car_slot = 0").first().session_uid == -5
    cut = p.withColumn("payload", F.expr("substring(payload, 1, length(payload) - 1)"))
    assert pk.cars(cut, "lap").count() == 0
    assert pk.cars(p, "status").count() == 0


def test_unknown_event_has_no_details(spark):
    body = F.struct(F.lit("SEND").alias("event_code"), F.lit(3).alias("vehicle_idx"))
    rows = spark.range(1).select(c("id").alias("recv_seq"), F.lit(1).cast("bigint").alias("session_uid"), F.lit(9).alias("frame_identifier"), body.alias("body"))
    e = pk.events(pk.pack(rows, "event")).first()
    assert e.event_code == "SEND" and e.vehicle_idx is None


def test_slots_in_use_keep_rows_of_zeros(spark):
    """A car at rest with all fields zero is a row; a slot without a car is none."""
    body = F.array(*[F.struct(F.lit(slot).alias("car_slot"), F.lit(0).alias("speed")) for slot in (0, 3)])
    rows = spark.range(3).select(c("id").alias("recv_seq"), F.lit(1).cast("bigint").alias("session_uid"), F.lit(0).alias("frame_identifier"), body.alias("body"))
    p = pk.pack(rows, "telemetry", slots=True)
    got = sorted((r.recv_seq, r.car_slot, r.speed) for r in pk.cars(p, "telemetry").collect())
    assert got == [(i, slot, 0) for i in range(3) for slot in (0, 3)]
    assert pk.cars(p.drop("slots"), "telemetry").count() == 66


def test_short_tyre_set_lists(spark):
    """A car with fewer than twenty sets keeps those it has."""
    sets = F.array(*[F.struct(F.lit(k).alias("visual_compound"), F.lit(ms).alias("lap_delta_ms")) for k, ms in ((16, -5), (7, 0))])
    body = F.struct(F.lit(4).alias("car_index"), sets.alias("sets"))
    rows = spark.range(1).select(c("id").alias("recv_seq"), F.lit(1).cast("bigint").alias("session_uid"), F.lit(0).alias("frame_identifier"), body.alias("body"))
    r = pk.singles(pk.pack(rows, "tyre_sets"), "tyre_sets").first()
    assert r.car_index == 4 and [(s.visual_compound, s.lap_delta_ms) for s in r.sets if s.visual_compound] == [(16, -5), (7, 0)]


class Captured:
    """Stands for a DataFrame and gives the function that a task would run."""

    columns = ["recv_seq", "payload"]

    def where(self, *_):
        return self

    select = where

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def telemetry(n: int) -> pa.RecordBatch:
    cars = [[{"car_slot": slot, "speed": i % 300, "gear": -1, "tyres_inner_temp": [1, 2, 3, i % 90]} for slot in (0, 21)] for i in range(n)]
    return pa.RecordBatch.from_pydict({"recv_seq": list(range(n)), "session_uid": [-7] * n, "frame_identifier": list(range(n)), "body": cars})


def test_batches_are_packed_and_decoded_in_pieces(spark):
    """What a task's Python holds does not grow with the batches that Spark sends."""
    n = 3 * pk.PIECE + 5
    packed = list(pk.pack(Captured(), "telemetry")(iter([telemetry(n)])))
    assert [b.num_rows for b in packed] == [pk.PIECE] * 3 + [5]
    whole = pa.Table.from_batches(packed).combine_chunks().to_batches()
    rows = list(pk.cars(Captured(), "telemetry")(iter(whole)))
    assert max(b.num_rows for b in rows) == pk.PIECE * pk.CARS and sum(b.num_rows for b in rows) == n * pk.CARS
    got = pa.Table.from_batches(rows).to_pylist()
    assert all(r["session_uid"] == -7 for r in got)
    driven = [(r["recv_seq"], r["speed"], r["gear"], r["tyres_inner_temp"]) for r in got if r["car_slot"] == 21]
    assert driven == [(i, i % 300, -1, [1, 2, 3, i % 90]) for i in range(n)]


def test_kinds_packed_in_one_pass(spark):
    """Several kinds from one scan are the packets that each kind gives alone; values that do not fit are refused."""
    lead = [c("id").alias("recv_seq"), F.lit(3).cast("bigint").alias("session_uid"), c("id").alias("frame_identifier")]
    lap = F.array(F.struct(F.lit(2).alias("car_slot"), F.when(c("id") % 4 > 0, c("id")).alias("sector")))
    event = F.struct(F.lit("FLBK").alias("event_code"), c("id").alias("rewind_frame"))
    ids = spark.range(0, 80, 8)
    both = ids.select(*lead, lap.alias("lap"), F.when(c("id") % 3 == 0, event).alias("event"))
    alone = pk.pack(ids.select(*lead, lap.alias("body")), "lap").unionByName(
        pk.pack(ids.where("id % 3 = 0").select(*lead, event.alias("body")), "event").withColumn("recv_seq", c("recv_seq") + 1))
    rows = lambda df: sorted((r.recv_seq, bytes(r.payload)) for r in df.collect())
    assert rows(pk.pack_kinds(both, ("lap", "event"))) == rows(alone)
    high = F.array(F.struct(F.lit(2).alias("car_slot"), F.lit(256).alias("sector")))
    with pytest.raises(Exception, match="does not fit"):
        pk.pack(ids.select(*lead, high.alias("body")), "lap").collect()

"""Bulk decoding of landed binary packets into rows.

Packets arrive as a table or stream with a ``payload`` column. The packet kind is read in the JVM, so
only the wanted kind reaches Python, and each Arrow batch is decoded as one numpy array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER_SIZE, CARS = 29, 22
# Packet layouts in wire order. u/i = unsigned/signed integer, f = float, S = text,
# V = skipped bytes, with the size in bytes; [n] repeats a field.
HEADER = (
    "packet_format u2, game_year u1, major u1, minor u1, packet_version u1, packet_id u1, session_uid i8, session_time f4, "
    "frame_identifier u4, overall_frame_identifier u4, player_car_index u1, secondary_player_car_index u1"
)
LAP = (
    "last_lap_ms u4, current_lap_ms u4, s1_part_ms u2, s1_part_min u1, s2_part_ms u2, s2_part_min u1, delta_front_part_ms u2, "
    "delta_front_part_min u1, delta_leader_part_ms u2, delta_leader_part_min u1, lap_distance f4, total_distance f4, "
    "safety_car_delta f4, car_position u1, current_lap_num u1, pit_status u1, num_pit_stops u1, sector u1, lap_invalid u1, "
    "penalties u1, total_warnings u1, corner_cutting_warnings u1, unserved_drive_through u1, unserved_stop_go u1, "
    "grid_position u1, driver_status u1, result_status u1, pit_lane_timer_active u1, pit_lane_time_ms u2, pit_stop_timer_ms u2, "
    "pit_stop_should_serve_pen u1, speed_trap_kmh f4, speed_trap_lap u1"
)
PARTICIPANT = (
    "ai_controlled u1, driver_id u1, network_id u1, team_id u1, my_team u1, race_number u1, nationality u1, name S32, "
    "your_telemetry u1, show_online_names u1, tech_level u2, platform u1, num_colours u1, skip V12"
)
TELEMETRY = (
    "speed u2, throttle f4, steer f4, brake f4, clutch u1, gear i1, engine_rpm u2, drs u1, rev_lights_percent u1, "
    "rev_lights_bits u2, brakes_temp u2[4], tyres_surface_temp u1[4], tyres_inner_temp u1[4], engine_temp u2, "
    "tyres_pressure f4[4], surface_type u1[4]"
)
STATUS = (
    "traction_control u1, anti_lock_brakes u1, fuel_mix u1, front_brake_bias u1, pit_limiter u1, fuel_in_tank f4, "
    "fuel_capacity f4, fuel_remaining_laps f4, max_rpm u2, idle_rpm u2, max_gears u1, drs_allowed u1, drs_distance u2, "
    "actual_compound u1, visual_compound u1, tyres_age_laps u1, fia_flags i1, power_ice f4, power_mguk f4, ers_store f4, "
    "ers_mode u1, ers_harvest_mguk f4, ers_harvest_mguh f4, ers_deployed f4, network_paused u1"
)
CLASSIFICATION = (
    "position u1, num_laps u1, grid_position u1, points u1, num_pit_stops u1, result_status u1, result_reason u1, best_lap_ms u4, "
    "total_race_time f8, penalties_time u1, num_penalties u1, num_stints u1, stints_actual u1[8], stints_visual u1[8], stints_end_lap u1[8]"
)
DAMAGE = (
    "tyres_wear f4[4], tyres_damage u1[4], brakes_damage u1[4], tyre_blisters u1[4], front_wing_l u1, front_wing_r u1, rear_wing u1, "
    "floor u1, diffuser u1, sidepod u1, drs_fault u1, ers_fault u1, gear_box u1, engine u1, engine_mguh u1, engine_es u1, "
    "engine_ce u1, engine_ice u1, engine_mguk u1, engine_tc u1, engine_blown u1, engine_seized u1"
)
ZONE = "zone_start f4, zone_flag i1"
FORECAST = (
    "session_type u1, offset_min u1, weather u1, track_temp i1, track_temp_change i1, air_temp i1, air_temp_change i1, rain_percent u1"
)
SESSION_HEAD = (
    "weather u1, track_temp i1, air_temp i1, total_laps u1, track_length u2, session_type u1, track_id i1, formula u1, "
    "session_time_left u2, session_duration u2, skip1 V5, num_marshal_zones u1"
)
SESSION_MID = "safety_car_status u1, skip2 V1, num_forecast u1"
SESSION_TAIL = (
    "skip3 V1, ai_difficulty u1, skip4 V20, ers_assist u1, drs_assist u1, skip5 V4, skip6 V4, skip7 V12, low_fuel_mode u1, "
    "skip8 V3, car_damage u1, car_damage_rate u1, skip9 V7, safety_car_setting u1, skip10 V7, skip11 V12, sector2_start_m f4, sector3_start_m f4"
)
HISTORY_HEAD = "car_index u1, num_laps u1, num_stints u1, best_lap_lap u1, best_s1_lap u1, best_s2_lap u1, best_s3_lap u1"
HISTORY_LAP = "lap_ms u4, s1_part_ms u2, s1_part_min u1, s2_part_ms u2, s2_part_min u1, s3_part_ms u2, s3_part_min u1, valid_flags u1"
HISTORY_STINT = "end_lap u1, actual_compound u1, visual_compound u1"
TYRE_SET = (
    "actual_compound u1, visual_compound u1, wear u1, available u1, recommended_session u1, life_span u1, usable_life u1, "
    "lap_delta_ms i2, fitted u1"
)
# Absolute byte offsets in the extended motion packet.
MOTION = {"wheel_speed": (77, "<f4", (4,)), "slip_ratio": (93, "<f4", (4,)), "slip_angle": (109, "<f4", (4,)), "velocity_x": (161, "<f4", ()), "velocity_y": (165, "<f4", ()), "yaw": (233, "<f4", ())}
MOTION_SIZE = 273
# Event details by code; codes not listed carry none.
EVENTS = {
    "FTLP": "vehicle_idx u1, lap_time f4", "RTMT": "vehicle_idx u1, reason u1", "DRSD": "reason u1", "TMPT": "vehicle_idx u1",
    "RCWN": "vehicle_idx u1", "DTSV": "vehicle_idx u1",
    "PENA": "penalty_type u1, infringement_type u1, vehicle_idx u1, other_vehicle_idx u1, time_s u1, lap_num u1, places_gained u1",
    "SPTP": "vehicle_idx u1, speed f4", "SGSV": "vehicle_idx u1", "FLBK": "rewind_frame u4, rewind_time f4",
    "OVTK": "vehicle1_idx u1, vehicle2_idx u1", "SCAR": "safety_car_type u1, event_type u1", "COLL": "vehicle1_idx u1, vehicle2_idx u1",
}
EVENT_FIELDS = {
    "vehicle_idx": "bigint", "lap_time": "float", "reason": "bigint", "penalty_type": "bigint", "infringement_type": "bigint",
    "other_vehicle_idx": "bigint", "time_s": "bigint", "lap_num": "bigint", "places_gained": "bigint", "speed": "float",
    "rewind_frame": "bigint", "rewind_time": "float", "vehicle1_idx": "bigint", "vehicle2_idx": "bigint",
    "safety_car_type": "bigint", "event_type": "bigint",
}


def layout(*texts: str) -> np.dtype:
    fields = []
    for item in ", ".join(texts).split(", "):
        name, code = item.split(" ")
        code, _, count = code.partition("[")
        code = code if code[0] in "SV" else "<" + code
        fields.append((name, code, (int(count[:-1]),)) if count else (name, code))
    return np.dtype(fields)


def _session_layout() -> np.dtype:
    head, mid, tail = layout(SESSION_HEAD), layout(SESSION_MID), layout(SESSION_TAIL)
    parts = head.descr + [("marshal_zones", layout(ZONE), (21,))] + mid.descr + [("forecast", layout(FORECAST), (64,))] + tail.descr
    return np.dtype([p if len(p) == 3 else (p[0], p[1]) for p in parts])


def _history_layout() -> np.dtype:
    return np.dtype(layout(HISTORY_HEAD).descr + [("laps", layout(HISTORY_LAP), (100,)), ("stints", layout(HISTORY_STINT), (8,))])


def _tyre_set_layout() -> np.dtype:
    return np.dtype([("car_index", "u1"), ("sets", layout(TYRE_SET), (20,)), ("fitted_idx", "u1")])


def _motion_layout() -> np.dtype:
    return np.dtype({
        "names": list(MOTION), "formats": [(t, s) if s else t for _, t, s in MOTION.values()],
        "offsets": [o for o, _, _ in MOTION.values()], "itemsize": MOTION_SIZE,
    })


# name: (packet id, layout of one slot, bytes before the slots, bytes after them)
CAR_KINDS = {
    "lap": (2, LAP, 0, 2), "participant": (4, PARTICIPANT, 1, 0), "telemetry": (6, TELEMETRY, 0, 3),
    "status": (7, STATUS, 0, 0), "classification": (8, CLASSIFICATION, 1, 0), "damage": (10, DAMAGE, 0, 0),
}
# name: (packet id, layout, offset of the layout, least packet length)
SINGLE_KINDS = {
    "session": (1, _session_layout(), HEADER_SIZE, 753), "history": (11, _history_layout(), HEADER_SIZE, HEADER_SIZE + 7 + 1400 + 24),
    "tyre_sets": (12, _tyre_set_layout(), HEADER_SIZE, HEADER_SIZE + 202), "motion": (13, _motion_layout(), 0, MOTION_SIZE),
}
# Arrays whose used length another field gives.
USED = {"marshal_zones": "num_marshal_zones", "forecast": "num_forecast", "laps": "num_laps", "stints": "num_stints"}


def _spark_type(t: np.dtype) -> str:
    if t.subdtype:
        return f"array<{_spark_type(t.subdtype[0])}>"
    if t.names:
        inner = ", ".join(f"{n}: {_spark_type(t[n])}" for n in t.names if t[n].kind != "V" or t[n].names)
        return f"struct<{inner}>"
    return {"S": "string", "f": "float" if t.itemsize == 4 else "double"}.get(t.kind, "bigint")


def _fields(t: np.dtype) -> list[str]:
    return [n for n in t.names if not (t[n].kind == "V" and not t[n].names and not t[n].subdtype)]


def _schema(t: np.dtype) -> str:
    return ", ".join(f"{n} {_spark_type(t[n])}" for n in _fields(t))


def _arrow(a: np.ndarray, used: np.ndarray | None = None) -> pa.Array:
    """A field of n packets (n, or n x k for arrays) as an Arrow column; ``used`` shortens arrays."""
    if a.ndim == 2:
        n, k = a.shape
        counts = np.full(n, k) if used is None else np.minimum(used.astype(np.int64), k)
        flat = a[np.arange(k) < counts[:, None]]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), _arrow(flat))
    if a.dtype.names:
        names = _fields(a.dtype)
        return pa.StructArray.from_arrays([_arrow(a[n]) for n in names], names)
    if a.dtype.kind == "S":
        return pa.array([v.split(b"\0", 1)[0].decode("utf-8", "replace") for v in a.tolist()], pa.string())
    return pa.array(np.ascontiguousarray(a) if a.dtype.kind == "f" else a.astype(np.int64))


def packet_id():
    return F.conv(F.hex(F.substring("payload", 7, 1)), 16, 10).cast("int")


PIECE = 512  # packets decoded or packed at once: what a task's Python holds does not grow with Spark's batches


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, PIECE):
            yield b.slice(at, PIECE)


def of_kind(packets: DataFrame, number: int, least: int) -> DataFrame:
    return packets.where((F.length("payload") >= least) & (packet_id() == number))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The data buffer of a binary column and where each payload starts, with the end of the last."""
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    return np.frombuffer(data, np.uint8), at[column.offset : column.offset + len(column) + 1].astype(np.int64)


def _view(column: pa.Array, t: np.dtype, offset: int | np.ndarray, count: int = 1, rows: np.ndarray | None = None) -> np.ndarray:
    """``count`` records of type ``t`` from each payload (of ``rows``), ``offset`` bytes after its start.

    Payloads of one size, the usual case for one kind, are one strided view of the buffer.
    """
    data, at = _bytes(column)
    starts = (at[:-1] if rows is None else at[rows]) + offset
    n, size = len(starts), t.itemsize * count
    step = np.diff(starts)
    if n > 1 and (step == step[0]).all() and step[0] >= 0:
        flat = np.lib.stride_tricks.as_strided(data[starts[0] :], (n, size), (step[0], 1))
    else:
        flat = np.empty((n, size), np.uint8)
        for i in range(0, n, GATHERED):
            flat[i : i + GATHERED] = data[starts[i : i + GATHERED, None] + np.arange(size)]
    return np.ascontiguousarray(flat).view(t).reshape(n, count)


GATHERED = 1024  # payloads of mixed sizes copied at once
HEAD = layout(HEADER)
KEPT = {"session_uid": "bigint", "session_time": "float", "frame_identifier": "bigint", "player_car_index": "bigint"}
KEPT_SCHEMA = ", ".join(f"{k} {t}" for k, t in KEPT.items())


def headers(packets: DataFrame) -> DataFrame:
    """Header of each packet; packets shorter than a header are dropped, unknown formats only marked."""
    names = _fields(HEAD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            h = _view(b.column("payload"), HEAD, 0)[:, 0]
            known = pa.array((h["packet_format"] == 2025) & (h["game_year"] == 25))
            yield pa.RecordBatch.from_arrays([b.column("recv_seq"), *[_arrow(h[n]) for n in names], known], ["recv_seq", *names, "known_format"])

    whole = packets.where(F.length("payload") >= HEADER_SIZE).select("recv_seq", "payload")
    return whole.mapInArrow(run, f"recv_seq bigint, {_schema(HEAD)}, known_format boolean")


def cars(packets: DataFrame, kind: str) -> DataFrame:
    """Twenty-two rows per packet of a per-car kind; packets that are too short give none.

    Where the packets come with ``slots``, the slots in use, only those give rows.
    """
    known = ["slots"] if "slots" in packets.columns else []
    number, text, before, after = CAR_KINDS[kind]
    slot = layout(text)
    names = _fields(slot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            raw = b.column("payload")
            h, a = _view(raw, HEAD, 0)[:, 0], _view(raw, slot, HEADER_SIZE + before, CARS).reshape(-1)
            lead = [pa.array(np.repeat(np.asarray(b.column("recv_seq")), CARS))]
            lead += [_arrow(np.repeat(h[k], CARS)) for k in KEPT] + [pa.array(np.tile(np.arange(CARS, dtype=np.int64), len(raw)))]
            out = pa.RecordBatch.from_arrays([*lead, *[_arrow(a[n]) for n in names]], ["recv_seq", *KEPT, "car_slot", *names])
            if known:
                used = np.zeros((len(raw), CARS), bool)
                at = b.column("slots")
                used[np.repeat(np.arange(len(raw)), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy()] = True
                out = out.filter(pa.array(used.reshape(-1)))
            yield out

    least = HEADER_SIZE + before + CARS * slot.itemsize + after
    return of_kind(packets, number, least).select("recv_seq", "payload", *known).mapInArrow(run, f"recv_seq bigint, {KEPT_SCHEMA}, car_slot bigint, {_schema(slot)}")


def singles(packets: DataFrame, kind: str) -> DataFrame:
    """One row per packet of a single-struct kind, with nested arrays cut to their used length."""
    number, t, offset, least = SINGLE_KINDS[kind]
    names = _fields(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            raw = b.column("payload")
            h, a = _view(raw, HEAD, 0)[:, 0], _view(raw, t, offset)[:, 0]
            cols = [_arrow(a[n], a[USED[n]] if n in USED else None) for n in names]
            yield pa.RecordBatch.from_arrays([b.column("recv_seq"), *[_arrow(h[k]) for k in KEPT], *cols], ["recv_seq", *KEPT, *names])

    return of_kind(packets, number, least).select("recv_seq", "payload").mapInArrow(run, f"recv_seq bigint, {KEPT_SCHEMA}, {_schema(t)}")


CODE = np.dtype("S4")


def _codes(raw: pa.Array, rows: np.ndarray | None = None) -> np.ndarray:
    return _view(raw, CODE, HEADER_SIZE, rows=rows)[:, 0]


def events(packets: DataFrame) -> DataFrame:
    """Event packets: the code and the details it carries, other fields null."""
    layouts = {code: layout(text) for code, text in EVENTS.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            raw = b.column("payload")
            h, codes, length = _view(raw, HEAD, 0)[:, 0], _codes(raw), np.diff(_bytes(raw)[1])
            kinds, which = np.unique(codes, return_inverse=True)
            values = {f: np.zeros(len(raw), np.float32 if k == "float" else np.int64) for f, k in EVENT_FIELDS.items()}
            missing = {f: np.ones(len(raw), bool) for f in EVENT_FIELDS}
            for code, t in layouts.items():
                rows = np.flatnonzero((codes == code.encode()) & (length >= HEADER_SIZE + 4 + t.itemsize))
                a = _view(raw, t, HEADER_SIZE + 4, rows=rows)[:, 0]
                for f in t.names:
                    values[f][rows], missing[f][rows] = a[f], False
            names = pa.array([k.decode("ascii", "replace") for k in kinds.tolist()], pa.string())
            out = [b.column("recv_seq"), *[_arrow(h[k]) for k in KEPT], names.take(pa.array(which.reshape(-1)))]
            out += [pa.array(values[f], mask=missing[f]) for f in EVENT_FIELDS]
            yield pa.RecordBatch.from_arrays(out, ["recv_seq", *KEPT, "event_code", *EVENT_FIELDS])

    body = ", ".join(f"{f} {k}" for f, k in EVENT_FIELDS.items())
    return of_kind(packets, 3, HEADER_SIZE + 4).select("recv_seq", "payload").mapInArrow(run, f"recv_seq bigint, {KEPT_SCHEMA}, event_code string, {body}")


# What driving events take from a kind of packet; per-car kinds give the player's slot alone.
PLAYER = {
    "session": ("track_id", "session_type"), "lap": ("lap_distance", "current_lap_num", "sector"),
    "telemetry": ("speed", "throttle", "steer", "brake"), "motion": tuple(MOTION),
}


def player_stream(packets: DataFrame) -> DataFrame:
    """The player's session, lap, telemetry and motion packets and the rewinds as one tagged stream, from one scan.

    A row has the struct of its own kind, the others null; ``rewind`` is true for a rewind. Packets that are too
    short and per-car packets without a player's slot give no row.
    """
    kinds = {}
    for kind, wanted in PLAYER.items():
        if kind in CAR_KINDS:
            number, text, before, after = CAR_KINDS[kind]
            t = layout(text)
            kinds[kind] = (number, t, HEADER_SIZE + before, HEADER_SIZE + before + CARS * t.itemsize + after, wanted)
        else:
            kinds[kind] = (*SINGLE_KINDS[kind], wanted)
    types = {kind: f"struct<{', '.join(f'{n}: {_spark_type(k[1][n])}' for n in k[4])}>" for kind, k in kinds.items()}
    numbers = [k[0] for k in kinds.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = {k: pa.StructArray.from_arrays([_arrow(np.zeros((0, *t[n].shape), t[n].base)) for n in w], list(w)).type for k, (_, t, _, _, w) in kinds.items()}
        for b in pieces(batches):
            raw = b.column("payload")
            h, length = _view(raw, HEAD, 0)[:, 0], np.diff(_bytes(raw)[1])

            def out(rows: np.ndarray, mine: str | None = None, body: pa.Array | None = None) -> pa.RecordBatch:
                cols = [body if k == mine else pa.nulls(len(rows), empty[k]) for k in kinds]
                lead = [b.column("recv_seq").take(pa.array(rows)), *[_arrow(h[k][rows]) for k in KEPT]]
                return pa.RecordBatch.from_arrays([*lead, *cols, pa.array(np.full(len(rows), mine is None))], ["recv_seq", *KEPT, *kinds, "rewind"])

            for kind, (number, t, offset, least, wanted) in kinds.items():
                fits = (h["packet_id"] == number) & (length >= least)
                if kind in CAR_KINDS:
                    fits &= h["player_car_index"] < CARS
                rows = np.flatnonzero(fits)
                if len(rows):
                    slot = h["player_car_index"][rows].astype(np.int64) * t.itemsize if kind in CAR_KINDS else 0
                    a = _view(raw, t, offset + slot, rows=rows)[:, 0]
                    yield out(rows, kind, pa.StructArray.from_arrays([_arrow(a[n]) for n in wanted], list(wanted)))
            rows = np.flatnonzero((h["packet_id"] == 3) & (length >= HEADER_SIZE + 4))
            rows = rows[_codes(raw, rows) == b"FLBK"]
            if len(rows):
                yield out(rows)

    found = packets.where((F.length("payload") >= HEADER_SIZE) & packet_id().isin(3, *numbers)).select("recv_seq", "payload")
    body = ", ".join(f"{k} {t}" for k, t in types.items())
    return found.mapInArrow(run, f"recv_seq bigint, {KEPT_SCHEMA}, {body}, rewind boolean")


# ---- packing, for round trips in tests and checks ---------------------------------------------


def _put(target: np.ndarray, at: tuple[np.ndarray, ...], values: pa.StructArray) -> None:
    """Write the fields of ``values`` into the records ``target[at]``; nulls leave what is there."""
    for n, column in zip([f.name for f in values.type], values.flatten()):
        t = target.dtype[n]
        if column.null_count:
            known = column.is_valid()
            column, rows = column.filter(known), tuple(x[known.to_numpy(zero_copy_only=False)] for x in at)
        else:
            rows = at
        if t.subdtype:
            size = column.value_lengths().to_numpy().astype(np.int64)
            rows = (*[np.repeat(x, size) for x in rows], np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
            column, t = column.flatten(), t.base
        if t.names:
            _put(target[n], rows, column)
        elif t.kind == "S":
            target[n][rows] = [x.encode() for x in column.to_pylist()]
        else:
            given = column.to_numpy(zero_copy_only=False)
            kept = given.astype(t)
            if t.kind in "iu" and given.dtype.kind in "iu" and (kept != given).any():
                raise OverflowError(f"{n} does not fit into {t}")
            target[n][rows] = kept


def _packets(batch: pa.RecordBatch, kind: str, body: pa.Array, slots: bool) -> Iterator[pa.RecordBatch]:
    """Packets of one kind from a batch; events come by code."""
    n = batch.num_rows
    number = 0 if kind == "header" else 3 if kind == "event" else (CAR_KINDS.get(kind) or SINGLE_KINDS[kind])[0]
    h, every = np.zeros(n, HEAD), np.arange(n)
    h["packet_format"], h["game_year"], h["packet_id"] = 2025, 25, number
    lead = [k for k in LEAD if k in batch.schema.names]
    _put(h, (every,), pa.StructArray.from_arrays([batch[k] for k in lead], lead))

    def out(rows: np.ndarray, parts: list[np.ndarray], *more: pa.Array) -> pa.RecordBatch:
        flat = np.concatenate([h[rows].view(np.uint8).reshape(len(rows), -1), *parts], axis=1)
        offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(flat.shape[1])
        payload = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(flat.reshape(-1))])
        return pa.RecordBatch.from_arrays([batch["recv_seq"].take(pa.array(rows)), payload, *more], ["recv_seq", "payload", *["slots"] * len(more)])

    def zeros(size: int, count: int = n) -> np.ndarray:
        return np.zeros((count, size), np.uint8)

    if kind == "header":
        yield out(every, [])
    elif kind in CAR_KINDS:
        _, text, before, after = CAR_KINDS[kind]
        a = np.zeros((n, CARS), layout(text))
        size = body.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        cars_ = body.flatten()
        fields = dict(zip([f.name for f in cars_.type], cars_.flatten()))
        slot = fields.pop("car_slot").to_numpy(zero_copy_only=False).astype(np.int64)
        if ((slot < 0) | (slot >= CARS)).any():
            raise IndexError("car_slot")
        _put(a, (np.repeat(every, size), slot), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
        used = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(slot.astype(np.int32)))
        yield out(every, [zeros(before), a.view(np.uint8).reshape(n, -1), zeros(after)], *[used] * slots)
    elif kind == "event":
        fields = dict(zip([f.name for f in body.type], body.flatten()))
        codes = np.array(fields.pop("event_code").to_pylist(), dtype=str)
        for code in np.unique(codes).tolist():
            rows = np.flatnonzero(codes == code)
            a = np.zeros(len(rows), layout(EVENTS[code])) if code in EVENTS else np.zeros(len(rows), "V0")
            mine = [f for f in fields if code in EVENTS and f in a.dtype.names]
            if mine:
                _put(a, (np.arange(len(rows)),), pa.StructArray.from_arrays([fields[f].take(pa.array(rows)) for f in mine], mine))
            name = np.tile(np.frombuffer(code.encode(), np.uint8), (len(rows), 1))
            details = [a.view(np.uint8).reshape(len(rows), -1)] if code in EVENTS else []
            yield out(rows, [name, *details, zeros(4, len(rows))])
    else:
        _, t, offset, least = SINGLE_KINDS[kind]
        a = np.zeros(n, t)
        _put(a, (every,), body)
        bytes_ = a.view(np.uint8).reshape(n, -1)[:, HEADER_SIZE - offset :]
        yield out(every, [bytes_, zeros(max(0, least - HEADER_SIZE - bytes_.shape[1]))])


LEAD = ("session_uid", "frame_identifier", "session_time", "player_car_index")


def pack(rows_: DataFrame, kind: str, slots: bool = False) -> DataFrame:
    """Packets from rows of (recv_seq, session_uid, frame_identifier, body), and session_time and
    player_car_index if there.

    ``body`` is an array of structs (``car_slot`` and fields) for per-car kinds, else one struct. With
    ``slots`` per-car packets come with their slots in use.
    Events carry ``event_code`` in the struct; kind "header" packs the header alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield from _packets(b, kind, None if kind == "header" else b["body"], slots and kind in CAR_KINDS)

    return rows_.mapInArrow(run, "recv_seq bigint, payload binary" + (", slots array<int>" if slots else ""))


def pack_kinds(rows_: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """As ``pack``, several kinds in one pass: a packet of each kind whose column, named as the kind, holds a body.
    Of the row's recv_seq, kind i gets the i-th after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            for i, kind in enumerate(kinds):
                mine = b.filter(b[kind].is_valid())
                if mine.num_rows:
                    seq = pa.compute.add(mine["recv_seq"], pa.scalar(i, pa.int64()))
                    mine = mine.set_column(mine.schema.get_field_index("recv_seq"), "recv_seq", seq)
                    yield from _packets(mine, kind, mine[kind], False)

    return rows_.mapInArrow(run, "recv_seq bigint, payload binary")

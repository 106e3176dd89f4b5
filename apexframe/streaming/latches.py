"""Steps that remember what they did last: latches of rules, message delivery, sector changes.

Everything that can be read off a tick (neighbours, gaps, texts, look-backs) is prepared as columns. A step is a
few lines over a session's state; ``operators.memory`` runs it in a batch, ``streaming.memory`` in a stream.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of corners and parts, waits and lifetimes in this module.
CORNERS = ("Rear-left", "Rear-right", "Front-left", "Front-right")
PARTS = ("Front wing", "Rear wing", "Floor", "Diffuser", "Sidepod")
EXTRA = "code string, n1 bigint, n2 bigint, n3 bigint"


# ---- steps: (state, row) -> None, (code, n1, n2[, n3]) or a list of them ----------------------


def yellow(s: dict, r) -> tuple | None:
    """``r.yellow`` has one bit per sector. One call per tick; a cleared sector is armed again."""
    said = s.get("said", 0) & r.yellow
    s["said"] = said
    for sector in (r.sector, (r.sector + 1) % 3):
        if r.yellow >> sector & 1 and not said >> sector & 1:
            s["said"] = said | 1 << sector
            return "yellow", sector + 1, 0
    return None


def record(wait_ms: int, silent: bool = False) -> Callable:
    """Announce a mark above the last one announced, then nothing for a while. With ``silent`` the first is only kept."""

    def step(s: dict, r) -> tuple | None:
        if silent and "top" not in s:
            s["top"] = r.mark
        if r.mark <= s.get("top", 0) or r.at < s.get("free", r.at):
            return None
        s["top"] = r.mark
        if r.at > 0:
            s["free"] = r.at + wait_ms
        return "record", r.mark

    return step


def climbs(levels: tuple, slack: int, prefer: Callable, together: bool = False, restored: int | None = None) -> Callable:
    """Announce the levels that channels reach, one per row.

    ``r.readings`` has a value per channel. A level is open on a channel while it lies above the highest one
    announced there; of all open levels reached, the first by ``prefer(channel, level)`` is announced. A
    reading more than ``slack`` under the announced level opens all levels of its channel again, or of every
    channel with ``together``; on channel ``restored`` that is itself announced.
    """

    def step(s: dict, r) -> tuple | None:
        top = s.get("top") or [0] * len(r.readings)
        eased = [i for i, v in enumerate(r.readings) if v < top[i] - slack]
        for i in range(len(top)) if together and eased else eased:
            top[i] = 0
        s["top"] = top
        if restored in eased:
            return "restored", restored, 0
        reached = [(i, x) for x in levels for i, v in enumerate(r.readings) if top[i] < x <= v]
        if not reached:
            return None
        channel, level = min(reached, key=lambda at: prefer(*at))
        top[channel] = level
        return "reached", channel, level

    return step


# Wear and damage levels in percent.
corner_wear = climbs((24, 37), 5, prefer=lambda corner, level: (corner, -level), together=True)
damage = climbs((10, 30, 60), 1, prefer=lambda part, level: (-level, part), restored=0)


def cooldown(wait_ms: int) -> Callable:
    """Let one firing through for each rival, then none for a while."""

    def step(s: dict, r) -> tuple | None:
        if r.at < s.get(r.rival, r.at):
            return None
        s[r.rival] = r.at + wait_ms
        return "fire", r.rival

    return step


def lap_gap(least: int) -> Callable:
    def step(s: dict, r) -> tuple | None:
        if "lap" in s and r.lap - s["lap"] < least:
            return None
        s["lap"] = int(r.lap)
        return "fire", r.lap

    return step


def per_lap(cap: int) -> Callable:
    """Let so many through in each lap."""

    def step(s: dict, r) -> tuple | None:
        s[r.lap] = s.get(r.lap, 0) + 1
        return ("pass", s[r.lap]) if s[r.lap] <= cap else None

    return step


def changed(s: dict, r) -> tuple | None:
    """A later lap whose value is another than that of the last one let through."""
    if r.lap > s.get("lap", 0) and r.value != s.get("value"):
        s["lap"], s["value"] = r.lap, r.value
        return "new", r.lap
    return None


CALLS = ("", "five", "next", "box")


def pit_calls(s: dict, r) -> tuple | None:
    """``r.due`` numbers the call a tick asks for (0 none). Each is made once, in rising order.

    A stop starts anew; a stop put off after its second call is announced as missed and starts anew.
    """
    made = 0 if r.stopped else s.get("made", 0)
    missed = bool(r.put_off) and made >= 2
    s["made"] = 0 if missed else max(made, int(r.due))
    if missed:
        return "missed", r.target, 0
    return (CALLS[r.due], r.target, 0) if r.due > made else None


def sector_changes(s: dict, r) -> list | None:
    """Completed sectors of one car from lap packets, with the newest history packet remembered.

    The code is the recovery tier; n1 sector, n2 lap, n3 sector time. History rows carry the last
    five laps' sector times, oldest first.
    """
    if r.is_history:
        s["n"], s["laps"] = int(r.num_laps), [[int(v) for v in lap] for lap in r.last_laps]
        return None
    out, was = [], s.get("sector")
    if was is not None and was != r.sector:
        c1, c2 = s.get("c1", 0), s.get("c2", 0)
        for i in range((r.sector - was) % 3):
            done = (was + i) % 3
            lap = s["lap"] if done == 2 else r.lap
            live = (r.s1_ms, r.s2_ms, -1)[done]
            back = s.get("n", 0) - lap
            laps = s.get("laps", [])
            old = laps[-1 - back][done] if 0 <= back < min(5, len(laps)) else 0
            tier = 0 if i == 0 else 1 if live > 0 else 2 if old > 0 else 3
            third = r.last_lap_ms - c1 - c2
            if tier >= 2:
                ms = old if tier == 2 else 0
            elif done < 2:
                ms = live
            elif r.last_lap_ms > 0 and c1 > 0 and c2 > 0 and third > 0:
                ms = third
            else:
                ms = r.last_lap_ms - r.s1_ms - r.s2_ms if r.last_lap_ms > 0 else 0
            out.append((str(tier), done, lap, ms))
    s["sector"], s["lap"] = int(r.sector), int(r.lap)
    for key, ms in (("c1", r.s1_ms), ("c2", r.s2_ms)):
        if ms > 0:
            s[key] = int(ms)
    return out or None


KEEP_MS = (8_000, 30_000, 60_000)  # age at which a message of each rank is dropped


def deliver(s: dict, r) -> tuple | None:
    """Queue the tick's messages and hand out at most one; n1 is its number.

    Rank 0 goes any time, 1 only inside a zone, 2 at most twice per zone visit. Messages expire by laps and by age.
    A quiet tick empties the queue; without a tick (``here`` false) messages only wait.
    """
    queue = [*s.get("queue", ()), *[(m["rank"], m["born"], m["no"], m["last_lap"]) for m in r.fresh or ()]]
    if r.here:
        queue = [] if r.quiet else sorted(m for m in queue if r.lap <= m[3] and r.at - m[1] <= KEEP_MS[m[0]])
    s["queue"] = queue
    if not r.here or r.quiet:
        return None
    if r.zone != s.get("zone", -1):
        s["zone"], s["used"] = r.zone, 0
    rank = queue[0][0] if queue else None
    if rank is None or (rank and r.zone < 0) or (rank == 2 and s.get("used", 0) >= 2):
        return None
    s["used"] = s.get("used", 0) + (rank == 2)
    s["queue"] = queue[1:]
    return "deliver", queue[0][2]


# ---- runners ---------------------------------------------------------------------------------


def _fire(state: dict, pdf: pd.DataFrame, order: list[str], keep: list[str], step: Callable) -> pd.DataFrame:
    pdf = pdf.sort_values(order, kind="stable")
    hits = []
    for i, r in enumerate(pdf.itertuples(index=False)):
        out = step(state, r)
        if out is not None:
            hits += [(i, o) for o in (out if isinstance(out, list) else [out])]
    fired = pdf.iloc[[i for i, _ in hits]][keep].reset_index(drop=True)
    fired["code"] = pd.Series([out[0] for _, out in hits], dtype="object")
    for k in (1, 2, 3):
        fired[f"n{k}"] = pd.Series([int(out[k]) if len(out) > k else 0 for _, out in hits], dtype="int64")
    return fired


def _schema(df: DataFrame, keep: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join([f"`{k}` {types[k]}" for k in keep] + [EXTRA])


def run(df: DataFrame, order: list[str], keep: list[str], step: Callable, keys: tuple[str, ...] = ("session_uid",)) -> DataFrame:
    """Batch run: one group per key, rows in ``order``."""
    return df.groupBy(*keys).applyInPandas(lambda pdf: _fire({}, pdf, order, keep, step), _schema(df, keep))


def run_stream(df: DataFrame, order: list[str], keep: list[str], step: Callable, keys: tuple[str, ...] = ("session_uid",)) -> DataFrame:
    """The same over a stream: the state lives in the state store between micro-batches."""
    from pyspark.sql.streaming import StatefulProcessor

    class Latch(StatefulProcessor):
        def init(self, handle) -> None:
            self.memo = handle.getValueState("memo", "json string")

        def handleInputRows(self, k, rows, timer):  # noqa: N802 - name set by the API
            state = json.loads(self.memo.get()[0]) if self.memo.exists() else {}
            yield _fire(state, pd.concat(list(rows)), order, keep, step)
            self.memo.update((json.dumps(state, default=int),))

        def close(self) -> None:
            pass

    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=Latch(), outputStructType=_schema(df, keep), outputMode="Append", timeMode="None"
    )


def label(names: tuple, i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))

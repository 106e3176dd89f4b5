"""Runs and liveness by event-time timers.

A session's timer stands at the next moment at which something is due; it is set anew whenever a row changes that
moment. When it expires, all that is due up to the watermark happens in order of time, so nothing waits for further
rows of its own session: the rows of any session move the watermark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

QUIET_MS, FLOOR_MS, LIVE_MS = 3000, 5000, 5000


class _Timed(StatefulProcessor):
    """A processor with one value of state and one timer for each key."""

    def init(self, handle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "data string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 - names set by the API
        state = self._read()
        for r in rows:
            self.take(state, r)
        yield from self._go_on(key[0], state, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        state = self._read()
        if state.get("timer") == expiredTimerInfo.getExpiryTimeInMs():
            state["timer"] = None
            yield from self._go_on(key[0], state, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _read(self) -> dict:
        return json.loads(self.memory.get()[0]) if self.memory.exists() else {}

    def _go_on(self, key, state: dict, now: int) -> Iterator[Row]:
        """Everything due by ``now``; then the timer stands at the next due moment, or the state is given up."""
        while (at := self.due(state)) is not None and at <= now:
            yield from self.happen(key, state, at)
        if at != state.get("timer"):
            if state.get("timer") is not None:
                self.handle.deleteTimer(state["timer"])
            if at is not None:
                self.handle.registerTimer(at)
            state["timer"] = at
        if at is None and state.get("end") is not None:
            self.memory.clear()
        else:
            self.memory.update((json.dumps(state),))


class Runs(_Timed):
    """Triggers gather into a run until they have been quiet; without a run for a while one starts by itself, from the
    first run to the session's end."""

    row = Row("session_uid", "fire_ms", "cause", "triggers")

    def take(self, state: dict, r) -> None:
        if r["ends"]:
            state["end"] = r["at_ms"]
        else:
            state["waiting"] = sorted([*state.get("waiting", []), r["at_ms"]])

    def _burst(self, state: dict) -> list[int]:
        """The first triggers that lie no further apart than the quiet time."""
        burst: list[int] = []
        for at in state.get("waiting", []):
            if burst and at - burst[-1] > QUIET_MS:
                break
            burst.append(at)
        return burst

    def due(self, state: dict) -> int | None:
        burst = self._burst(state)
        moments = [burst[-1] + QUIET_MS] if burst else []
        if "last" in state and state["last"] + FLOOR_MS < state.get("end", 1 << 62):
            moments.append(state["last"] + FLOOR_MS)
        return min(moments, default=None)

    def happen(self, key, state: dict, at: int) -> Iterator[Row]:
        burst = self._burst(state)
        run = bool(burst) and burst[-1] + QUIET_MS == at
        if run:
            state["waiting"] = state["waiting"][len(burst) :]
        state["last"] = at
        yield self.row(key, at, "trigger" if run else "idle", len(burst) if run else 0)


class Liveness(_Timed):
    """A session is live from its first state on, and no longer once no state has come for a while."""

    row = Row("session_uid", "at_ms", "live")

    def take(self, state: dict, r) -> None:
        state["times"] = sorted([*state.get("times", []), r["at_ms"]])

    def _chain(self, times: list[int]) -> int:
        """How many of the first times lie no further apart than a session stays live."""
        n = 1
        while n < len(times) and times[n] - times[n - 1] <= LIVE_MS:
            n += 1
        return n

    def due(self, state: dict) -> int | None:
        times = state.get("times")
        if not times:
            return None
        if not state.get("live"):
            return times[0]
        state["times"] = times = times[self._chain(times) - 1 :]  # what lies before the end of the chain is told
        return times[0] + LIVE_MS

    def happen(self, key, state: dict, at: int) -> Iterator[Row]:
        state["live"] = not state.get("live")
        if not state["live"]:
            state["times"] = state["times"][1:]
        yield self.row(key, at, state["live"])


def _timed(rows: DataFrame, late: str) -> DataFrame:
    return rows.withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", late)


def runs(triggers: DataFrame, late: str = "10 seconds") -> DataFrame:
    """``(session_uid, fire_ms, cause, triggers)`` of a stream ``(session_uid, at_ms, ends)`` of triggers and session ends."""
    rows = _timed(triggers.select("session_uid", F.col("at_ms").cast("long").alias("at_ms"), "ends"), late)
    key = rows.schema["session_uid"].dataType.simpleString()
    return rows.groupBy("session_uid").transformWithState(Runs(), f"session_uid {key}, fire_ms bigint, cause string, triggers bigint", "Append", "EventTime")


def liveness(states: DataFrame, late: str = "10 seconds") -> DataFrame:
    """``(session_uid, at_ms, live)``: when each session of a stream ``(session_uid, at_ms)`` goes live and stale."""
    rows = _timed(states.select("session_uid", F.col("at_ms").cast("long").alias("at_ms")), late)
    key = rows.schema["session_uid"].dataType.simpleString()
    return rows.groupBy("session_uid").transformWithState(Liveness(), f"session_uid {key}, at_ms bigint, live boolean", "Append", "EventTime")

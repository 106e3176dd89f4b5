"""Rule memory in a stream: ticks put in order, and look-backs kept in the state store.

``in_order`` holds ticks until the watermark has passed them and gives them on by event time, so a tick that arrives
late takes its place as long as it is not later than allowed; what is later is dropped and counted by the engine.
``Stateful`` is the engine that ``operators.memory.remembered`` takes instead of windows: the same folds as in a
batch, their memory being one value for each session. It ends with the session (a tick marked ``ended``); with
``ttl_ms`` also after so long without ticks, for streams that run on (the engine then starts batches for its clock
alone, so such a stream does not stop at the end of what is available). Columns that a stage only passes on cross to Python as one string.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from apexframe.operators.memory import KEY, ORDER, Folds, Look, result_types



def _row(value):
    """Structs as rows, which the engine takes by name."""
    if isinstance(value, dict):
        return Row(**{k: _row(v) for k, v in value.items()})
    return [_row(v) for v in value] if isinstance(value, list) else value


def _packed(df: DataFrame, keep: list[str]):
    """Columns beside ``keep`` as one, and their schema."""
    rest = [f for f in df.schema.fields if f.name not in keep]
    return F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in rest])).alias("_row"), _nullable(T.StructType(rest))


def _nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed everywhere, as what is read back from text has them."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_nullable(kind.elementType))
    return kind


def _unpacked(df: DataFrame, kept: list[str], rest: T.StructType) -> DataFrame:
    row = F.from_json("_row", rest)
    return df.withColumn("_row", row).select(*kept, *[F.col(f"_row.`{n}`").alias(n) for n in rest.names])


class InOrder(StatefulProcessor):
    """Holds rows by event time; a timer for each time hands them on once the watermark has reached it."""

    def __init__(self, key: str, order: str) -> None:
        self.order, self.row = order, Row(key, order, "_row")

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "at bigint", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 - names set by the API
        for r in rows:
            at = (r["_at"],)
            if self.held.containsKey(at):
                waiting = pickle.loads(self.held.getValue(at)[0])
            else:
                waiting = []
                self.handle.registerTimer(r["_at"])
            self.held.updateValue(at, (pickle.dumps([*waiting, (r[self.order], r["_row"])]),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        at = (expiredTimerInfo.getExpiryTimeInMs(),)
        if self.held.containsKey(at):
            for order, row in sorted(pickle.loads(self.held.getValue(at)[0])):
                yield self.row(key[0], order, row)
            self.held.removeKey(at)

    def close(self) -> None:
        pass


def in_order(ticks: DataFrame, ts: str = "ts", late: str = "10 seconds", key: str = KEY, order: str = ORDER) -> DataFrame:
    """``ticks`` by event time ``ts``, final once the watermark has passed it. Ticks of one time go by ``order``."""
    timed = ticks.withWatermark(ts, late)
    row, rest = _packed(timed, [key, order, ts])
    packed = timed.select(key, order, ts, F.unix_millis(ts).alias("_at"), row)
    fields = [timed.schema[key], timed.schema[order], T.StructField("_row", T.StringType())]
    out = packed.groupBy(key).transformWithState(InOrder(key, order), T.StructType(fields), "Append", "EventTime")
    return _unpacked(out, [key, order], rest)


class Remember(StatefulProcessor):
    def __init__(self, folds: Folds, names: list[str], order: str, ttl_ms: int | None) -> None:
        self.folds, self.order, self.ttl_ms = folds, order, ttl_ms
        self.row, self.n = Row(*names), len(folds.kinds)

    def init(self, handle) -> None:
        self.memory = handle.getValueState("memory", "data binary", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        state = pickle.loads(self.memory.get()[0]) if self.memory.exists() else self.folds.new()
        for r in sorted(rows, key=lambda r: r[self.order]):
            found = self.folds.take(state, [r[f"_in{i}"] for i in range(self.n)])
            found = [_row(x) for x in found]
            yield self.row(key[0], r[self.order], r["_row"], *found)
            if r["_end"]:
                state = self.folds.new()
        self.memory.update((pickle.dumps(state),))

    def close(self) -> None:
        pass


class Stateful:
    """Stream engine of ``remembered``: each turn is one stage with its memory in the state store."""

    def __init__(self, key: str = KEY, order: str = ORDER, ttl_ms: int | None = None) -> None:
        self.key, self.order, self.ttl_ms = key, order, ttl_ms

    def __call__(self, ticks: DataFrame, looks: dict[str, Look]) -> DataFrame:
        kept = [self.key, self.order]
        row, rest = _packed(ticks, kept)
        end = F.coalesce("ended", F.lit(False)) if "ended" in ticks.columns else F.lit(False)
        shaped = ticks.select(*kept, row, end.alias("_end"), *[look.input().alias(f"_in{i}") for i, look in enumerate(looks.values())])
        fields = [*[ticks.schema[k] for k in kept], T.StructField("_row", T.StringType()), *_nullable(T.StructType(result_types(ticks, looks))).fields]
        step = Remember(Folds(list(looks.values())), [f.name for f in fields], self.order, self.ttl_ms)
        out = shaped.groupBy(self.key).transformWithState(step, T.StructType(fields), "Append", "ProcessingTime" if self.ttl_ms else "None")
        return _unpacked(out, [*kept, *looks], rest)

"""What rules remember of earlier ticks: look-backs that many rules ask for together.

A rule is a generator over columns. It yields the look-backs it needs as ``{name: Look}``, is handed their columns
and may ask again, now with conditions over those; at last it returns its messages. ``remembered`` advances all
rules side by side and answers what they ask at the same turn with one step over the ticks, so any number of rules
takes one shuffle by session and one sort by tick. In a batch a turn is window expressions over the same order,
and a small fold over the sorted rows from the first turn on that asks for a latch (``step``). In a stream every
turn is that fold with its memory in the state store (``streaming.memory``).
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from types import SimpleNamespace
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY, ORDER = "session_uid", "tick"
FIRED = T.StructType([T.StructField("code", T.StringType())] + [T.StructField(f"n{k}", T.LongType()) for k in (1, 2, 3)])


class Look(NamedTuple):
    kind: str
    value: Column
    on: Column | None = None
    prior: bool = True
    step: Callable | None = None

    def input(self) -> Column:
        """The value where the tick counts, else null; a lag keeps nulls apart from ticks that do not count."""
        value = F.struct(self.value.alias("v")) if self.kind == "lag" else self.value
        return value if self.on is None else F.when(self.on, value)


def lag(value: str | Column, on: Column | None = None) -> Look:
    """The value at the last earlier tick that counts, be it null."""
    return Look("lag", _col(value), on)


def last(value: str | Column, on: Column | None = None, prior: bool = True) -> Look:
    """The last value that is not null."""
    return Look("last", _col(value), on, prior)


def least(value: str | Column, on: Column | None = None, prior: bool = True) -> Look:
    return Look("min", _col(value), on, prior)


def most(value: str | Column, on: Column | None = None, prior: bool = True) -> Look:
    return Look("max", _col(value), on, prior)


def count(on: Column, prior: bool = True) -> Look:
    return Look("count", F.lit(1), on, prior)


def mean(value: str | Column, rows: int, on: Column | None = None) -> Look:
    """The mean over the last ``rows`` ticks that count, this one among them; null before there are so many."""
    return Look("mean", _col(value).cast("double"), on, False, rows)


def latch(step: Callable, on: Column | None = None, **inputs: Column) -> Look:
    """``(code, n1, n2, n3)`` as ``step(state, inputs)`` gives them, null where it gives none."""
    return Look("step", F.struct(*[v.alias(k) for k, v in inputs.items()]), on, False, step)


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


class Message(NamedTuple):
    rule: str
    fire: Column
    priority: str | Column
    ttl: int | Column
    text: str | Column


Rule = Callable[[Column], Generator[dict[str, Look], SimpleNamespace, Any]]
Engine = Callable[[DataFrame, dict[str, Look]], DataFrame]


def remembered(ticks: DataFrame, rules: dict[str, tuple[Rule, Column]], engine: Engine | None = None) -> tuple[DataFrame, dict[str, Any]]:
    """``ticks`` with the look-backs of ``rules`` (name -> rule and the ticks it counts), and what each returns."""
    engine = engine or Windows()
    live, results, asked = {}, {}, {}
    for name, (rule, on) in rules.items():
        live[name] = rule(on)
        _advance(name, live, None, results, asked)
    turn = 0
    while live:
        turn += 1
        looks = {f"_{name}_{turn}_{k}": look for name, wanted in asked.items() for k, look in wanted.items()}
        ticks = engine(ticks, looks)
        answers, asked = {name: SimpleNamespace(**{k: F.col(f"_{name}_{turn}_{k}") for k in wanted}) for name, wanted in asked.items()}, {}
        for name, answer in answers.items():
            _advance(name, live, answer, results, asked)
    return ticks, results


def _advance(name: str, live: dict, answer: SimpleNamespace | None, results: dict, asked: dict) -> None:
    try:
        asked[name] = live[name].send(answer)
    except StopIteration as end:
        results[name] = end.value
        del live[name]


def spoken(ticks: DataFrame, messages: list[Message]) -> DataFrame:
    """``(session_uid, tick, rule, priority, ttl_laps, text)`` of all that fire, from one pass over the ticks."""
    return ticks.select(KEY, ORDER, F.explode(fired(messages)).alias("m")).select(KEY, ORDER, "m.*")


def fired(messages: list[Message]) -> Column:
    """The messages that fire at a tick, as a list."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    each = []
    for m in messages:
        text = lit(m.text)
        said = F.struct(F.lit(m.rule).alias("rule"), lit(m.priority).cast("string").alias("priority"), lit(m.ttl).cast("int").alias("ttl_laps"), text.alias("text"))
        each.append(F.when(m.fire & text.isNotNull(), said))
    return F.filter(F.array(*each), lambda m: m.isNotNull())


FOLDED = ("step", "mean")  # kinds that windows over ticks that count cannot express


class Windows:
    """Batch engine. ``key`` and ``order`` name the session and its tick; ticks of a session are unique."""

    def __init__(self, key: str = KEY, order: str = ORDER) -> None:
        self.key, self.order, self.folding = key, order, False

    def __call__(self, ticks: DataFrame, looks: dict[str, Look]) -> DataFrame:
        w = Window.partitionBy(self.key).orderBy(self.order)
        plain = {} if self.folding else {k: v for k, v in looks.items() if v.kind not in FOLDED}
        if plain:
            ticks = ticks.select("*", *[self._over(look, w).alias(name) for name, look in plain.items()])
        rest = {k: v for k, v in looks.items() if k not in plain}
        if not rest:
            return ticks
        if not self.folding:  # the number asks for sessions whole and in order; folds keep them so
            ticks, self.folding = ticks.withColumn("_seq", F.row_number().over(w)), True
        return folded(ticks, rest, self.key)

    @staticmethod
    def _over(look: Look, w) -> Column:
        x = look.input()
        frame = w.rowsBetween(Window.unboundedPreceding, -1 if look.prior else 0)
        if look.kind == "lag":
            return F.lag(look.value).over(w) if look.on is None else F.last(x, ignorenulls=True).over(frame)["v"]
        fold = {"min": F.min, "max": F.max, "count": F.count}.get(look.kind, lambda v: F.last(v, ignorenulls=True))
        return fold(x).over(frame)


class Folds:
    """The look-backs of one turn over rows in order. Used with plain lists, so batch and stream share it."""

    def __init__(self, looks: list[Look]) -> None:
        self.kinds, self.priors, self.steps = [x.kind for x in looks], [x.prior for x in looks], [x.step for x in looks]

    def new(self) -> list:
        return [{} if k == "step" else [] if k == "mean" else 0 if k == "count" else None for k in self.kinds]

    def take(self, state: list, inputs: list) -> list:
        """Outputs for one row, whose ``inputs`` are null where it does not count; ``state`` is brought forward."""
        out = []
        for i, x in enumerate(inputs):
            kind, was = self.kinds[i], state[i]
            if x is not None:
                state[i] = self._next(kind, was, x, i)
            if kind == "step":
                out.append(self._stepped(i, was, x))
            elif kind == "mean":
                out.append(_mean(state[i]) if x is not None and len(state[i]) == self.steps[i] else None)
            else:
                out.append(was if self.priors[i] else state[i])
        return out

    def _next(self, kind: str, was, x, i: int):
        if kind == "lag":
            return x["v"]
        if kind == "mean":
            return [*was, x][-self.steps[i] :]
        if kind == "count":
            return was + 1
        if kind in ("min", "max") and was is not None:
            return min(was, x) if kind == "min" else max(was, x)
        return was if kind == "step" else x

    def _stepped(self, i: int, state: dict, x) -> dict | None:
        found = None if x is None else self.steps[i](state, SimpleNamespace(**(x if isinstance(x, dict) else x.asDict())))
        if found is None:
            return None
        code, *numbers = found
        return dict(zip(("code", "n1", "n2", "n3"), (code, *[int(n) for n in numbers], 0, 0, 0)))


def _mean(values: list) -> float:
    total = 0.0
    for v in values:  # added up plainly, as the window average does
        total += v
    return total / len(values)


def result_types(ticks: DataFrame, looks: dict[str, Look]) -> list[T.StructField]:
    kinds = ticks.select(*[look.value.alias(name) for name, look in looks.items()]).schema.fields
    fixed = {"count": T.LongType(), "mean": T.DoubleType(), "step": FIRED}
    return [T.StructField(name, fixed.get(look.kind, f.dataType)) for f, (name, look) in zip(kinds, looks.items())]  # null before the first


def folded(ticks: DataFrame, looks: dict[str, Look], key: str = KEY) -> DataFrame:
    """``ticks``, sorted by session and tick and sessions whole, with ``looks`` added; nothing is held but a session's
    memory and a batch. Only the session, ``_seq``, which keeps the order asked for, and the inputs go to Python; the
    ticks themselves wait in the JVM."""
    fields = result_types(ticks, looks)
    folds, names = Folds(list(looks.values())), list(looks)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        session, state = object(), None
        for uids, _, *inputs in batches:
            out = []
            for uid, *xs in zip(uids.to_pylist(), *[x.to_pylist() for x in inputs]):
                if uid != session:
                    session, state = uid, folds.new()
                out.append(folds.take(state, xs))
            made = [pa.array([row[i] for row in out], _arrow_type(kind, x.type)) for i, (kind, x) in enumerate(zip(folds.kinds, inputs))]
            yield pa.StructArray.from_arrays(made, names)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    # Not deterministic: a value depends on the rows before it, so no filter may be moved below it.
    fold = F.arrow_udf(run, T.StructType(fields)).asNondeterministic()
    held = ticks.withColumn("_folded", fold(F.col(key), F.col("_seq"), *[look.input() for look in looks.values()]))
    return held.select(*[F.col(f"`{n}`") for n in ticks.columns], *[F.col("_folded")[n].alias(n) for n in looks])


def _arrow_type(kind: str, given: pa.DataType) -> pa.DataType:
    if kind == "lag":
        return given.field("v").type
    if kind == "count":
        return pa.int64()
    if kind == "mean":
        return pa.float64()
    if kind == "step":
        return pa.struct([("code", pa.string()), *[(f"n{k}", pa.int64()) for k in (1, 2, 3)]])
    return given

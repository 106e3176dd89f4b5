"""Aggregate and window building blocks: regression with diagnostics, exact quantiles, ordered walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regression(y: str, x: str) -> Column:
    """Least-squares fit as one struct aggregate (all parts combine map-side).

    No x spread gives slope 0 through the mean of y; no y spread gives R2 0.
    """
    fy, fx = F.col(y).cast("double"), F.col(x).cast("double")
    n, sxx = F.count(F.when(fx.isNotNull() & fy.isNotNull(), 1)), F.regr_sxx(fy, fx)
    syy, sxy = F.regr_syy(fy, fx), F.regr_sxy(fy, fx)
    flat = sxx == 0
    slope = F.when(flat, 0.0).otherwise(sxy / sxx)
    spare = F.when(n > 2, (syy - slope * sxy) / (n - 2)).otherwise(0.0)
    return F.struct(
        slope.alias("slope"),
        F.when(flat, F.regr_avgy(fy, fx)).otherwise(F.regr_intercept(fy, fx)).alias("intercept"),
        F.when(flat | (syy <= 0), 0.0).otherwise(sxy * sxy / (sxx * syy)).alias("r2"),
        F.when(~flat & (spare > 0), F.sqrt(spare / sxx)).otherwise(0.0).alias("se"),
        n.alias("n"),
    )


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Collapse rows to (keys, value, n) with map-side combine.

    Times are integer milliseconds, so a group holding a third of all rows shrinks to its
    distinct times before any of it meets in one task.
    """
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def quantiles(counts: DataFrame, keys: list[str], value: str, **which: float) -> DataFrame:
    """Exact interpolated quantiles per group from value counts."""
    aggs = [F.percentile(F.col(value), F.lit(p), F.col("n")).alias(name) for name, p in which.items()]
    return counts.groupBy(*keys).agg(*aggs, F.sum("n").alias("n_rows"))


def mad_keep(counts: DataFrame, keys: list[str], value: str, factor: float) -> DataFrame:
    """Value counts without those further than ``factor`` median deviations from the median.

    Groups below three rows, or with no deviation, pass unchanged.
    """
    w = Window.partitionBy(*keys)  # spillable, one row per distinct value of the group
    mid = lambda v: F.percentile(v, F.lit(0.5), F.col("n")).over(w)
    near = counts.select("*", F.sum("n").over(w).alias("_rows"), F.abs(F.col(value) - mid(F.col(value))).alias("_dev"))
    spread = near.withColumn("_mad", mid(F.col("_dev")))
    kept = spread.where((F.col("_rows") < 3) | (F.col("_mad") == 0) | (F.col("_dev") <= factor * F.col("_mad")))
    return kept.select(*counts.columns)


def weighted_mean(value: str) -> Column:
    return F.sum(F.col(value) * F.col("n")) / F.sum("n")


def weighted_stddev_pop(value: str) -> Column:
    """Population deviation from exact integer sums, so the result does not depend on row order."""
    v, n = F.col(value).cast("decimal(20,0)"), F.col("n").cast("decimal(18,0)")
    s0, s1 = F.sum("n").cast("double"), F.sum(v * n).cast("double")
    s2 = F.sum((v * v).cast("decimal(20,0)") * n).cast("double")
    return F.sqrt(F.greatest(F.lit(0.0), s2 / s0 - (s1 / s0) * (s1 / s0)))


FOLDS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "last": (lambda x: F.last(x, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
    "first": (lambda x: F.first(x, ignorenulls=True), lambda a, b: F.coalesce(a, b)),
}


def _expr(e: str | Column) -> Column:
    return F.expr(e) if isinstance(e, str) else e


def along(
    df: DataFrame,
    keys: list[str],
    order: str,
    lags: dict[str, str | Column] | None = None,
    running: dict[str, tuple] | None = None,
    span: int = 4096,
) -> DataFrame:
    """Ordered look-backs per key: values of the previous row and running aggregates.

    ``lags`` maps a new column to the expression to take from the previous row. ``running`` maps a
    new column to ``(kind, expression[, "prior"])`` with kind one of sum, min, max, count, last
    (last non-null) and first (first non-null); "prior" leaves the current row out.

    With a ``span`` the walk survives a key holding a third of all rows: it is cut into spans of
    ``span`` units of the integer column ``order``, each span is its own window partition, and only
    one summary row per span is walked over the whole key. ``span=0`` uses one window per key, for
    walks whose length has a fixed bound.
    """
    lags, running = lags or {}, running or {}
    if not span:
        return _along_bounded(df, keys, order, lags, running)
    base = df.withColumn("__span", F.floor(F.col(order) / span))
    for i, expr in enumerate(lags.values()):
        base = base.withColumn(f"__l{i}", _expr(expr))
    for i, spec in enumerate(running.values()):
        base = base.withColumn(f"__r{i}", _expr(spec[1]))
    part = [*keys, "__span"]
    w = Window.partitionBy(*part).orderBy(order)
    seen = [F.row_number().over(w).alias("__n")]
    seen += [F.lag(f"__l{i}").over(w).alias(f"__p{i}") for i in range(len(lags))]
    for i, spec in enumerate(running.values()):
        frame = w.rowsBetween(Window.unboundedPreceding, -1 if "prior" in spec[2:] else 0)
        seen.append(FOLDS[spec[0]][0](F.col(f"__r{i}")).over(frame).alias(f"__q{i}"))
    within = base.select("*", *seen)

    o = F.col(order)
    ends = [F.max_by(f"__l{i}", o).alias(f"__e{i}") for i in range(len(lags))]
    for i, spec in enumerate(running.values()):
        kind, r = spec[0], F.col(f"__r{i}")
        if kind == "last":
            total = F.max_by(r, F.when(r.isNotNull(), o))
        elif kind == "first":
            total = F.min_by(r, F.when(r.isNotNull(), o))
        else:
            total = FOLDS[kind][0](r)
        ends.append(total.alias(f"__t{i}"))
    tails = base.groupBy(*part).agg(*ends)
    wt = Window.partitionBy(*keys).orderBy("__span")
    before = wt.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.lag(f"__e{i}").over(wt).alias(f"__c{i}") for i in range(len(lags))]
    for i, spec in enumerate(running.values()):
        up = F.sum if spec[0] == "count" else FOLDS[spec[0]][0]
        carried.append(up(F.col(f"__t{i}")).over(before).alias(f"__b{i}"))
    out = within.join(tails.select(*part, *carried), part, "left")
    made = {}
    for i, name in enumerate(lags):
        made[name] = F.when(F.col("__n") == 1, F.col(f"__c{i}")).otherwise(F.col(f"__p{i}"))
    for i, (name, spec) in enumerate(running.items()):
        made[name] = FOLDS[spec[0]][1](F.col(f"__b{i}"), F.col(f"__q{i}"))
    return out.select(*[F.col(x) for x in df.columns if x not in made], *[e.alias(n) for n, e in made.items()])


def _along_bounded(df: DataFrame, keys: list[str], order: str, lags: dict, running: dict) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    made = {name: F.lag(_expr(e)).over(w) for name, e in lags.items()}
    for name, spec in running.items():
        frame = w.rowsBetween(Window.unboundedPreceding, -1 if "prior" in spec[2:] else 0)
        made[name] = FOLDS[spec[0]][0](_expr(spec[1])).over(frame)
    return df.select(*[F.col(x) for x in df.columns if x not in made], *[e.alias(n) for n, e in made.items()])


def asof(left: DataFrame, right: DataFrame, keys: list[str], order: str, payload: dict[str, str], span: int = 4096) -> DataFrame:
    """Each left row with the newest right row at or before it (right first on ties).

    Both sides become one ordered stream, so there is no inequality join. ``payload`` maps new
    column names to right columns; they stay null where nothing arrived before.
    """
    packed = F.struct(*[F.col(v).alias(k) for k, v in payload.items()])
    a = left.withColumn("_right", F.lit(None).cast(right.select(packed.alias("p")).schema[0].dataType)).withColumn("_left", F.lit(True))
    b = right.select(*keys, order, packed.alias("_right"), F.lit(False).alias("_left"))
    both = a.unionByName(b, allowMissingColumns=True)
    both = both.withColumn("_at", F.col(order) * 2 + F.col("_left").cast("int"))
    seen = along(both, keys, "_at", running={"_seen": ("last", F.col("_right"))}, span=2 * span)
    return seen.where("_left").select(*left.columns, *[F.col(f"_seen.{k}").alias(k) for k in payload])


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, salts: int = 64) -> DataFrame:
    """The first ``n`` rows per group with their rank ``rn``; a hot group is cut down in slices first."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(x) for x in df.columns]), F.lit(salts)))
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    first = salted.withColumn("_rn", F.row_number().over(inner)).where(F.col("_rn") <= n).drop("_rn", "_salt")
    return first.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= n)


def rolling(df: DataFrame, keys: list[str], order: str, n: int, exprs: dict[str, Column], span: int = 4096) -> DataFrame:
    """Aggregates over the last ``n`` rows including the current one, for a gap-free ``order``.

    Each span of the walk is its own window partition and also receives a copy of the ``n - 1``
    rows before it.
    """
    o = F.col(order)
    own = F.floor(o / span)
    tail = F.pmod(o, F.lit(span)) > span - n
    copies = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    laid = df.withColumn("_part", F.explode(copies))
    w = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(1 - n, 0)
    out = laid.select("*", *[e.over(w).alias(name) for name, e in exprs.items()])
    return out.where(F.col("_part") == own).drop("_part")

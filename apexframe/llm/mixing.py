"""Mixing sources to target weights with a time-varying curriculum.

Each source has a weight schedule over training time; its integral, scaled to the source's target, is the
tokens demanded up to a time. Documents of a source stand in a fixed pseudo-random order, their sizes
cumulated once through the source for each repetition. A copy is taken while its middle lies below the
target, and its training position is the time at which the cumulative demand reaches its middle: the
inverse of the integral. A range sort by position gives the training order.

Cumulating is done in two steps, so that a source holding most rows is spread over many tasks: sums of
hash ranges of a source, then running sums within a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexframe.llm.common import renamed, stored

WEIGHTS = (5.0, 2.0, 1.0)  # by rank of the source, repeating
MOST = 3  # times a source may be taken
RANGE_BITS = 12  # hash ranges of a source
RAMP = (1.0, 0.5)  # weight of a source at the start and end of training, alternating with its mirror image by rank


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``(source, source_size)`` -> with ``rank``, ``weight`` and ``target``: shares of all sizes by weight,
    none above ``most`` times the source's size.

    Resharing the excess by weight until none is above ends where target = min(most * size, level * weight)
    with one level for all; sources sorted by most * size / weight, the level follows from running sums.
    One row for each source: these windows run over the table of sources, not of documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = ranked.withColumn("weight", weight).withColumn("top", (F.col("source_size") * most).cast("double"))
    up = Window.orderBy(F.col("top") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(F.col("top") / F.col("weight"), "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    total = F.sum(F.col("source_size").cast("double")).over(every)
    rows = rows.withColumn("level", (total - F.coalesce(F.sum("top").over(up), F.lit(0.0))) / F.sum("weight").over(rest))
    # the first source, in that order, whose top is not reached by its level fixes the level of all that follow
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("top"), F.struct(F.col("top") / F.col("weight"), F.col("rank"), F.col("level").alias("level")))).over(every)["level"]
    target = F.least("top", F.coalesce(level * F.col("weight"), F.col("top")))
    return rows.select("source", "source_size", "rank", "weight", target.alias("target"))


def inverse_demand(share: Column, first: Column, last: Column) -> Column:
    """Time in [0, 1] at which a source with linear weight from ``first`` to ``last`` has had ``share`` of
    its demand: the root of the integral first * t + (last - first) * t^2 / 2."""
    total = (first + last) / 2 * share
    bend = last - first
    # 2 c / (b + sqrt(b^2 + 4 a c)): no cancellation, and right for a constant weight
    return 2 * total / (first + F.sqrt(F.greatest(first * first + 2 * bend * total, F.lit(0.0))))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: int = 7, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """One row for each row of ``docs``: ``(doc_id, source, text_hash, size, source_size, target, copies, positions)``.

    positions are the training times of the copies taken, possibly none. Null texts have size 0; a document
    without words is taken once if its source is, as often as its place in the order says. Null is a source
    of its own, the last. Rows that repeat id, source and text are one stretch of the order, in any
    order among themselves. An empty table gives no rows.
    """
    rows = renamed(docs, doc_id=key, source=source, text=text)
    rows = rows.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("size"))
    rows = rows.withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "text_hash"))
    rows = stored(rows.withColumn("range", F.shiftrightunsigned("place", 64 - RANGE_BITS)), "sizes")
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = stored(ranges.withColumn("before", F.coalesce(F.sum("sum").over(ahead), F.lit(0))), "ranges")
    plan = stored(targets(ranges.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, most), "targets")
    plan, ranges = plan.alias("p"), ranges.alias("r")
    known = ranges.join(plan, F.col("r.source").eqNullSafe(F.col("p.source"))).select(
        F.col("r.source").alias("of"), F.col("range").alias("in"), "before", "source_size", "target", "rank")
    own = Window.partitionBy("source", "range").orderBy("place", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0)))
    placed = placed.join(known, placed["source"].eqNullSafe(known["of"]) & (placed["range"] == known["in"]))
    middle = F.col("before") + F.col("own") + F.col("size") / 2
    first = F.when(F.col("rank") % 2 == 0, RAMP[0]).otherwise(RAMP[1])
    last = F.when(F.col("rank") % 2 == 0, RAMP[1]).otherwise(RAMP[0])
    starts = F.transform(F.array(*[F.lit(i) for i in range(most)]), lambda i: i * F.col("source_size") + F.col("middle"))
    taken = F.filter(starts, lambda x: (x < F.col("target")))
    positions = F.transform(taken, lambda x: inverse_demand(x / F.col("target"), first, last))
    return placed.withColumn("middle", middle).withColumn("positions", positions).select(
        "doc_id", "source", "text_hash", "size", "source_size", "target", F.size("positions").alias("copies"), "positions")


def training_order(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: int = 7, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, in training order over the partitions.

    The columns of ``docs`` and ``training_position``. Rows not taken are left out. Of rows repeating id,
    source and text one stands for all, with the positions of all.
    """
    rows = mixed(docs, weights, most, seed, text, key, source)
    plan = stored(rows.groupBy("doc_id", "source", "text_hash").agg(F.flatten(F.collect_list("positions")).alias("positions"), F.count(F.lit(1)).alias("rows")), "plan")
    left = docs.withColumn("_hash", F.xxhash64(text))
    if not plan.where("rows > 1").isEmpty():
        left = left.dropDuplicates([key, source, "_hash"])
    left, plan = left.alias("d"), plan.where(F.size("positions") > 0).alias("m")
    same = F.col(f"d.{key}").eqNullSafe(F.col("m.doc_id")) & F.col(f"d.{source}").eqNullSafe(F.col("m.source")) & (F.col("d._hash") == F.col("m.text_hash"))
    timed = left.join(plan, same).select(*[F.col(f"d.`{c}`") for c in docs.columns], F.explode("m.positions").alias("training_position"))
    return timed.repartitionByRange("training_position").sortWithinPartitions("training_position")

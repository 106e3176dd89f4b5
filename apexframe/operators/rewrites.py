"""Message-rewrite evaluation: scorecards, work still to do, stratified samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apexframe.functions import stats
from apexframe.functions import text as tx

c = F.col
WHO = ["model", "variant"]


def scorecard(runs: DataFrame, judgements: DataFrame, dims: list[str]) -> DataFrame:
    """Latency quantiles, judge scores and invented-fact rate per (model, variant).

    Scores are averaged per row first, then over rows. Failed runs count in the rate's denominator
    only.
    """
    per_row = judgements.groupBy(*WHO, "row_id").agg(*[F.avg(d).alias(d) for d in dims])
    has = runs.select(*WHO, "row_id").distinct()
    per_dim = per_row.join(has, [*WHO, "row_id"]).groupBy(*WHO).agg(*[F.avg(d).alias(f"_{d}") for d in dims])
    fine = c("error").isNull()
    made_up = fine & (F.size(tx.invented_facts(F.coalesce("prompt_user", F.lit("")), c("output"))) > 0)
    base = runs.select(*WHO, "total_ms", "ttft_ms", fine.alias("_ok"), made_up.alias("_inv"))
    pct = lambda col, p: F.coalesce(F.percentile(F.when(c("_ok"), c(col)), F.lit(p)), F.lit(0.0))
    per = base.groupBy(*WHO).agg(
        F.count("*").alias("n_runs"), pct("total_ms", 0.5).alias("p50_total_ms"), pct("total_ms", 0.95).alias("p95_total_ms"),
        pct("ttft_ms", 0.5).alias("p50_ttft_ms"), (F.count_if("_inv") / F.count("*")).alias("fact_invented_rate"),
    )
    out = per.join(per_dim, WHO, "left")
    present = F.filter(F.array(*[c(f"_{d}") for d in dims]), lambda v: v.isNotNull())
    overall = F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, v: a + v) / F.size(present))
    return out.select(
        *WHO, "n_runs", "p50_total_ms", "p95_total_ms", "p50_ttft_ms", F.round(overall, 4).alias("overall"),
        F.round("fact_invented_rate", 4).alias("fact_invented_rate"), *[F.round(f"_{d}", 4).alias(d) for d in dims],
    )


def remaining(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return tasks.join(done.select(*keys), keys, "left_anti")


def stratified_sample(df: DataFrame, stratum: str, row_id: str, size: int, seed: int) -> DataFrame:
    """Exactly ``size`` rows (or all), shared out in proportion to the strata.

    Within a stratum rows are picked by a seeded hash. Rounding surplus is trimmed from the end of
    the stratum order, shortage filled from the rows left over, lowest id first.
    """
    by_hash = F.md5(F.concat(c(row_id).cast("string"), F.lit(f":{seed}")))
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*")).scalar()
    quota = sizes.withColumn("_quota", F.rint(F.lit(size) * c("_n") / total)).select(F.col(stratum).alias("_s"), "_quota")
    ids = df.select(row_id, stratum).withColumn("_h", by_hash)
    top = stats.top_per_group(ids, [stratum], [c("_h")], size)
    picked = top.join(quota, top[stratum].eqNullSafe(c("_s"))).where(c("rn") <= c("_quota"))
    order = Window.orderBy(F.col(stratum).isNull(), F.col(stratum).cast("string"), "rn")  # about ``size`` rows
    kept = picked.withColumn("_k", F.row_number().over(order)).where(c("_k") <= size).select(row_id)
    spare = df.select(row_id).join(kept, row_id, "left_anti").orderBy(row_id).limit(size)
    spare = spare.withColumn("_k", F.row_number().over(Window.orderBy(row_id)))  # at most ``size`` rows
    fill = spare.where(c("_k") <= F.lit(size) - kept.agg(F.count("*")).scalar()).select(row_id)
    return df.join(kept.unionByName(fill), row_id, "left_semi")

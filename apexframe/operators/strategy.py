"""Strategy tables: candidate stops, feasibility, outcome distributions, ranking, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexframe import dims
from apexframe.functions import rows
from apexframe.operators import coefficients as co
from apexframe.operators import ticks as tk

c = F.col
# Candidate generation limits.
MAX_CANDIDATES, MIN_STINT, MIN_FINAL, TWO_STOP_LAPS, MAX_LAP_DELTA_MS = 50, 3, 3, 15, 5000
FRESH_GAIN_MS, REPAIR_DAMAGE, RANK_NOISE = 1500, 20, 0.5


def laps_to_cliff(compound: Column, wear_rate: Column | None) -> Column:
    """Stint cap: laps until 80 % wear, or the fixed lifespan where no wear rate is known."""
    fixed = dims.lookup(dims.LIFESPAN_LAPS, compound, F.lit(dims.DEFAULT_LIFESPAN)).cast("bigint")
    if wear_rate is None:
        return fixed
    fitted = F.greatest(F.lit(1).cast("bigint"), F.rint(F.lit(dims.CLIFF_WEAR) / wear_rate).cast("bigint"))
    return F.when(wear_rate > 0, fitted).otherwise(fixed)


def stint_caps(wear_rates: Column) -> Column:
    """Map of compound to stint cap from a map of dry compound to wear rate."""
    pairs = []
    for comp in dims.ALL_COMPOUNDS:
        pairs += [F.lit(comp), laps_to_cliff(F.lit(comp), F.try_element_at(wear_rates, F.lit(comp)))]
    return F.create_map(*pairs)


def available_compounds(sets: DataFrame, keys: list[str]) -> DataFrame:
    """Usable compounds per car in set order, split by dry and wet."""
    ok = (c("available") == 1) & (c("fitted") == 0) & (F.abs("lap_delta_time_ms") <= MAX_LAP_DELTA_MS)
    first = sets.groupBy(*keys, "visual_compound").agg(F.min(F.when(ok, c("set_index"))).alias("_i"))
    usable = F.collect_list(F.when(c("_i").isNotNull(), F.struct("_i", "visual_compound")))
    per = first.groupBy(*keys).agg(F.transform(F.array_sort(usable), lambda e: e["visual_compound"]).alias("_all"))
    is_dry = lambda e: e.isin(*dims.DRY_COMPOUNDS)
    return per.select(
        *keys, F.filter("_all", is_dry).alias("dry_compounds"), F.filter("_all", lambda e: ~e.isin(*dims.DRY_COMPOUNDS)).alias("wet_compounds")
    )


def compounds_for(weather: Column, dry: Column, wet: Column, known: Column) -> Column:
    """Compounds that suit the weather; the standard ones while no sets are known."""
    as_list = lambda v: F.array(*[F.lit(x).cast("bigint") for x in v])
    default = F.when(weather >= 3, as_list((7,))).otherwise(as_list(dims.DRY_COMPOUNDS))
    return F.when(~known, default).when(weather >= 3, wet).otherwise(dry)


def lap_step(left: Column) -> Column:
    return F.when(left <= 7, 1).when(left <= 15, 2).when(left <= 30, 3).otherwise(5)


def break_even_laps(pit_loss_ms: Column) -> Column:
    loss = F.when(pit_loss_ms > 0, pit_loss_ms).otherwise(dims.DEFAULT_PIT_LOSS_MS)
    return F.greatest(F.lit(MIN_FINAL), F.ceil(loss / FRESH_GAIN_MS))


def _laps(start: Column, stop: Column, step: Column) -> Column:
    """Laps from start, below stop."""
    b = "bigint"
    return F.when(start < stop, F.sequence(start.cast(b), (stop - 1).cast(b), step.cast(b))).otherwise(F.array().cast("array<bigint>"))


def situation(snaps: DataFrame) -> DataFrame:
    """Limits the generator works with, one row per race snapshot.

    ``snaps`` has current_lap, total_laps, compound, tyre_age, stops_done, weather, usable_life,
    compounds (array), caps (map), pit_loss_ms, front_wing_damage and its own key columns.
    """
    left = c("total_laps") - c("current_lap")
    out = snaps.where(left > 1).withColumn("left", left).withColumn("cap", F.element_at("caps", c("compound").cast("int")))
    estimate = F.greatest(F.lit(0), c("cap") - c("tyre_age"))
    out = out.withColumn("life", F.when(c("usable_life") > 0, c("usable_life")).otherwise(estimate))
    out = out.withColumn("free", c("stops_done") > 0).withColumn("wet", c("weather") >= 3)
    out = out.withColumn("can_finish", c("left") <= c("life")).withColumn("step", lap_step(c("left")))
    last = c("total_laps") - MIN_FINAL + 1
    optional = F.least(last, c("total_laps") - break_even_laps(c("pit_loss_ms")) + 1)
    out = out.withColumn("last_pit", F.when(c("free") & c("can_finish"), optional).otherwise(last))
    return out.withColumn("no_window", c("current_lap") + MIN_STINT >= last)


def all_plans(snaps: DataFrame) -> DataFrame:
    """No-stop, one-stop and two-stop plans per snapshot that keep to the tyre rules, whatever the lifespans."""
    s = situation(snaps)
    none = F.array().cast("array<struct<on_lap:bigint,compound:bigint>>")
    zero = s.where((c("free") | c("wet") | c("no_window")) & c("can_finish")).select(
        "*", none.alias("stops"), F.lit(-1).alias("i1"), F.lit(-1).alias("i2")
    )
    stop = lambda lap, comp: F.struct(lap.cast("bigint").alias("on_lap"), comp.cast("bigint").alias("compound"))
    one = s.select("*", F.posexplode("compounds").alias("i1", "_c1"))
    one = one.where((c("_c1") != c("compound")) | c("free") | c("wet"))
    one = one.withColumn("_l1", F.explode(_laps(c("current_lap") + MIN_STINT, c("last_pit"), c("step"))))
    one = one.withColumn("stops", F.array(stop(c("_l1"), c("_c1")))).withColumn("i2", F.lit(-1)).drop("_c1", "_l1")
    step2 = F.greatest(c("step"), F.lit(5))
    two = s.where(c("left") >= TWO_STOP_LAPS).select("*", F.posexplode("compounds").alias("i1", "_c1"))
    two = two.select("*", F.posexplode("compounds").alias("i2", "_c2"))
    two = two.where(c("free") | c("wet") | (c("_c1") != c("compound")) | (c("_c2") != c("compound")))
    two = two.withColumn("_l1", F.explode(_laps(c("current_lap") + MIN_STINT, c("total_laps") - MIN_STINT - 1, step2)))
    two = two.withColumn("_l2", F.explode(_laps(c("_l1") + MIN_STINT, c("last_pit"), step2)))
    two = two.withColumn("stops", F.array(stop(c("_l1"), c("_c1")), stop(c("_l2"), c("_c2")))).drop("_c1", "_c2", "_l1", "_l2")
    return zero.unionByName(one).unionByName(two)


def candidates(snaps: DataFrame, keys: list[str]) -> DataFrame:
    """The plans of ``all_plans`` that keep to the lifespans, at most fifty per snapshot, those with fewer than two stops first."""
    fits = all_plans(snaps).where((F.size("compounds") == 0) | within_lifespans())
    order = [F.when(F.size("stops") == 2, 1).otherwise(0), F.size("stops"), c("i1"), c("i2"), c("stops")]
    w = Window.partitionBy(*keys).orderBy(*order)  # a snapshot yields a few hundred plans at most
    top = fits.withColumn("plan", F.row_number().over(w)).where(c("plan") <= MAX_CANDIDATES)
    repair = (c("front_wing_damage") >= REPAIR_DAMAGE) & (F.size("stops") > 0)
    label = F.concat(plan_label(c("stops"), c("compound")), F.when(repair, " +FW").otherwise(""))
    return top.select(*keys, "plan", label.alias("label"), "stops", repair.alias("repair_front_wing"))


def within_lifespans() -> Column:
    """Every stint no longer than its compound's cap; the first carries the laps already run."""
    cap = lambda comp: F.element_at("caps", comp.cast("int"))
    at = lambda i: F.get("stops", F.lit(i))
    n = F.size("stops")
    first_end = F.when(n > 0, at(0)["on_lap"]).otherwise(c("total_laps") + 1)
    ok1 = first_end - c("current_lap") + c("tyre_age") <= c("cap")
    second_end = F.when(n > 1, at(1)["on_lap"]).otherwise(c("total_laps") + 1)
    ok2 = (n < 1) | (second_end - at(0)["on_lap"] <= cap(at(0)["compound"]))
    ok3 = (n < 2) | (c("total_laps") + 1 - at(1)["on_lap"] <= cap(at(1)["compound"]))
    return ok1 & ok2 & ok3


def letter(code: Column) -> Column:
    return dims.lookup(dims.COMPOUND_LETTERS, code, F.lit("?"))


def plan_label(stops: Column, start: Column) -> Column:
    at = lambda i, f: F.get(stops, F.lit(i))[f]
    one = F.concat(F.lit("1-stop L"), at(0, "on_lap"), F.lit(" "), letter(start), F.lit("->"), letter(at(0, "compound")))
    two = F.concat(
        F.lit("2-stop L"), at(0, "on_lap"), F.lit("/"), at(1, "on_lap"), F.lit(" "), letter(start), F.lit("->"),
        letter(at(0, "compound")), F.lit("->"), letter(at(1, "compound")),
    )
    return F.when(F.size(stops) == 0, "No stop").when(F.size(stops) == 1, one).otherwise(two)


def first_shortage(stops: Column, have: Column) -> Column:
    """First compound (in stop order) the sets do not cover, as a reason; null when feasible."""
    need = F.transform(F.array_distinct(F.transform(stops, lambda s: s["compound"])), lambda k: F.struct(
        k.alias("k"), F.size(F.filter(stops, lambda s: s["compound"] == k)).alias("n"),
        F.coalesce(F.try_element_at(have, k), F.lit(0)).alias("a"),
    ))
    short = F.get(F.filter(need, lambda e: e["a"] < e["n"]), F.lit(0))
    names = {16: "Soft", 17: "Medium", 18: "Hard"}
    name = dims.lookup(names, short["k"], F.concat(F.lit("Compound-"), short["k"]))
    return F.concat(F.lit("Need "), short["n"], F.lit(" "), name, F.lit(" set(s) but only "), short["a"], F.lit(" available"))


def set_counts(sets: DataFrame, keys: list[str]) -> DataFrame:
    n = sets.where((c("available") == 1) & (c("fitted") == 0)).groupBy(*keys, "visual_compound").agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(c("visual_compound").cast("bigint"), "_n"))).alias("have"))


def next_stop(stops: Column, lap: Column, inclusive: bool) -> Column:
    """First stop after ``lap`` (or from it on, when inclusive)."""
    keep = (lambda s: s["on_lap"] >= lap) if inclusive else (lambda s: s["on_lap"] > lap)
    return F.get(F.filter(stops, keep), F.lit(0))


# ---- outcome tables -------------------------------------------------------------------------


def outcomes(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Finish distribution per key: moments, discrete 95 % band, top chances and the whole map.

    Positions are first counted, so only twenty-odd rows per key meet in one place.
    """
    counts = samples.groupBy(*keys, "position").agg(F.count("*").alias("n"), F.sum("retired").alias("dnf"))
    w = Window.partitionBy(*keys)
    counts = counts.withColumn("total", F.sum("n").over(w)).withColumn(
        "upto", F.sum("n").over(w.orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    )
    reach = lambda p: F.min(F.when(c("upto") >= F.ceil(p * c("total")), c("position")))
    share = lambda k: F.sum(F.when(c("position") <= k, c("n")).otherwise(0)) / F.sum("n")
    p, n = c("position"), c("n")
    mean = F.sum(p * n) / F.sum("n")
    out = counts.groupBy(*keys).agg(
        F.sum("n").alias("iterations"), mean.alias("mean_position"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum(p * p * n) / F.sum("n") - mean * mean)).alias("std_dev"),
        reach(0.025).alias("ci_low"), reach(0.975).alias("ci_high"), (F.sum("dnf") / F.sum("n")).alias("dnf_rate"),
        share(3).alias("top3"), share(10).alias("points_finish"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("position", (n / c("total")).alias("prob"))))).alias("distribution"),
    )
    return out.withColumn("expected_points", expected_points(c("distribution")))


def expected_points(distribution: Column) -> Column:
    points = F.array(*[F.lit(float(v)) for v in dims.RACE_POINTS])
    each = F.transform(
        F.map_entries(distribution), lambda e: F.coalesce(F.get(points, (e["key"] - 1).cast("int")), F.lit(0.0)) * e["value"]
    )
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x)


def convergence(samples: DataFrame, every: int = 200, within: float = 0.1) -> DataFrame:
    """Mean position per car at each checkpoint and whether every car has settled.

    Sums per block of iterations come first; the running part only sees one row per block.
    """
    block = F.floor(c("iteration") / every).cast("bigint")
    sums = samples.groupBy("job", "car", block.alias("block")).agg(F.sum("position").alias("s"), F.count("*").alias("n"))
    ends = samples.groupBy("job").agg(F.max("iteration").alias("_last"))
    grid = sums.select("job", "car").distinct().join(ends, "job")
    grid = grid.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(c("_last") / every).cast("bigint"))))
    w = Window.partitionBy("job", "car").orderBy("block")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    full = grid.where((c("block") + 1) * every <= c("_last") + 1).join(sums, ["job", "car", "block"], "left")
    full = full.withColumn("mean", F.sum("s").over(run) / F.sum("n").over(run)).withColumn("checkpoint", (c("block") + 1) * every)
    moved = full.withColumn("_step", F.abs(c("mean") - F.lag("mean").over(w)))
    per = moved.groupBy("job", "checkpoint").agg(
        F.max("_step").alias("max_step"), F.bool_and(F.coalesce(c("_step") < within, F.lit(False))).alias("settled")
    )
    return per.where(c("checkpoint") >= 3 * every)


def rank_plans(evaluated: DataFrame, keys: list[str]) -> DataFrame:
    """Rank by mean position in half-place buckets, then fewer stops, later first stop, label."""
    w = Window.partitionBy(*keys).orderBy(
        F.rint(c("mean_position") / RANK_NOISE), "n_stops", F.desc("first_stop_lap"), "label"
    )  # fifty plans per snapshot at most
    return evaluated.withColumn("rank", F.row_number().over(w))


def quality_flags(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Ties at the top and collapsed results per ranking; needs the player's position."""
    at = lambda r: F.max(F.when(c("rank") == r, c("mean_position")))
    worst = F.max_by("mean_position", "rank")
    out = ranked.groupBy(*keys).agg(
        at(1).alias("best"), at(2).alias("second"), worst.alias("worst"), F.count("*").alias("plans"), F.max("player_position").alias("pos")
    )
    many = c("plans") >= 2
    return out.select(
        *keys, "plans", (many & (c("second") - c("best") < RANK_NOISE)).alias("tie"),
        (many & (c("worst") - c("best") < 0.5) & (F.abs(c("best") - c("pos")) > 5)).alias("degenerate"),
    )


def pace_source(history: Column, baseline: Column) -> Column:
    observed = F.exists(history, lambda h: F.size(h) > 0)
    return F.when(observed, "observed").when(F.exists(baseline, lambda b: b > 0), "baseline").otherwise("circuit_default")


def insufficient_calibration(source: Column, baseline: Column) -> Column:
    return (source == "circuit_default") | ~F.exists(baseline, lambda b: b > 0)


def top_three_json(ranked: DataFrame, keys: list[str]) -> DataFrame:
    entry = F.struct("rank", "label", c("mean_position").alias("meanPosition"), c("expected_points").alias("expectedPoints"))
    per = ranked.where(c("rank") <= 3).groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("t"))
    return per.select(*keys, F.to_json("t").alias("best_strategies"))


def top_two_phrase(best_strategies: Column) -> Column:
    """The two best plans as a phrase; empty for missing or broken JSON."""
    items = F.from_json(F.trim(best_strategies), "array<struct<rank:double,label:string,meanPosition:double>>")
    keyed = F.array_sort(F.transform(items, lambda e: F.struct(F.coalesce(e["rank"], F.lit(99.0)).alias("r"), e.alias("e"))))
    label = lambda e: F.coalesce(e["e"]["label"], F.lit("?"))
    # Half of a tenth goes to the even digit, where format_string would round it up.
    even = lambda v: F.format_string("%.1f", F.when(F.pmod(v * 4, F.lit(4.0)) == 1, v - 0.05).otherwise(v))
    mean = lambda e: F.concat(F.lit(" (~P"), even(e["e"]["meanPosition"]), F.lit(")"))
    said = F.transform(F.slice(keyed, 1, 2), lambda e: F.concat(label(e), F.when(e["e"]["meanPosition"].isNotNull(), mean(e)).otherwise("")))
    return F.coalesce(F.array_join(said, "; "), F.lit(""))


# ---- race snapshots and sector projection ----------------------------------------------------


def circuit_lap_ms(track_id: Column) -> Column:
    return dims.lookup(dims.CIRCUIT_LAP_MS, track_id, F.lit(dims.DEFAULT_LAP_MS)).cast("double")


def base_pace(recent: Column, baseline: Column, track_id: Column) -> Column:
    """Upper-middle recent time, else the baseline, else a third of the circuit's default lap."""
    timed = F.array_sort(F.filter(recent, lambda t: t > 0))
    n = F.size(timed)
    mid = F.get(timed, F.floor(n / 2).cast("int")).cast("double")
    return F.when(n > 0, mid).when(baseline > 0, baseline.cast("double")).otherwise(circuit_lap_ms(track_id) / 3)


def pace_floor(perfect: Column, pace: Column) -> Column:
    return F.when(perfect > 0, perfect.cast("double")).otherwise(pace * 0.9)


def damage_ms(front_wing: Column, floor: Column, engine: Column) -> Column:
    lap = lambda d, k: k * (50.0 * d + 0.1 * d * d)
    return (lap(front_wing, 1.0) + lap(floor, 0.8) + lap(engine, 0.5)) / 3


def with_curves(rows_: DataFrame, offsets: DataFrame) -> DataFrame:
    """Attach each row's age curve (a short array, one entry per tyre age); the player borrows the AI's."""
    keys = ["track_id", "compound", "sector_number"]
    bins = F.array_sort(F.collect_list(F.struct(c("tyre_age_laps").alias("age"), c("offset_ms").alias("ms"))))
    per = offsets.groupBy(*keys, "regime").agg(bins.alias("_k"))
    by = per.groupBy(*keys).agg(
        F.max_by("_k", F.when(c("regime") == "AI", 1)).alias("_ai"), F.max_by("_k", F.when(c("regime") == "PLAYER", 1)).alias("_pl")
    )
    out = rows_.join(by, keys, "left")
    curve = F.when(c("regime") == "PLAYER", F.coalesce("_pl", "_ai")).otherwise(c("_ai"))
    return out.withColumn("curve", curve).drop("_ai", "_pl")


def curve_offset(curve: Column, age: Column, deg: Column) -> Column:
    """Offset at an age: first bin below it, linear between bins, the slope beyond the last."""
    first, last = F.get(curve, F.lit(0)), F.element_at(curve, -1)
    below = F.element_at(F.filter(curve, lambda b: b["age"] <= age), -1)
    above = F.get(F.filter(curve, lambda b: b["age"] >= age), F.lit(0))
    span = above["age"] - below["age"]
    mid = F.when(span == 0, below["ms"]).otherwise(below["ms"] + (age - below["age"]) / span * (above["ms"] - below["ms"]))
    inside = F.when(age <= first["age"], first["ms"]).when(age > last["age"], last["ms"] + deg * (age - last["age"])).otherwise(mid)
    return F.when(curve.isNotNull(), inside)


def project(rows_: DataFrame, offsets: DataFrame) -> DataFrame:
    """Expected sector time: pace, tyre and fuel differences from the reference, damage, floor.

    Needs track_id, compound, regime, sector_number, pace_ms, floor_ms, deg, fuel_effect,
    tyre_age_laps, age_ref, fuel_kg, fuel_ref, damage parts and safety_car_status. The tyre term is
    worked out once per distinct slot and pair of ages.
    """
    slot = ["track_id", "compound", "regime", "sector_number", "tyre_age_laps", "age_ref", "deg"]
    at = lambda age: curve_offset(c("curve"), age, c("deg"))
    linear = c("deg") * (c("tyre_age_laps") - c("age_ref"))
    tyre = F.coalesce(at(c("tyre_age_laps")) - at(c("age_ref")), linear)
    deltas = with_curves(rows_.select(*slot).distinct(), offsets).select(*slot, tyre.alias("_tyre"))
    fuel = c("fuel_effect") * (c("fuel_kg") - c("fuel_ref"))
    hurt = damage_ms(F.greatest("front_wing_damage_l", "front_wing_damage_r"), c("floor_damage"), c("engine_damage"))
    ms = F.greatest(c("pace_ms") + c("_tyre") + fuel + hurt, c("floor_ms"))
    out = rows_.join(deltas, slot)
    return out.withColumn("projected_ms", F.when(c("safety_car_status") > 0, c("pace_ms") * 1.4).otherwise(ms)).drop("_tyre")


def race_snapshots(cars: DataFrame, baselines: DataFrame, recent: DataFrame, sets: DataFrame, strategy: bool = True) -> DataFrame:
    """One nested document per tick: the field with baselines, recent times, tyre sets and gaps."""
    lead = cars.groupBy(*tk.TICK).agg(
        F.coalesce(F.max(F.when(c("pos") == 1, c("lap"))), F.lit(1)).alias("current_lap"),
        F.coalesce(F.max(F.when(c("pos") == 1, c("sector"))), F.lit(0)).alias("current_sector"),
    )
    field = tk.gap_to_leader(cars).join(lead, tk.TICK).withColumn("compound", c("tyre")).withColumn("regime", rows.regime(c("ai")))
    field = field.withColumn("car_index", c("car"))
    left = c("total_laps") - c("current_lap") + (1 if strategy else 0)
    field = field.withColumn("burn", rows.fuel_per_sector(c("fuel"), left))
    # One request per car and sector, brought back as three-slot arrays.
    req = field.select(
        *tk.TICK, "car", "track_id", "compound", "regime", c("fuel").alias("fuel_kg"), "weather", "track_temp",
        F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(3)])).alias("sector_number"),
    )
    near = co.nearest_baseline(req, baselines).groupBy(*tk.TICK, "car").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("sector_number", "baseline_ms"))), lambda e: e["baseline_ms"]).alias("baseline"),
        F.transform(F.array_sort(F.collect_list(F.struct("sector_number", "perfect_ms"))), lambda e: e["perfect_ms"]).alias("perfect"),
    )
    slot = lambda s: F.coalesce(F.max(F.when(c("sector_number") == s, c("recent_ms"))), F.array().cast("array<bigint>"))
    hist = recent.withColumnRenamed("tyre_compound_visual", "compound").groupBy("track_id", "car_index", "compound").agg(
        F.array(*[slot(s) for s in range(3)]).alias("history")
    )
    own = sets.groupBy("session_uid", "car_index").agg(F.array_sort(F.collect_list(F.struct("set_index", "visual_compound", "available", "usable_life", "fitted"))).alias("tyre_sets"))
    full = field.join(near, [*tk.TICK, "car"]).join(hist, ["track_id", "car_index", "compound"], "left").join(own, ["session_uid", "car_index"], "left")
    empty = F.array(*[F.array().cast("array<bigint>")] * 3)
    entry = F.struct(
        "car", "pos", "compound", "tyre_age", "fuel", "burn", c("gap_ms").alias("total_time_ms"), "baseline", "perfect",
        F.coalesce("history", empty).alias("history"), F.coalesce(F.size("tyre_sets"), F.lit(0)).alias("n_sets"), "tyre_sets",
    )
    return full.groupBy(*tk.TICK).agg(
        F.first("track_id").alias("track_id"), F.first("current_lap").alias("current_lap"), F.first("current_sector").alias("current_sector"),
        F.first("weather").alias("weather"), (F.max("safety_car") > 0).alias("safety_car"), F.array_sort(F.collect_list(entry)).alias("cars"),
    )

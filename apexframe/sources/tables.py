"""File sources and sinks: JSON lines, CSV, circuit files, and table writes by key."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from apexframe import dims
from apexframe.functions import text as tx
from apexframe.session import shared_folder

c = F.col
TICK_SCHEMA = (
    "type string, sessionUid string, trackId int, sessionType int, currentLap bigint, event string, driverName string, "
    "cars array<struct<idx:bigint,name:string,pos:bigint,lap:bigint,sector:bigint,lastLapTimeMs:bigint,pitStatus:int,ai:boolean>>"
)
# The export's columns in order, and the key of each table.
RADIO_HEADER = (
    "message_id", "session_uid", "sent_at", "priority", "session_type", "track_id", "circuit_name", "lap_number", "total_laps",
    "player_position", "driver_name", "tyre_compound", "tyre_age_laps", "sector", "message_text", "best_strategies", "rendered_text",
)
TABLE_KEYS = {
    "sessions": ["session_uid"], "participants": ["session_uid", "car_index"],
    "sector_snapshots": ["session_uid", "car_index", "lap_number", "sector_number"], "session_events": ["event_id"],
    "tyre_sets": ["session_uid", "car_index", "set_index"], "final_classifications": ["session_uid", "car_index"],
    "calibration_coefficients": ["coefficient_id"],
    "sector_pace_baselines": ["track_id", "sector_number", "compound", "regime", "fuel_bucket_kg", "weather", "track_temp_bucket_c"],
    "tyre_age_pace_offsets": ["track_id", "compound", "regime", "sector_number", "tyre_age_laps"],
    "radio_messages": ["message_id"], "simulation_runs": ["run_id"], "simulation_accuracy": ["accuracy_id"],
}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def route(lines: DataFrame) -> DataFrame:
    """JSON lines as typed messages (fixed schema, unknown fields dropped); ``lines`` has ``value``."""
    return lines.select(F.from_json("value", TICK_SCHEMA).alias("m")).where(c("m").isNotNull()).select("m.*")


def tick_cars(messages: DataFrame) -> DataFrame:
    state = messages.where(c("type") == "state")
    return state.select("sessionUid", "trackId", "sessionType", "currentLap", F.inline("cars"))


def read_circuits(spark: SparkSession, path: str) -> DataFrame:
    """Delivery zones per track from one JSON file per circuit."""
    schema = "trackId bigint, name string, safeZones array<struct<fromMetres:double,toMetres:double,label:string>>"
    files = spark.read.schema(schema).json(path, multiLine=True)
    zone = F.posexplode("safeZones").alias("zone_idx", "z")
    return files.select(c("trackId").alias("track_id"), "name", zone).select(
        "track_id", "name", "zone_idx", c("z.fromMetres").alias("from_m"), c("z.toMetres").alias("to_m"), c("z.label").alias("label")
    )


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped and a missing file reads as empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path, ignoreNullFields=False)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True, quoteAll=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def radio_export(radio: DataFrame, drivers: DataFrame) -> DataFrame:
    """Messages as text columns in export order, names resolved, nulls as empty text."""
    out = radio.join(drivers, "session_uid", "left")
    have = set(out.columns)
    special = {
        "circuit_name": F.when(c("track_id").isNotNull(), dims.track_name(c("track_id"))),
        "sent_at": F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss"),
    }
    col = lambda n: special[n] if n in special else (c(n) if n in have else F.lit(None))
    return out.select(*[F.coalesce(col(n).cast("string"), F.lit("")).alias(n) for n in RADIO_HEADER])


# ---- writes by key ---------------------------------------------------------------------------


def insert_absent(target: DataFrame | None, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``batch`` whose key the target does not hold yet, the first row per key by ``order`` winning."""
    names = [n for n in batch.columns if n not in keys]
    pick = F.min_by(F.struct(*names), c(order))
    once = batch.groupBy(*keys).agg(pick.alias("_r")).select(*keys, "_r.*").select(*batch.columns)
    return once if target is None else once.join(target.select(*keys), keys, "left_anti")


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Target with the newest batch row per key; ``keep`` columns stay as first written."""
    names = [n for n in target.columns if n not in keys]
    newest = batch.groupBy(*keys).agg(
        F.max_by(F.struct(*[n for n in names]), c(order)).alias("_new"), F.min_by(F.struct(*[n for n in names]), c(order)).alias("_first")
    )
    old = target.select(*keys, F.struct(*names).alias("_old"))
    both = old.join(newest, keys, "full_outer")
    value = lambda n: (
        F.when(c("_old").isNotNull(), c(f"_old.{n}")).otherwise(c(f"_first.{n}")) if n in keep
        else F.when(c("_new").isNotNull(), c(f"_new.{n}")).otherwise(c(f"_old.{n}"))
    )
    return both.select(*keys, *[value(n).alias(n) for n in names])


def with_id(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    return df.withColumn(name, F.xxhash64(*keys))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> str:
    """Write the next version of a table beside the current one; readers switch once it is complete."""
    spark = df.sparkSession
    now = versions(spark, path)
    target = f"{path}/version-{(now[-1] + 1) if now else 0:08d}"
    df.write.mode("errorifexists").parquet(target)
    return target


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions (those with a success marker), oldest first."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [n for n in names if n.startswith("version-") and fs.exists(hadoop.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.split("-")[1]) for n in done)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    have = versions(spark, path)
    return spark.read.parquet(f"{path}/version-{have[-1]:08d}") if have else None


def _mark() -> list[Column]:
    """Row count and order-free checksum of a table, of the column ``_mark`` of ``_marked``."""
    return [F.count("*").alias("rows"), F.coalesce(F.sum(c("_mark").cast("decimal(20,0)")), F.lit(0)).cast("string").alias("mark")]


def _marked(df: DataFrame) -> DataFrame:
    """Each row with a hash of all its columns; nulls are told apart, as the hash itself passes over them."""
    nested = [f for f in df.schema.fields if "map<" in f.dataType.simpleString()]  # these have no hash
    plain = [c(f"`{f.name}`") for f in df.schema.fields if f not in nested]
    nulls = [F.concat(*[F.when(x.isNull(), "1").otherwise("0") for x in plain])] if plain else []
    whole = [F.to_json(F.struct(*[c(f"`{f.name}`") for f in nested]))] if nested else []
    return df.select("*", F.xxhash64(*plain, *nulls, *whole).alias("_mark"))


def summary(df: DataFrame) -> DataFrame:
    """Rows and checksum of a table, whatever the order."""
    return _marked(df).agg(*_mark())


def backup(tables: dict[str, DataFrame], path: str) -> None:
    """Write the tables, then a manifest with rows and checksum of each as they were written. A backup without its
    manifest is not complete."""
    marks = []
    for name, df in tables.items():
        seen = Observation()
        _marked(df).observe(seen, *_mark()).drop("_mark").write.mode("errorifexists").parquet(f"{path}/{name}")
        marks.append((name, seen.get["rows"], seen.get["mark"]))
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame(marks, "name string, rows bigint, mark string").coalesce(1).write.json(f"{path}/manifest")


def restore(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows of the backup missing from each live table, tables in the order of their foreign keys.

    Every table is verified against the manifest before any is given; a damaged one is refused.
    """
    marks = {r.name: (r.rows, r.mark) for r in spark.read.schema("name string, rows bigint, mark string").json(f"{path}/manifest").collect()}  # a row for each table
    names = [n for n in TABLE_KEYS if n in tables]
    for name in names:
        found = summary(spark.read.parquet(f"{path}/{name}")).first()
        if (found.rows, found.mark) != marks.get(name):
            raise ValueError(f"backup of {name} is damaged: {found.rows} rows with mark {found.mark}, not {marks.get(name)}")
    return {n: spark.read.parquet(f"{path}/{n}").join(tables[n].select(*TABLE_KEYS[n]), TABLE_KEYS[n], "left_anti") for n in names}


def radio_log(messages: DataFrame) -> DataFrame:
    """Delivered messages with the stream's hex session id as a signed number."""
    return messages.withColumn("session_uid", tx.signed_uid(c("session_hex"))).drop("session_hex")


def pair_run_io(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests and results by job, with the player's mean position taken from the result."""
    mean = F.get(F.filter("cars", lambda e: e["car_index"] == c("player_car_index")), F.lit(0))["mean_position"]
    return requests.join(results, "job_id", "full_outer").withColumn("player_mean_position", mean)


def fixed(x: Column, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f", x)


def markdown_row(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(x.cast("string"), F.lit("None")) for x in cells]), F.lit(" |"))


def latest_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(w)).where(c("_rn") == 1).drop("_rn")

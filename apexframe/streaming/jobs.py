"""Structured Streaming jobs: landed packets to ticks, statistics, snapshots, messages and tables.

Event time is the receive time. Watermarks bound the state of windows and of ticks put in order; what rules
and transitions remember is one value for each key in the state store (see ``memory`` and ``latches``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apexframe.sources import keyed
from apexframe.sources import tables as tb
from apexframe.streaming import latches as lt

c = F.col
PACKET_SCHEMA = "recv_seq bigint, recv_ts timestamp, payload binary"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_parquet(spark: SparkSession, path: str, schema: str = PACKET_SCHEMA, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def downsample(states: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Newest state per session and second; a second is final once the watermark has passed it."""
    names = [n for n in states.columns if n not in ("session_uid", "ts")]
    per = states.withWatermark("ts", late).groupBy("session_uid", F.window("ts", "1 second").alias("w")).agg(
        F.max_by(F.struct("ts", *names), F.struct("ts", "recv_seq")).alias("s")
    )
    return per.select("session_uid", c("w.start").alias("second"), *[c(f"s.{n}").alias(n) for n in names])


def packet_stats(packets: DataFrame) -> DataFrame:
    """Running count, mean size and rate per (session, packet type); for update mode."""
    span = F.max("recv_ms") - F.min("recv_ms")
    return packets.groupBy("session_uid", "packet_id").agg(
        F.count("*").alias("packets"), F.avg("size").alias("avg_size"),
        F.when(span > 0, F.count("*") * 1000.0 / span).otherwise(0.0).alias("per_second"),
    )


def first_packets(packets: DataFrame, late: str = "1 hour") -> DataFrame:
    """One packet of each kind per session."""
    return packets.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_uid", "kind"])


def debounce(triggers: DataFrame, seconds: int = 3, late: str = "10 seconds") -> DataFrame:
    """One firing per burst of triggers, at the end of the quiet time."""
    w = F.session_window("ts", f"{seconds} seconds")
    per = triggers.withWatermark("ts", late).groupBy("session_uid", w).agg(F.count("*").alias("triggers"))
    return per.select("session_uid", c("session_window.end").alias("fire_at"), "triggers")


def sector_snapshots(feed: DataFrame, keys: tuple[str, ...] = ("session_uid", "car_index")) -> DataFrame:
    """Lap and history packets to completed sectors, with state for each session and car.

    ``feed``: the keys, seq, is_history, lap, sector, s1_ms, s2_ms, last_lap_ms, num_laps and
    last_laps (the last five laps' sector times), nulls filled.
    """
    out = lt.run_stream(feed, ["seq"], [*keys, "seq"], lt.sector_changes, keys)
    return out.select(
        *keys, "seq", c("n1").alias("completed"), c("n2").alias("snap_lap"), c("code").cast("int").alias("tier"), c("n3").alias("sector_ms")
    )


def insert_absent_sink(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink keeping the first row per key; a replayed batch adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = spark.read.parquet(path) if tb.exists(spark, path) else None
        tb.append(tb.insert_absent(target, batch, keys, order), path)

    return write


def upsert_sink(path: str, keys: list[str], order: str, keep: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        now = tb.current(batch.sparkSession, path)
        base = now if now is not None else batch.limit(0)
        tb.replace(tb.upsert(base, batch, keys, order, keep), path)

    return write


def merge_sink(path: str, keys: list[str], order: str, update: bool, writer: str = "", **layout) -> Callable[[DataFrame, int], None]:
    """Keyed foreachBatch sink on ``sources.keyed``: a micro-batch reads and writes only the buckets of its keys.

    A batch is known by the stream that sent it (or ``writer``) and its number, so what comes again after a failure
    changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        keyed.merge(batch, path, keys, order, update, writer or stream or "batch", batch_id, **layout)

    return write


def known_sessions(packets: DataFrame, sessions: DataFrame, behind: str = "1 day", late: str = "1 minute") -> DataFrame:
    """Packets of known sessions: those received at or after the first packet of their session.

    ``sessions`` are session packets (session_uid, recv_ts, recv_seq), ``packets`` any others with the same columns. A
    packet passes if one of its session's was received before it, within ``behind``; both sides' state ends with the time
    bounds. Whatever order the two streams bring them in, a packet ahead of its session is dropped.
    """
    opened = sessions.withWatermark("recv_ts", late).select(c("session_uid").alias("_uid"), c("recv_ts").alias("_ts"), c("recv_seq").alias("_seq"))
    return packets.withWatermark("recv_ts", late).join(
        opened,
        (c("session_uid") == c("_uid")) & (c("recv_seq") >= c("_seq"))
        & (c("recv_ts") >= c("_ts")) & (c("recv_ts") <= c("_ts") + F.expr(f"INTERVAL {behind}")),
        "left_semi",
    )


def session_end_sink(on_practice: Callable[[DataFrame], None], on_race: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """Ended sessions by kind: practice sessions recalibrate their tracks, races get evaluated."""

    def write(batch: DataFrame, batch_id: int) -> None:
        ended = batch.where(c("kind") == "ended")
        practice, race = ended.where(c("session_kind") == "PRACTICE"), ended.where(c("session_kind") == "RACE")
        if not practice.isEmpty():
            on_practice(practice.select("track_id").distinct())
        if not race.isEmpty():
            on_race(race.select("session_uid").distinct())

    return write


def drain(df: DataFrame, checkpoint: str, mode: str = "append", path: str | None = None, sink: Callable | None = None):
    """Run a stream over everything available now and stop; recovers from its checkpoint."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = (w.foreachBatch(sink) if sink else w.format("parquet").option("path", path)).start()
    q.awaitTermination()
    return q

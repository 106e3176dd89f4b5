"""Tables written by key: rows lie in buckets of a leading key, a merge touches only the buckets of its batch.

``path/data/v<n>/bucket=<b>`` holds what write n gave a bucket, ``path/commits/version-<n>`` names the pieces that
count after write n and the last batch of each writer. A commit counts once its success marker is there, so a write
that was cut off leaves the table as it was, and a batch that comes again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apexframe.sources import tables as tb

c = F.col
BUCKETS = 256
PIECES = 16  # appended pieces of a bucket, beyond which a merge writes it as one
COMMIT = "kind string, name string, number bigint"
SPREAD = 8  # files of a rewritten bucket are dealt over so many tasks, as one key may hold much of a table


class State:
    """What a commit says: ``pieces`` of each bucket (at most BUCKETS x PIECES), last batch of each writer."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        have = tb.versions(spark, f"{path}/commits")
        self.version = (have[-1] if have else -1) if version is None else version
        self.pieces: dict[int, list[int]] = {}
        self.writers: dict[str, int] = {}
        self.buckets: int | None = None
        if self.version >= 0:
            for r in spark.read.schema(COMMIT).json(f"{path}/commits/version-{self.version:08d}").collect():
                if r.kind == "buckets":
                    self.buckets = r.number
                elif r.kind == "writer":
                    self.writers[r.name] = r.number
                else:
                    self.pieces.setdefault(int(r.name), []).append(r.number)

    def folders(self, path: str, buckets: list[int] | None = None) -> list[str]:
        chosen = self.pieces if buckets is None else [b for b in buckets if b in self.pieces]
        return [f"{path}/data/v{v:08d}/bucket={b}" for b in sorted(chosen) for v in sorted(self.pieces[b])]

    def commit(self, spark: SparkSession, path: str) -> None:
        rows = [("buckets", None, self.buckets)] + [("writer", w, n) for w, n in self.writers.items()]
        rows += [("piece", str(b), v) for b, vs in self.pieces.items() for v in vs]
        spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("overwrite").json(f"{path}/commits/version-{self.version:08d}")


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as of its newest commit; None before the first row."""
    folders = State(spark, path).folders(path)
    return spark.read.parquet(*folders) if folders else None


def bucket_of(by: list[str], buckets: int):
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")


def merge(
    batch: DataFrame, path: str, keys: list[str], order: str, update: bool, writer: str, batch_id: int,
    keep: tuple[str, ...] = (), by: list[str] | None = None, buckets: int = BUCKETS, retain: int = 3,
) -> bool:
    """Merge ``batch`` into the table at ``path``; false if this writer's batch is in it already.

    With ``update`` the newest row per key by ``order`` replaces the table's (``keep`` columns stay as first written)
    and the touched buckets are written anew. Without it rows of unknown keys are appended, the first per key by
    ``order``, and only key columns are read. ``by`` (the first key unless given) deals rows to buckets, so a batch of few
    sessions reads and writes few buckets. The ``retain`` newest commits stay readable. Batches of one writer come in ascending
    order of their ids; one table has one writing stream at a time. An empty batch is committed with no piece. Rows with
    a null in their key are equal within a batch and never match the table.
    """
    spark = batch.sparkSession
    state = State(spark, path)
    if state.writers.get(writer, -1) >= batch_id:
        return False
    if state.buckets not in (None, buckets):
        raise ValueError(f"{path} has {state.buckets} buckets, not {buckets}")
    state.buckets, state.version = buckets, state.version + 1
    state.writers[writer] = batch_id
    rows = batch.withColumn("bucket", bucket_of(by or keys[:1], buckets)).persist()
    try:
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most ``buckets``
        if touched:
            _write(rows, state, path, keys, order, update, keep, touched, by or keys[:1], buckets)
        state.commit(spark, path)
    finally:
        rows.unpersist()
    retire(spark, path, retain)
    return True


def _write(rows, state, path, keys, order, update, keep, touched, by, buckets) -> None:
    spark = rows.sparkSession
    old = state.folders(path, touched)
    target = spark.read.parquet(*old) if old else None
    folder = f"{path}/data/v{state.version:08d}"
    new = rows.drop("bucket")
    if update:
        whole = tb.upsert(target if old else new.drop(order).limit(0), new, keys, order, keep)
        anew = touched
    else:
        absent = tb.insert_absent(target.select(*keys) if old else None, new, keys, order).drop(order)
        anew = [b for b in touched if len(state.pieces.get(b, [])) >= PIECES]
        again = state.folders(path, anew)
        whole = absent.unionByName(spark.read.parquet(*again)) if again else absent
    laid = whole.withColumn("bucket", bucket_of(by, buckets))
    laid = laid.repartition("bucket", F.pmod(F.xxhash64(*keys), F.lit(SPREAD)))
    laid.write.mode("overwrite").partitionBy("bucket").parquet(folder)  # what a cut-off attempt left is replaced
    written = set(_children(spark, folder))
    for b in touched:
        have = [] if b in anew else state.pieces.get(b, [])
        found = have + ([state.version] if f"bucket={b}" in written else [])
        if found:
            state.pieces[b] = found


def _children(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def retire(spark: SparkSession, path: str, retain: int) -> None:
    """Delete pieces that only commits older than the ``retain`` newest name, and those commits."""
    versions = tb.versions(spark, f"{path}/commits")
    old, kept = versions[:-retain], versions[-retain:]
    if not old:
        return
    used = {f for v in kept for f in State(spark, path, v).folders(path)}
    gone = {f for v in old for f in State(spark, path, v).folders(path)} - used
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in [*sorted(gone), *[f"{path}/commits/version-{v:08d}" for v in old]]:
        fs.delete(hadoop.Path(folder), True)

"""What the operators share: reading tables, cutting lineage, slicing Arrow batches by bytes, giving memory of workers back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apexframe.session import shared_folder

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

_kept: dict[str, list[dict]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path under the cluster's checkpoint folder."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: later stages, and tasks run
    again after a lost executor, start from these files."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_type(docs: DataFrame, column: str = "doc_id") -> T.DataType:
    return docs.schema[column].dataType


def kept(owner: str) -> dict:
    """A new cache that tasks of ``owner`` keep in their worker; a task of another operator there empties it (``handed``).
    Workers serve all jobs of a session, so a cache would else outlive its job and add to what later ones hold."""
    cache: dict = {}
    _kept.setdefault(owner, []).append(cache)
    return cache


def handed(batches: Iterator[pa.RecordBatch], owner: str = "") -> Iterator[pa.RecordBatch]:
    """The batches of a task of ``owner``. Caches of others go at its start, and Arrow's pool, which holds on to the
    memory of earlier batches, gives it back to the system before each one."""
    for cache in (c for other, caches in _kept.items() if other != owner for c in caches):
        cache.clear()
    for batch in batches:
        pa.default_memory_pool().release_unused()
        yield batch


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20, owner: str = "") -> Iterator[pa.RecordBatch]:
    """Cut batches, as ``handed`` gives them, into runs of rows of about ``most_bytes`` of ``column``; one longer text is a
    run of its own."""
    for batch in handed(batches, owner):
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch[column]), 0).to_pylist()
        at, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most_bytes:
                yield batch.slice(at, i - at)
                pa.default_memory_pool().release_unused()  # whoever takes the slices held the batch before until now
                at, held = i, 0
            held += size
        if at < batch.num_rows:
            yield batch.slice(at)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each row's text, null as empty."""
    return [x or b"" for x in batch[column].cast(pa.binary()).to_pylist()]


def renamed(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under names of our own, so that other columns cannot clash."""
    return docs.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def in_sample(column: str, share: float) -> Column:
    """Whether the hash of a value falls into a share of all hashes: the same rows in every table and run, and
    no sort of candidates that would send each task's best to one place."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))

"""WARC archives of web pages, and their capture index by external merge.

Archives are WARC/1.1 text written by Spark: a row is a record, the two line ends that close a record are
the sink's separator, and the sink's gzip codec compresses a file. Reading follows Content-Length, so
payloads may hold anything. The index of captures is an external merge: each archive gives a run sorted
by URL key and timestamp, runs are cut at common boundaries so that every range holds a bounded
number of entries, and a range merges its pieces of all runs with a loser tree. Ranges ascend, so the
index is ordered globally, and a URL with very many captures is spread over ranges by timestamp.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256
from itertools import islice
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apexframe.llm.common import renamed, shared_path, stored

LEAST_REVISIT = 100  # payload bytes
FIRST_CAPTURE = 1_577_836_800  # 2020-01-01; page n counts as captured n seconds later where no time is given
RECORDS = 2_000  # of an archive file
END = "\r\n\r\n"


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", time: str | None = None) -> DataFrame:
    """``(page_id, url, payload, captured, payload_bytes, payload_digest, record_type, refers_to)`` for each row.

    Null html is an empty payload. Of records with equal payloads of at least 100 bytes that with the
    smallest page_id is the response (null ids last; rows repeating that id all are), the others revisit it.
    """
    rows = renamed(pages, page_id=key, url=url, payload=html, **({"captured": time} if time else {}))
    if not time:
        rows = rows.withColumn("captured", F.timestamp_seconds(F.coalesce(F.col("page_id"), F.lit(0)) + FIRST_CAPTURE))
    rows = rows.withColumn("payload", F.coalesce("payload", F.lit("")))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2(F.encode("payload", "utf-8"), 256))
    # only digests that occur again are joined back
    light = rows.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    again = light.where("n > 1").select(F.col("payload_digest").alias("digest"), "first")
    joined = rows.join(again, F.col("payload_digest") == F.col("digest"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", "payload", "captured", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def _uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit(""))


def record_text(revisit_profile: str = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest") -> Column:
    """A WARC record without its closing line ends. Line ends in a URL are percent-encoded."""
    revisit = F.col("record_type") == "revisit"
    target = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit("WARC/1.1"), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", _uri(F.col("page_id"))),
        _line("WARC-Date", F.date_format(F.to_utc_timestamp("captured", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")), _line("WARC-Target-URI", target),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        _line("WARC-Refers-To", _uri(F.col("refers_to"))), _line("WARC-Profile", F.when(revisit, revisit_profile)),
        _line("Content-Type", F.lit("text/html; charset=utf-8")), F.lit("\r\nContent-Length: "), F.col("payload_bytes").cast("string"),
        F.lit(END), F.col("payload"))


def write_archives(pages: DataFrame, folder: str, **names: str) -> None:
    """Write a record for each row of ``pages`` to gzip archives under ``folder``; a revisit keeps its payload,
    so that the archive alone gives back every page."""
    rows = records(pages, **names).select(record_text().alias("value"))
    rows.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(folder)


def _read(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and payload of each record of an archive."""
    data = zlib.decompress(data, 47)
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        headers = dict(line.split(": ", 1) for line in data[at:stop].decode().split("\r\n")[1:])
        begin = stop + 4
        end = begin + int(headers["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} is not closed")
        yield at, headers, data[begin:end]
        at = end + 4


def url_key(url: str | None) -> str:
    """The host's labels reversed, then path and query, lower case: captures of a site lie together."""
    try:
        parts = urlsplit(url or "")
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return f"){url}".lower()
    return f"{host}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


ENTRY = T.StructType([
    T.StructField("url_key", T.StringType()), T.StructField("captured", T.StringType()), T.StructField("page_id", T.LongType()),
    T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
])
NAMES = [f.name for f in ENTRY]
ARROW = pa.schema([(f.name, pa.int64() if f.dataType == T.LongType() else pa.string()) for f in ENTRY])


def _number(uri: str | None) -> int | None:
    return int(uri.removeprefix("<urn:page:").removesuffix(">")) if uri else None


def _order(entry: tuple) -> tuple:
    """URL key, time, then page (none first) and place: a total order of entries."""
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[3], entry[4]


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """The index entries of all archives, those of an archive as one sorted run. Digests are of what is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                name, entries = path.as_py().rsplit("/", 1)[-1], []
                for offset, head, payload in _read(content.as_py()):
                    digest = sha256(payload).hexdigest()
                    if head["WARC-Payload-Digest"] != f"sha256:{digest}":
                        raise ValueError(f"payload at {offset} of {name} has another digest than its header")
                    entries.append((url_key(head.get("WARC-Target-URI")), head["WARC-Date"], _number(head.get("WARC-Record-ID")), name, offset, len(payload), digest, head["WARC-Type"], _number(head.get("WARC-Refers-To"))))
                entries.sort(key=_order)
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, e)) for e in entries], ARROW)

    return files.mapInArrow(run, ENTRY)


class LoserTree:
    """Merges sorted runs: the root holds the next entry's run, each inner node the loser of its match, so that
    taking an entry replays one path of log2(k) comparisons."""

    def __init__(self, sequences: list[Iterator[tuple]]):
        self.sequences = [iter(s) for s in sequences]
        self.k = len(self.sequences)
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * self.k
        self.winner = self._build(1) if self.k else -1

    def _next(self, i: int):
        entry = next(self.sequences[i], None)
        return None if entry is None else (_order(entry), entry)

    def _beats(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a][0], a) < (self.heads[b][0], b)

    def _build(self, node: int) -> int:
        """Winner of the subtree; leaf i is node k + i."""
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.winner] is not None:
            run = self.winner
            yield self.heads[run][1]
            self.heads[run] = self._next(run)
            node = (self.k + run) // 2
            while node:
                if self._beats(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


MERGED = T.StructType([*ENTRY, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: pieces of runs in, entries in order out, with the range's number and the place in it."""
    pieces: dict[str, list[tuple]] = {}
    for batch in batches:
        for entry in zip(*(batch[n].to_pylist() for n in NAMES)):
            pieces.setdefault(entry[3], []).append(entry)
    for piece in pieces.values():
        piece.sort(key=_order)  # a shuffle may interleave a run's blocks; on a run in order this is one pass
    part, place, out = TaskContext.get().partitionId(), 0, []
    merged = iter(LoserTree([iter(pieces[name]) for name in sorted(pieces)]))
    while out := list(islice(merged, 10_000)):
        columns = [pa.array(x, f.type) for x, f in zip(zip(*out), ARROW)]
        columns += [pa.array(np.full(len(out), part, np.int32)), pa.array(np.arange(place, place + len(out)))]
        yield pa.RecordBatch.from_arrays(columns, [*NAMES, "part", "place"])
        place += len(out)


def capture_index(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of all archives under ``folder``, ascending by URL key and time over the partitions; (part,
    place) is an entry's place in the whole index."""
    entries = stored(runs(spark, folder), "runs")
    return entries.repartitionByRange("url_key", "captured", "page_id").mapInArrow(_merge, MERGED)


def archived(pages: DataFrame, **names: str) -> tuple[str, DataFrame]:
    """Write ``pages`` to archives in a new shared folder and index what is read back: folder and index.

    Null URLs have the key ``)/``. Null page ids give records without an id. Empty tables give no entries.
    """
    folder = shared_path(pages.sparkSession, "warc")
    write_archives(pages, folder, **names)
    return folder, capture_index(pages.sparkSession, folder)

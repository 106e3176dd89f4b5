"""Benchmark decontamination: a prefix-filtered containment join of item windows with whole documents.

A benchmark item is a set of windows of consecutive words. A window lies in a document only if all of its
shingles do, so one of them, the rarest in the corpus, is a sufficient prefix. Shingle counts are taken
over all documents in a first pass; the second looks only for prefix shingles, derives from the shingle's
offset where the window would start (positional bound), checks that it fits into the document (length
bound), and compares the words (verification). Benchmarks are taken in blocks of bounded size, each
sent to all tasks; several blocks meet again by document.
"""

from __future__ import annotations


from collections import Counter, defaultdict
from collections.abc import Iterator


import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apexframe.llm.common import renamed, slices, stored, texts

WINDOW = 10
SHINGLE = 2
BLOCK_BYTES = 8 << 20  # of benchmark text that is sent to all tasks at once
TO_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


class Windows:
    """The windows of a block of items, and the shingles that lead to them."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW, shingle: int = SHINGLE):
        self.shingle = shingle
        found: dict[tuple, set[str]] = defaultdict(set)
        for item, text in items:
            words = words_of(text)
            n = min(size, len(words))
            for i in range(len(words) - n + 1 if n else 0):
                found[tuple(words[i : i + n])].add(item)
        self.windows = {window: frozenset(ids) for window, ids in found.items()}
        self.lead: dict[int, dict[tuple, tuple]] = {}

    def shingles(self) -> dict[int, set[tuple]]:
        """All shingles by length; a window shorter than a shingle is its own."""
        out: dict[int, set[tuple]] = defaultdict(set)
        for window in self.windows:
            n = min(self.shingle, len(window))
            out[n].update(window[i : i + n] for i in range(len(window) - n + 1))
        return out

    def order(self, counts: dict[tuple, int]) -> None:
        """Keep of each window its rarest shingle, with the offsets and lengths it can have there."""
        lead: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for window in self.windows:
            n = min(self.shingle, len(window))
            rarity, i = min((counts.get(window[i : i + n], 0), i) for i in range(len(window) - n + 1))
            if rarity:
                lead[n][window[i : i + n]].add((i, len(window)))
        self.lead = {n: {s: tuple(sorted(at)) for s, at in by.items()} for n, by in lead.items()}

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words that are windows, and the items these belong to."""
        spans, items = [], set()
        for n, lead in self.lead.items():
            grams = zip(*(words[i:] for i in range(n))) if n > 1 else zip(words)
            for p, gram in enumerate(grams):
                if gram in lead:
                    for offset, size in lead[gram]:
                        start = p - offset
                        if start >= 0 and start + size <= len(words):
                            ids = self.windows.get(tuple(words[start : start + size]))
                            if ids is not None:
                                spans.append((start, start + size))
                                items |= ids
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans that cover the same words."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks; the driver holds one block at a time. Rows without id are items named ''."""
    block, held = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).toLocalIterator():
        block.append((row.item, bytes(row.text)))
        held += len(row.text) + 64
        if held >= BLOCK_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def _counted(rows: DataFrame, shingles: dict[int, set[tuple]]) -> dict[tuple, int]:
    """How often each of ``shingles`` occurs in all documents."""
    known = rows.sparkSession.sparkContext.broadcast(shingles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches, "text"):
            for text in texts(batch):
                words = words_of(text)
                for n, wanted in known.value.items():
                    grams = zip(*(words[i:] for i in range(n))) if n > 1 else zip(words)
                    counts.update(filter(wanted.__contains__, grams))
        yield pa.RecordBatch.from_arrays([pa.array([b" ".join(g) for g in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], ["gram", "n"])

    sums = rows.select("text").mapInArrow(run, "gram binary, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {tuple(bytes(r.gram).split(b" ")): r.n for r in sums.collect()}


FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]


def _hits(rows: DataFrame, windows: Windows) -> DataFrame:
    """``rows`` (a column ``text`` among others, which is dropped) with the hits of one block."""
    known = rows.sparkSession.sparkContext.broadcast(windows)
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text in texts(batch):
                words = words_of(text)
                spans, items = known.value.find(words)
                spans = merged(spans)
                out.append((len(words), sum(b - a for a, b in spans), [a for a, _ in spans], [b for _, b in spans], sorted(items)))
            columns = [pa.array(list(x), t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([batch[c] for c in kept] + columns, kept + [f.name for f in FIELDS])

    return rows.mapInArrow(run, T.StructType([rows.schema[c] for c in kept] + FIELDS))


@F.udf(T.ArrayType(T.ArrayType(T.LongType())))
def _merged(starts, ends):
    spans = merged([(a, b) for s, e in zip(starts, ends) for a, b in zip(s, e)])
    return [[a for a, _ in spans], [b for _, b in spans]]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, text_hash, n_words, n_hit, starts, ends, items)`` for each row of ``docs``.

    starts and ends are the disjoint spans of words inside occurrences of windows, items the ids (as
    strings, sorted) of the items that occur. Items without words never occur; null texts have no words;
    equal items all count. Repeated rows each get a row. An empty benchmark hits nothing.
    """
    rows = renamed(docs, doc_id=key, text=text).withColumn("text_hash", F.xxhash64("text"))
    parts = []
    for block in _blocks(benchmark):
        windows = Windows(block)
        windows.order(_counted(rows, windows.shingles()))
        parts.append(_hits(rows, windows))
    if not parts:
        parts.append(_hits(rows, Windows([])))
    if len(parts) == 1:
        return parts[0].select("doc_id", "text_hash", *[f.name for f in FIELDS])
    # rows that repeat both id and text have equal hits: count them, and give them back at the end
    joined = stored(parts[0].unionByName(parts[1]) if len(parts) == 2 else _union(parts), "hits")
    groups = joined.groupBy("doc_id", "text_hash").agg(
        F.first("n_words").alias("n_words"), F.collect_list("starts").alias("s"), F.collect_list("ends").alias("e"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count(F.lit(1)) / len(parts)).cast("int").alias("rows"))
    spans = groups.withColumn("spans", _merged("s", "e"))
    total = F.aggregate(F.zip_with(F.col("spans")[1], F.col("spans")[0], lambda b, a: b - a), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return spans.withColumn("copy", F.explode(F.sequence(F.lit(1), "rows"))).select(
        "doc_id", "text_hash", "n_words", total.alias("n_hit"), F.col("spans")[0].alias("starts"), F.col("spans")[1].alias("ends"), "items")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that hold a window of ``benchmark``. All columns are kept."""
    hit = contamination(docs, benchmark, text, key).where("n_hit > 0").select("doc_id", "text_hash").distinct().alias("h")
    left = docs.withColumn("_hash", F.xxhash64(text)).alias("d")
    same = F.col(f"d.{key}").eqNullSafe(F.col("h.doc_id")) & (F.col("d._hash") == F.col("h.text_hash"))
    return left.join(hit, same, "left_anti").drop("_hash")


def items_digest(items) -> str:
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)

"""SimHash near-duplicates: fingerprints compared as bit planes with carry-save counters.

A document's fingerprint has a bit set where over half of its shingle hashes have it. Distinct
fingerprints are dealt to buckets of equal bit bands: with six bands and at most four differing bits, two
bands of a linked pair agree, so the 15 pairs of bands lose no link. Inside a bucket the fingerprints lie
as 64 bit planes, one machine word holding the same bit of 64 fingerprints; a query is compared with 64
others at once, its differing bits counted in three carry-save bit counters, and a word is abandoned
once all of its lanes are beyond the radius. A bucket gives a spanning list of links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apexframe.llm.common import id_type, renamed, slices, stored, texts
from apexframe.llm.graph import components

RADIUS = 4
SHINGLE = 4
SEED = 42
BANDS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
BLOCK = 16_384  # fingerprints of a bucket that one task holds; larger buckets are split into pairs of blocks
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
LANE = np.arange(8, dtype=np.int64) * 256
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of whole ``text``; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-shingle])).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], dtype="<u8")
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + LANE).ravel(), minlength=2048).reshape(8, 256)
    over = (counts @ BYTE_BITS).ravel() * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, text_hash, fp)`` for each row; ``fp`` holds the 64 bits as a long. Null text: no words."""
    rows = renamed(docs, doc_id=key, text=text).withColumn("text_hash", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(x) for x in texts(batch)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(fps)], ["doc_id", "text_hash", "fp"])

    fields = [T.StructField("doc_id", id_type(docs, key)), T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())]
    return rows.mapInArrow(run, T.StructType(fields))


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit b of fingerprints 64 w .. 64 w + 63 in one word."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near(planes: np.ndarray, masks: np.ndarray, q: np.ndarray, w: np.ndarray, lanes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """For queries ``q`` and words ``w``: indexes that have a lane within ``radius``, and those lanes.

    ``masks`` (64, n) holds each query's bit b as all ones or zeros, ``lanes`` the lanes that count.
    """
    left = np.arange(len(q))
    ones, twos, fours = (np.zeros(len(q), np.uint64) for _ in range(3))
    far = ~lanes
    for b in range(64):
        x = planes[b][w] ^ masks[b][q]
        carry = ones & x
        ones = ones ^ x
        x = twos & carry
        twos = twos ^ carry
        far = far | (fours & x)
        fours = fours ^ x
        if b >= radius:
            far = far | _over(ones, twos, fours, radius)
            if b % 4 == 3:
                alive = far != ALL
                if not alive.all():
                    left, q, w, ones, twos, fours, far = (v[alive] for v in (left, q, w, ones, twos, fours, far))
                    if not len(left):
                        break
    return left, ~far


def _over(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count (0 to 7) is above ``radius``."""
    over = np.zeros_like(ones)
    for count in range(radius + 1, 8):
        over |= (ones if count & 1 else ~ones) & (twos if count & 2 else ~twos) & (fours if count & 4 else ~fours)
    return over


def _below(n: np.ndarray) -> np.ndarray:
    """Words with the lowest n (0 to 64) lanes set."""
    n = n.astype(np.uint64)
    return np.where(n >= 64, ALL, (np.uint64(1) << np.minimum(n, np.uint64(63))) - np.uint64(1))


def bucket_links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links ``(fp, fp)`` inside runs of equal keys; ``keys`` sorted, whole buckets only."""
    n = len(keys)
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(start, n))
    keep = np.repeat(size > 1, size)
    fps, size = fps[keep], size[size > 1]
    n = len(fps)
    if not n:
        return fps, fps
    end = np.repeat(np.cumsum(size), size)
    planes = planes_of(fps)
    masks = np.where(np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T != 0, ALL, np.uint64(0))
    label = np.arange(n)
    step = 1 << 17
    spans = (end - 1) // 64 - np.arange(n) // 64 + 1
    edges = np.concatenate(([0], np.cumsum(spans)))
    at = 0
    while at < n:  # about ``step`` comparisons of a query with a word at a time
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + step, "right")) - 1)
        q = np.repeat(np.arange(at, to), spans[at:to])
        w = np.arange(len(q)) - np.repeat(edges[at:to] - edges[at], spans[at:to]) + q // 64
        lanes = _below(np.clip(end[q] - 64 * w, 0, 64)) & ~_below(np.clip(q + 1 - 64 * w, 0, 64))
        i, found = near(planes, masks, q, w, lanes)
        if len(i):
            bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, lane = np.nonzero(bits)
            label = _joined(label, q[i[r]], 64 * w[i[r]] + lane)
        at = to
    linked = np.flatnonzero(label != np.arange(n))
    return fps[linked], fps[label[linked]]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each class after joining the classes of ``a`` and ``b``."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket; a bucket may go on in the next batch."""
    keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

    def out(k, f):
        a, b = bucket_links(k, f)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        keys = np.concatenate((keys, batch["bucket"].to_numpy(zero_copy_only=False)))
        fps = np.concatenate((fps, batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)))
        whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if whole:
            yield out(keys[:whole], fps[:whole])
            keys, fps = keys[whole:], fps[whole:]
    if len(keys):
        yield out(keys, fps)


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """``distinct(fp)`` -> spanning links ``(a, b)`` whose components are those of all pairs within the radius."""
    bands = []
    for k, ((a, n), (b, m)) in enumerate(combinations(BANDS, 2)):
        high = F.shiftrightunsigned("fp", a).bitwiseAND((1 << n) - 1)
        low = F.shiftrightunsigned("fp", b).bitwiseAND((1 << m) - 1)
        bands.append(F.lit(k << 32) + high * (1 << m) + low)
    keyed = distinct.select("fp", F.explode(F.array(*bands)).alias("band"))
    hot = stored(keyed.groupBy("band").count().where(F.col("count") > block), "buckets")
    if hot.isEmpty():
        dealt = keyed.withColumn("bucket", F.col("band"))
    else:
        blocks = F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("long")
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        pair = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        dealt = (
            keyed.join(hot, "band", "left").withColumn("blocks", blocks)
            .select("fp", "band", "blocks", mine.alias("mine"), pair.alias("other"))
            .withColumn("bucket", F.when(F.col("blocks") == 1, F.col("band")).otherwise(
                F.xxhash64("band", F.least("mine", "other"), F.greatest("mine", "other"))))
        )
    return dealt.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, text_hash, fp, component_id, keeper)`` for each row of ``docs``.

    component_id is the smallest id reachable over links of at most four differing bits; documents of equal
    fingerprint, those without words among them (fingerprint zero), are one node. Null ids count after all
    others, so component_id is null only where a whole class has null ids. keeper is true for the row that
    a deduplication keeps (and for rows repeating it: equal id and text). Repeated rows each get a row. An
    empty table gives none.
    """
    return classified(stored(fingerprints(docs, text, key), "fingerprints"), lambda nodes: links(nodes.select("fp")))


def classified(fps: DataFrame, links_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``fps(doc_id, text_hash, fp)``, and ``bands`` if any, with the class and keeper of each row; ``links_of``
    gives the links of the distinct ``nodes(fp, first)``, ``first`` being the row of the smallest id."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    bands = [F.first("bands").alias("bands")] if "bands" in fps.columns else []  # the same for all of a node
    nodes = stored(fps.groupBy("fp").agg(F.min(first).alias("first"), *bands), "nodes")
    roots = stored(components(links_of(nodes)), "roots")
    classes = roots.join(nodes, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("first").alias("best"))
    joined = roots.join(classes, "root").select(F.col("node").alias("fp"), "best")
    named = nodes.join(joined, "fp", "left").select("fp", F.coalesce("best", "first").alias("best"))
    keeper = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    return fps.join(named, "fp").select("doc_id", "text_hash", "fp", F.col("best.doc_id").alias("component_id"), keeper.alias("keeper"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", find: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """``docs`` with one document of each class that ``find`` gives: the smallest id, nulls last. Of repeated
    rows (equal id and text) one stays. All columns are kept."""
    keep = stored(find(docs, text, key).where("keeper").select("doc_id", "text_hash"), "keepers")
    left = docs.withColumn("_hash", F.xxhash64(text)).alias("d")
    same = F.col(f"d.{key}").eqNullSafe(F.col("k.doc_id")) & (F.col("d._hash") == F.col("k.text_hash"))
    left = left.join(keep.distinct().alias("k"), same, "left_semi")
    if not keep.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        left = left.dropDuplicates([key, "_hash"])
    return left.drop("_hash")

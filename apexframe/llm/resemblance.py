"""Near-duplicates by SimHash and resemblance: candidates by equal bit bands, compared as bit planes, verified on whole sets.

Two documents are linked if the Jaccard similarity of their sets of five-word shingles is at least 0.8. Documents of
equal sets are one node. At that similarity two sets differ in up to 16.2 % of their SimHash bits, those of four and five
shingles in 18.75 % (DIFFER): too many for the few bands of a 64-bit SimHash, so a set's SimHash has 1,024 bits here, and
a bucket holds the nodes that agree in one of many bands of it. There are as many bands as it takes for a pair that
differs in so many bits to share none with a chance of MISS: 42 bands of 8 bits (55 for sets of up to five shingles) up to two million nodes, 108 (163) of 12 bits at 33 million.
With the nodes bands get wider, so that buckets stay small, and more.

In a bucket the first 64 bits lie as bit planes, and 64 nodes are compared with one at once by carry-save counters, within the
sizes that 0.8 allows. Lanes within 26 bits (see RADIUS), which a pair of similarity 0.8 is not with a chance of 1.3e-5
at most, are compared in 256 bits. A bucket gives a spanning list of near pairs, and the components of all buckets' lists
are the candidates. Only within them whole sets are compared, read again from their texts, exactly, as products of a 0/1 matrix; these give a
spanning list of links, never all pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apexframe.llm import ngrams, simhash
from apexframe.llm.common import handed, id_type, renamed, slices, stored, texts
from apexframe.llm.graph import components

SHINGLE = 5
LEAST = (4, 5)  # similarity of linked documents, as a fraction; so a set of fewer than four has no other linked to it
SEED = 42
WORDS = 16  # of 64 bits each: the SimHash of a set
BITS = 64 * WORDS
DIFFER = (3 / 16, 0.162)  # share of bits in which sets of similarity 0.8 differ, at most: of four and five shingles, of others
MISS = 1e-5  # chance that a pair which differs in so many bits shares no band
WIDTH = 8  # bits of a band, at least
BUCKET = 8192  # nodes of a bucket, on average, beyond which bands get wider
BLOCK = 4096  # candidates whose sets one task compares, and a fourth of the nodes of a bucket; beyond, pairs of blocks are compared
BLOCK_SHINGLES = 2 << 20  # shingles of candidates that one block holds
COLUMNS = 1024  # shingles compared at once
ROWS = 256  # documents compared with all others of a bucket at once
RADIUS = 26  # differing bits of the first 64, beyond which sets are not compared
NEAR = 4  # words of the SimHash that are compared in a bucket, and the differing bits allowed in them: as in DIFFER
NEAR_RADIUS = (80, 70)
NEAR_WORDS = 1 << 11  # words of 64 with a near lane whose lanes are taken apart at a time
HELD = 8 << 20  # bytes of sets from which on the candidates so far are compared
COMPARED = 1 << 14  # comparisons of a fingerprint with a word of 64 at a time
_draw = np.random.default_rng(SEED)
SALTS = _draw.integers(0, 1 << 63, WORDS - 1, np.uint64)
FACTORS = _draw.integers(0, 1 << 63, WORDS - 1, np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()  # a byte's bits as bytes


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of whole ``text``; a shorter text is its own. None without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, "<u8")
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-SHINGLE])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())], "<u8"))


def node_of(found: np.ndarray) -> int:
    """Hash of a set, as a long; zero for the empty one."""
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63) if len(found) else 0


def sketch(found: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingle hashes, in words; the hashes themselves vote for the first, mixed ones for the others."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(found), 255):  # so that votes for a bit fit in a byte
        own = found[at : at + 255, None]
        mixed = (own ^ SALTS) * FACTORS
        mixed = (mixed ^ mixed >> np.uint64(29)) * MIX
        votes = np.concatenate((own, mixed ^ mixed >> np.uint64(32)), axis=1)
        counts += SPREAD[votes.view(np.uint8)].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(counts * 2 > len(found), bitorder="little").view("<u8")


def fingerprint(found: np.ndarray) -> int:
    """The first 64 bits of the SimHash of a set of shingle hashes."""
    return int(sketch(found)[0])


def missed(width: int, number: int, share: float) -> float:
    """The chance that ``number`` bands of ``width`` bits all differ, where each bit differs with the chance ``share``."""
    if number * width <= BITS:
        return (1 - (1 - share) ** width) ** number
    total = 0.0  # bands overlap: by the number of differing bits
    for d in range(BITS + 1):
        log = math.lgamma(BITS + 1) - math.lgamma(d + 1) - math.lgamma(BITS - d + 1) + d * math.log(share) + (BITS - d) * math.log(1 - share)
        total += math.exp(log) * (1 - math.comb(BITS - d, width) / math.comb(BITS, width)) ** number
    return total


def bands_for(nodes: int) -> tuple[np.ndarray, int]:
    """(bands, width): the bits of the SimHash in each band, for so many nodes; and how many of the bands sets of more than five shingles need."""
    width = max(WIDTH, math.ceil(math.log2(max(1, nodes) / BUCKET)))
    all_of, most = (next(n for n in itertools.count(1) if missed(width, n, share) <= MISS) for share in DIFFER)
    draw = np.random.default_rng(SEED)
    bands = []
    while len(bands) < all_of:  # bands of one permutation share no bit
        bands += list(draw.permutation(BITS)[: BITS // width * width].reshape(-1, width))
    return np.array(bands[:all_of]), most


def band_keys(sketches: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """(sets, bands): each band's number and bits, as longs, of SimHashes (sets, words)."""
    bits = np.unpackbits(sketches.view(np.uint8), axis=1, bitorder="little")[:, bands.ravel()]
    keys = np.zeros((len(sketches) * len(bands), 8), np.uint8)
    packed = np.packbits(bits.reshape(-1, bands.shape[1]), axis=1, bitorder="little")
    keys[:, : packed.shape[1]] = packed
    return keys.view("<i8").reshape(len(sketches), -1) + (np.arange(len(bands)) << 32)


def sets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, text_hash, fp, bands)`` for each row; ``fp`` stands for the set, ``bands`` holds its size and the words
    of its SimHash, from which bands are taken. Null text: no words, no bands."""
    rows = renamed(docs, doc_id=key, text=text).withColumn("text_hash", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [shingles(x) for x in texts(batch)]
            bands = [np.concatenate(([len(x)], sketch(x).view(np.int64))) if len(x) else np.empty(0, np.int64) for x in found]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in bands]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bands)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array([node_of(x) for x in found], pa.int64()), lists], ["doc_id", "text_hash", "fp", "bands"])

    fields = [T.StructField("doc_id", id_type(docs, key)), T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return rows.mapInArrow(run, T.StructType(fields))


def bucket_links(nodes: np.ndarray, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of all pairs of similar sets in one bucket."""
    n = len(nodes)
    size = np.array([len(x) for x in found], np.int64)
    values, column = np.unique(np.concatenate(found), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    shared = np.bincount(column, minlength=len(values)) > 1  # others are in no intersection
    place = np.cumsum(shared) - 1
    row, column = row[shared[column]], place[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = int(shared.sum())
    label = np.arange(n)
    part = min(n, ROWS)
    for a in range(0, n, part):
        both = np.zeros((min(part, n - a), n), np.float32)  # whole numbers below 2^24
        for at in range(0, width, COLUMNS):
            lo, hi = np.searchsorted(column, (at, at + COLUMNS))
            has = np.zeros((n, min(COLUMNS, width - at)), np.float32)
            has[row[lo:hi], column[lo:hi] - at] = 1
            both += has[a : a + part] @ has.T
        common = both.astype(np.int64)
        i, j = np.nonzero(common * LEAST[1] >= (size[a : a + part, None] + size - common) * LEAST[0])
        keep = a + i < j
        if keep.any():
            label = simhash._joined(label, a + i[keep], j[keep])
    linked = np.flatnonzero(label != np.arange(n))
    return nodes[linked], nodes[label[linked]]


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is above ``radius``, the counters being its binary digits from the lowest on."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], simhash.ALL)
    for k in range(len(counters) - 1, -1, -1):
        if not radius >> k & 1:
            above |= equal & counters[k]
            equal &= ~counters[k]
        else:
            equal &= counters[k]
    return above


def within(planes: np.ndarray, masks: np.ndarray, q: np.ndarray, w: np.ndarray, lanes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """For queries ``q`` and words ``w`` of 64 fingerprints: indexes with a lane within ``radius``, and those lanes.

    Differing bits are added to carry-save counters of all lanes at once; a word is left once all its lanes are beyond.
    """
    left = np.arange(len(q))
    counters = [np.zeros(len(q), np.uint64) for _ in range(radius.bit_length())]
    far = ~lanes
    for b in range(64):
        x = planes[b][w] ^ masks[b][q]
        for k, count in enumerate(counters):
            x, counters[k] = count & x, count ^ x
        far = far | x
        if b >= radius and b % 16 == 15:
            far = far | _above(counters, radius)
            alive = far != simhash.ALL
            if not alive.all():
                left, q, w, far = left[alive], q[alive], w[alive], far[alive]
                counters = [x[alive] for x in counters]
                if not len(left):
                    break
    return left, ~far


def parts(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS, sizes: np.ndarray | None = None, sketches: np.ndarray | None = None) -> np.ndarray:
    """The smallest index reached from each fingerprint by steps within ``radius`` inside its run of equal keys.

    With ``sizes``, ascending in a run, only sets whose sizes allow a similarity of 0.8 are compared, and with
    ``sketches``, their first words (sets, NEAR), steps are within NEAR_RADIUS of these, too.
    """
    n = len(keys)
    run = np.cumsum(np.concatenate(([False], keys[1:] != keys[:-1])))
    place, last = run << 32, np.int64((1 << 32) - 1)
    if sizes is not None:
        place, last = place + sizes, sizes * LEAST[1] // LEAST[0]
    end = np.searchsorted(place, (run << 32) + last, "right")
    met = np.flatnonzero(end > np.arange(1, n + 1))
    planes = simhash.planes_of(fps)
    masks = np.where(np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T != 0, simhash.ALL, np.uint64(0))
    label = np.arange(n)
    first = (met + 1) // 64
    spans = (end[met] - 1) // 64 - first + 1
    edges = np.concatenate(([0], np.cumsum(spans)))
    at = 0
    while at < len(met):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + COMPARED, "right")) - 1)
        q = np.repeat(met[at:to], spans[at:to])
        w = np.arange(len(q)) - np.repeat(edges[at:to] - edges[at] - first[at:to], spans[at:to])
        lanes = simhash._below(np.clip(end[q] - 64 * w, 0, 64)) & ~simhash._below(np.clip(q + 1 - 64 * w, 0, 64))
        i, near = within(planes, masks, q, w, lanes, radius)
        for some in range(0, len(i), NEAR_WORDS):  # in a group of near copies all lanes are near
            r, lane = np.nonzero(np.unpackbits(near[some : some + NEAR_WORDS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            r = i[some + r]
            a, b = q[r], 64 * w[r] + lane
            if sketches is not None:
                differ = np.bitwise_count(sketches[a] ^ sketches[b]).sum(axis=1, dtype=np.int64)
                keep = differ <= np.where(sizes[a] == LEAST[0], *NEAR_RADIUS)
                a, b = a[keep], b[keep]
            label = simhash._joined(label, a, b)
        at = to
    return label


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and size -> spanning lists of near nodes; a bucket may go on in the next batch."""
    names = ["bucket", "fp", "size", *[f"s{i}" for i in range(NEAR)]]
    held = np.empty((len(names), 0), np.int64)

    def out(keys, nodes, sizes, *words):
        sketches = np.ascontiguousarray(np.stack(words, axis=1)).view(np.uint64)
        label = parts(keys, np.ascontiguousarray(sketches[:, 0]), RADIUS, sizes, sketches)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[label[linked]])], ["a", "b"])

    for batch in handed(batches):
        held = np.concatenate((held, np.stack([batch[x].to_numpy(zero_copy_only=False) for x in names])), axis=1)
        whole = int(np.searchsorted(held[0], held[0, -1])) if held.shape[1] else 0
        if whole:
            yield out(*held[:, :whole])
            held = held[:, whole:]
    if held.shape[1]:
        yield out(*held)


def run_links(keys: np.ndarray, nodes: np.ndarray, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the whole sets within each run of equal keys."""
    ends = np.flatnonzero(np.diff(keys)) + 1
    runs = zip(np.concatenate(([0], ends)).tolist(), np.append(ends, len(keys)).tolist())
    pairs = [bucket_links(nodes[a:b], found[a:b]) for a, b in runs if b - a > 1]
    none = np.empty(0, np.int64)
    return tuple(np.concatenate([none, *side]) for side in (zip(*pairs) if pairs else ((), ())))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and node; whole buckets are taken together up to ``HELD`` bytes, and a bucket may go on in the
    next batch. A set that comes again, from a repeated row, is left out."""
    keys, nodes, found, held = [], [], [], 0

    def out():
        a, b = run_links(np.array(keys, np.int64), np.array(nodes, np.int64), found)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in handed(batches):
        for key, node, data in zip(batch["bucket"].to_pylist(), batch["fp"].to_pylist(), batch["data"]):
            if held >= HELD and key != keys[-1]:
                yield out()
                keys, nodes, found, held = [], [], [], 0
            if keys and key == keys[-1] and node == nodes[-1]:
                continue
            keys.append(key)
            nodes.append(node)
            found.append(np.frombuffer(data.as_py(), "<u8"))
            held += found[-1].nbytes
    if keys:
        yield out()


def split(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """``rows(bucket, fp, ...)`` with the buckets of ``blocks(bucket, blocks)`` split into all pairs of so many blocks."""
    hot = stored(blocks.where("blocks > 1"), "blocks")
    if hot.isEmpty():
        return rows
    others = [x for x in rows.columns if x != "bucket"]
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    mine = F.pmod(F.xxhash64("fp"), blocks)
    pair = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    each = rows.join(hot, "bucket", "left").select("bucket", "blocks", mine.alias("mine"), pair.alias("other"), *others)
    bucket = F.when(F.col("blocks").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")))
    return each.select(bucket.alias("bucket"), *others)


def candidates(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``nodes(fp, bands)`` -> ``(node, root)``: the components of nodes that are near in a bucket of an equal bit band."""
    nodes = nodes.where(F.size("bands") > 0).where(F.col("bands")[0] >= LEAST[0]).select("fp", "bands")
    bands, most = bands_for(nodes.count())

    def of(batch):
        """Sizes and words of each node, its keys, and which of them it needs."""
        words = batch["bands"].flatten().to_numpy(zero_copy_only=False).reshape(-1, WORDS + 1)
        needed = np.arange(len(bands)) < np.where(words[:, :1] <= LEAST[1], len(bands), most)
        return words, band_keys(np.ascontiguousarray(words[:, 1:]), bands), needed

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in handed(batches):
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                words, keys, needed = of(batch)
                node = np.nonzero(needed)[0]
                each = [x[node] for x in (batch["fp"].to_numpy(zero_copy_only=False), *words.T[: NEAR + 1])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[needed], *each)], ["bucket", "fp", "size", *[f"s{i}" for i in range(NEAR)]])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in handed(batches):
            if batch.num_rows:
                _, keys, needed = of(batch)
                keys, n = np.unique(keys[needed], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["bucket", "n"])

    rows = nodes.mapInArrow(dealt, "bucket long, fp long, size long, " + ", ".join(f"s{i} long" for i in range(NEAR)))
    blocks = nodes.mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.ceil(F.sum("n") / (4 * block)).cast("long").alias("blocks"))
    near = split(rows, blocks).repartition("bucket").sortWithinPartitions("bucket", "size").mapInArrow(_near, "a long, b long")
    return components(near)


def links(docs: DataFrame, nodes: DataFrame, text: str = "text", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """``nodes(fp, first, bands)`` of ``docs`` -> spanning links ``(a, b)`` of all similar pairs."""
    found = candidates(nodes, block).join(nodes, F.col("node") == F.col("fp"))
    members = stored(found.select(F.col("root").alias("bucket"), "fp", F.col("bands")[0].alias("size"), "first"), "candidates")
    parts_of = F.greatest(F.count(F.lit(1)) / block, F.sum("size") / BLOCK_SHINGLES)
    rows = split(members.select("bucket", "fp"), members.groupBy("bucket").agg(F.ceil(parts_of).cast("long").alias("blocks")))
    wanted = members.select(F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"))
    marks = docs.sparkSession.sparkContext.broadcast(ngrams.marked(wanted))
    whole = renamed(docs, doc_id=key, text=text).withColumn("text_hash", F.xxhash64("text"))
    whole = whole.select(ngrams._mark("doc_id", "text_hash").alias("at"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sets of at least the wanted rows; those of rows marked by chance are left over in the join."""
        for batch in handed(batches):
            at = batch["at"].to_numpy()
            batch = batch.filter(pa.array((marks.value[at >> 3] >> (at & 7) & 1).astype(bool)))
            for part in slices(iter([batch]), "text"):
                found = {node_of(x): x.tobytes() for x in map(shingles, texts(part))}
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.binary())], ["fp", "data"])

    met = rows.join(whole.mapInArrow(run, "fp long, data binary"), "fp").select("bucket", "fp", "data")
    return met.repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, text_hash, fp, component_id, keeper)`` for each row of ``docs``, as ``simhash.near_duplicates``
    gives them, with links of similarity 0.8 or more; documents without words are one class."""
    found = stored(sets(docs, text, key), "shingle_sets")
    return simhash.classified(found, lambda nodes: links(docs, nodes, text, key))

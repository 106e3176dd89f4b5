"""Set join of texts by their word n-grams: Jaccard similarity of 0.8 or more, by prefix trees.

Texts of equal sets are one node. N-grams have one order over all texts, from rare to frequent, by a table of
counters over all texts (of fixed size, so n-grams that share a counter count together; ties go by hash). It only
decides how much work there is: any order gives the same links. Of two linked sets, the first n - ceil(0.8 n) + 1
n-grams of each share one, so a node is sent where these are. All nodes that share such an n-gram go to the least
node among them, their leader; a group of near copies so meets at a few leaders and not at each of its n-grams.

Before whole sets move, leaders see a bit image of each: the parity of its n-grams at each of about 2 n places. Images differ
in no more places than the sets in n-grams, so a node whose image is too far from all others at a leader is not sent there.

At a leader the sets, turned from frequent to rare, lie in a radix trie. A set walks it once: the overlap with a path
is counted once for all sets below it, and a subtree is left where its sizes or the n-grams remaining on either side
cannot reach the overlap that 0.8 needs, or where all of its sets are linked to the walker already. A leader gives
a spanning list of links, never all pairs.

A leader with more than a block of sets first joins blocks. If its sets are of one class then, it is done; else pairs
of blocks are joined, sets of one class counting as linked.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apexframe.llm.common import id_type, renamed, slices, stored, texts
from apexframe.llm.graph import components

SHINGLE = 5
LEAST = (4, 5)  # similarity of linked sets, as a fraction
SEED = 42
COUNTERS = 24  # bits: 16.8 million counters, a byte each where they are sent to all tasks
CHUNK = 1 << 14  # counters of one row
BLOCK = 4096  # sets that are joined in one task, at most ...
BLOCK_GRAMS = 1 << 20  # ... and about so many n-grams
REMEMBERED = 200_000  # words whose hashes a worker remembers before it starts anew
MARKS = 27  # bits of the place of a row's mark
LEAST_HOT = 500  # an n-gram counted less often than this is never handled as frequent
SHARE = 2000  # a node of more than one in so many rows is sent to all tasks: fewer than so many nodes
ODD = [np.uint64(x | 1) for x in np.random.default_rng(SEED).integers(0, 1 << 63, SHINGLE, np.uint64).tolist()]


class _Words(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found


_words = _Words()


def grams(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of whole ``text``, A-Z lowered; of a shorter text, that of all its words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED + len(words))], np.uint64)
    each = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    out = each[:n] * ODD[0]
    for k in range(1, size):
        out ^= out >> np.uint64(29)
        out = (out + each[k : k + n]) * ODD[k % SHINGLE]
    return np.unique(out ^ (out >> np.uint64(32)))


def set_hash(found: np.ndarray) -> int:
    """Hash of a set, as a long; zero for the empty one."""
    return (xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63) or 1) if len(found) else 0


def described(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, text_hash, fp, n)`` for each row, ``fp`` standing for its set of ``n`` n-grams, and the counters of all
    n-grams ``(chunk, counts)`` as each task found them."""
    rows = renamed(docs, doc_id=key, text=text).withColumn("text_hash", F.xxhash64("text"))
    kind = id_type(docs, key)
    names = ["doc_id", "text_hash", "fp", "n", "chunk", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTERS, np.uint32)
        blank = None
        for batch in batches:
            blank = batch["doc_id"].slice(0, 0)
            for part in slices(iter([batch]), "text"):
                found = [grams(x, size) for x in texts(part)]
                at = (np.concatenate(found) >> np.uint64(64 - COUNTERS)).astype(np.int64)
                places, times = np.unique(at, return_counts=True)
                counts[places] += times.astype(np.uint32)
                columns = [pa.array([set_hash(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64())]
                none = [pa.nulls(part.num_rows, pa.int32()), pa.nulls(part.num_rows, pa.binary())]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["text_hash"], *columns, *none], names)
        if blank is None:
            return
        for chunk, held in enumerate(counts.reshape(-1, CHUNK)):
            if held.any():
                empty = [pa.nulls(1, blank.type), *[pa.nulls(1, pa.int64()) for _ in range(3)]]
                small = held.astype(np.min_scalar_type(held.max()))
                yield pa.RecordBatch.from_arrays([*empty, pa.array([chunk], pa.int32()), pa.array([zlib.compress(small, 1)], pa.binary())], names)

    fields = [T.StructField("doc_id", kind), T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("n", T.LongType())]
    fields += [T.StructField("chunk", T.IntegerType()), T.StructField("counts", T.BinaryType())]
    both = stored(rows.mapInArrow(run, T.StructType(fields)), "gram_sets")
    return both.where("chunk IS NULL").drop("chunk", "counts"), both.where("chunk IS NOT NULL").select("chunk", "counts")


def rarity(counters: DataFrame) -> np.ndarray:
    """A class from 0 (rare) to 255 for each counter, eight to a doubling. The sums are made by chunk in tasks; what
    comes to the driver is one byte a counter, 16.8 MB whatever the input."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(chunk: int, total: np.ndarray) -> pa.RecordBatch:
            classes = np.minimum(np.log2(total + 1.0) * 8, 255).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([classes.tobytes()], pa.binary())], ["chunk", "classes"])

        at, total = None, None
        for batch in batches:
            for chunk, counts in zip(batch["chunk"].to_pylist(), batch["counts"]):
                if chunk != at:
                    if at is not None:
                        yield out(at, total)
                    at, total = chunk, np.zeros(CHUNK, np.int64)
                held = zlib.decompress(counts.as_buffer())
                total += np.frombuffer(held, f"u{len(held) // CHUNK}")
        if at is not None:
            yield out(at, total)

    classes = np.zeros(1 << COUNTERS, np.uint8)
    for row in counters.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(summed, "chunk int, classes binary").toLocalIterator():
        classes[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.classes, np.uint8)
    return classes


def ordered(found: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A sorted set from rare to frequent n-grams."""
    return found[np.argsort(classes[(found >> np.uint64(64 - COUNTERS)).astype(np.int64)], kind="stable")]


def prefix(n: int) -> int:
    """How many first n-grams of a set of ``n`` are enough to meet every set linked to it."""
    return n - -(-n * LEAST[0] // LEAST[1]) + 1 if n else 0


def image(found: np.ndarray) -> np.ndarray:
    """The parity of a set's n-grams at each place, as words of 64 places; places are a power of two, at least 2 n."""
    places = 1 << max(6, (2 * len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def plausible(sizes: np.ndarray, images: list[np.ndarray]) -> np.ndarray:
    """Which sets may be similar to another one, by their sizes and images; no set that is gets lost."""
    out = np.zeros(len(sizes), bool)
    width = np.array([len(x) for x in images])
    for w in np.unique(width):
        own, wider = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        both = np.concatenate((own, wider))
        folded = [images[k] for k in own] + [images[k][:w] ^ images[k][w:] for k in wider]
        grid = np.stack(folded)
        step = max(1, (1 << 21) // grid.size)
        for a in range(0, len(own), step):
            some = slice(a, min(a + step, len(own)))
            apart = np.bitwise_count(grid[some, None, :] ^ grid[None, :, :]).sum(axis=2, dtype=np.int64)
            x, y = sizes[own[some]][:, None], sizes[both][None, :]
            near = (apart * (2 * LEAST[1] - 1) <= x + y) & (np.minimum(x, y) * LEAST[1] >= np.maximum(x, y) * LEAST[0])
            near[np.arange(near.shape[0]), np.arange(a, a + near.shape[0])] = False
            out[own[some]] |= near.any(axis=1)
            out[both] |= near.any(axis=0)
    return out


def prefixes(docs: DataFrame, classes, frequent: int, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``(fp, grams, hot, image)``: the prefix of each set, n-grams of a class above ``frequent`` apart; a task gives a set
    once as long as it remembers it."""

    def listed(lists: list[np.ndarray]) -> pa.Array:
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64))).astype(np.int32)
        values = np.concatenate(lists).view(np.int64) if lists else np.empty(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in slices(batches, "text"):
            fps, rare, hot, images = [], [], [], []
            for x in texts(batch):
                found = grams(x, size)
                fp = set_hash(found)
                if fp and fp not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known.add(fp)
                    first = ordered(found, classes.value)[: prefix(len(found))]
                    cut = int(np.searchsorted(classes.value[(first >> np.uint64(64 - COUNTERS)).astype(np.int64)], frequent, "right"))
                    fps.append(fp)
                    rare.append(first[:cut])
                    hot.append(first[cut:])
                    images.append(image(found).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), listed(rare), listed(hot), pa.array(images, pa.binary())], ["fp", "grams", "hot", "image"])

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "fp long, grams array<long>, hot array<long>, image binary")


def leaders(prefixed: DataFrame) -> DataFrame:
    """``(leader, fp)``: the nodes that meet at each leader, two or more.

    The nodes of an n-gram pass one after the other, the least first. The few n-grams that a large share of the texts
    may hold are summed up where they are read, and joined back, so no task gets all of their nodes.
    """
    each = prefixed.select("fp", F.explode("grams").alias("gram"))
    led = each.withColumn("leader", F.first("fp").over(Window.partitionBy("gram").orderBy("fp").rowsBetween(Window.unboundedPreceding, 0)))
    hot = prefixed.select("fp", F.explode("hot").alias("gram"))
    least = hot.groupBy("gram").agg(F.min("fp").alias("leader"))
    others = led.select("leader", "fp").unionByName(hot.join(least, "gram").select("leader", "fp")).where("leader <> fp").distinct()
    others = stored(others, "led")
    return others.unionByName(others.select("leader", F.col("leader").alias("fp")).distinct())


def dealt(members: DataFrame, nodes: DataFrame, block: int = BLOCK, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """``(leader, fp, n, blocks)``: leaders of equal members are taken once; ``blocks`` is how many one is cut into. Nodes
    that can have no similar one at a leader of one block are left out there."""
    sized = stored(members.join(nodes, "fp"), "members")
    each = sized.groupBy("leader").agg(F.count(F.lit(1)).alias("held"), F.sum("n").alias("grams"), F.bit_xor(F.xxhash64("fp")).alias("who"))
    once = each.groupBy("held", "who").agg(F.min("leader").alias("leader"), F.max("grams").alias("grams"))
    blocks = F.greatest(F.ceil(F.col("held") / block), F.ceil(F.col("grams") / block_grams)).cast("long")
    rows = sized.join(once.select("leader", blocks.alias("blocks")), "leader")
    single = rows.where("blocks = 1").select("leader", "fp", "n", "image").repartition("leader").sortWithinPartitions("leader")
    kept = single.mapInArrow(_plausible, "leader long, fp long, n long").withColumn("blocks", F.lit(1).cast("long"))
    return stored(kept.unionByName(rows.where("blocks > 1").select("leader", "fp", "n", "blocks")), "dealt")


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by leader; a leader may go on in the next batch."""

    def out(leader: int, held: list) -> pa.RecordBatch:
        fps, sizes, images = zip(*held)
        keep = plausible(np.array(sizes, np.int64), [np.frombuffer(x, np.uint64) for x in images])
        fps, sizes = np.array(fps, np.int64)[keep], np.array(sizes, np.int64)[keep]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), leader, np.int64)), pa.array(fps), pa.array(sizes)], ["leader", "fp", "n"])

    leader, held = None, []
    for batch in batches:
        for key, *row in zip(*[batch[c].to_pylist() for c in ("leader", "fp", "n", "image")]):
            if key != leader:
                if held:
                    yield out(leader, held)
                leader, held = key, []
            held.append(row)
    if held:
        yield out(leader, held)


def marked(wanted: DataFrame) -> np.ndarray:
    """A bit for the hash of each row ``(doc_id, text_hash)``; 16 MB whatever the input."""
    at = _mark("doc_id", "text_hash") + 1
    bits = wanted.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
    found = np.zeros(1 << (MARKS - 3), np.uint8)
    for row in bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        data = np.frombuffer(row.bits, np.uint8)
        found[(row.bucket - 1) * len(data) : row.bucket * len(data)] = data
    return found


def _mark(*columns: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - MARKS)


def sets(docs: DataFrame, marks, classes, text: str = "text", key: str = "doc_id", size: int = SHINGLE) -> DataFrame:
    """``(fp, data)``: the sets of at least the marked rows, read again from their texts, frequent n-grams first. A row
    whose hash is marked by chance is left over in the join; a task gives a set once as long as it remembers it."""
    rows = renamed(docs, doc_id=key, text=text).withColumn("text_hash", F.xxhash64("text"))
    rows = rows.select(_mark("doc_id", "text_hash").alias("at"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            at = batch["at"].to_numpy()
            batch = batch.filter(pa.array((marks.value[at >> 3] >> (at & 7) & 1).astype(bool)))
            for part in slices(iter([batch]), "text"):
                fps, data = [], []
                for x in texts(part):
                    found = grams(x, size)
                    fp = set_hash(found)
                    if fp and fp not in known:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known.add(fp)
                        fps.append(fp)
                        data.append(ordered(found, classes.value)[::-1].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(data, pa.binary())], ["fp", "data"])

    return rows.mapInArrow(run, "fp long, data binary")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common start of two sequences."""
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    at = int(differ.argmax()) if n else 0
    return at if n and differ[at] else n


class Trie:
    """A radix trie over sets, given as ascending arrays of ranks and sorted as sequences.

    A node holds a range of sets and an edge, the ranks that its path has beyond its parent's; a set is a leaf.
    Nodes are numbered level by level, so the children of one lie together.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        count = len(sets)
        self.flat = np.concatenate(sets)
        self.sizes = np.array([len(x) for x in sets], np.int64)
        base = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        shared = [0, *map(_common, sets, sets[1:]), 0]
        # leaves are 0 .. count - 1, the root is count, then the inner nodes as they open
        lo, hi, end, parent = [*range(count), 0], [*range(1, count + 1), count], [*self.sizes.tolist(), 0], [0] * count + [-1]
        stack = [count]
        for i in range(1, count + 1):
            parent[i - 1] = stack[-1]
            first, pending = i - 1, -1
            while end[stack[-1]] > shared[i]:
                node = stack.pop()
                hi[node], first = i, lo[node]
                parent[node], pending = stack[-1], node
            if end[stack[-1]] < shared[i]:
                new = len(lo)
                lo.append(first), hi.append(count), end.append(shared[i]), parent.append(stack[-1])
                parent[pending if pending >= 0 else i - 1] = new
                stack.append(new)
        level = np.zeros(len(lo), np.int64)
        up = np.array(parent)
        step = up.copy()
        while (step >= 0).any():
            level += step >= 0
            step = np.where(step >= 0, up[step], -1)
        by = np.lexsort((lo, level))
        name = np.empty(len(by), np.int64)
        name[by] = np.arange(len(by))
        self.lo, self.hi, self.end = (np.array(x)[by] for x in (lo, hi, end))
        self.parent = np.where(up[by] >= 0, name[up[by]], -1)
        depth = np.where(self.parent >= 0, self.end[self.parent], 0)
        self.edge, self.length = base[self.lo] + depth, self.end - depth
        self.below = np.bincount(self.parent[1:], minlength=len(by))
        self.child = np.concatenate(([1], 1 + np.cumsum(self.below)[:-1]))
        self.least, self.most = np.empty(len(by), np.int64), np.zeros(len(by), np.int64)
        self.least[:] = self.flat.size + 1
        leaf = name[:count]
        self.least[leaf] = self.most[leaf] = self.sizes
        for k in range(int(level.max()), 0, -1):
            of = np.flatnonzero(level[by] == k)
            np.minimum.at(self.least, self.parent[of], self.least[of])
            np.maximum.at(self.most, self.parent[of], self.most[of])
        self.last = np.where(self.length > 0, self.flat[np.minimum(self.edge + self.length - 1, self.flat.size - 1)], -1)

    def linked(self, i: int, has: np.ndarray, passed: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Sets after ``i`` that are similar to it, not looked for where all are of its label. ``has`` marks the set's
        ranks, ``passed`` how many of them are at or below each rank."""
        (a, b), size = LEAST, int(self.sizes[i])
        mine = np.concatenate(([0], np.cumsum(label == label[i])))
        nodes, over, at = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        found = [np.empty(0, np.int64)]
        while len(nodes):
            # down to the children of the nodes, with the overlap and the passed ranks of their paths
            n = self.below[nodes]
            nodes, over, at = np.repeat(self.child[nodes] - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(over, n), np.repeat(at, n)
            lo, hi, least, most = self.lo[nodes], self.hi[nodes], self.least[nodes], self.most[nodes]
            lo = np.maximum(lo, i + 1)
            keep = (hi > lo) & (most * b >= size * a) & (least * a <= size * b)
            keep[keep] = mine[hi[keep]] - mine[lo[keep]] < hi[keep] - lo[keep]
            nodes, over, at, least, most = (x[keep] for x in (nodes, over, at, least, most))
            if not len(nodes):
                break
            length = self.length[nodes]
            ends = np.cumsum(length)
            ranks = self.flat[np.repeat(self.edge[nodes] - ends + length, length) + np.arange(ends[-1])]
            sums = np.concatenate(([0], np.cumsum(has[ranks])))
            over = over + sums[ends] - sums[ends - length]
            at = np.where(length > 0, passed[self.last[nodes]], at)
            need = -(-a * (size + np.maximum(least, -(-size * a // b))) // (a + b))
            keep = over + np.minimum(most - self.end[nodes], size - at) >= need
            leaf = self.below[nodes] == 0
            found.append(self.lo[nodes[keep & leaf]])  # nothing remains of a leaf: its overlap is whole
            keep &= ~leaf
            nodes, over, at = nodes[keep], over[keep], at[keep]
        return np.concatenate(found)


def joined(fps: np.ndarray, found: list[np.ndarray], classes: np.ndarray, cls: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links ``(a, b)`` between similar sets, each from frequent to rare; those of one class ``cls`` count as linked."""
    values, place = np.unique(np.concatenate(found), return_inverse=True)
    by = np.lexsort((values, classes[(values >> np.uint64(64 - COUNTERS)).astype(np.int64)]))[::-1]
    rank = np.empty(len(values), np.int64)
    rank[by] = np.arange(len(values))
    sets = np.split(rank[place], np.cumsum([len(x) for x in found])[:-1])
    order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u4").tobytes())
    trie = Trie([sets[k] for k in order])
    label = np.arange(len(sets))
    if cls is not None:
        label = np.unique(cls[order], return_inverse=True)[1]
    a, b = [], []
    for i in range(len(order) - 1):
        if (label[i + 1 :] == label[i]).all():
            continue
        has = np.zeros(len(values), np.int64)
        has[sets[order[i]]] = 1
        for j in trie.linked(i, has, np.cumsum(has), label).tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                a.append(order[i])
                b.append(order[j])
    return fps[a], fps[b]


def _links(classes):
    """Links of rows ``(bucket, fp, cls, data)`` that come sorted by bucket, a bucket perhaps over several batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def out() -> pa.RecordBatch:
            fps, cls, data = zip(*held)
            a, b = joined(np.array(fps, np.int64), [np.frombuffer(d, np.uint64) for d in data], classes.value, np.array(cls, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for key, *row in zip(batch["bucket"].to_pylist(), batch["fp"].to_pylist(), batch["cls"].to_pylist(), batch["data"].to_pylist()):
                if key != bucket:
                    if len(held) > 1:
                        yield out()
                    bucket, held = key, []
                held.append(row)
        if len(held) > 1:
            yield out()

    return run


def links(members: DataFrame, read: DataFrame, classes) -> DataFrame:
    """``members(leader, fp, n, blocks)`` and ``read(fp, data)`` -> links ``(a, b)`` whose components are those of all similar
    pairs. A set that comes twice does no harm."""
    mine = F.pmod(F.xxhash64("fp", F.lit(SEED)), F.col("blocks"))

    def walked(rows: DataFrame) -> DataFrame:
        met = rows.join(read, "fp").select("bucket", "fp", "cls", "data")
        return stored(met.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_links(classes), "a long, b long"), "links")

    first = walked(members.select("fp", F.when(F.col("blocks") == 1, F.col("leader")).otherwise(F.xxhash64("leader", mine)).alias("bucket"), F.col("fp").alias("cls")))
    hot = members.where("blocks > 1")
    if hot.isEmpty():
        return first
    roots = stored(components(first), "roots")
    classed = hot.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("cls", F.coalesce("root", "fp"))
    mixed = classed.groupBy("leader").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high").select("leader")
    pairs = classed.join(mixed, "leader").select("leader", "fp", "cls", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    bucket = F.xxhash64("leader", F.least("mine", "other"), F.greatest("mine", "other"))
    return first.unionByName(walked(pairs.where("mine <> other").select("fp", bucket.alias("bucket"), "cls")))


def similar_sets(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, block: int = BLOCK, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, n_links)`` for each row of ``docs``: the size of its set of distinct n-grams, the
    smallest id reachable over links, and how many links join its set in the spanning list given.

    Texts of equal sets are linked. A text of fewer words than an n-gram has one, all of its words; null texts and
    those without words have none, link with nothing and are their own component. Null ids come after all others, so a
    component_id is null only where no row of the component has an id. Repeated rows each get a row. An empty
    table gives none.
    """
    spark = docs.sparkSession
    rows, counters = described(docs, text, key, size)
    classes = spark.sparkContext.broadcast(rarity(counters))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = stored(rows.where("n > 0").groupBy("fp").agg(F.min(first).alias("first"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")), "nodes")
    total = nodes.agg(F.sum("copies")).first()[0] or 0
    frequent = int(np.log2(max(total / SHARE, LEAST_HOT) + 1) * 8)
    prefixed = stored(prefixes(docs, classes, frequent, text, size), "prefixes")
    images = prefixed.select("fp", "image").dropDuplicates(["fp"])
    members = dealt(leaders(prefixed), nodes.select("fp", "n").join(images, "fp"), block, block_grams)
    wanted = members.select("fp").distinct().join(nodes, "fp").select("fp", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"))
    marks = spark.sparkContext.broadcast(marked(wanted))
    edges = stored(links(members, sets(docs, marks, classes, text, key, size), classes), "links")
    roots = stored(components(edges), "roots")
    best = roots.join(nodes, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("first").alias("best"))
    degree = edges.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    named = nodes.join(roots.join(best, "root").select(F.col("node").alias("fp"), "best"), "fp", "left").join(degree, "fp", "left")
    named = stored(named.select("fp", "copies", F.coalesce("best", "first").alias("best"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "named")
    return attached(rows, named).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def attached(rows: DataFrame, named: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``named(fp, copies, ...)``. Nodes with more than one in ``SHARE`` of all copies, so
    fewer than ``SHARE`` nodes, are sent to all tasks and their rows stay where they are; the others meet by ``fp``."""
    total = named.agg(F.sum("copies")).first()[0] or 0
    many = F.broadcast(named.where(F.col("copies") > total / SHARE))
    apart = rows.join(F.broadcast(named.where(F.col("copies") > total / SHARE).select("fp")), "fp", "left_anti")
    return rows.join(many, "fp").unionByName(apart.join(named, "fp", "left"))

"""LM scoring: logistic mixing of hashed-context bit predictors, over UTF-8 bytes.

A byte is eight binary decisions. For each decision five predictors look up how often a one followed their
context: the last 1, 2, 3 and 5 bytes, and the word so far (its last nine bytes), each with the decision's partial byte,
hashed into tables of fixed size. Their log-odds are combined by weights that a gate chooses (how well the
word is known, how many of the other contexts have been seen, and the partial byte), and the result is
refined by an adaptive map from partial byte and quantised odds to the frequency observed there. Bits per
byte follow from the summed code lengths.

Training reads the texts once. Counts are exact sums over all tasks. Weights and adaptive map are learned
online in each task, step by step on its own counts so far, a prediction never using the occurrence that it
predicts; the tasks' weights are averaged by bytes seen, their maps added. All is frozen for scoring, so
a score depends neither on the order of documents nor on their partition. A symbol with its contexts recurs
often: equal ones are worked out once per block.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apexframe.llm.common import id_type, renamed, slices, stored, texts

ORDERS = (1, 2, 3, 5)  # bytes of context
BACK = 5  # bytes a key holds in full, FAR with its hash
FAR = 9
PREDICTORS = len(ORDERS) + 1
TABLE_BITS = (16, 20, 21, 22, 23)  # slots of each predictor's table
OFFSETS = np.concatenate(([0], np.cumsum([1 << b for b in TABLE_BITS])))  # the model's fixed size: two counts for each slot
BLOCK_BITS = 16
BUCKETS = 33  # of the adaptive map
SLICE = 4 << 20  # bytes of text worked on at once
BLOCK = 1_500_000  # distinct symbols gathered before they are counted and learned from
STEP = 16_384  # distinct symbols of one online step
END_BYTE = b"\xff"  # closes a text; no UTF-8 text holds it
PAD = bytes(FAR)
WORD_LEVELS = 5
LEVEL_OF = np.log2(np.arange(16) + 1).astype(np.int64)  # by times the word so far was met: 0, 1, 3, 7, 15 and more
GATES = WORD_LEVELS * (len(ORDERS) + 1) * 256
HOT_WORDS = 300_000  # words more frequent than one in so many are at most so many: their counts go to all tasks
SALT = np.uint64(0x9E3779B97F4A7C15)
NODE_SALT = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Model:
    """counts (slots, 2) of zeros and ones; weights (GATES, PREDICTORS); refine (256 * BUCKETS, 2) counts."""

    counts: np.ndarray
    weights: np.ndarray
    refine: np.ndarray


def empty_refine() -> np.ndarray:
    return np.zeros((256 * BUCKETS, 2))


# --- symbols -----------------------------------------------------------------


def symbols(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all symbols of ``batch``, the end of each text included, and where each text starts.

    From the top a key holds the symbol, the five bytes before it, the nearest first, and 16 bits of hash of the
    sixth to ninth as far as they are in the same word. Lower-cases A-Z. Texts do not see each other.
    """
    data = np.frombuffer(b"".join([part for x in batch for part in (PAD, x.lower(), END_BYTE)]), np.uint8)
    sizes = np.fromiter(map(len, batch), np.int64, len(batch)) + 1
    own = np.ones(len(data), bool)
    starts = np.concatenate(([0], np.cumsum(sizes + len(PAD))[:-1]))
    own[(starts[:, None] + np.arange(len(PAD))).ravel()] = False
    letter = data > 32
    inside = np.zeros(len(data), bool)  # the k bytes before are of one word
    inside[1:] = letter[:-1]
    for k in range(2, BACK + 1):
        inside[k:] &= letter[:-k]
    far = np.zeros(len(data), np.uint16)
    for k, factor in zip(range(BACK + 1, FAR + 1), (40503, 27961, 52391, 36277)):
        inside[k:] &= letter[:-k]
        far[k:] += (data[:-k] * np.uint16(factor)) * inside[k:]
    raw = np.zeros((len(data), 8), np.uint8)
    raw[:, :2] = far.view(np.uint8).reshape(-1, 2)
    for k in range(BACK + 1):
        raw[k:, 7 - k] = data[: len(data) - k]
    return raw.view("<u8")[own, 0], np.concatenate(([0], np.cumsum(sizes)))


def distinct(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    if times is not None:
        order = np.argsort(keys, kind="stable")
        return runs(keys[order], times[order])
    return runs(np.sort(keys))


def runs(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``distinct`` of sorted keys."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys))) if times is None else np.add.reduceat(times, first)


def gathered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of ``keys`` in which equal ones mostly are neighbours, and where runs of equal ones begin in it. What is sorted
    is a hash with the place below it, in one word each; keys of one hash may lie among each other."""
    low = np.uint64(max(1, len(keys)).bit_length())
    mixed_keys = keys ^ (keys >> np.uint64(32))
    mixed_keys *= SALT
    mixed_keys ^= mixed_keys >> np.uint64(29)
    mixed_keys *= NODE_SALT
    mixed_keys >>= low
    mixed_keys <<= low
    mixed_keys |= np.arange(len(keys), dtype=np.uint64)
    mixed_keys.sort()
    order = (mixed_keys & ((np.uint64(1) << low) - np.uint64(1))).view(np.int64)
    lying = keys[order]
    return order, np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), lying[1:] != lying[:-1])))


def word_context(keys: np.ndarray) -> np.ndarray:
    """The bytes of the word so far, the nearest first, zero beyond it, and the hash of those further off."""
    out = np.zeros(len(keys), np.uint64)
    inside = np.ones(len(keys), bool)
    for k in range(1, BACK + 1):
        byte = (keys >> np.uint64(56 - 8 * k)) & np.uint64(255)
        inside &= byte > 32
        out |= np.where(inside, byte, np.uint64(0)) << np.uint64(8 * k - 8)
    return out | ((keys & np.uint64(0xFFFF)) << np.uint64(40)) * inside


class Contexts:
    """For sorted distinct keys: per predictor the distinct (context, symbol), and where each key finds its own."""

    def __init__(self, keys: np.ndarray):
        self.symbol = (keys >> np.uint64(56)).astype(np.int64)
        self.groups, self.places = [], {}
        for k in ORDERS:
            self._add(keys >> np.uint64(56 - 8 * k), np.uint64((1 << (8 * k)) - 1))
        word = word_context(keys)  # in sorted keys equal ones, with equal symbols, are neighbours too
        self._add(word | (keys >> np.uint64(56) << np.uint64(56)), np.uint64((1 << 56) - 1))

    def _add(self, value: np.ndarray, context: np.uint64) -> None:
        first = np.concatenate(([True], value[1:] != value[:-1]))
        at = np.flatnonzero(first)
        own = None if len(at) == len(value) else np.cumsum(first) - 1
        self.groups.append((at, own, ((value[at] & context) + np.uint64(1)) * SALT, self.symbol[at]))

    def slots(self, k: int, bit: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots of predictor k for the decision on ``bit``, and the bits taken. The four decisions of half a symbol lie
        in 16 neighbouring slots, so memory is fetched once for them; the hash says in which order."""
        _, _, context, symbol = self.groups[k]
        place = self.places.get((k, bit >> 2))
        if place is None:
            before = (symbol >> 4) | 16 if bit < 4 else np.ones(1, np.int64)
            mix = (context ^ (context >> np.uint64(31))) + before.view(np.uint64) * NODE_SALT
            mix ^= mix >> np.uint64(29)
            place = self.places[k, bit >> 2] = ((mix * SALT) >> np.uint64(64 - TABLE_BITS[k])).view(np.int64) + OFFSETS[k]
        ahead = 8 >> (bit & 3)
        return place ^ ((symbol >> (bit + 1)) & (ahead - 1) | ahead), (symbol >> bit) & 1

    def count_into(self, counts: np.ndarray, times: np.ndarray) -> None:
        flat = counts.reshape(-1)
        for k, (at, _, _, _) in enumerate(self.groups):
            n = np.add.reduceat(times, at).astype(counts.dtype)
            for bit in range(8):
                slot, taken = self.slots(k, bit)
                np.add.at(flat, 2 * slot + taken, n)

    def looked_up(self, counts: np.ndarray, bit: int, leave_out: bool) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds (PREDICTORS, n) of a one, and the gate's upper part. ``leave_out``: without one own occurrence, which
        must have been counted."""
        rows, seen, level = [], 0, None
        pairs = counts.reshape(-1).view(f"<u{2 * counts.itemsize}")  # a slot's two counts in one access
        single = np.eye(2, dtype=counts.dtype).reshape(-1).view(pairs.dtype)
        for k, (_, own, _, _) in enumerate(self.groups):
            slot, taken = self.slots(k, bit)
            pair = pairs[slot]
            if leave_out:
                pair -= single[taken]
            pair = pair.view(counts.dtype).astype(np.float32)
            zero, one = pair[::2], pair[1::2]
            total = one + zero
            odds = np.log((one + np.float32(0.2)) / (zero + np.float32(0.2)))
            if k == len(ORDERS):
                level = LEVEL_OF[np.minimum(total if own is None else total[own], 15).astype(np.int64)]
            else:
                known = (total > 0).astype(np.int64)
                seen = seen + (known if own is None else known[own])
            rows.append(odds if own is None else odds[own])
        return rows, level * (len(ORDERS) + 1) + seen


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -14, 14)))


def cell_of(node: np.ndarray, x: np.ndarray) -> np.ndarray:
    return node * BUCKETS + np.clip(np.rint(x * 2) + BUCKETS // 2, 0, BUCKETS - 1).astype(np.int64)


def fresh_weights() -> np.ndarray:
    return np.full((GATES, PREDICTORS), 0.3, np.float32)


def mixed(odds: np.ndarray, weights: np.ndarray, gate: np.ndarray) -> np.ndarray:
    chosen = weights[gate]
    x = odds[0] * chosen[:, 0]
    for k in range(1, PREDICTORS):
        x += odds[k] * chosen[:, k]
    return x


def learn(model: Model, keys: np.ndarray, times: np.ndarray, square: np.ndarray, rate: float = 0.02) -> None:
    """Online steps over distinct symbols, each weighed by its number; changes weights and adaptive map.

    Steps take every m-th of the sorted symbols, so each meets all kinds.
    """
    steps = max(1, -(-len(keys) // STEP))
    for s in range(steps):
        key, n = keys[s::steps], times[s::steps].astype(np.float32)
        found = Contexts(key)
        for bit in range(7, -1, -1):
            odds, gate = found.looked_up(model.counts, bit, True)
            node, taken = (found.symbol | 256) >> (bit + 1), (found.symbol >> bit) & 1
            gate = gate * 256 + node
            x = mixed(odds, model.weights, gate)
            error = (taken - squash(x)) * n
            model.refine += np.bincount(2 * cell_of(node, x) + taken, n, model.refine.size).reshape(-1, 2)
            total = np.bincount(gate, n, GATES)
            hit = np.flatnonzero(total)
            step = np.stack([np.bincount(gate, error * row, GATES)[hit] for row in odds], axis=1) / total[hit, None]
            square[hit] = 0.9 * square[hit] + 0.1 * step * step
            model.weights[hit] += rate * step / (np.sqrt(square[hit]) + 1e-2)


def code_lengths(model: Model, keys: np.ndarray) -> np.ndarray:
    """Bits of each of the sorted distinct ``keys`` under the frozen model."""
    bits = np.zeros(len(keys))
    total = model.refine.sum(axis=1)
    refined = ((model.refine[:, 1] + 0.5) / (total + 1)).astype(np.float32)
    trust = (0.5 * total / (total + 50)).astype(np.float32)
    for at in range(0, len(keys), STEP):
        found = Contexts(keys[at : at + STEP])
        chance = np.ones(len(found.symbol), np.float64)
        for bit in range(7, -1, -1):
            odds, gate = found.looked_up(model.counts, bit, False)
            node, taken = (found.symbol | 256) >> (bit + 1), (found.symbol >> bit) & 1
            x = mixed(odds, model.weights, gate * 256 + node)
            p, cell = squash(x), cell_of(node, x)
            p = np.clip(p + trust[cell] * (refined[cell] - p), np.float32(1e-5), np.float32(1 - 1e-5))
            chance *= np.where(taken == 1, p, 1 - p)
        bits[at : at + STEP] = -np.log2(chance)
    return bits


class Lengths:
    """Code lengths of the symbols met so far under one model, the latest ``most`` of them at least."""

    def __init__(self, model: Model, most: int = 3_000_000):
        self.model, self.most = model, most
        self.keys, self.bits = np.empty(0, np.uint64), np.empty(0)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Bits of each of ``keys``, in their order."""
        order, first = gathered(keys)
        each = keys[order[first]]  # hardly any key twice
        by = np.argsort(each)
        mine, times = runs(each[by])
        at = np.minimum(np.searchsorted(self.keys, mine), max(len(self.keys) - 1, 0))
        known = self.keys[at] == mine if len(self.keys) else np.zeros(len(mine), bool)
        bits = np.empty(len(mine))
        bits[known] = self.bits[at[known]]
        bits[~known] = code_lengths(self.model, mine[~known])
        if len(self.keys) + int((~known).sum()) > self.most:
            self.keys, self.bits = mine, bits
        else:
            where = np.searchsorted(self.keys, mine[~known])
            self.keys, self.bits = np.insert(self.keys, where, mine[~known]), np.insert(self.bits, where, bits[~known])
        out = np.empty(len(keys))
        found = np.empty(len(each))
        found[by] = np.repeat(bits, times)
        out[order] = np.repeat(found, np.diff(np.append(first, len(keys))))
        return out


# --- counts of tasks ---------------------------------------------------------


def _sparse(counts: np.ndarray) -> bytes:
    """Compressed gaps (16 bits: a block has 2^16 counts) and values of what is not zero."""
    at = np.flatnonzero(counts)
    gaps = np.diff(at, prepend=0).astype("<u2")
    values = counts[at]
    small = np.minimum(values, 255).astype(np.uint8)
    return zlib.compress(len(at).to_bytes(4, "little") + gaps.tobytes() + small.tobytes() + values[values >= 255].astype("<u8").tobytes(), 1)


def _add(block: np.ndarray, data: bytes) -> None:
    raw = zlib.decompress(data)
    n = int.from_bytes(raw[:4], "little")
    at = np.cumsum(np.frombuffer(raw, "<u2", n, 4).astype(np.int64))
    values = np.frombuffer(raw, np.uint8, n, 4 + 2 * n).astype(np.int64)
    values[values == 255] = np.frombuffer(raw, "<u8", -1, 4 + 3 * n).astype(np.int64)
    block[at] += values


def _trained_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts as rows (0, block, data), its weights as (1, 0, data) and its map as (2, 0, data)."""
    model = Model(np.zeros((OFFSETS[-1], 2), np.uint32), fresh_weights(), empty_refine())
    square, seen = np.full(model.weights.shape, 1e-2, np.float32), 0
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def take() -> None:
        keys, times = distinct(np.concatenate([k for k, _ in held]), np.concatenate([t for _, t in held])) if len(held) > 1 else held[0]
        for at in range(0, len(keys), STEP):
            Contexts(keys[at : at + STEP]).count_into(model.counts, times[at : at + STEP])
        learn(model, keys, times, square)

    for batch in slices(batches, "text", SLICE):
        keys, _ = symbols(texts(batch))
        seen += len(keys)
        held.append(distinct(keys))
        size += len(held[-1][0])
        if size > BLOCK:
            take()
            held, size = [], 0
    if held:
        take()
    if seen:
        flat = model.counts.reshape(-1, 1 << BLOCK_BITS)
        rows = [(0, i, _sparse(block)) for i, block in enumerate(flat) if block.any()]
        weights = np.rint(np.clip(model.weights, -100, 100) * 1024).astype(np.int64) * seen  # whole numbers: their sums do not depend on the order
        rows.append((1, 0, np.append(weights.ravel(), seen).tobytes()))
        rows.append((2, 0, np.rint(model.refine).astype(np.int64).tobytes()))
        for row in rows:
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.int32()), pa.array([row[2]], pa.binary())], ["kind", "block", "data"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of this partition by kind and block."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for kind, i, data in zip(batch["kind"].to_pylist(), batch["block"].to_pylist(), batch["data"]):
            if kind == 0:
                _add(sums.setdefault((kind, i), np.zeros(1 << BLOCK_BITS, np.int64)), data.as_py())
            else:
                values = np.frombuffer(data.as_py(), np.int64).astype(object if kind == 1 else np.int64)
                sums[kind, i] = sums[kind, i] + values if (kind, i) in sums else values
    for (kind, i), values in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([i], pa.int32()), pa.array([zlib.compress(values.astype("<f8").tobytes(), 1)], pa.binary())], ["kind", "block", "data"])


# --- Spark -------------------------------------------------------------------


def trained(train: DataFrame) -> Model:
    """A model of ``train(text)``. The driver gets one row for each block of a model of fixed size."""
    rows = train.select("text").mapInArrow(_trained_part, "kind int, block int, data binary")
    sums = rows.repartition("kind", "block").mapInArrow(_summed, "kind int, block int, data binary")
    counts, weights, refine = np.zeros((OFFSETS[-1], 2), np.uint16), fresh_weights(), empty_refine()
    flat = counts.reshape(-1, 1 << (BLOCK_BITS - 1), 2)
    for row in sums.toLocalIterator():
        values = np.frombuffer(zlib.decompress(row.data), "<f8")
        if row.kind == 0:  # pairs too large for 16 bits are scaled
            pairs = values.reshape(-1, 2)
            flat[row.block] = np.ceil(pairs * np.minimum(1.0, 60_000 / np.maximum(pairs.max(axis=1, keepdims=True), 1)))
        elif row.kind == 1:
            weights = (values[:-1] / values[-1] / 1024).astype(np.float32).reshape(weights.shape)
        else:
            refine = values.reshape(refine.shape)
    return Model(counts, weights, refine)


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


END_WORD = b" "  # the end token; no word holds a space


def word_counts(train: DataFrame) -> DataFrame:
    """``(word, c)`` over the training texts, the end of each text counted under END_WORD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches, "text", SLICE):
            for text in texts(batch):
                counts.update(words(text))
            counts[END_WORD] += batch.num_rows
            if len(counts) > 500_000:
                yield _pairs(counts)
                counts = Counter()
        yield _pairs(counts)

    return stored(train.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")


def _pairs(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])


def scores(docs: DataFrame, text: str = "text", key: str = "doc_id", folds: int = 5, held: int = 1) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)`` for each row.

    Learns from the rows whose crc32 of the id as text, modulo ``folds``, is not ``held``; null ids count as
    the empty string. score is the log10 probability of the lower-cased text and its end under the mixing
    model, base_score that of its words and end under smoothed word counts. Null texts are empty. Repeated
    rows each count and get a row. An empty table gives none.
    """
    rows = renamed(docs, doc_id=key, text=text)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    rows = rows.withColumn("held_out", fold == held)
    train = rows.where("not held_out")
    counted = word_counts(train)
    total, kinds = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    hot = {bytes(r.word): r.c for r in counted.where(F.col("c") > total / HOT_WORDS).collect()}
    tail = counted.where(F.col("c") <= total / HOT_WORDS)
    model = trained(train)
    shared = docs.sparkSession.sparkContext.broadcast((Lengths(model), hot))
    bottom = np.log10(total + 0.5 * (kinds + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, hot = shared.value  # one object for all tasks of a worker
        value = {word: float(np.log10(c + 0.5)) for word, c in hot.items()}
        for batch in slices(batches, "text", SLICE):
            found = texts(batch)
            keys, starts = symbols(found)
            bits = np.add.reduceat(lengths.of(keys), starts[:-1])
            out: list[tuple] = []
            rare_words, rare_times, offsets = [], [], [0]
            for x in found:
                counts = Counter(words(x))
                counts[END_WORD] += 1
                n, known, base = sum(counts.values()), 0, 0.0
                for word, times in counts.items():
                    if word in value:
                        known += times
                        base += times * value[word]
                    else:
                        rare_words.append(word)
                        rare_times.append(times)
                offsets.append(len(rare_words))
                out.append((n, known, base, len(x)))
            n, known, base, size = (np.array(c) for c in zip(*out))
            rare = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_times, pa.int64())], ["word", "times"])
            columns = [batch["doc_id"], batch["held_out"], *map(pa.array, (n, known, base - n * bottom, size, bits)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rare)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "known", "base", "n_bytes", "bits", "rare"])

    fields = [T.StructField("doc_id", id_type(docs, key)), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("n_bytes", T.LongType()), T.StructField("bits", T.DoubleType()),
              T.StructField("rare", T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("times", T.LongType())])))]
    scored = rows.mapInArrow(run, T.StructType(fields)).withColumn("row", F.monotonically_increasing_id())
    scored = stored(scored, "scored")
    each = scored.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.times").alias("times"))
    met = each.join(tail, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rest = met.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("rest"))
    joined = scored.drop("rare").join(rest, "row", "left")
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), (-F.col("bits") * float(np.log10(2.0))).alias("score"),
        (F.col("bits") / (F.col("n_bytes") + 1)).alias("bits_per_byte"))

"""Token ids in ORC files, and token counts, by a public tokenizer file.

Both encode whole texts. A text is cut before white space that follows other characters: the pre-tokenizers
used start a new piece there whatever lies around, so a text's ids are those of its units one after the
other. Units are encoded by the library in batches and remembered per worker, up to a bound, so a frequent
unit is encoded once and a long text never is one call.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apexframe.llm.common import handed, id_type, kept, renamed, shared_path, slices, stored

REMEMBERED = 800_000  # units that a worker remembers before it starts anew
REMEMBERED_CHARS = 16 << 20  # their characters
ORC = {
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
    "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "compression": "lz4",
}
CALL_BYTES = 1 << 20  # of units in one call of the library
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # fixed values: Unicode White_Space
UNITS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
WORDS = re.compile(f"[^{SPACE}]+")
MEETING = "[{0}][{0}]".format(SPACE.encode().decode("unicode_escape"))  # as characters, for Arrow's expressions
ODD_SPACE = re.compile("[\x1c-\x1f]")  # Python calls these white space, the tokenizers do not

JOINED = re.compile(f"[{SPACE}]+[^{SPACE}]")  # how units begin that stay apart when joined
JOIN = 32  # units in one text of a call

OWNER = "tokens"  # of the caches below
_loaded: dict[str, object] = kept(OWNER)
_sizes: dict[str, np.ndarray] = kept(OWNER)
_units: dict[tuple[str, str], Memory] = kept(OWNER)


def _tokenizer(path: str):
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if path.endswith(".model"):
            import sentencepiece

            _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _loaded[path] = tokenizer
    return _loaded[path]


def encode_units(path: str, units: list[str]) -> Iterator[list[int]]:
    """Ids of each unit, in calls balanced by size."""
    tokenizer = _tokenizer(path)
    if path.endswith(".model"):
        yield from tokenizer.encode(units, num_threads=1)
        return
    at, held = 0, 0
    for i, unit in enumerate(units):
        held += len(unit)
        if held >= CALL_BYTES or i + 1 == len(units):
            for encoding in tokenizer.encode_batch_fast(units[at : i + 1], add_special_tokens=False):
                yield encoding.ids
            at, held = i + 1, 0


def lengths(path: str, units: list[str]) -> Iterator[int]:
    """Number of ids of each unit."""
    return map(len, encode_units(path, units))


def token_bytes(path: str) -> np.ndarray:
    """Bytes of text that each id of a byte-level vocabulary stands for."""
    if path not in _sizes:
        tokenizer = _tokenizer(path)
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            sizes[i] = len(token)
        for i, token in tokenizer.get_added_tokens_decoder().items():
            sizes[i] = len(token.content.encode())
        _sizes[path] = sizes
    return _sizes[path]


def joined_ids(path: str, units: list[str]) -> list[bytes] | None:
    """Ids of units encoded many to a text, given back to them by the bytes that ids stand for; None if
    they do not meet the units' ends, as with vocabularies that are not byte-level."""
    texts = ["".join(units[i : i + JOIN]) for i in range(0, len(units), JOIN)]
    ids = np.fromiter(chain.from_iterable(encode_units(path, texts)), "<u4")
    met = np.cumsum(token_bytes(path)[ids])
    ends = np.cumsum(np.fromiter((len(u.encode()) for u in units), np.int64, len(units)))
    at = np.searchsorted(met, ends)
    if not len(ids) or met[-1] != ends[-1] or (met[at] != ends).any():
        return None
    data, cuts = ids.tobytes(), [0, *(4 * (at + 1)).tolist()]
    return [data[a:b] for a, b in pairwise(cuts)]


# Letters, digits and marks that the byte-level pre-tokenizer certainly keeps in runs of one kind. Apostrophes may be
# contractions and '<' may begin a special token, so units with them, or anything else, go to the library whole.
LETTER, DIGIT, MARK, BLANK, BREAK = range(1, 6)
KINDS = np.zeros(0x181, np.uint8)  # by code point; the last stands for all beyond
KINDS[[*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x180)]] = LETTER
KINDS[48:58], KINDS[32], KINDS[10] = DIGIT, BLANK, BREAK
KINDS[[ord(c) for c in r'''!"#$%&()*+,-./:;=>?@[\]^_`{|}~''']] = MARK
PIECES_KEPT = 500_000
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as themselves
HIDDEN = [b for b in range(256) if b not in SHOWN]
LETTERS = {b: chr(b if b in SHOWN else 256 + HIDDEN.index(b)) for b in range(256)}
WRITTEN = ["".join(LETTERS[b] for b in chr(c).encode()).encode() for c in range(0x180)]  # so vocabularies write a character
WIDTHS = np.array([len(x) for x in WRITTEN])
WRITTEN_BYTES = np.array([list(x.ljust(4, b"\0")) for x in WRITTEN], np.uint8)


def ragged(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs values[start[i] : start[i] + size[i]], one after the other."""
    ends = np.cumsum(size)
    return values[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def strings(distinct: pa.Array, apart: str) -> list[str]:
    """The values as Python strings; ``apart`` is a character in none of them."""
    if not len(distinct):
        return []
    return pa.compute.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), apart)[0].as_py().split(apart)


def pieces_of(units: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Which units are plain, the pieces of these, as a byte-level vocabulary writes them, and how many each has."""
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")
    kinds, starts = KINDS[np.minimum(points, len(KINDS) - 1)], np.cumsum(sizes) - sizes
    head = np.zeros(len(points), bool)
    head[starts[sizes > 0]] = True
    odd = np.concatenate(([0], np.cumsum((kinds == 0) | (kinds >= BLANK) & ~head)))
    plain = (odd[starts + sizes] == odd[starts]) & (sizes > 0)
    plain[plain] &= (sizes[plain] > 1) | (kinds[starts[plain]] < BLANK)
    mine = np.repeat(plain, sizes)
    points, kinds, head = points[mine], kinds[mine], head[mine]
    cut = head.copy()
    cut[1:] |= (kinds[1:] != kinds[:-1]) & (kinds[:-1] != BLANK)  # a space belongs to what follows
    width = WIDTHS[points]
    data = WRITTEN_BYTES[points][np.arange(4) < width[:, None]]
    at = np.flatnonzero(cut)
    offsets = np.append((np.cumsum(width) - width)[at], len(data)).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))
    return plain, pieces, np.diff(np.append(np.flatnonzero(head[at]), len(at)))


class Pieces(dict):
    """Numbers of pieces that the pre-tokenizer keeps whole, and their ids in one array, by the vocabulary's model."""

    def __init__(self, model) -> None:
        super().__init__()
        self.tokenize = model.tokenize
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has."""
        coded = pieces.dictionary_encode()
        written = strings(coded.dictionary, "\0")
        if len(self) + len(written) > PIECES_KEPT:
            self._empty()
        numbers = np.fromiter(map(self.get, written, repeat(-1)), np.int64, len(written))
        at = np.flatnonzero(numbers < 0)
        numbers[at] = np.arange(len(self), len(self) + len(at))
        fresh, tokenize = [written[i] for i in at.tolist()], self.tokenize
        self.update(zip(fresh, numbers[at].tolist()))
        found = [[t.id for t in tokenize(x)] for x in fresh]
        size = np.fromiter(map(len, found), np.int64, len(found))
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(size) - size))
        self.length = np.concatenate((self.length, size))
        self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(found), "<u4", size.sum())))
        numbers = numbers[coded.indices.to_numpy()]
        return ragged(self.ids, self.start[numbers], self.length[numbers]), self.length[numbers]


_pieces: dict[str, Pieces] = kept(OWNER)


def _runs_apart(path: str) -> bool:
    """Whether the vocabulary is byte-level BPE over runs of letters, digits and marks, with nothing before it."""
    tokenizer = None if path.endswith(".model") else _tokenizer(path)
    pre = getattr(tokenizer, "pre_tokenizer", None)
    plain = type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space and tokenizer.normalizer is None
    return plain and type(tokenizer.model).__name__ == "BPE"


def coded(path: str, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the units in one array, where each unit's begin there, and how many it has. Of plain units the pieces are
    given to the vocabulary's model, each once; other units go through the whole tokenizer."""
    start, size = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
    plain, ids = np.zeros(len(units), bool), np.zeros(0, "<u4")
    if _runs_apart(path):
        if path not in _pieces:
            _pieces[path] = Pieces(_tokenizer(path).model)
        plain, pieces, counts = pieces_of(units)
        ids, lengths = _pieces[path].encode(pieces)
        ends = np.cumsum(lengths)[np.cumsum(counts) - 1]
        size[plain] = np.diff(ends, prepend=0)
        start[plain] = ends - size[plain]
    rest = list(packed_whole(path, [u for u, p in zip(units, plain.tolist()) if not p]))
    size[~plain] = [len(x) // 4 for x in rest]
    start[~plain] = len(ids) + np.cumsum(size[~plain]) - size[~plain]
    return np.concatenate((ids, np.frombuffer(b"".join(rest), "<u4"))), start, size


def packed(path: str, units: list[str]) -> list[bytes]:
    """Ids of each unit as little-endian integers."""
    ids, start, size = coded(path, units)
    return [ids[a : a + n].tobytes() for a, n in zip(start.tolist(), size.tolist())]


def packed_whole(path: str, units: list[str]) -> Iterator[bytes]:
    """Ids of each unit as little-endian integers, by the library's tokenizer."""
    single = [np.array(ids, "<u4").tobytes() for ids in encode_units(path, [u for u in units if not JOINED.match(u)])]
    rest = [u for u in units if JOINED.match(u)]
    many = joined_ids(path, rest) if rest and not path.endswith(".model") else None
    if many is None:
        many = [np.array(ids, "<u4").tobytes() for ids in encode_units(path, rest)]
    alone, together = iter(single), iter(many)
    return (next(together if JOINED.match(u) else alone) for u in units)


def split_words(text: str) -> list[str]:
    """Runs without white space, for tokenizers that drop white space."""
    return WORDS.findall(text) if ODD_SPACE.search(text) else text.split()


def split_units(text: str) -> list[str]:
    """Runs of white space with what follows, for tokenizers that keep white space."""
    return UNITS.findall(text)


def whole(text: str) -> list[str]:
    """The text itself, for tokenizers without a known safe boundary."""
    return [text] if text else []


class Memory(dict):
    """Values of the units a worker has encoded."""

    chars = 0

    def fill(self, path: str, lists: list[list[str]], value: Callable) -> Callable:
        """Look-up that knows each unit in ``lists``."""
        fresh = list({u for units in lists for u in units if u not in self})
        size = sum(map(len, fresh))
        if len(self) + len(fresh) > REMEMBERED or self.chars + size > REMEMBERED_CHARS:
            self.clear()
            fresh = list({u for units in lists for u in units})
            self.chars, size = 0, sum(map(len, fresh))
        self.update(zip(fresh, value(path, fresh), strict=True))
        self.chars += size
        return self.__getitem__


def _memory(path: str, value: Callable) -> Memory:
    return _units.setdefault((path, value.__name__), Memory())


def token_counts(docs: DataFrame, path: str, split: Callable[[str], list[str]] = split_words, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for each row of ``docs``.

    Null and empty texts count zero. Repeated rows each get a row; an empty table gives none. ``split`` is
    the rule for safe boundaries of the tokenizer in ``path``.
    """
    rows = renamed(docs, doc_id=key, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", owner=OWNER):
            lists = [split(x or "") for x in batch["text"].to_pylist()]
            size = _memory(path, lengths).fill(path, lists, lengths)
            counts = np.fromiter((sum(map(size, units)) for units in lists), np.int64, len(lists))
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch["text"]), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], sizes, pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    fields = [T.StructField("doc_id", id_type(docs, key)), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return rows.mapInArrow(run, T.StructType(fields))


class Codes(dict):
    """Numbers of the units that a worker has met, and the ids of each in one array.

    A key is a unit as a tuple, or, as a string, the text after a single space or from a line feed on. Texts in which no
    two white spaces meet fall into the latter by one plain split, and each distinct one of a batch is looked up once.
    Once more than ``REMEMBERED`` are held, those met longest ago go, about half.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.path, self.fresh, self.clock = path, [], 0
        self.start, self.length, self.stamp = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, "<u4")

    def numbers(self, keys: list) -> np.ndarray:
        """The numbers of the distinct ``keys``; new ones get the next."""
        found = np.fromiter(map(self.get, keys, repeat(-1)), np.int64, len(keys))
        at = np.flatnonzero(found < 0)
        found[at] = np.arange(len(self), len(self) + len(at))
        fresh = [keys[i] for i in at.tolist()]
        self.update(zip(fresh, found[at].tolist()))
        self.fresh += [k[0] if isinstance(k, tuple) else k if k[:1] == "\n" else " " + k for k in fresh]
        return found

    def _each(self, units: list[str]) -> np.ndarray:
        """The numbers of units that may be equal."""
        keys = {(u,): 0 for u in units}
        keys.update(zip(keys, self.numbers(list(keys)).tolist()))
        return np.fromiter((keys[u,] for u in units), np.int64, len(units))

    def encode(self, texts: pa.Array, split: Callable[[str], list[str]], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and where each text ends."""
        if len(self) > REMEMBERED:
            self._forget()
        texts = pa.compute.fill_null(texts, "")
        even = np.zeros(len(texts), bool)
        if split is split_units:
            even = ~pa.compute.match_substring_regex(texts, MEETING).to_numpy(zero_copy_only=False)
        counts = np.zeros(len(texts), np.int64)
        plain, counts[even] = self._split_plainly(texts.filter(pa.array(even)))
        odd = [self._each(units) for units in map(split, texts.filter(pa.array(~even)).to_pylist())]
        counts[~even] = [len(x) for x in odd]
        codes = np.empty(counts.sum(), np.int64)
        from_plain = np.repeat(even, counts)
        codes[from_plain] = plain
        if odd:
            codes[~from_plain] = np.concatenate(odd)
        self._settle()
        self.clock += 1
        self.stamp[codes] = self.clock
        size = self.length[codes]
        ids = ragged(self.ids, self.start[codes], size)
        after = np.concatenate(([0], np.cumsum(size)))[np.cumsum(counts)]
        return np.insert(ids, after, end_id), after + np.arange(1, len(texts) + 1)

    def _split_plainly(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the units of all texts, and how many each has."""
        if not len(texts):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lists = pa.compute.split_pattern(pa.compute.replace_substring(texts, "\n", " \n"), " ")
        counts = pa.compute.list_value_length(lists).to_numpy().astype(np.int64)
        values = lists.flatten()
        first = np.zeros(len(values), bool)
        first[np.cumsum(counts) - counts] = True
        rest = values.filter(pa.array(~first)).dictionary_encode()
        codes = np.empty(len(values), np.int64)
        codes[~first] = self.numbers(strings(rest.dictionary, " "))[rest.indices.to_numpy()]
        heads = values.filter(pa.array(first)).to_pylist()
        met = np.array([x != "" for x in heads], bool)
        own = np.full(len(heads), -1, np.int64)
        own[met] = self._each([x for x in heads if x])
        codes[first] = own
        return codes[codes >= 0], counts - ~met

    def _settle(self) -> None:
        """Encode the units first met since the last call."""
        ids, start, size = coded(self.path, self.fresh)
        self.start = np.concatenate((self.start, len(self.ids) + start))
        self.length = np.concatenate((self.length, size))
        self.stamp = np.concatenate((self.stamp, np.zeros(len(size), np.int64)))
        self.ids = np.concatenate((self.ids, ids))
        self.fresh = []

    def _forget(self) -> None:
        keep = self.stamp > np.median(self.stamp)
        kept = [key for key, k in zip(self, keep.tolist()) if k]
        size = self.length[keep]
        self.ids = ragged(self.ids, self.start[keep], size)
        self.start, self.length, self.stamp = np.cumsum(size) - size, size, self.stamp[keep]
        self.clear()
        self.update(zip(kept, range(len(kept))))


_codes: dict[str, Codes] = kept(OWNER)


def token_ids(rows: DataFrame, path: str, split: Callable[[str], list[str]], end_id: int) -> DataFrame:
    """``rows(doc_id, text)`` as ``(part, row, doc_id, ids)``: the ids with the end id last, the number of
    the partition, and of the row in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        codes = _codes.setdefault(path, Codes(path))
        for batch in slices(batches, "text", owner=OWNER):
            ids, ends = codes.encode(batch["text"], split, end_id)
            n = batch.num_rows
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.view("<i4")))
            columns = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), batch["doc_id"], lists]
            yield pa.RecordBatch.from_arrays(columns, ["part", "row", "doc_id", "ids"])
            row += n

    fields = [T.StructField("part", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    return rows.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


def write_orc(docs: DataFrame, folder: str, path: str, split: Callable[[str], list[str]] = split_units, end_id: int = 0, text: str = "text", key: str = "doc_id", order: str | None = None) -> None:
    """Write the ids of ``docs`` as ORC under ``folder``, in ascending id over all files, or by ``order``.

    Each row is (part, row, doc_id, ids). A part is a range of ids, or of the column ``order``, as Spark's range
    partitioning cuts them; within it rows ascend by it, nulls first, then by id, null ids first, equal ids by
    text. ORC run-length encodes the ids; stripes, row indexes and Bloom filters on doc_id let tasks read stripes
    in parallel and skip those without an id.
    """
    rows = renamed(docs, doc_id=key, text=text, **({"place": order} if order else {}))
    by = [F.col(c).asc_nulls_first() for c in (["place"] if order else []) + ["doc_id"]]
    ordered = rows.repartitionByRange(by[0]).sortWithinPartitions(*by, "text")
    token_ids(ordered, path, split, end_id).write.options(**ORC).orc(folder)


def read_orc(spark: SparkSession, folder: str, only: list | None = None) -> DataFrame:
    """``(part, row, doc_id, ids)`` of the files; with ``only``, of these ids, skipping stripes by row index
    and Bloom filter."""
    rows = spark.read.orc(folder)
    return rows if only is None else rows.where(F.col("doc_id").isin(list(only)))


def digests(rows: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of what ``read_orc`` gives: the place in the whole sequence,
    and a checksum of the ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in handed(batches, OWNER):
            lists = batch["ids"]
            offsets = lists.offsets.to_numpy()
            view = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            columns = [batch["part"], batch["row"], batch["doc_id"], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "row", "doc_id", "n_tokens", "ids_crc32"])

    fields = [rows.schema["part"], rows.schema["row"], rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    each = stored(rows.mapInArrow(run, T.StructType(fields)), "digests")
    sums = each.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    starts = sums.select("part", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("before"))
    earlier = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    own = each.withColumn("own", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    return own.join(starts, "part").select("doc_id", (F.col("own") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def binary_output(docs: DataFrame, path: str, split: Callable[[str], list[str]] = split_units, end_id: int = 0, text: str = "text", key: str = "doc_id", order: str | None = None) -> tuple[str, DataFrame]:
    """Write ``docs`` in a new shared folder and read them back: the folder and the digest rows.

    Null and empty texts give the end id alone. Without ``order`` rows of equal id lie together, ordered by
    text; with it, rows lie by that column. An empty table gives no rows.
    """
    folder = shared_path(docs.sparkSession, "tokens")
    write_orc(docs, folder, path, split, end_id, text, key, order)
    return folder, digests(read_orc(docs.sparkSession, folder))

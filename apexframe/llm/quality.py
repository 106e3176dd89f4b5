"""Quality rules: a linear-chain conditional random field over lines, decoded by Viterbi.

Lines are described by a few shares and counts of their characters and words. A CRF with two states,
content and boilerplate, is fitted on a bounded sample of labelled documents whose lines inherit the
document's label; the chain lets a line's neighbours speak for it. A document's verdict is the share of its
words in lines that Viterbi decoding marks as content.
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

from apexframe.llm.common import id_type, in_sample, renamed, slices, texts

SAMPLE = 3_000  # labelled documents, about, that the field is fitted on
SAMPLE_BYTES = 20_000  # longer documents are no part of the sample; they are judged like all others
LEAST_CONTENT = 0.5  # share of words in content lines that a document needs
LEAST_WORDS = 50
SLICE = 1 << 20  # bytes of texts that are judged at once; their characters take a hundred times that in counts
SYMBOLS = b"#*$%&|<>"
FEATURES = 12

# classes of bytes whose counts describe a line: white space, ASCII upper, letters, digits, symbols, marks, word starts
_CLASS = np.zeros((6, 256), np.int32)
_CLASS[0, [9, 10, 11, 12, 13, 32]] = 1
_CLASS[1, 65:91] = 1
_CLASS[2, [*range(65, 91), *range(97, 123), *range(0xC2, 0xF5)]] = 1
_CLASS[3, 48:58] = 1
_CLASS[4, list(SYMBOLS)] = 1
_CLASS[5, [33, 63, 45, 59, 58, 64, 95, 47, 92, 123, 125, 91, 93, 61, 43, 126, 94]] = 1
_NOT_FOLLOW = np.ones(256, np.int32)  # first bytes of code points
_NOT_FOLLOW[0x80:0xC0] = 0


@dataclass
class Field:
    """Weights: of features for the two states (0 boilerplate, 1 content), of state pairs, of starts."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray


@dataclass
class Lines:
    """Lines of several texts, one after the other."""

    first: np.ndarray  # index of each text's first line, and the end
    words: np.ndarray
    features: np.ndarray
    sums: dict[str, np.ndarray]  # counts by text


def lines_of(batch: list[bytes]) -> Lines:
    """Every text has a line at least; lines end at \\n."""
    sizes = np.fromiter((len(x) + 1 for x in batch), np.int64, len(batch))
    data = np.frombuffer(b"\n".join(batch) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    first = np.concatenate(([0], np.searchsorted(ends, np.cumsum(sizes)) + 1))
    starts = np.concatenate(([0], ends[:-1]))

    def per_line(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, starts, dtype=np.int64)

    space, upper, letters, digits, symbols, marks = (per_line(c[data]) for c in _CLASS)
    blank = _CLASS[0][data]
    begins = (1 - blank) * np.concatenate(([1], blank[:-1]))
    words = per_line(begins)
    points = per_line(_NOT_FOLLOW[data] * (1 - blank))
    pipes = per_line((data == 124).astype(np.int32))
    shouts = per_line((data == 33).astype(np.int32))
    stops = per_line(((data == 46) | (data == 44)).astype(np.int32))
    chars = np.maximum(points, 1)
    count = np.maximum(words, 1)
    features = np.stack([
        np.ones(len(words)), upper / chars, digits / chars, np.minimum(symbols / count, 3.0), np.minimum(shouts / count, 2.0), np.minimum(marks / count, 3.0),
        np.minimum(pipes / count, 1.0), np.minimum(stops / count, 1.0), np.minimum(points / count, 30.0) / 10, np.log1p(words) / 4,
        (words == 0).astype(float), np.clip(1 - letters / chars, 0, 1)], axis=1)
    sums = {"n_words": np.add.reduceat(words, first[:-1]), "word_chars": np.add.reduceat(points, first[:-1]), "n_symbols": np.add.reduceat(symbols, first[:-1])}
    return Lines(first, words, features, sums)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def repeated_words(text: bytes) -> int:
    """Words inside windows of three words that the text holds twice or more."""
    words = text.split()
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    hit = np.zeros(len(words), bool)
    at = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    for k in range(3):
        hit[k : k + len(windows)] |= at
    return int(hit.sum())


def viterbi(field: Field, lines: Lines) -> np.ndarray:
    """The best state of each line, all texts advancing together line by line."""
    score = lines.features @ field.emit
    size = np.diff(lines.first)
    order = np.argsort(-size, kind="stable")
    first, size = lines.first[:-1][order], size[order]
    back = np.zeros((len(score), 2), np.int8)
    now = score[first] + field.start
    for t in range(1, int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -t))  # texts with a line t
        step = now[:n, :, None] + field.move[None]
        best = step.argmax(axis=1)
        back[first[:n] + t] = best
        now[:n] = np.take_along_axis(step, best[:, None, :], 1)[:, 0] + score[first[:n] + t]
    state = np.zeros(len(score), np.int8)
    here = now.argmax(axis=1).astype(np.int8)
    state[first + size - 1] = here
    for t in range(int(size[0]) - 1 if len(size) else 0, 0, -1):
        n = int(np.searchsorted(-size, -t))
        at = first[:n] + t
        state[at - 1] = back[at, state[at]]
    return state


def _log_partition(field: Field, features: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log partition of one text, the state marginals and the summed pair marginals (forward-backward)."""
    score = features @ field.emit
    n = len(score)
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = score[0] + field.start
    for t in range(1, n):
        ahead[t] = np.logaddexp(ahead[t - 1, 0] + field.move[0], ahead[t - 1, 1] + field.move[1]) + score[t]
    for t in range(n - 2, -1, -1):
        x = score[t + 1] + behind[t + 1]
        behind[t] = np.logaddexp(field.move[:, 0] + x[0], field.move[:, 1] + x[1])
    total = np.logaddexp(ahead[-1, 0], ahead[-1, 1])
    pairs = np.zeros((2, 2))
    if n > 1:
        pairs = np.exp(ahead[:-1, :, None] + field.move[None] + (score[1:] + behind[1:])[:, None, :] - total).sum(axis=0)
    return total, np.exp(ahead + behind - total), pairs


def fit(samples: list[tuple[bytes, int]], rounds: int = 6, rate: float = 0.3, shrink: float = 1e-4) -> Field:
    """Conditional likelihood by stochastic gradient steps with per-weight rates, in the order given.

    Without samples of both labels every line is content.
    """
    field = Field(np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.zeros(2))
    if len({label for _, label in samples}) < 2:
        field.start[1] = field.emit[0, 1] = 1.0
        return field
    share = np.mean([label for _, label in samples])
    weight = {0: 0.5 / max(1 - share, 1e-3), 1: 0.5 / max(share, 1e-3)}
    lines = [lines_of([text]).features for text, _ in samples]
    squares = [np.full(x.shape, 1e-2) for x in (field.emit, field.move, field.start)]
    for _ in range(rounds):
        for features, (_, label) in zip(lines, samples):
            n = len(features)
            _, state, pairs = _log_partition(field, features)
            target = np.zeros_like(state)
            target[:, label] = 1
            wanted = np.zeros((2, 2))
            wanted[label, label] = n - 1
            scale = weight[label] / n
            steps = (features.T @ (target - state) * scale, (wanted - pairs) * scale, (target[0] - state[0]) * scale)
            for x, step, square in zip((field.emit, field.move, field.start), steps, squares):
                step = step - shrink * x
                square += step * step
                x += rate * step / np.sqrt(square)
    return field


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", key: str = "doc_id") -> Field:
    """A field from about ``sample`` labelled documents, those whose id hashes into that share of the labels.

    Rows without text, id or label are no samples, nor are texts over SAMPLE_BYTES.
    """
    marked = renamed(labels, doc_id="doc_id", quality="quality").where("doc_id is not null and quality is not null")
    taken = in_sample("doc_id", sample / max(1, marked.count()))
    marked = marked.where(taken).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = renamed(docs, doc_id=key, text=text).where(taken & F.octet_length("text").between(1, SAMPLE_BYTES))
    chosen = rows.join(marked, "doc_id").select("doc_id", "quality", "text").collect()
    chosen = sorted((zlib.crc32(str(row.doc_id).encode()), row.text, int(row.quality > 0)) for row in chosen)
    return fit([(text.encode(), label) for _, text, label in chosen])


FIELDS = [(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("content_share", T.DoubleType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType())]


def judged(batch: list[bytes], field: Field, least: float = LEAST_CONTENT) -> dict[str, np.ndarray]:
    """The columns of FIELDS for each text."""
    lines = lines_of(batch)
    out = dict(lines.sums)
    out["n_dup_lines"] = np.fromiter(map(duplicate_lines, batch), np.int64, len(batch))
    out["n_repeat_words"] = np.fromiter(map(repeated_words, batch), np.int64, len(batch))
    content = np.add.reduceat(viterbi(field, lines) * lines.words, lines.first[:-1])
    out["content_share"] = content / np.maximum(out["n_words"], 1)
    out["base_failed"] = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["content_share"] >= least)
    return out


def quality(docs: DataFrame, field: Field, text: str = "text", key: str = "doc_id", least: float = LEAST_CONTENT) -> DataFrame:
    """``(doc_id, n_words, ..., content_share, base_failed, kept)`` for each row of ``docs``.

    Null and empty texts have no words and are not kept. Repeated rows each get a row; an empty table
    gives none.
    """
    rows = renamed(docs, doc_id=key, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = judged(texts(batch), field, least)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(out[n]) for n, _ in FIELDS]], ["doc_id", *[n for n, _ in FIELDS]])

    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", id_type(docs, key)), *[T.StructField(n, t) for n, t in FIELDS]]))


def filtered(docs: DataFrame, field: Field, text: str = "text", least: float = LEAST_CONTENT) -> DataFrame:
    """The rows of ``docs`` that are kept, with all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE):
            yield batch.filter(pa.array(judged(texts(batch, text), field, least)["kept"]))

    return docs.mapInArrow(run, docs.schema)

"""Runs (maximal repetitions) of words in each text.

A run's root, rotated to its least form, is a Lyndon word in one of two opposite orders of the words, and is the
longest one starting where it starts. Phase one of Baier's suffix sorter gives these longest Lyndon prefixes of
all suffixes: it groups suffixes by them, from the highest group down, and lengthens the prefix of the suffix
before each group by the group's own. Run once under each order, it yields the candidates; each is extended to
both sides as far as words a period apart agree.

A run of at least twelve words repeats each of its six-word windows inside itself, so only stretches covered by
windows met twice in the same stretch are sorted; all others hold no run. Texts are whole and alone: a task holds
one at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apexframe.llm.common import id_type, renamed, slices, texts

LEAST = 12  # words of a run
WINDOW = LEAST // 2
BASE = np.uint64(0x9E3779B97F4A7C15)


def lyndon_lengths(word: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each place of ``word`` (small non-negative integers, the
    end below all of them): phase one of Baier's suffix sorter.

    Groups lie as blocks of ``order``, higher ones further right, and are named by their first place. ``before[i]``
    is the nearest place left of i in a lower group than i's, known once i's group has been taken.
    """
    n = len(word)
    order_of = np.argsort(word, kind="stable")
    values = word[order_of]
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    group_of = np.empty(n, np.int64)
    group_of[order_of] = np.repeat(starts, np.diff(np.append(starts, n)))
    place_of = np.empty(n, np.int64)
    place_of[order_of] = np.arange(n)
    order, group, place = order_of.tolist(), group_of.tolist(), place_of.tolist()
    size, context = [0] * n, [0] * n
    for start, held in zip(starts.tolist(), np.diff(np.append(starts, n)).tolist()):
        size[start], context[start] = held, 1
    before, length = [-1] * n, [0] * n
    end = n
    while end:
        start = group[order[end - 1]]
        own = context[start]
        members = order[start:end]
        members.sort()
        met: dict[int, int] = {}
        for i in members:
            length[i] = own
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                met[j] = met.get(j, 0) + 1
        end = start
        if not met:
            continue
        moves: dict[tuple[int, int], list[int]] = {}
        for j, times in met.items():
            moves.setdefault((-times, group[j]), []).append(j)
        for (times, old), moved in sorted(moves.items()):
            last = old + size[old]
            left = size[old] - len(moved)
            new = old + left
            for j in moved:  # to the end of the old block
                last -= 1
                other, at = order[last], place[j]
                order[at], order[last] = other, j
                place[other], place[j] = at, last
                group[j] = new
            size[old] = left
            size[new], context[new] = len(moved), context[old] - times * own
    return np.array(length, np.int64)


def windows(word: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """A hash of the ``width`` words from each place on."""
    n = len(word) - width + 1
    out = np.zeros(n, np.uint64)
    mixed = (word.astype(np.uint64) + np.uint64(1)) * BASE
    mixed ^= mixed >> np.uint64(32)
    for k in range(width):
        out = out * BASE + mixed[k : k + n]
    return out


def stretches(word: np.ndarray) -> list[tuple[int, int]]:
    """Stretches ``(start, end)`` that hold all runs: covered by windows that are met twice in the stretch."""
    n = len(word) - WINDOW + 1
    if n <= 1:
        return []
    hashes, at, part = windows(word), np.arange(n), np.zeros(n, np.int64)
    while True:
        by = np.lexsort((part, hashes))
        same = (hashes[by[1:]] == hashes[by[:-1]]) & (part[by[1:]] == part[by[:-1]])
        kept = np.zeros(len(by), bool)
        kept[by[1:]] |= same
        kept[by[:-1]] |= same
        few = kept.mean() > 0.9  # a stretch left too wide is sorted for nothing, but loses no run
        at, hashes = at[kept], hashes[kept]
        if len(at) <= 1:
            return []
        part = np.cumsum(np.concatenate(([0], np.diff(at) > WINDOW)))  # windows further apart neither share words nor touch
        if few:
            break
    cut = np.flatnonzero(np.diff(part)) + 1
    return [(int(a), int(b) + WINDOW) for a, b in zip(at[np.concatenate(([0], cut))], at[np.concatenate((cut - 1, [len(at) - 1]))]) if b + WINDOW - a >= LEAST]


def _rooted(word: np.ndarray, least: int) -> np.ndarray:
    """Runs ``(start, length, period)`` of one stretch."""
    n = len(word)
    hashes = windows(word)
    found = []
    roots = []
    for flipped in (word, word.max() - word):
        length = lyndon_lengths(flipped)
        at = np.flatnonzero(2 * length <= n)
        period = length[at]
        agree = np.zeros(len(at), bool)
        for back in range(WINDOW):  # a run's agreeing places around its first root fill a window
            x = at - back
            y = x + period
            inside = (x >= 0) & (y < len(hashes))
            agree[inside] |= hashes[x[inside]] == hashes[y[inside]]
        roots.append(np.stack((at[agree], period[agree]), axis=1))
    at, period = np.concatenate(roots).T
    for p in np.unique(period):
        agrees = np.concatenate(([False], word[:-p] == word[p:], [False]))
        change = np.flatnonzero(agrees[1:] != agrees[:-1])
        first, end = change[::2], change[1::2]  # places that agree with those a period on
        long = end - first >= max(p, least - p)
        first, end = first[long], end[long]
        mine = np.sort(at[period == p])
        rooted = np.searchsorted(mine, first) < np.searchsorted(mine, end, "right")  # a root from ``first`` to ``end``
        found.append(np.stack((first, end - first + p, np.full(len(first), p)), axis=1)[rooted])
    return np.concatenate(found) if found else np.empty((0, 3), np.int64)


def runs(words: Sequence, least: int = LEAST) -> np.ndarray:
    """Runs ``(start, length, period)`` of at least ``least`` (12 or more) words, by start, then period."""
    if len(words) < least:
        return np.empty((0, 3), np.int64)
    names: dict = {}
    word = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    parts = [_rooted(np.unique(word[a:b], return_inverse=True)[1], least) + (a, 0, 0) for a, b in stretches(word)]
    found = np.concatenate(parts) if parts else np.empty((0, 3), np.int64)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapsed(n: int, found: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def injected(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a periodic tail for each tenth id, by its checksum; none for a null id."""
    if doc_id is None or not words:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * (-(-(n - a) // p)))[: n - a]


def periodic(docs: DataFrame, change: Callable[[list[bytes], object], list[bytes]] | None = None, text: str = "text", key: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_runs, start, length, period, runs, collapsed)`` for each row of ``docs``.

    The run given is the longest (then the first, then the one of the smallest period), null without any; ``runs``
    lists all as ``start,length,period`` and a line feed, by start, then period; ``collapsed`` is the kept words
    joined by a space. Both are SHA-256 digests unless ``keep_text``. ``change`` may replace a text's words, given
    its id. Null and empty texts have no words. Repeated rows each get a row; an empty table gives none.
    """
    rows = renamed(docs, doc_id=key, text=text)

    def shown(data: bytes) -> str:
        return data.decode() if keep_text else sha256(data).hexdigest()

    def described(doc_id, data: bytes) -> tuple:
        words = data.split()
        words = change(words, doc_id) if change else words
        found = runs(words)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in found.tolist()).encode()
        if not len(found):
            return len(words), 0, None, None, None, shown(listed), shown(b" ".join(words))
        best = found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]].tolist()
        left = [words[i] for i in np.flatnonzero(collapsed(len(words), found)).tolist()]
        return len(words), len(found), *best, shown(listed), shown(b" ".join(left))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), "text"):
                out = list(zip(*map(described, part["doc_id"].to_pylist(), texts(part))))
                columns = [pa.array(c, pa.int64()) for c in out[:5]] + [pa.array(c, pa.string()) for c in out[5:]]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *columns], ["doc_id", *names])

    names = ["n_words", "n_runs", "start", "length", "period", "runs", "collapsed"]
    fields = [T.StructField(c, T.LongType()) for c in names[:5]] + [T.StructField(c, T.StringType()) for c in names[5:]]
    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", id_type(docs, key)), *fields]))

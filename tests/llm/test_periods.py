"""Runs of words against brute force over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from apexframe.llm import periods
from apexframe.llm.queries import queries

from .cases import FOLDER, LONG, ROWS, awkward, documents


def brute(w, least=12):
    found = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(least, 2 * q) and not any(w[i : i + n - d] == w[i + d : i + n] for d in range(1, q)):
                found.append((i, n, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def lyndon(w):
    return [next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w)) - i for i in range(len(w))]


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
@settings(max_examples=300, deadline=None)
def test_lengths_of_lyndon_words(w):
    ranks = np.unique(w, return_inverse=True)[1]
    for order in (ranks, ranks.max() - ranks):
        assert periods.lyndon_lengths(order).tolist() == lyndon(order.tolist())


@given(st.lists(st.integers(0, 2), max_size=25), st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(0, 60), st.lists(st.integers(0, 2), max_size=25))
@settings(max_examples=400, deadline=None)
def test_runs_are_those_of_brute_force(head, root, n, tail):
    w = head + (root * 60)[:n] + tail
    assert [tuple(r) for r in periods.runs(w).tolist()] == brute(w)


def test_long_and_nested_runs():
    assert periods.runs(LONG.split()).tolist() == [[0, 90_000, 3]]
    a, b = "a", "ab"
    while len(b) < 2000:
        a, b = b, b + a
    assert [tuple(r) for r in periods.runs(list(b)).tolist()] == brute(b)
    rng = random.Random(4)
    once = [rng.randrange(1000) for _ in range(5000)]
    assert periods.runs(once * 2 + once[:100]).tolist() == [[0, 10_100, 5000]]


def test_equal_hashes_change_nothing(monkeypatch):
    """Hashes only narrow the search: with one hash for all windows the runs are the same."""
    rng = random.Random(8)
    texts = [[rng.randrange(3) for _ in range(80)] + [1, 2, 3, 4] * 5 for _ in range(30)]
    monkeypatch.setattr(periods, "windows", lambda word, width=6: np.zeros(len(word) - width + 1, np.uint64))
    assert all([tuple(r) for r in periods.runs(w).tolist()] == brute(w) for w in texts)


def injected(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not words:
        return words
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_is_brute_force(spark):
    docs = documents()
    got = {r.doc_id: r for r in queries()["op13_periodic_runs"](spark, FOLDER).collect()}
    assert len(got) == len(docs)
    some = 0
    for doc_id, text in zip(docs.doc_id.tolist(), docs.text):
        words = injected((text or "").encode().split(), doc_id)
        if len(words) > 1500:
            continue  # the brute force is quadratic; long texts are tested above
        found = brute(words)
        r = got[doc_id]
        dropped = {i for s, n, q in found for i in range(s + q, s + n)}
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None) and r.n_runs == len(found)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest()
        some += bool(found)
    assert some > 5


def test_awkward_rows(spark):
    got = periodic = periods.periodic(awkward(spark), keep_text=True).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in periodic if r.doc_id is not None}
    assert (by[4].n_runs, by[4].start, by[4].length, by[4].period, by[4].collapsed) == (1, 0, 90_000, 3, "lorem ipsum dolor")
    assert (by[2].n_words, by[2].n_runs, by[2].start, by[2].runs, by[2].collapsed) == (0, 0, None, "", "")
    assert by[6].n_words == 0 and by[3].n_words == 0
    assert periods.periodic(awkward(spark, [])).count() == 0
    assert periods.periodic(awkward(spark), periods.injected).count() == len(ROWS)


@pytest.mark.parametrize("doc_id", [None, 1, 5])
def test_nothing_to_inject_without_words(doc_id):
    assert periods.injected([], doc_id) == []

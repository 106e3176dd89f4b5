"""Near copies of the pipeline against brute force over all pairs."""

import itertools
import random

import corpus_pipeline
import numpy as np
from apexframe.llm import resemblance
from apexframe.llm.graph import components

from .cases import FOLDER, ROWS, awkward, documents
from .test_methods import classes


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def edited():
    """Texts and copies with one to nine changed words: similarities on both sides of 0.8."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(6, 300))]
        rows.append(" ".join(words))
        for k in range(1, 10, 2):
            copy = list(words)
            for at in rng.sample(range(len(copy)), min(k, len(copy))):
                copy[at] = f"x{rng.randrange(5000)}"
            rows.append(" ".join(copy))
    return rows


def brute(ids, texts):
    found = dict(zip(ids, map(grams, texts)))
    return classes(list(ids), [(a, b) for a, b in itertools.combinations(ids, 2) if similar(found[a], found[b])])


def test_edited_copies_are_found(spark):
    texts = edited()
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = brute(range(len(texts)), texts)
    got = {r.doc_id: r.component_id for r in resemblance.near_duplicates(docs).collect()}
    assert got == want
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()} == set(want.values())
    assert len(set(want.values())) < len(texts) - 60  # edited copies are among them


def test_stage_is_brute_force_on_documents(spark):
    docs = documents()
    got = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER)
    assert {r.doc_id for r in got.collect()} == set(brute(docs.doc_id.tolist(), docs.text).values())


def test_blocks_give_the_same_classes(spark):
    texts = edited()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(range(len(texts)), texts)
    found = resemblance.sets(docs)
    nodes = found.selectExpr("fp", "named_struct('none', false, 'doc_id', doc_id, 'text_hash', text_hash) AS first", "bands")
    of = {r.fp: r.doc_id for r in nodes.selectExpr("fp", "first.doc_id").collect()}
    edges = resemblance.links(docs, nodes, block=2)
    got = classes(range(len(texts)), [(of[r.node], of[r.root]) for r in components(edges).collect()])
    assert got == want


def test_awkward_rows(spark):
    got = resemblance.near_duplicates(awkward(spark)).collect()
    assert len(got) == len(ROWS)
    assert {r.component_id for r in got if r.fp == 0} == {2}
    assert {r.component_id for r in got if r.doc_id in (1, 5)} == {1}
    assert resemblance.near_duplicates(awkward(spark, [])).count() == 0
    assert resemblance.near_duplicates(awkward(spark, [(None, None, None, None)])).first().component_id is None


def test_parts_are_those_of_all_pairs():
    rng = np.random.default_rng(4)
    for radius in (3, 7, 26):
        fps = rng.integers(0, 1 << 63, 40, np.uint64)
        fps = np.concatenate([fps, fps[:30] ^ (np.uint64(1) << rng.integers(0, 64, 30, np.uint64)), fps[:90]])
        keys = np.sort(rng.integers(0, 4, len(fps)))
        pairs = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if keys[i] == keys[j] and int(fps[i] ^ fps[j]).bit_count() <= radius]
        want = classes(list(range(len(fps))), pairs)
        assert resemblance.parts(keys, fps, radius).tolist() == [want[i] for i in range(len(fps))]


def test_similar_sets_are_within_the_radius():
    """Sets at 0.8 of each other, from the smallest that can be on, against the stated radius."""
    rng = np.random.default_rng(5)
    widest = 0
    for n in (4, 8, 12, 40, 400):
        for _ in range(400):
            whole = np.unique(rng.integers(0, 1 << 63, n + n // 4, np.uint64) * np.uint64(2) + rng.integers(0, 2, n + n // 4, np.uint64))
            part = np.sort(rng.permutation(whole)[:n])
            widest = max(widest, (resemblance.fingerprint(whole) ^ resemblance.fingerprint(part)).bit_count())
    assert widest <= resemblance.RADIUS


def pairs_at_the_limit(rng, n, count):
    """Random sets of n and n + n // 4 hashes, one in the other: a similarity of 0.8 where 4 divides n."""
    for _ in range(count):
        whole = rng.integers(0, 1 << 63, n + n // 4, np.uint64) * np.uint64(2) + rng.integers(0, 2, n + n // 4, np.uint64)
        yield np.sort(whole), np.sort(whole[:n])


def test_sketch_is_the_majority_of_votes():
    found = np.unique(np.random.default_rng(6).integers(0, 1 << 63, 700, np.uint64))
    want = sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in found) > len(found))
    got = resemblance.sketch(found)
    assert int(got[0]) == want == resemblance.fingerprint(found)
    assert len(got) == resemblance.WORDS and len(set(got.tolist())) == len(got)


def test_buckets_are_equal_bit_bands():
    """A bit of the SimHash decides on the bands it lies in, and on no others."""
    for nodes in (1000, 1 << 24):
        bands, most = resemblance.bands_for(nodes)
        assert len(bands) >= most and all(len(set(band)) == len(band) for band in bands.tolist())
        one = np.random.default_rng(7).integers(0, 1 << 63, (1, resemblance.WORDS), np.uint64)
        for bit in range(0, resemblance.BITS, 37):
            other = one.copy()
            other[0, bit // 64] ^= np.uint64(1 << bit % 64)
            changed = (resemblance.band_keys(one, bands) != resemblance.band_keys(other, bands))[0]
            assert changed.tolist() == [bit in band for band in bands.tolist()]
        for share, number in zip(resemblance.DIFFER, (len(bands), most)):
            assert resemblance.missed(bands.shape[1], number, share) <= resemblance.MISS


def test_similar_sets_share_a_band_and_are_near():
    rng = np.random.default_rng(8)
    bands, most = resemblance.bands_for(1000)
    for n, number, radius in zip((4, 8, 12, 40, 400), (len(bands), most, most, most, most), resemblance.NEAR_RADIUS + resemblance.NEAR_RADIUS[1:] * 3):
        both = np.array([[resemblance.sketch(x) for x in pair] for pair in pairs_at_the_limit(rng, n, 300)])
        differ = np.bitwise_count(both[:, 0] ^ both[:, 1])
        assert differ.sum() / differ.size / 64 <= resemblance.DIFFER[n > 5] + 0.005
        assert differ[:, : resemblance.NEAR].sum(axis=1).max() <= radius
        met = resemblance.band_keys(both[:, 0].copy(), bands) == resemblance.band_keys(both[:, 1].copy(), bands)
        assert met[:, :number].any(axis=1).all()


def test_parts_with_sizes_and_sketches_are_those_of_all_pairs():
    rng = np.random.default_rng(9)
    sketches = rng.integers(0, 1 << 63, (60, resemblance.NEAR), np.uint64)
    sketches = np.concatenate([sketches] * 4)
    sketches[60:] ^= rng.integers(0, 1 << 63, (180, resemblance.NEAR), np.uint64) & rng.integers(0, 1 << 63, (180, resemblance.NEAR), np.uint64) & rng.integers(0, 1 << 63, (180, resemblance.NEAR), np.uint64)
    sizes, keys = rng.integers(4, 9, len(sketches)), rng.integers(0, 4, len(sketches))
    order = np.lexsort((sizes, keys))
    sketches, sizes, keys = sketches[order], sizes[order], keys[order]

    def near(i, j):
        bits = [int(a ^ b).bit_count() for a, b in zip(sketches[i], sketches[j])]
        return bits[0] <= resemblance.RADIUS and sum(bits) <= resemblance.NEAR_RADIUS[int(min(sizes[i], sizes[j]) > 4)]

    pairs = [(i, j) for i, j in itertools.combinations(range(len(keys)), 2) if keys[i] == keys[j] and 4 * max(sizes[i], sizes[j]) <= 5 * min(sizes[i], sizes[j]) and near(i, j)]
    want = classes(list(range(len(keys))), pairs)
    got = resemblance.parts(keys, np.ascontiguousarray(sketches[:, 0]), sizes=sizes, sketches=sketches)
    assert got.tolist() == [want[i] for i in range(len(keys))] and len(set(want.values())) < len(keys) - 20

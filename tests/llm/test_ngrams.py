"""Set join by n-grams against brute force over all pairs."""

import itertools
import random

import numpy as np
import pytest

from apexframe.llm import ngrams
from apexframe.llm.graph import components
from apexframe.llm.queries import oracle_sql, queries

from tests.oracle import compare, connect

from .cases import FOLDER, ROWS, awkward
from .test_methods import classes
from .test_resemblance import edited, grams, similar

RARE = np.random.default_rng(1).integers(0, 4, 1 << ngrams.COUNTERS).astype(np.uint8)


def linked(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


@pytest.mark.parametrize("seed", range(40))
def test_trie_links_are_those_of_all_pairs(seed):
    rng = random.Random(seed)
    tokens = [rng.getrandbits(64) for _ in range(rng.choice((8, 20, 60, 400)))]
    made = set()
    for _ in range(rng.randrange(2, 40)):
        s = set(rng.choice(sorted(made))) if made and rng.random() < 0.7 else set(rng.sample(tokens, rng.randrange(1, len(tokens) + 1)))
        for _ in range(rng.randrange(4)):
            s.add(rng.choice(tokens))
            if len(s) > 1 and rng.random() < 0.6:
                s.discard(rng.choice(sorted(s)))
        made.add(tuple(sorted(s)))
    made = [set(s) for s in made]
    rows = [ngrams.ordered(np.array(sorted(s), np.uint64), RARE)[::-1] for s in made]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(made)), 2) if linked(made[i], made[j])]
    a, b = ngrams.joined(np.arange(len(made)), rows, RARE)
    assert classes(range(len(made)), zip(a.tolist(), b.tolist())) == classes(range(len(made)), pairs)
    assert len(a) < len(made)
    for i, j in pairs:  # linked sets meet in their prefixes
        x, y = (set(rows[k][::-1][: ngrams.prefix(len(rows[k]))].tolist()) for k in (i, j))
        assert x & y


def test_sets_of_one_class_are_not_walked():
    s = [np.array(sorted({1, 2, 3, 4, 5, k}), np.uint64) for k in (6, 7, 8)]
    a, _ = ngrams.joined(np.arange(3), s, RARE, np.array([5, 5, 5]))
    assert not len(a)


def brute(ids, texts):
    found = dict(zip(ids, map(grams, texts)))
    return classes(list(ids), [(a, b) for a, b in itertools.combinations(ids, 2) if found[a] and found[b] and similar(found[a], found[b])]), found


@pytest.mark.parametrize("block, block_grams", [(ngrams.BLOCK, ngrams.BLOCK_GRAMS), (2, 200)])
def test_edited_copies_at_every_block_size(spark, block, block_grams):
    texts = edited() + ["a b c d", "A b c D", "a b c d e", "", " \t", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, found = brute(range(len(texts)), texts)
    got = ngrams.similar_sets(docs, block=block, block_grams=block_grams).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {k: len(v) for k, v in found.items()}


def test_hot_group_of_copies_and_a_common_passage(spark):
    """Copies with edits, more than a block of them; and short texts that share 46 of about 58 n-grams, unlinked."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(150)]
    passage = " ".join(f"p{i}" for i in range(50))
    texts = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(150), rng.randrange(5)):
            words[at] = f"e{rng.randrange(10**6)}"
        texts += [" ".join(words), passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(13))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    want, _ = brute(range(len(texts)), texts)
    assert {r.doc_id: r.component_id for r in ngrams.similar_sets(docs, block=40).collect()} == want
    assert len(set(want.values())) > 150


def test_a_leader_takes_all_that_share(spark):
    data = [(1, [10, 11], []), (2, [11], [12]), (3, [], [12]), (3, [], [12]), (4, [13], [14])]
    rows = spark.createDataFrame(data, "fp long, grams array<long>, hot array<long>")
    assert sorted(map(tuple, ngrams.leaders(rows).collect())) == [(1, 1), (1, 2), (2, 2), (2, 3)]


def test_counters_cover_all_rows_alike(spark):
    docs = spark.createDataFrame([(i, f"one two three four five six word{i % 7}") for i in range(60)], "doc_id long, text string")
    one, many = (ngrams.rarity(ngrams.described(docs.repartition(n))[1]) for n in (1, 9))
    assert (one == many).all()
    common = ngrams.grams(b"one two three four five")
    assert one[int(common[0] >> np.uint64(64 - ngrams.COUNTERS))] == int(np.log2(61) * 8)


def test_awkward_rows(spark):
    got = ngrams.similar_sets(awkward(spark)).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert by[2] == {(0, 2)} and by[3] == {(0, 3)} and by[6] == {(0, 6)}  # without words: each alone
    assert {c for _, c in by[1] | by[5]} == {1}
    assert by[None] == {(1, None), (0, None)}
    assert ngrams.similar_sets(awkward(spark, [])).count() == 0


def test_hot_node_stays_in_place(spark):
    docs = spark.createDataFrame([(i, "the same text in all of these rows") for i in range(3000)] + [(5000, "another text that is alone here")], "doc_id long, text string")
    got = ngrams.similar_sets(docs)
    assert {(r.component_id, r["count"]) for r in got.groupBy("component_id").count().collect()} == {(0, 3000), (5000, 1)}


def test_query_is_its_sql(spark):
    assert compare(queries()["op11_ngram_join"](spark, FOLDER), connect(FOLDER), oracle_sql()["op11_ngram_join"]) is None

"""What the language model's look-ups fetch, and how equal symbols are brought together for scoring."""

import numpy as np

from apexframe.llm import mixture


def keys_of(text: bytes) -> np.ndarray:
    return mixture.symbols([text])[0]


def test_the_decisions_of_half_a_symbol_lie_in_sixteen_slots():
    found = mixture.Contexts(mixture.distinct(keys_of(b"the cat sat on the mat, 12 \xc3\xa9t\xc3\xa9 " * 9))[0])
    for k in range(mixture.PREDICTORS):
        for half in ((7, 6, 5, 4), (3, 2, 1, 0)):
            slots = np.stack([found.slots(k, bit)[0] for bit in half])
            assert (slots >> 4 == slots[0] >> 4).all()
            assert all(len(set(column)) == 4 for column in slots.T.tolist())
            assert mixture.OFFSETS[k] <= slots.min() and slots.max() < mixture.OFFSETS[k + 1]


def test_equal_keys_are_gathered_even_when_hashes_are_equal(monkeypatch):
    keys = np.random.default_rng(3).integers(0, 1 << 63, 500, np.uint64)[np.random.default_rng(4).integers(0, 500, 4000)]
    order, first = mixture.gathered(keys)
    assert sorted(order.tolist()) == list(range(4000)) and len(first) == len(set(keys.tolist()))
    model = mixture.Model(np.zeros((mixture.OFFSETS[-1], 2), np.uint16), mixture.fresh_weights(), mixture.empty_refine())
    mine, times = mixture.distinct(keys)
    mixture.Contexts(mine).count_into(model.counts, times)
    whole = mixture.code_lengths(model, mine)[np.searchsorted(mine, keys)]
    assert (mixture.Lengths(model).of(keys) == whole).all()
    monkeypatch.setattr(mixture, "SALT", np.uint64(0))  # all hashes are equal
    order, first = mixture.gathered(keys)
    assert order.tolist() == list(range(4000)) and len(first) > 3000
    model = mixture.Model(model.counts, model.weights, model.refine)
    expected = mixture.code_lengths(model, mine)[np.searchsorted(mine, keys)]
    assert (mixture.Lengths(model).of(keys) == expected).all()

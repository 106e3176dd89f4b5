"""What a worker holds: caches of other operators, Arrow's pool, and blocks of near copies."""

import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from apexframe.llm import common, resemblance, tokens

BYTE = public_tokenizers.path("byte_bpe_50k.json")
MB = 1 << 20


def peak(call):
    tracemalloc.start()
    try:
        out = call()
        return out, tracemalloc.get_traced_memory()[1] / MB
    finally:
        tracemalloc.stop()


def test_tasks_of_other_operators_empty_the_caches():
    batch = pa.record_batch({"text": ["some words"]})
    caches = [tokens._loaded, tokens._sizes, tokens._pieces, tokens._codes]
    tokens._codes.setdefault(BYTE, tokens.Codes(BYTE)).encode(batch["text"], tokens.split_units, 0)
    tokens.token_bytes(BYTE)
    assert list(common.slices(iter([batch]), "text", owner=tokens.OWNER)) == [batch] and all(caches)
    assert list(common.slices(iter([batch]), "text")) == [batch] and not any(caches)
    assert tokens.Codes(BYTE).encode(batch["text"], tokens.split_units, 0)[1].tolist() == [3]


READ = """
import pyarrow as pa
from apexframe.llm import common

def held():
    return int(next(x for x in open("/proc/self/status") if x.startswith("RssAnon")).split()[1]) / 1024

def read():
    for n in range(8):
        yield pa.record_batch({"text": pa.array(["x" * (3000 + 100 * n)] * 10_000)})

before, most, n = held(), 0, 0
for batch in common.slices(read(), "text"):
    n += batch.num_rows
    most = held()
assert n == 80_000
print(most - before)
"""


def test_memory_of_earlier_batches_goes_back():
    held = float(subprocess.run([sys.executable, "-c", READ], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout)
    assert held < 100  # batches have up to 37 MB


def test_sets_of_a_large_group_are_compared_in_parts():
    rng = np.random.default_rng(1)
    base, others = np.split(rng.choice(1 << 40, 9_000, replace=False).astype("<u8"), [400])
    found = [np.unique(np.concatenate((base, rng.choice(others, 20)))) for _ in range(4096)]
    (a, b), mb = peak(lambda: resemblance.bucket_links(np.arange(4096), found))
    assert a.tolist() == list(range(1, 4096)) and not b.any()
    assert mb < 150


def test_near_lanes_of_a_large_group_are_taken_apart_in_parts():
    sketches = np.tile(np.random.default_rng(1).integers(0, 1 << 63, resemblance.NEAR, np.uint64), (4096, 1))
    keys, sizes = np.zeros(4096, np.int64), np.full(4096, 50)
    label, mb = peak(lambda: resemblance.parts(keys, sketches[:, 0].copy(), resemblance.RADIUS, sizes, sketches))
    assert not label.any()
    assert mb < 50

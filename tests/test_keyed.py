"""Tables by key: buckets, replays, cut-off writes, appended pieces, streams."""

import datetime
import os
import random

import pytest
from apexframe.sources import keyed
from apexframe.streaming import jobs

KEYS = ["session_uid", "car"]
SCHEMA = "session_uid bigint, car int, first int, value int, seq bigint"


def files(path):
    return {f"{d}/{f}": (os.stat(f"{d}/{f}").st_mtime_ns, os.stat(f"{d}/{f}").st_ino) for d, _, fs in os.walk(f"{path}/data") for f in fs if f.endswith(".parquet")}


def batches(n=6, seed=1):
    rng = random.Random(seed)
    seq = 0
    for _ in range(n):
        rows = []
        for _ in range(rng.randrange(1, 30)):
            seq += 1
            rows.append((1 if rng.random() < 0.4 else rng.randrange(12), rng.randrange(4), seq, rng.randrange(100), seq))
        yield rows


@pytest.mark.parametrize("update", [True, False])
def test_merges_against_a_dict(spark, tmp_path, update):
    path, want = f"{tmp_path}/t", {}
    for i, rows in enumerate(batches()):
        assert keyed.merge(spark.createDataFrame(rows, SCHEMA), path, KEYS, "seq", update, "w", i, keep=("first",), buckets=8)
        known = set(want)
        for uid, car, first, value, _ in rows:
            if (uid, car) not in want:
                want[uid, car] = (first, value)
            elif update:
                want[uid, car] = (want[uid, car][0], value)
        assert known <= set(want)
        got = {(r.session_uid, r.car): (r.first, r.value) for r in keyed.read(spark, path).collect()}
        assert got == want and keyed.read(spark, path).count() == len(want)


def test_untouched_files_stay_and_replays_change_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    make = lambda uids, v: spark.createDataFrame([(u, k, v, v, v) for u in uids for k in range(3)], SCHEMA)
    keyed.merge(make(range(20), 1), path, KEYS, "seq", True, "w", 0, buckets=16)
    before = files(path)
    mine = keyed.State(spark, path)
    bucket = spark.createDataFrame([(7,)], "session_uid bigint").select(keyed.bucket_of(["session_uid"], 16).alias("b")).first().b
    assert keyed.merge(make([7], 2), path, KEYS, "seq", True, "w", 1, buckets=16)
    after = files(path)
    assert all(after[f] == s for f, s in before.items())  # old files are as they were, until retired
    now = keyed.State(spark, path)
    assert {b for b in now.pieces if now.pieces[b] != mine.pieces[b]} == {bucket}
    assert not keyed.merge(make([7], 9), path, KEYS, "seq", True, "w", 1, buckets=16)
    assert files(path) == after and {r.value for r in keyed.read(spark, path).where("session_uid = 7").collect()} == {2}
    assert keyed.merge(make([7], 9), path, KEYS, "seq", True, "other", 0, buckets=16)  # another writer's numbers are its own
    with pytest.raises(ValueError, match="buckets"):
        keyed.merge(make([7], 9), path, KEYS, "seq", True, "w", 5, buckets=4)


def test_a_write_that_was_cut_off(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    rows = lambda v: spark.createDataFrame([(1, 1, v, v, v)], SCHEMA)
    keyed.merge(rows(1), path, KEYS, "seq", True, "w", 0)
    with monkeypatch.context() as m:
        m.setattr(keyed.State, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            keyed.merge(rows(2), path, KEYS, "seq", True, "w", 1)
    assert [r.value for r in keyed.read(spark, path).collect()] == [1]
    assert keyed.merge(rows(3), path, KEYS, "seq", True, "w", 1)
    assert [r.value for r in keyed.read(spark, path).collect()] == [3]


def test_pieces_are_joined_and_old_ones_retired(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "PIECES", 3)
    path = f"{tmp_path}/t"
    for i in range(7):
        keyed.merge(spark.createDataFrame([(1, i, i, i, i)], SCHEMA), path, KEYS, "seq", False, "w", i, buckets=2, retain=2)
    state = keyed.State(spark, path)
    assert max(map(len, state.pieces.values())) <= 3
    assert sorted(r.car for r in keyed.read(spark, path).collect()) == list(range(7))
    named = {f for v in (state.version - 1, state.version) for f in keyed.State(spark, path, v).folders(path)}
    assert {os.path.dirname(f) for f in files(path)} == named


def test_empty_batches(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert keyed.read(spark, path) is None
    none = spark.createDataFrame([], SCHEMA)
    assert keyed.merge(none, path, KEYS, "seq", True, "w", 0) and keyed.read(spark, path) is None
    assert not keyed.merge(none, path, KEYS, "seq", True, "w", 0)


def test_stream_into_a_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    want = {}
    for i, rows in enumerate(batches(3, seed=4)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.drain(jobs.read_parquet(spark, f"{tmp_path}/in", SCHEMA), f"{tmp_path}/cp", sink=jobs.merge_sink(path, KEYS, "seq", True, buckets=8))
        want |= {(r[0], r[1]): r[3] for r in rows}
    assert {(r.session_uid, r.car): r.value for r in keyed.read(spark, path).collect()} == want
    state = keyed.State(spark, path)
    assert len(state.writers) == 1 and "batch" not in state.writers and max(state.writers.values()) >= 2  # one stream, by its own id


def test_gate_of_known_sessions(spark, tmp_path):
    """Packets ahead of and behind their session, the two streams in any order, against the batch rule."""
    schema = "session_uid bigint, recv_ts timestamp, recv_seq bigint"
    rng = random.Random(2)
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    opened = [(u, at(60 * u + 30), 1000 * (60 * u + 30)) for u in range(1, 6)] + [(u, at(60 * u + 50), 1000 * (60 * u + 50)) for u in range(1, 6)]
    sent = [(u, at(s), 1000 * s + i) for i in range(200) for u in [rng.randrange(1, 8)] for s in [rng.randrange(0, 500)]]
    for name, data in (("s", opened), ("p", sent)):
        rows = [(u, datetime.datetime.fromisoformat(t), q) for u, t, q in data]
        spark.createDataFrame(rows, "session_uid bigint, recv_ts timestamp, recv_seq bigint").write.parquet(f"{tmp_path}/{name}")
    stream = lambda n: jobs.read_parquet(spark, f"{tmp_path}/{n}", schema)
    jobs.drain(jobs.known_sessions(stream("p"), stream("s")), f"{tmp_path}/cp", path=f"{tmp_path}/out")
    first = {u: min(q for v, _, q in opened if v == u) for u in range(1, 6)}
    want = sorted((u, q) for u, _, q in sent if u in first and q >= first[u])
    assert sorted((r.session_uid, r.recv_seq) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == want and 0 < len(want) < len(sent)

"""Merkle manifests against trees built by hand."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from apexframe.llm import merkle
from apexframe.llm.queries import oracle_sql, queries

from tests.oracle import compare, connect

from .cases import FOLDER, ROWS, awkward


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """Root, and for each leaf its siblings level by level (None where it stands alone)."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            steps[leaf].append((i % 2 == 1, nodes[i ^ 1] if i ^ 1 < len(nodes) else None))
        nodes = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at = [i // 2 for i in at]
    return nodes[0], steps


def brute(rows):
    """rows (doc_id, source, lang, n_chars, text) -> list of (doc_id, leaf, subroot, root, steps)."""
    trees = {}
    for r in rows:
        trees.setdefault("n" if r[2] is None else "s" + r[2], []).append((r[0] is not None, r[0] or 0, H(*map(field, r)), r[0]))
    names = sorted(trees, key=lambda t: t.encode())
    built = {t: climb([leaf for _, _, leaf, _ in sorted(trees[t])]) for t in names}
    root, upper = climb([built[t][0] for t in names])
    return [
        (doc_id, leaf, built[t][0], root, own + up)
        for t, up in zip(names, upper) for (_, _, leaf, doc_id), own in zip(sorted(trees[t]), built[t][1])
    ]


def proofs(df, **options):
    got = merkle.manifest(df, **options)[1].collect()
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, [(bool(s.left), s.digest) if s.digest else (None, None) for s in r.steps]) for r in got), key=repr)


def expected(rows):
    return sorted(((*r[:4], [(a, d) if d else (None, None) for a, d in r[4]]) for r in brute(rows)), key=repr)


@pytest.mark.parametrize("sizes, bits", [((1,), 10), ((2, 3, 1), 1), ((4, 5, 0), 2), ((17, 9, 8), 3), ((64, 63, 65, 1, 2), 10)])
def test_trees_of_every_shape(spark, sizes, bits):
    rows = [(i * 7 % 1000 + 1000 * k, "é" * (i % 3), None if k == 1 else f"l{k}", i or None, f"text {i}") for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    assert proofs(df, bits=bits) == expected(rows)


def test_nodes_are_nested_intervals(spark):
    rows = [(i, "s", "ab"[i % 2], i, "t") for i in range(45)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    nodes = merkle.manifest(df, bits=2)[0].collect()
    by = {(n.tree, n.level, n.lo): n for n in nodes}
    assert len(by) == len(nodes)
    for n in nodes:
        parent = by.get((n.tree, n.level + 1, n.lo >> n.level + 1 << n.level + 1))
        assert (parent is None) == (n.lo == 0 and n.hi == n.n - 1)
        if parent:
            below = sorted((x for x in nodes if x.tree == n.tree and x.level == n.level and parent.lo <= x.lo and x.hi <= parent.hi), key=lambda x: x.lo)
            assert (below[0].lo, below[-1].hi) == (parent.lo, parent.hi) and len(below) <= 2
            assert parent.digest == H(*[x.digest for x in below])


def test_awkward_rows_and_ties(spark):
    df = awkward(spark)
    rows = [(r[0], r[3], r[2], len(r[1] or ""), r[1]) for r in ROWS]
    assert proofs(df) == expected(rows)
    assert proofs(awkward(spark, [])) == []
    renamed = df.withColumns({c: F.lit("x") for c in ("tree", "rank", "n", "digest", "place", "range", "level", "lo", "hi", "steps")})
    assert proofs(renamed) == expected(rows)


def test_tampering_is_found(spark):
    rows = [(i, "s", f"l{i % 3}", None if i % 5 == 0 else i, "t") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for r in merkle.manifest(df, change={"n_chars": F.col("n_chars") + 1})[1].withColumn("up", merkle.folded(F.col("changed"), F.col("steps"))).collect():
        assert (r.up == r.root) == (r.doc_id % 5 == 0)  # a null stays
    assert all(r.up == r.root for r in merkle.manifest(df)[1].withColumn("up", merkle.folded(F.col("leaf"), F.col("steps"))).collect())


def test_query_is_its_sql_and_tampers_by_checksum(spark):
    df = queries()["op12_merkle_manifest"](spark, FOLDER)
    assert compare(df, connect(FOLDER), oracle_sql()["op12_merkle_manifest"]) is None
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) for r in df.select("doc_id", "verified").collect())

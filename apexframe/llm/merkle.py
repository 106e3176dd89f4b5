"""Merkle manifest of a dataset: nested-interval labels and proofs by containment joins.

Leaves of a group lie by their rank; a node carries its level and the interval ``lo .. hi`` of the leaf ranks
under it. Levels are built in bands of ``BITS``: a task hashes blocks of at most ``2 ** BITS`` nodes up to one,
whose tops are the members of the next band, so no task holds more than a block and a dataset of any size needs
a handful of bands. A member's proof comes from joins on (tree, level, parent's bucket): of the nodes inside the
parent's interval the one that holds the rank is its ancestor, and the parent's interval without it is the
sibling. A bucket of a band is met by at most ``2 ** BITS`` members, so the upper levels, which all leaves
share, are joined by blocks and never by leaves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexframe.llm.common import stored

BITS = 10  # levels of a band: a block is at most 1,024 nodes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree string, level int, lo long, hi long, n long, digest string"
STEP = "array<struct<left: boolean, digest: string>>"
ONE_TREE = "roots"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def tree_key(group: Column) -> Column:
    """A key without nulls whose bytes sort as the group does, null first."""
    return F.coalesce(F.concat(F.lit("s"), group.cast("string")), F.lit("n"))


def ranked(rows: DataFrame, by: Sequence[str], what: str) -> DataFrame:
    """``rows`` with ``rank``, the place in its ``tree`` by the columns ``by``, nulls first, and ``n``, the size of
    the tree. The order is one range sort; what is summed over parts is one row for each tree and part."""
    order = [F.col(c).asc_nulls_first() for c in ("tree", *by)]
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), what)
    placed = placed.withColumn("range", F.shiftright("place", 33))
    runs = placed.groupBy("tree", "range").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("held"))
    own = Window.partitionBy("tree")
    ahead = F.coalesce(F.sum("held").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "range", (ahead - F.col("first")).alias("shift"), F.sum("held").over(own).alias("n"))
    return placed.join(runs, ["tree", "range"]).withColumn("rank", F.col("place") + F.col("shift")).drop("place", "range", "shift")


def _climb(base: int, bits: int):
    """Nodes of a band from its members, which come sorted by tree and rank, blocks whole."""

    def nodes_of(tree: str, at: int, n: int, digests: list[str]) -> Iterator[tuple]:
        members = -(-n >> base)
        top = base + (bits if members > 1 << bits else (members - 1).bit_length())
        first = at << base
        for level in range(base, top + 1):
            for i, d in enumerate(digests):
                lo = first + (i << level)
                yield tree, level, lo, min(lo + (1 << level), n) - 1, n, d
            digests = [sha256("".join(digests[i : i + 2]).encode()).hexdigest() for i in range(0, len(digests), 2)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch[c].to_pylist() for c in ("tree", "rank", "n", "digest")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for (tree, block), members in groupby(rows(batches), lambda r: (r[0], r[1] >> bits)):
            members = list(members)
            held += nodes_of(tree, block << bits, members[0][2], [m[3] for m in members])
            if len(held) >= 1 << 13:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], ["tree", "level", "lo", "hi", "n", "digest"])

    return run


def bands(members: DataFrame, bits: int = BITS) -> list[DataFrame]:
    """``members(tree, rank, n, digest)`` -> the nodes of each band; a band's top level has the members of the next."""
    found: list[DataFrame] = []
    base = 0
    while True:
        block = F.shiftright("rank", bits)
        dealt = members.select("tree", "rank", "n", "digest").repartition("tree", block).sortWithinPartitions("tree", "rank")
        found.append(stored(dealt.mapInArrow(_climb(base, bits), NODE), "nodes"))
        base += bits
        more = found[-1].where((F.col("level") == base) & (F.col("n") > 1 << base))
        if more.isEmpty():
            return found
        members = more.select("tree", F.shiftright("lo", base).alias("rank"), "n", "digest")


def _whole(nodes: DataFrame) -> DataFrame:
    """Nodes that cover their whole tree: its root, one for each tree."""
    return nodes.where("lo = 0 AND hi = n - 1")


def _shifted(column: str, by: Column) -> Column:
    return F.call_function("shiftright", F.col(column), by)


def siblings(nodes: DataFrame, base: int, bits: int) -> DataFrame:
    """``(tree, lo, steps)``: for each member of a band, its siblings in that band, level by level."""
    height = F.length(F.conv((F.col("n") - 1).cast("string"), 10, 2))  # bits of n - 1
    height = F.when(F.col("n") > 1, height).otherwise(0)
    members = nodes.where(F.col("level") == base).where(F.col("n") > 1 << base)
    last = F.least(height, F.lit(base + bits)) - 1
    each = members.select("tree", F.col("lo").alias("rank"), F.explode(F.sequence(F.lit(base), last)).alias("at"))
    each = each.withColumn("bucket", _shifted("rank", F.col("at") + 1))
    inside = nodes.select(F.col("tree").alias("t"), "level", "lo", "hi", "digest", _shifted("lo", F.col("level") + 1).alias("parent"))
    same = (F.col("tree") == F.col("t")) & (F.col("at") == F.col("level")) & (F.col("bucket") == F.col("parent"))
    apart = (F.col("rank") < F.col("lo")) | (F.col("rank") > F.col("hi"))
    met = each.join(inside, same & apart, "left")
    step = F.struct("at", (F.col("hi") < F.col("rank")).alias("left"), "digest")
    steps = met.groupBy("tree", F.col("rank").alias("lo")).agg(F.sort_array(F.collect_list(step)).alias("steps"))
    return steps.select("tree", "lo", F.transform("steps", lambda s: F.struct(s["left"].alias("left"), s["digest"].alias("digest"))).alias("steps"))


def paths(found: list[DataFrame], above: DataFrame, bits: int = BITS) -> DataFrame:
    """``(tree, rank, steps, ...)`` of each leaf: its siblings up to the root of its tree, then the ``steps`` of
    ``above(tree, steps, ...)``, whose other columns are passed down."""
    passed = [c for c in above.columns if c not in ("tree", "steps")]
    upper = None
    for k in range(len(found) - 1, -1, -1):
        base, nodes = k * bits, found[k]
        tops = _whole(nodes).select("tree").join(above, "tree").withColumn("block", F.lit(0).cast("long"))
        higher = tops if upper is None else tops.unionByName(upper.withColumn("block", F.shiftright("lo", base + bits)).drop("lo"))
        members = nodes.where(F.col("level") == base).select("tree", "lo", F.shiftright("lo", base + bits).alias("block"))
        own = members.join(siblings(nodes, base, bits), ["tree", "lo"], "left").withColumnRenamed("steps", "own")
        joined = own.join(higher, ["tree", "block"])
        steps = F.concat(F.coalesce("own", F.array().cast(STEP)), "steps")
        upper = stored(joined.select("tree", "lo", steps.alias("steps"), *passed), "paths")
    return upper.withColumnRenamed("lo", "rank")


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "lang", change: dict[str, Column] | None = None) -> DataFrame:
    """``(doc_id, tree, digest, changed)``: each row's leaf, and its leaf with the columns of ``change`` in place."""
    columns = {c: F.col(f"`{c}`") for c in fields}
    changed = digest((columns | (change or {})).values())
    return docs.select(F.col(f"`{key}`").alias("doc_id"), tree_key(F.col(f"`{group}`")).alias("tree"), digest(columns.values()).alias("digest"), changed.alias("changed"))


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "lang", change: dict[str, Column] | None = None, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """The manifest's nodes ``(tree, level, lo, hi, n, digest)`` and ``(doc_id, leaf, changed, subroot, root, steps)``
    of each row of ``docs``; ``steps`` holds a sibling (left of it or not, digest) for each level up to the root, with
    null for a level where the node stands alone.

    A null field is written ``-``; a null group is a tree of its own and the first; null ids come before all others;
    repeated rows are leaves of their own, and rows of equal id lie by their digests. An empty table gives no rows.
    The tree ``roots`` has the subroots as leaves, so its name is no key of a group ('n' or 's' and the group).
    """
    each = ranked(stored(leaves(docs, fields, key, group, change), "leaves"), ("doc_id", "digest"), "ranked")
    each = stored(each, "leaves")
    found = bands(each, bits)
    subroots = _union([_whole(f) for f in found]).select(F.col("tree").alias("name"), "digest")
    top = stored(ranked(subroots.select(F.lit(ONE_TREE).alias("tree"), "name", "digest"), ("name",), "ranked"), "subroots")
    high = bands(top, bits)
    root = _union([_whole(f) for f in high]).select("tree", F.col("digest").alias("root"), F.array().cast(STEP).alias("steps"))
    of = paths(high, root, bits).join(top, ["tree", "rank"]).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "steps")
    proofs = each.join(paths(found, of, bits), ["tree", "rank"])
    own = [f.where((F.col("level") < (k + 1) * bits) | (F.col("n") <= 1 << (k + 1) * bits)) for all_bands in (found, high) for k, f in enumerate(all_bands)]
    return _union(own), proofs.select("doc_id", F.col("digest").alias("leaf"), "changed", "subroot", "root", "steps")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    def up(node: Column, s: Column) -> Column:
        both = F.when(s["digest"].isNull(), node).when(s["left"], F.concat(s["digest"], node)).otherwise(F.concat(node, s["digest"]))
        return F.sha2(both.cast("binary"), 256)

    return F.aggregate(steps, leaf, up)


def proof_digest(steps: Column) -> Column:
    found = F.filter(F.transform(steps, lambda s: s["digest"]), lambda d: d.isNotNull())
    return F.sha2(F.array_join(found, "").cast("binary"), 256)

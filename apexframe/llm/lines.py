"""Line dedup by a deletion-neighbourhood join. DataFrame functions only.

A line is a sequence of words. Lines equal in words are duplicates; so are lines of at least five words
that one word edit (substitution, insertion, deletion) makes equal. Two such lines share their first or last half, so
only lines with a partner in a half go on; these emit, within that half's group, the other part with each
single word deleted, as hashed keys. Equal keys meet, the words are compared, and a line with an earlier
line, in document order, is removed. No key lists its pairs: it passes on its earliest line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexframe.llm.common import renamed, stored

LEAST_WORDS = 5
FULL, DELETED, REPLACED = 0, 1, 2
FILTER_BITS = 1 << 24
HOT_LINES = 2_000  # lines that are more than one in so many of all are fewer than so many: they go to all tasks


def _words(line: str) -> Column:
    return F.array_remove(F.split(line, r"[\x20\x09-\x0D]+"), "")


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    return renamed(docs, doc_id=key, text=text).withColumn("text_hash", F.xxhash64("text"))


def _exploded(rows: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, line_no, words, n)`` of every line."""
    each = rows.select("doc_id", "text_hash", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return each.select("doc_id", "text_hash", "line_no", _words("line").alias("words")).withColumn("n", F.size("words"))


def lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, text_hash, line_no, n, h1, h2, half0 to half3)`` of every line: (h1, h2) stands for its words,
    the halves, null for short lines, for what it shares with a line one edit away."""
    each = _exploded(_rows(docs, text, key))
    long, short = F.floor(F.col("n") / 2).cast("int"), F.floor((F.col("n") - 1) / 2).cast("int")
    part = lambda prefix, h: F.xxhash64(F.slice("words", F.lit(1), h) if prefix else F.slice("words", F.col("n") - h + 1, h))
    same = F.col("n") % 2 == 1
    each = each.withColumn("p", F.when(F.col("n") >= LEAST_WORDS, part(True, long))).withColumn("s", F.when(F.col("n") >= LEAST_WORDS, part(False, long)))
    halves = [  # a half's key holds the side and the words of the shorter line
        F.xxhash64(F.lit(True), "n", "p"), F.xxhash64(F.lit(True), F.col("n") - 1, F.when(same, F.col("p")).otherwise(part(True, short))),
        F.xxhash64(F.lit(False), "n", "s"), F.xxhash64(F.lit(False), F.col("n") - 1, F.when(same, F.col("s")).otherwise(part(False, short)))]
    return each.select(
        "doc_id", "text_hash", "line_no", "n", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2"),
        *[F.when(F.col("n") >= LEAST_WORDS, h).alias(f"half{i}") for i, h in enumerate(halves)])


def _among(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``rows`` whose long ``column`` may be in ``wanted``: a Bloom filter of fixed size, FILTER_BITS / 64 rows of 64
    bits, is sent to all tasks. Rows that only share a bit pass too; a join settles them."""
    place = lambda c: F.pmod(F.col(c), F.lit(FILTER_BITS))
    bits = wanted.select(place(column).alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit % 64 AS int))")).alias("_bits"))
    tested = rows.withColumn("_bit", place(column)).withColumn("_word", F.shiftright("_bit", 6)).join(F.broadcast(bits), "_word")
    return tested.where(F.getbit("_bits", (F.col("_bit") % 64).cast("int")) == 1).select(*rows.columns)


def _place() -> Column:
    """Order of lines: by document id (null last), text, line."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "line_no")


def _rest(prefix: Column, shorter: Column) -> Column:
    h = F.floor(shorter / 2).cast("int")
    return F.when(prefix, F.slice("words", h + 1, F.col("n") - h)).otherwise(F.slice("words", F.lit(1), F.col("n") - h))


def _without(words: Column, i: Column) -> Column:
    """``words`` without the i-th, from 1."""
    return F.concat(F.slice(words, F.lit(1), i - 1), F.slice(words, i + 1, F.size(words)))


def one_edit(a: Column, b: Column) -> Column:
    """Whether word lists are one substitution, insertion or deletion apart."""
    n, m = F.size(a), F.size(b)
    differ = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    longer, shorter = F.when(n > m, a).otherwise(b), F.when(n > m, b).otherwise(a)
    at = F.array_position(differ, True).cast("int")  # never 0 for lists of other lengths: a word meets null
    return F.when(n == m, F.size(F.filter(differ, lambda x: x)) == 1).when(F.abs(n - m) == 1, _without(longer, at) == shorter).otherwise(False)


def near_lines(docs: DataFrame, distinct: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(h1, h2)`` of the ``distinct`` lines with an earlier line one edit apart."""
    # halves: (key, whether the line is the longer of the pair); a line can be either
    sides = [(True, 0), (True, 1), (False, 0), (False, 1)]
    entries = F.array(*[F.struct(F.col(f"half{i}").alias("half"), F.lit(p).alias("prefix"), F.lit(d).alias("longer")) for i, (p, d) in enumerate(sides)])
    halves = distinct.where(F.col("n") >= LEAST_WORDS).select("h1", "h2", "n", F.explode(entries).alias("e")).select("h1", "h2", "e.*").where((F.col("longer") == 0) | (F.col("n") > LEAST_WORDS))
    counts = halves.groupBy("half").agg(F.sum(1 - F.col("longer")).alias("short"), F.sum("longer").alias("long"))
    counts = counts.select("half", (F.col("short") > 1).alias("replace"), ((F.col("short") > 0) & (F.col("long") > 0)).alias("delete"))
    paired = halves.join(counts.where("replace or delete"), "half").where("delete or (replace and longer = 0)")
    roles = paired.groupBy("h1", "h2").agg(F.collect_list(F.struct("half", "prefix", "longer", "replace", "delete")).alias("roles"))  # four at most
    known = stored(distinct.join(roles, ["h1", "h2"]).select("h1", "h2", "first", "first.text_hash", "first.line_no", "roles"), "near-roles")
    # the words of those lines, from where they first stand
    rows = _among(_rows(docs, text, key), "text_hash", known)
    texts = _exploded(rows).where(F.col("n") >= LEAST_WORDS).withColumn("first", _place())
    kept = texts.join(known, ["text_hash", "line_no", "first"]).select("h1", "h2", "first", "roles", "words", "n").dropDuplicates(["h1", "h2"])
    kept = stored(kept, "near-candidates")
    role = kept.select("h1", "h2", "first", "words", "n", F.explode("roles").alias("r"))
    role = role.select("h1", "h2", "first", "r.*", _rest(F.col("r.prefix"), F.col("n") - F.col("r.longer")).alias("rest"))
    at = F.sequence(F.lit(1), F.size("rest"))
    # hashing a list folds its words, so two pieces hash like their concatenation
    less = lambda i: (F.slice("rest", F.lit(1), i - 1), F.slice("rest", i + 1, F.size("rest")))
    entry = lambda kind, i, *words: F.struct(F.xxhash64("half", i, *words).alias("variant"), F.lit(kind).alias("kind"))
    none = F.array().cast("array<struct<variant: bigint, kind: int>>")
    variants = F.concat(
        F.when(F.col("delete") & (F.col("longer") == 0), F.array(entry(FULL, F.lit(0), F.col("rest")))).otherwise(none),
        F.when(F.col("delete") & (F.col("longer") == 1), F.transform(at, lambda i: entry(DELETED, F.lit(0), *less(i)))).otherwise(none),
        F.when(F.col("replace") & (F.col("longer") == 0), F.transform(at, lambda i: entry(REPLACED, i, *less(i)))).otherwise(none))
    keyed = role.select("h1", "h2", "first", "half", F.explode(F.array_distinct(variants)).alias("v")).select("h1", "h2", "first", "half", "v.*")
    best = F.struct("first", "h1", "h2")
    met = keyed.groupBy("half", "variant").agg(
        *[F.min(F.when(F.col("kind") == kind, best)).alias(f"b{kind}") for kind in (FULL, DELETED, REPLACED)], F.count(F.lit(1)).alias("rows")).where("rows > 1")
    other = F.when(F.col("kind") == FULL, F.col(f"b{DELETED}")).when(F.col("kind") == DELETED, F.col(f"b{FULL}")).otherwise(F.col(f"b{REPLACED}"))
    pairs = keyed.join(met, ["half", "variant"]).select("h1", "h2", "first", other.alias("o")).where("o.first < first")
    pairs = pairs.select("h1", "h2", F.col("o.h1").alias("o1"), F.col("o.h2").alias("o2")).distinct()
    mine = kept.select("h1", "h2", F.col("words").alias("a"))
    theirs = kept.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("words").alias("b"))
    return pairs.join(mine, ["h1", "h2"]).join(theirs, ["o1", "o2"]).where(one_edit(F.col("a"), F.col("b"))).select("h1", "h2").distinct()


def _marked_lines(each: DataFrame, marked: DataFrame) -> DataFrame:
    """``each`` line with what ``marked`` (h1, h2, first, near, times) holds of its words, null where nothing.

    Lines without words, and those so common that they are few, do not travel to meet their mark: however
    many rows a line has, they stay where they are.
    """
    marked = stored(marked, "marked-lines")
    total = marked.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    common = F.col("times") > total / HOT_LINES
    hot = F.broadcast(marked.where(common).drop("times"))
    blank = each.where("n = 0").withColumns({name: F.lit(None).cast(marked.schema[name].dataType) for name in ("first", "near")})
    full = each.where("n > 0")
    rest = full.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(marked.where(~common).drop("times"), ["h1", "h2"], "left")
    return rest.unionByName(full.join(hot, ["h1", "h2"])).unionByName(blank)


def duplicate_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, text_hash, n_lines, n_exact, n_near, removed)`` for each document with a text.

    n_exact lines equal an earlier line in words, n_near others are one word from an earlier line; removed
    lists their numbers, from 0, ascending. Lines without words are never removed. Earlier is by document
    id (null last), then line; whether the earlier line is itself removed does not matter. A null text is
    one line without words. Rows that repeat both id and text are one document with one row. An empty table
    gives no rows.
    """
    each = stored(lines(docs, text, key), "lines")
    full = each.where("n > 0").select("h1", "h2", "n", _place().alias("first"), *[f"half{i}" for i in range(4)])
    distinct = full.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("times"), F.first("n").alias("n"), *[F.first(f"half{i}").alias(f"half{i}") for i in range(4)])
    distinct = stored(distinct, "distinct-lines")
    near = near_lines(docs, distinct, text, key).withColumn("near", F.lit(True))
    marked = distinct.select("h1", "h2", "first", "times").join(near, ["h1", "h2"], "left").where("times > 1 or near").select("h1", "h2", "first", "times", F.coalesce("near", F.lit(False)).alias("near"))
    placed = _marked_lines(each.select("doc_id", "text_hash", "line_no", "h1", "h2", "n"), marked)
    exact = F.col("first").isNotNull() & (F.col("first") != _place())
    kind = F.when(F.col("n") == 0, 0).when(exact, 1).when(F.col("near"), 2).otherwise(0)
    # equal rows of a document give each line twice
    placed = placed.select("doc_id", "text_hash", "line_no", kind.alias("kind")).groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.when(F.col("kind") == 1, F.col("line_no"))).alias("exact"), F.collect_set(F.when(F.col("kind") == 2, F.col("line_no"))).alias("near"), (F.max("line_no") + 1).alias("n_lines"))
    return placed.select(
        "doc_id", "text_hash", F.col("n_lines").cast("long").alias("n_lines"), F.size("exact").cast("long").alias("n_exact"), F.size("near").cast("long").alias("n_near"),
        F.array_sort(F.concat("exact", "near")).alias("removed"))


def without_duplicate_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with the lines that ``duplicate_lines`` lists taken out of the text; all columns and rows stay."""
    found = duplicate_lines(docs, text, key).where("size(removed) > 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), F.col("removed").alias("_removed")).alias("r")
    left = docs.withColumn("_hash", F.xxhash64(text)).alias("d")
    joined = left.join(found, F.col(f"d.{key}").eqNullSafe(F.col("r._id")) & (F.col("d._hash") == F.col("r._h")), "left")
    kept = F.array_join(F.filter(F.split(F.col(f"d.{text}"), "\n"), lambda x, i: ~F.array_contains(F.col("r._removed"), i)), "\n")
    new = F.when(F.col("r._removed").isNull(), F.col(f"d.{text}")).otherwise(kept)
    return joined.select(*[(new.alias(c) if c == text else F.col(f"d.`{c}`")) for c in docs.columns])

"""Small tables with awkward rows, and reading of the given tables."""

import pyarrow.parquet as pq
from pyspark.sql import types as T

FOLDER = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 30_000
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use for columns of their own
    T.StructField("text_hash", T.StringType()), T.StructField("size", T.StringType()), T.StructField("part", T.StringType()), T.StructField("n_words", T.StringType()),
])
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, LONG, "en", "b"),
    (5, "The quick brown fox jumps over the lazy dog again", "en", "a"), (1, "The quick brown fox jumps over the lazy dog again", "en", "a"),
    (None, "a row without an id", "en", "c"), (6, "  \t\n \x0b", "en", None), (7, "Émile & 東京 😀 naïve\nline two\nline two", "fr", "b"),
    (8, "The quick brown cat jumps over the lazy dog again\n\nThe quick brown fox jumps over the lazy dog", "en", "a"), (None, None, None, None),
]


def awkward(spark, rows=None):
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", "z", "w") for r in rows], SCHEMA)


def documents():
    return pq.read_table(f"{FOLDER}/documents.parquet").to_pandas().sort_values("doc_id").reset_index(drop=True)

"""Every operator over nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from apexframe.llm import decontaminate, lines, mixing, mixture, quality, secrets, simhash, tokens, warc

from .cases import LONG, ROWS, awkward

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def benchmark(spark, rows=((1, "quick brown fox jumps over the lazy dog"), (2, None), (None, "lorem ipsum"), (3, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


@pytest.fixture(scope="module")
def field():
    return quality.fit([])


def test_simhash(spark):
    got = simhash.near_duplicates(awkward(spark)).collect()
    assert len(got) == len(ROWS)
    by = {(r.doc_id, r.text_hash): r for r in got}
    first = [r for r in got if r.doc_id in (1, 5)]
    assert {r.component_id for r in first} == {1} and len(first) == 3
    assert {r.component_id for r in got if r.fp == 0} == {2}  # null, empty and blank texts are one class
    assert sum(r.keeper for r in got) == len({(r.component_id) for r in got}) + 1  # the repeated row is told apart only when dropped
    assert len(by) == len(ROWS) - 1
    kept = simhash.drop_near_duplicates(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert kept.count() == len({r.component_id for r in got})
    assert simhash.near_duplicates(awkward(spark, [])).count() == 0
    assert simhash.near_duplicates(awkward(spark, [(None, None, None, None)])).first().component_id is None


def test_tokens(spark):
    _, got = tokens.binary_output(awkward(spark), BYTE)
    rows = got.orderBy("start").collect()
    assert len(rows) == len(ROWS)
    assert [r.doc_id for r in rows] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x or 0))
    ends = [r.start + r.n_tokens for r in rows]
    assert [r.start for r in rows] == [0, *ends[:-1]]
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {1}
    assert tokens.binary_output(awkward(spark, []), BYTE)[1].count() == 0
    counts = {r.doc_id: r for r in tokens.token_counts(awkward(spark), WORD).collect()}
    assert (counts[2].n_bytes, counts[2].n_tokens, counts[3].n_tokens, counts[6].n_tokens) == (0, 0, 0, 0)
    assert counts[4].over_limit and counts[4].n_bytes == len(LONG)
    assert tokens.token_counts(awkward(spark, []), WORD).count() == 0


def test_decontamination(spark):
    got = decontaminate.contamination(awkward(spark), benchmark(spark)).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert (by[1].n_words, by[1].n_hit, list(by[1].items)) == (10, 8, ["1"])
    assert list(by[4].items) == [""] and by[4].n_hit == 2 * 30_000
    assert by[2].n_words == 0 and by[8].n_hit == 8
    assert decontaminate.contamination(awkward(spark), benchmark(spark, [(1, None)])).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(awkward(spark), benchmark(spark).limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(awkward(spark, []), benchmark(spark)).count() == 0
    left = decontaminate.decontaminated(awkward(spark), benchmark(spark))
    assert left.columns == awkward(spark).columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 2, 3, 6, 7]


def test_mixing(spark):
    got = mixing.mixed(awkward(spark)).collect()
    assert len(got) == len(ROWS)
    assert {r.source for r in got} == {"a", "b", "c", None}
    assert all(r.copies <= 3 for r in got) and abs(sum({r.source: r.target for r in got}.values()) - sum(r.size for r in got)) < 1e-6
    assert mixing.mixed(awkward(spark, [])).count() == 0
    assert mixing.mixed(awkward(spark, [(1, None, None, None)])).first().target == 0
    order = mixing.training_order(awkward(spark))
    assert order.columns == [*awkward(spark).columns, "training_position"]
    assert order.count() == sum(r.copies for r in got)


def test_quality(spark, field):
    got = {r.doc_id: r for r in quality.quality(awkward(spark), field).collect()}
    assert (got[2].n_words, got[2].kept, got[2].base_failed) == (0, False, True)
    assert got[7].n_words == 9 and got[7].n_dup_lines == 1 and got[7].n_symbols == 1
    assert quality.quality(awkward(spark, []), field).count() == 0
    assert quality.filtered(awkward(spark), field).columns == awkward(spark).columns
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.fitted(awkward(spark), labels).start[1] > 0  # no sample: all lines are content


def test_secrets(spark):
    ratios = secrets.trained(awkward(spark))
    got = secrets.spans(awkward(spark), ratios).collect()
    assert len(got) == len(ROWS) and not any(r.base for r in got)
    assert secrets.spans(awkward(spark, []), ratios).count() == 0
    assert len(secrets.trained(awkward(spark, []))) == secrets.CLASSES**2


def test_lines(spark):
    rows = lines.duplicate_lines(awkward(spark)).collect()
    assert len(rows) == len(ROWS) - 1  # equal rows are one document
    got = {(r.doc_id, r.n_lines): r for r in rows}
    assert got[5, 1].removed == [0] and got[1, 1].removed == []
    assert got[7, 3].n_exact == 1 and got[8, 3].n_near == 2
    assert lines.duplicate_lines(awkward(spark, [])).count() == 0
    out = {r.doc_id: r.text for r in lines.without_duplicate_lines(awkward(spark)).collect() if r.doc_id}
    assert out[7] == "Émile & 東京 😀 naïve\nline two" and out[8] == "" and out[2] is None


def test_lm(spark):
    got = mixture.scores(awkward(spark)).collect()
    assert len(got) == len(ROWS)
    assert all(r.score < 0 and r.base_score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 6)} == {1}
    assert mixture.scores(awkward(spark, [])).count() == 0
    alone = mixture.scores(awkward(spark, [(12, "held out", None, None)])).first()  # crc32('12') % 5 != 1 or the model is empty
    assert alone.score < 0


def test_warc(spark):
    html = "<p>" + "x" * 200
    pages = [(3, "http://a.org/1", html), (2, "http://a.org/2", html), (2, "http://a.org/2", html), (4, None, None), (None, "http://b.org/\r\nx", html), (5, "http://a.org/1", "é\r\n\r\nWARC/1.1\r\n")]
    _, index = warc.archived(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, offset int"))
    got = index.orderBy("part", "place").collect()
    assert len(got) == len(pages) and [r.url_key for r in got] == sorted(r.url_key for r in got)
    kind = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in got}
    assert kind == {3: ("revisit", 2, 203), 2: ("response", None, 203), 4: ("response", None, 0), None: ("revisit", 2, 203), 5: ("response", None, 16)}
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(empty)[1].count() == 0


def test_text_of_words_only_in_other_columns(spark):
    docs = awkward(spark).withColumnRenamed("text", "body").withColumn("text", F.lit("other"))
    assert tokens.token_counts(docs, WORD, text="body").where("doc_id = 4").first().n_bytes == len(LONG)

"""Backups with a manifest, and export columns."""

import pytest
from pyspark.sql import functions as F

from apexframe.sources import tables as tb

c = F.col


def live(spark):
    sets = spark.createDataFrame([(1, 0, i, 16 + i % 3, None if i == 2 else "é") for i in range(6)], "session_uid bigint, car_index bigint, set_index bigint, visual_compound int, note string")
    return {
        "tyre_sets": sets, "sessions": spark.createDataFrame([(1, {"a": 1}), (2, None)], "session_uid bigint, extra map<string,int>"),
        "radio_messages": spark.createDataFrame([], "message_id bigint, text string"),
    }


def test_lost_rows_come_back_whole_and_in_order_of_keys(spark, tmp_path):
    tables = live(spark)
    tb.backup(tables, f"{tmp_path}/b")
    left = {n: df.where("false") if n != "tyre_sets" else df.where("set_index < 4") for n, df in tables.items()}
    back = tb.restore(spark, f"{tmp_path}/b", left)
    assert list(back) == ["sessions", "tyre_sets", "radio_messages"]
    assert [tuple(r) for r in back["tyre_sets"].orderBy("set_index").collect()] == [(1, 0, 4, 17, "é"), (1, 0, 5, 18, "é")]
    assert {r.session_uid: r.extra for r in back["sessions"].collect()} == {1: {"a": 1}, 2: None} and back["radio_messages"].count() == 0


@pytest.mark.parametrize("name", ["tyre_sets", "radio_messages"])
def test_damaged_tables_are_refused(spark, tmp_path, name):
    tables = live(spark)
    tb.backup(tables, f"{tmp_path}/b")
    more = {"tyre_sets": tables["tyre_sets"].limit(1), "radio_messages": spark.createDataFrame([(1, "x")], "message_id bigint, text string")}
    more[name].write.mode("append").parquet(f"{tmp_path}/b/{name}")
    with pytest.raises(ValueError, match=name):
        tb.restore(spark, f"{tmp_path}/b", tables)


def test_a_changed_value_is_noticed(spark, tmp_path):
    tables = live(spark)
    tb.backup(tables, f"{tmp_path}/b")
    tb.backup(tables | {"tyre_sets": tables["tyre_sets"].withColumn("visual_compound", F.when(c("set_index") == 3, 9).otherwise(c("visual_compound")))}, f"{tmp_path}/other")
    changed = spark.read.parquet(f"{tmp_path}/other/tyre_sets")
    changed.write.mode("overwrite").parquet(f"{tmp_path}/b/tyre_sets")  # as many rows, one value changed
    with pytest.raises(ValueError, match="tyre_sets"):
        tb.restore(spark, f"{tmp_path}/b", tables)


def test_export_has_all_columns(spark):
    radio = spark.createDataFrame([(1, 5, 3, "2024-01-02 03:04:05", None)], "message_id bigint, session_uid bigint, track_id int, sent_at string, rendered_text string").withColumn("sent_at", c("sent_at").cast("timestamp"))
    r = tb.radio_export(radio, spark.createDataFrame([(5, "Ada")], "session_uid bigint, driver_name string")).first()
    assert r.__fields__ == list(tb.RADIO_HEADER)
    assert (r.message_id, r.sent_at, r.driver_name, r.rendered_text, r.best_strategies) == ("1", "2024-01-02 03:04:05", "Ada", "", "")


def test_tracks_with_data_joins_session_ids_once(spark, capsys):
    """The sectors of a session are reduced to its id before they are joined."""
    import datetime

    from apexframe.operators import readiness as rd

    at = datetime.datetime(2024, 5, 6, 7, 8, 9)
    sessions = spark.createDataFrame([(1, 3, at), (2, 4, at)], "session_uid long, track_id long, created_at timestamp")
    out = rd.tracks_with_data(sessions, spark.createDataFrame([(1,)] * 50, "session_uid long"))
    assert [(r.track_id, r.last_at) for r in out.collect()] == [(3, "2024-05-06T07:08:09")]
    out.explain()
    assert capsys.readouterr().out.split("Initial Plan")[-1].count("HashAggregate(keys=[session_uid") == 2


def test_marks_tell_nulls_apart(spark):
    """A value that moves to another column, or a null, changes a table's mark; the hash takes columns as they are."""
    schema = "a string, b string, m map<string, int>"
    rows = [[("x", None, None)], [(None, "x", None)], [("x", None, {"k": 1})], [(None, None, None)], [("x", "x", None)]]
    marks = [tb.summary(spark.createDataFrame(r, schema)).first().mark for r in rows]
    assert len(set(marks)) == len(rows)
    flat = tb._marked(spark.createDataFrame(rows[0], schema).drop("m"))
    assert "to_json" not in flat._jdf.queryExecution().optimizedPlan().toString()

"""Late rows are counted and set aside; an append never fails its caller and appears once."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from marketlens.streaming import event_log, late_rows, usage_stream

SCHEMA = "event_id bigint, occurred_at timestamp, view_name string"


def _at(day, hour=1):
    return dt.datetime(2024, 1, day, hour)


def _stream(spark, landing):
    ss = usage_stream.stream_session(spark, 2)
    return ss.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(landing)


def _land(spark, rows, landing):
    spark.createDataFrame(rows, spark.createDataFrame([], SCHEMA).schema).coalesce(1).write.mode("append").parquet(landing)


def test_late_rows_counted_and_kept(spark):
    folder = tempfile.mkdtemp(prefix="ml-late-rows-")
    landing = os.path.join(folder, "landing")
    _land(spark, [(1, _at(1), "a"), (2, _at(5), "a"), (3, None, "a")], landing)
    # mark 5 January 01:00, a day's delay: days that had ended by the 4th, 01:00, are late
    _land(spark, [(4, _at(3, 23), "a"), (5, _at(4), "a"), (6, _at(9), "b")], landing)
    _land(spark, [(7, _at(7), "a"), (8, _at(8), "a"), (8, _at(8), "a"), (9, _at(2), "b")], landing)
    query, base = late_rows.run_counts(_stream(spark, landing), "t", root=folder)
    query.awaitTermination()
    got = {r.day and r.day.day: (r.events, r.dropped) for r in late_rows.daily(spark, base).collect()}
    assert got == {1: (1, 0), 5: (1, 0), None: (1, 0), 3: (0, 1), 4: (1, 0), 9: (1, 0), 7: (0, 1), 8: (2, 0), 2: (0, 1)}
    kept = sorted((r.event_id, r.batch_id) for r in late_rows.late_rows(spark, base).collect())
    assert kept == [(4, 1), (7, 2), (9, 2)]
    # a later run goes on from the marks of the first
    _land(spark, [(10, _at(3), "a"), (11, _at(9), "a")], landing)
    query, _ = late_rows.run_counts(_stream(spark, landing), "t", root=folder)
    query.awaitTermination()
    got = {r.day and r.day.day: (r.events, r.dropped) for r in late_rows.daily(spark, base).collect()}
    assert got[3] == (0, 2) and got[9] == (2, 0)


def test_replayed_batch_counts_once(spark):
    folder = tempfile.mkdtemp(prefix="ml-late-replay-")
    landing = os.path.join(folder, "landing")
    _land(spark, [(1, _at(9), "a")], landing)
    _land(spark, [(2, _at(1), "a"), (3, _at(20), "a")], landing)
    query, base = late_rows.run_counts(_stream(spark, landing), "t", root=folder)
    query.awaitTermination()
    before = sorted(map(tuple, late_rows.daily(spark, base).collect()))
    # what a driver lost between the sink and its own commit does again
    again = spark.createDataFrame([(2, _at(1), "a"), (3, _at(20), "a")], SCHEMA)
    late_rows.write_batch(again, 1, base, dt.timedelta(days=1))
    assert sorted(map(tuple, late_rows.daily(spark, base).collect())) == before
    assert before == [(dt.date(2024, 1, 1), 0, 1), (dt.date(2024, 1, 9), 1, 0), (dt.date(2024, 1, 20), 1, 0)]
    assert late_rows.late_rows(spark, base).count() == 1


def test_append_that_fails_waits_and_appears_once(spark):
    base = tempfile.mkdtemp(prefix="ml-event-log-")
    schema = spark.createDataFrame([], SCHEMA).schema
    failing = [True, True]

    def write(df, path):
        event_log._write(df, path)
        if failing and failing.pop():
            raise OSError("storage went away half-way")      # the rows are there, their commit is not
    log = event_log.EventLog(spark, base, schema, limit=3, write=write)
    assert event_log.read(spark, base, schema).count() == 0 and log.flush() == 0
    assert [log.offer((i, _at(1 + i), "a")) for i in range(4)] == [True, True, True, False]
    assert log.lost == 1
    assert log.flush() == 0 and len(log.failures) == 1 and "OSError" in log.failures[0]
    assert event_log.read(spark, base, schema).count() == 0
    assert log.offer((9, _at(9), "b"))
    assert log.flush() == 0 and len(log.failures) == 2
    assert log.flush() == 4                                   # the waiting batch, then what came since
    got = event_log.read(spark, base, schema)
    assert sorted(r.event_id for r in got.collect()) == [0, 1, 2, 9] and got.schema.fieldNames() == schema.fieldNames()
    assert event_log.commits(spark, base).agg(F.sum("events")).first()[0] == 4


def test_batch_appended_again_appears_once(spark):
    base = tempfile.mkdtemp(prefix="ml-event-log-")
    rows = spark.createDataFrame([(1, _at(1), "a"), (1, _at(1), "a"), (2, None, None)], SCHEMA)
    assert event_log.append_batch(rows, base, "one")
    assert not event_log.append_batch(rows, base, "one")
    assert event_log.append_batch(rows.limit(1), base, "1/2 = %2F")
    assert event_log.read(spark, base, rows.schema).count() == 4
    with pytest.raises(ValueError):
        event_log.append_batch(rows, base, "")

"""Usage measures: structure, gap fill, no fan-out, streaming equals batch."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from marketlens.operators import usage
from marketlens.sources import testmart
from marketlens.streaming import usage_stream

EMPTY = "event_id long, occurred_at timestamp, view_name string, soc_code string, area_code string, session_id string, detail string"


def test_window_has_exactly_n_days(usage_log):
    rows = usage.usage_by_day(usage_log, 30, "2024-01-30").collect()
    assert len(rows) == 30 and rows[0].day == dt.date(2024, 1, 1)


def test_empty_log(spark, market):
    log = spark.createDataFrame([], EMPTY)
    days = usage.usage_by_day(log, 7, "2024-01-30").collect()
    assert len(days) == 7 and all(r.events == 0 for r in days)
    assert usage.usage_by_view(log, 30, "2024-01-30").count() == 0
    (s,) = usage.usage_summary(log, 30, "2024-01-30").collect()
    assert s.total_events == 0 and s.sessions == 0


def test_one_event_counted_once(spark, market):
    log = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 30, 12), "index", "Brand#3", "0", "s1", None)], EMPTY)
    (r,) = usage.top_requests(log, market, 30, "2024-01-30").collect()
    assert (r.soc_code, r.events, r.sessions, r.occupation) == ("Brand#3", 1, 1, "Role 3")


def test_unlabelled_category_falls_back(spark, market):
    log = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 30, 12), "index", "Brand#99", "0", "s1", None)], EMPTY)
    (r,) = usage.top_requests(log, market, 30, "2024-01-30").collect()
    assert (r.occupation, r.occupation_group) == ("Brand#99", "Unknown")


def test_headline_share(spark):
    rows = [(i, dt.datetime(2024, 1, 30), "a" if i < 70 else "b", None, None, str(i), None)
            for i in range(100)]
    (h,) = usage.usage_headline(spark.createDataFrame(rows, EMPTY), 30, "2024-01-30").collect()
    assert h.top_view == "a" and h.top_view_share == pytest.approx(0.7) and h.concentrated


def test_days_must_be_positive(usage_log):
    with pytest.raises(ValueError):
        usage.usage_by_day(usage_log, 0, "2024-01-30")


def test_stream_equals_batch_over_many_files(spark):
    ev = testmart.table(spark, "/root/testdata/sf0.001", "events")
    folder = tempfile.mkdtemp(prefix="ml-events-")
    # land the events as one file per day, then stream one file per trigger
    (ev.withColumn("d", F.to_date("ts")).repartition("d").write.mode("overwrite")
     .partitionBy("d").parquet(os.path.join(folder, "landing")))
    stream = usage_stream.events_stream(spark, os.path.join(folder, "landing"), max_files=3)
    got = usage_stream.materialize(usage_stream.daily_counts(stream, "30 days"), "t", ["day"])
    want = usage_stream.usage_from_events(ev).groupBy(F.to_date("occurred_at").alias("day")).count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_batch_append(spark, usage_log):
    path = os.path.join(tempfile.mkdtemp(prefix="ml-append-"), "log")
    usage_stream.append_events(usage_log.limit(10), path)
    usage_stream.append_events(usage_log.limit(5), path)
    assert spark.read.parquet(path).count() == 15


def test_stream_sessions_exact_over_many_batches(spark):
    ev = testmart.table(spark, "/root/testdata/sf0.001", "events")
    folder = tempfile.mkdtemp(prefix="ml-sess-")
    (ev.withColumn("d", F.to_date("ts")).repartition("d").write.mode("overwrite")
     .partitionBy("d").parquet(os.path.join(folder, "landing")))
    ss = usage_stream.stream_session(spark, 4)
    stream = usage_stream.events_stream(ss, os.path.join(folder, "landing"), max_files=2)
    got = usage_stream.materialize(usage_stream.view_sessions(stream, "30 days"), "s",
                                   ["day", "view_name"])
    want = (usage_stream.usage_from_events(ev)
            .groupBy(F.to_date("occurred_at").alias("day"), "view_name")
            .agg(F.countDistinct("session_id").alias("sessions")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def _land(frames, folder):
    for df in frames:                    # one file per frame, in arrival order
        df.coalesce(1).write.mode("append").parquet(folder)


def _between(ev, lo, hi):
    return ev.where((F.col("ts") >= F.lit(lo).cast("timestamp_ntz"))
                    & (F.col("ts") < F.lit(hi).cast("timestamp_ntz")))


def test_late_rows_behind_watermark_are_dropped(spark):
    ev = testmart.table(spark, "/root/testdata/sf0.001", "events")
    landing = os.path.join(tempfile.mkdtemp(prefix="ml-late-"), "landing")
    recent, more, late = (_between(ev, "2024-01-20", "2024-01-25"),
                          _between(ev, "2024-01-25", "2024-02-01"),
                          _between(ev, "2024-01-01", "2024-01-05"))
    _land([recent, more, late], landing)
    ss = usage_stream.stream_session(spark, 2)
    stream = usage_stream.events_stream(ss, landing, max_files=1)
    query, sink = usage_stream.run_to_table(usage_stream.daily_counts(stream, "1 day"), "late", ["day"])
    query.awaitTermination()
    assert sum(p["numInputRows"] for p in query.recentProgress) == ev.count() - \
        _between(ev, "2024-01-05", "2024-01-20").count()            # the late rows were read ...
    got = usage_stream.latest(ss, sink, ["day"])
    assert got.where(F.col("day") < F.lit("2024-01-05").cast("date")).count() == 0   # ... and dropped
    assert got.agg(F.sum("events")).first()[0] == recent.count() + more.count()


def test_recreated_window_never_replaces_full_count(spark):
    """Late rows one batch after the watermark moved slip through and re-create an
    evicted day with a partial count; the sink keeps the full count."""
    ev = testmart.table(spark, "/root/testdata/sf0.001", "events")
    landing = os.path.join(tempfile.mkdtemp(prefix="ml-recreate-"), "landing")
    early, later, again = (_between(ev, "2024-01-01", "2024-01-03"),
                           _between(ev, "2024-01-20", "2024-02-01"),
                           _between(ev, "2024-01-01", "2024-01-02").limit(3))
    _land([early, later, later.limit(1), again], landing)
    ss = usage_stream.stream_session(spark, 2)
    stream = usage_stream.events_stream(ss, landing, max_files=1)
    query, sink = usage_stream.run_to_table(usage_stream.daily_counts(stream, "1 day"), "re", ["day"])
    query.awaitTermination()
    got = {r.day.isoformat(): r.events for r in usage_stream.latest(ss, sink, ["day"]).collect()}
    jan1 = _between(ev, "2024-01-01", "2024-01-02").count()
    assert got["2024-01-01"] >= jan1                    # never the partial re-count


def test_stream_append_sink(spark):
    folder = tempfile.mkdtemp(prefix="ml-sink-")
    ss = usage_stream.stream_session(spark, 2)
    stream = usage_stream.events_stream(ss, "/root/testdata/sf0.001/events.parque[t]")
    q = usage_stream.stream_append(stream, os.path.join(folder, "log"), os.path.join(folder, "ckpt"))
    q.processAllAvailable()
    q.stop()
    n = spark.read.parquet(os.path.join(folder, "log")).count()
    assert n == testmart.table(spark, "/root/testdata/sf0.001", "events").count()


def test_stopped_stream_goes_on_where_it_was(spark):
    ev = testmart.table(spark, "/root/testdata/sf0.001", "events")
    root = tempfile.mkdtemp(prefix="ml-resume-")
    landing = os.path.join(root, "landing")
    ev.where("event_id % 2 = 0").write.parquet(landing)
    read = []
    for _ in range(2):
        stream = usage_stream.events_stream(usage_stream.stream_session(spark, 2), landing)
        query, sink = usage_stream.run_to_table(
            usage_stream.daily_counts(stream, "60 days"), "resume", ["day"], root=root)
        query.awaitTermination()
        read.append(sum(p["numInputRows"] for p in query.recentProgress))
        ev.where("event_id % 2 = 1").write.mode("append").parquet(landing)
    assert sum(read) == ev.count() and min(read) > 0        # nothing is read again
    got = {r.day: r.events for r in usage_stream.latest(spark, sink, ["day"]).collect()}
    want = {r.day: r.n for r in ev.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_stream_session_takes_over_settings(spark):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "12345")
    try:
        assert usage_stream.stream_session(spark, 3).conf.get("spark.sql.files.maxRecordsPerFile") == "12345"
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")

"""Usage measures over the event log as Structured Streaming jobs (Q7d, Q8s, I24).

* :func:`events_stream` reads event files as they land (``maxFilesPerTrigger``
  bounds each micro-batch) and maps them to the usage-log columns.
* :func:`daily_counts` is the streaming twin of Q7: a 1-day event-time window
  with a watermark; rows older than the watermark are read but dropped (they
  never reach the result), and state for closed days is evicted.
* :func:`view_stats` / :func:`view_sessions` are the streaming twins of Q8:
  events and last event per (day, view), and exact distinct sessions through a
  watermark-bounded deduplication (a HyperLogLog estimate is optional).
* :func:`run_to_table` executes a streaming aggregate in update mode through
  ``foreachBatch``: each micro-batch's changed rows are written under
  ``batch_id=N`` (overwrite, so a replayed batch is idempotent) and
  :func:`latest` resolves the current value per key. A run with a ``root`` of its
  own resumes there after a restart.
* :func:`append_events` / :func:`stream_append` are the event-append sinks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketlens.session import ensure_checkpoint_dir


def usage_from_events(ev: DataFrame) -> DataFrame:
    """Driver ``events`` rows -> usage-log columns (batch or stream). Event time is
    a UTC ``TIMESTAMP`` (watermarks require it)."""
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("occurred_at"),
        F.col("event_type").alias("view_name"),
        F.when(k % 10 != 0, F.concat(F.lit("Brand#"), k.cast("string"))).alias("soc_code"),
        (F.col("user_id") % 25).cast("string").alias("area_code"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("props").alias("detail"))


def stream_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session for a streaming query whose state-store partition count is sized for
    the stream (it is fixed at the first start and kept in the checkpoint), not
    inherited from the batch shuffle setting: the cluster's cores unless given. Shares
    the SparkContext and takes over the session's own runtime settings."""
    child = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            child.conf.set(key, value)
    n = state_partitions or max(1, spark.sparkContext.defaultParallelism)
    child.conf.set("spark.sql.shuffle.partitions", str(n))
    child.conf.set("spark.sql.session.timeZone", "UTC")
    return child


def events_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of usage-log rows from event Parquet files under ``path`` (a folder
    or a glob)."""
    sample = spark.read.parquet(path)              # schema only (metadata)
    reader = spark.readStream.schema(sample.schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return usage_from_events(reader.parquet(path))


def daily_counts(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    return (stream.withWatermark("occurred_at", watermark)
            .groupBy(F.window("occurred_at", "1 day").alias("w"))
            .agg(F.count(F.lit(1)).alias("events"))
            .select(F.to_date(F.col("w.start")).alias("day"), "events"))


def view_stats(stream: DataFrame, watermark: str = "1 day",
               approx_sessions: float | None = None) -> DataFrame:
    """Events and last event per (day, view); ``approx_sessions=rsd`` adds a
    HyperLogLog session estimate in the same aggregate."""
    aggs = [F.count(F.lit(1)).alias("events"), F.max("occurred_at").alias("last_seen")]
    if approx_sessions:
        aggs.append(F.approx_count_distinct("session_id", approx_sessions).alias("sessions_approx"))
    out = (stream.withWatermark("occurred_at", watermark)
           .groupBy(F.window("occurred_at", "1 day").alias("w"), "view_name").agg(*aggs))
    cols = ["events", F.col("last_seen").cast("timestamp_ntz").alias("last_seen")]
    if approx_sessions:
        cols.append("sessions_approx")
    return out.select(F.to_date(F.col("w.start")).alias("day"), "view_name", *cols)


def view_sessions(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Exact distinct sessions per (day, view): each (day window, view, session) is
    kept once by a deduplication whose key carries the event-time window, so its
    state is evicted as the watermark passes; the count of the survivors is exact."""
    first = (stream.withWatermark("occurred_at", watermark)
             .withColumn("w", F.window("occurred_at", "1 day"))
             .dropDuplicates(["w", "view_name", "session_id"])
             .where(F.col("session_id").isNotNull()))
    return (first.groupBy("w", "view_name").agg(F.count(F.lit(1)).alias("sessions"))
            .select(F.to_date(F.col("w.start")).alias("day"), "view_name", "sessions"))


def run_to_table(agg: DataFrame, name: str, keys: list[str], root: str | None = None,
                 trigger_available_now: bool = True) -> tuple[StreamingQuery, str]:
    """Run a streaming aggregate (update mode) into an idempotent per-batch sink.

    With ``root`` the checkpoint and sink are ``root/streams/name``: a later run under the same
    root and name goes on where the last one stopped. Without it the run is a single one in a new
    folder of the shared checkpoint folder."""
    spark = agg.sparkSession
    base = (f"{root.rstrip('/')}/streams/{name}" if root else
            f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}")
    sink = f"{base}/sink"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}"))

    writer = (agg.writeStream.outputMode("update").foreachBatch(write_batch)
              .option("checkpointLocation", f"{base}/checkpoint"))
    writer = writer.trigger(availableNow=True) if trigger_available_now else writer
    return writer.start(), sink


def latest(spark: SparkSession, sink: str, keys: list[str], monotone: bool = True) -> DataFrame:
    """Current value per key from the per-batch sink.

    Late-event filtering uses the previous batch's watermark, so rows arriving
    right after the watermark moved can re-create a day window whose state was
    already evicted; update mode then emits that window with a *partial* value.
    For monotone measures (counts, maxima, distinct counts) the largest emitted
    value per column is the final one, and a re-created partial never wins.
    ``monotone=False`` takes the row of the latest batch instead.
    """
    rows = spark.read.parquet(sink)
    values = [c for c in rows.columns if c not in keys and c != "batch_id"]
    if monotone:
        return rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v"))
    return picked.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])


def materialize(agg: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run the stream over everything available now and return its result table
    (the measures here are monotone; see :func:`latest`)."""
    query, sink = run_to_table(agg, name, keys)
    query.awaitTermination()
    return latest(agg.sparkSession, sink, keys)


def append_events(events: DataFrame, path: str) -> None:
    """I24 (batch): append rows to the event log, partitioned by day."""
    (events.withColumn("day", F.to_date("occurred_at"))
     .write.mode("append").partitionBy("day").parquet(path))


def stream_append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """I24 (stream): exactly-once file sink for landing events."""
    return (stream.withColumn("day", F.to_date("occurred_at"))
            .writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).partitionBy("day")
            .outputMode("append").start())

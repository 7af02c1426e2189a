"""Daily counts that also count and set aside late rows (Q7d).

The built-in watermark drops late rows without keeping them, and its metric counts
rows after partial aggregation. Here each micro-batch is split by the mark that the
batches before it left behind: a row is late if its day had ended, plus the allowed
delay, at the latest event time seen before its batch. A batch writes its late rows and
then its counts, each under ``batch_id=N`` (overwritten by a replay); the counts carry
the batch's latest event time, so the mark of a replayed batch is the same again. No
state grows with the stream but one row a batch, day and verdict.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketlens.session import ensure_checkpoint_dir

COUNTS = "day date, late boolean, events bigint, last_at timestamp, batch_id bigint"


def _mark(spark: SparkSession, base: str, batch_id: int) -> dt.datetime | None:
    """Latest event time of the batches before this one."""
    if batch_id == 0:
        return None
    seen = spark.read.schema(COUNTS).parquet(f"{base}/counts").where(F.col("batch_id") < batch_id)
    return seen.agg(F.max("last_at")).first()[0]


def is_late(mark: dt.datetime | None, delay: dt.timedelta):
    """Whether a row's day had ended, ``delay`` ago, when its batch began; rows without a time never are."""
    if mark is None:
        return F.lit(False)
    day_end = F.date_trunc("day", "occurred_at") + F.expr("INTERVAL 1 DAY")
    return F.coalesce(day_end <= F.lit(mark - delay), F.lit(False))


def write_batch(batch: DataFrame, batch_id: int, base: str, delay: dt.timedelta) -> None:
    """The late rows of a micro-batch, then its counts; written again by a replay."""
    late = is_late(_mark(batch.sparkSession, base, batch_id), delay)
    batch.where(late).write.mode("overwrite").parquet(f"{base}/late/batch_id={batch_id}")
    (batch.groupBy(F.to_date("occurred_at").alias("day"), late.alias("late"))
     .agg(F.count(F.lit(1)).alias("events"), F.max("occurred_at").alias("last_at"))
     .write.mode("overwrite").parquet(f"{base}/counts/batch_id={batch_id}"))


def run_counts(stream: DataFrame, name: str, delay: dt.timedelta = dt.timedelta(days=1),
               root: str | None = None) -> tuple[StreamingQuery, str]:
    """Start the counts over all that is available now; the second value is the base for ``daily`` and
    ``late_rows``. With ``root`` a later run goes on where the last one stopped."""
    spark = stream.sparkSession
    base = (f"{root.rstrip('/')}/streams/{name}" if root else
            f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}")
    query = (stream.writeStream.foreachBatch(lambda batch, i: write_batch(batch, i, base, delay))
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    return query, base


def daily(spark: SparkSession, base: str) -> DataFrame:
    """Per day the events counted in time and those dropped as late; together every row read. Rows
    without a time are counted under the null day."""
    counts = spark.read.schema(COUNTS).parquet(f"{base}/counts")
    return counts.groupBy("day").agg(
        F.coalesce(F.sum(F.when(~F.col("late"), F.col("events"))), F.lit(0)).alias("events"),
        F.coalesce(F.sum(F.when(F.col("late"), F.col("events"))), F.lit(0)).alias("dropped"))


def late_rows(spark: SparkSession, base: str) -> DataFrame:
    """The rows set aside, with the batch that met them."""
    return spark.read.parquet(f"{base}/late")

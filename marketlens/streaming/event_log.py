"""An event log whose append never fails its caller.

A caller offers events to a bounded hand-off and goes on; ``flush`` writes what was
offered as one batch. A batch is written under a folder of the attempt and becomes
readable by a commit record that names the attempt, so an attempt that died half-way is
never read, and a batch that is written again after its commit appears once. What fails is kept for
the next flush under the same batch key, and reported aside::

    base/data/batch=<key>/attempt=<id>/day=<date>/part-*.parquet
    base/commits/<key>/part-*.json              (written last; an existing one is never replaced)
"""

from __future__ import annotations

import logging
import queue
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = logging.getLogger(__name__)
COMMIT = "batch string, attempt string, events bigint"


def _write(events: DataFrame, path: str) -> None:
    events.withColumn("day", F.to_date("occurred_at")).write.partitionBy("day").parquet(path)


def commits(spark: SparkSession, base: str) -> DataFrame:
    """One row per committed batch; a log without one has none."""
    try:
        return spark.read.schema(COMMIT).json(f"{base.rstrip('/')}/commits/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def append_batch(events: DataFrame, base: str, key: str,
                 write: Callable[[DataFrame, str], None] = _write) -> bool:
    """Append ``events`` as batch ``key``, once however often it is called; False if it was there already.
    Raises what the storage raises. One writer a key at a time."""
    if not key:
        raise ValueError("a batch needs a key")
    spark, base = events.sparkSession, base.rstrip("/")
    if not commits(spark, base).where(F.col("batch") == key).isEmpty():
        return False
    attempt = uuid.uuid4().hex
    folder = quote(key, safe="")                  # readers of partition folders undo it
    path = f"{base}/data/batch={folder}/attempt={attempt}"
    write(events, path)
    n = events.sparkSession.read.schema(events.schema).parquet(path).count()
    record = spark.createDataFrame([(key, attempt, n)], COMMIT)
    record.coalesce(1).write.mode("error").json(f"{base}/commits/{folder}")
    return True


def read(spark: SparkSession, base: str, schema: T.StructType) -> DataFrame:
    """The rows of committed attempts; the commit records prune the folders of all others. ``schema`` has no
    columns ``batch``, ``attempt`` or ``day``."""
    base = base.rstrip("/")
    done = commits(spark, base).select("batch", "attempt")
    if done.isEmpty():
        return spark.createDataFrame([], schema)
    # stated types: a folder name such as 12e4 is a string here, not a number
    full = T.StructType([*schema.fields, T.StructField("batch", T.StringType()), T.StructField("attempt", T.StringType())])
    rows = spark.read.schema(full).option("basePath", f"{base}/data").parquet(f"{base}/data")
    return rows.join(done, ["batch", "attempt"], "left_semi").select(*schema.fieldNames())


@dataclass
class EventLog:
    """A hand-off of at most ``limit`` events in front of a log. ``offer`` and ``flush`` never raise.

    ``lost`` counts events that came when the hand-off was full, ``failures`` holds the last ``kept`` errors."""

    spark: SparkSession
    base: str
    schema: T.StructType
    limit: int = 10_000
    kept: int = 20
    write: Callable[[DataFrame, str], None] = _write
    lost: int = 0
    failures: list[str] = field(default_factory=list)

    def __post_init__(self):
        self._offered: queue.Queue = queue.Queue(self.limit)
        self._pending: tuple[str, list] | None = None     # a batch whose write failed, with its key

    def offer(self, event: tuple) -> bool:
        """Take one event without waiting; False, and counted, if the hand-off is full."""
        try:
            self._offered.put_nowait(event)
            return True
        except queue.Full:
            self.lost += 1
            return False

    def flush(self) -> int:
        """Write the batch that failed last, then what was offered since; the number of events now in the log
        by this call. A failing write is reported aside and tried again by the next call."""
        written = self._hand_over() if self._pending else 0
        if self._pending is None:
            rows = []
            while len(rows) < self.limit:
                try:
                    rows.append(self._offered.get_nowait())
                except queue.Empty:
                    break
            if rows:
                self._pending = (uuid.uuid4().hex, rows)
                written += self._hand_over()
        return written

    def _hand_over(self) -> int:
        key, rows = self._pending
        try:
            append_batch(self.spark.createDataFrame(rows, self.schema), self.base, key, self.write)
        except Exception as e:  # noqa: BLE001  the caller's work goes on whatever the log's storage does
            self.failures = [*self.failures, f"{key}: {type(e).__name__}: {str(e)[:200]}"][-self.kept:]
            LOG.warning("events of batch %s wait for the next flush: %s", key, type(e).__name__)
            return 0
        self._pending = None
        return len(rows)

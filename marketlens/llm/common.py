"""Shared helpers: written tables that cut lineage, session set-up, Arrow plumbing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from marketlens.session import configure, ensure_checkpoint_dir

#: Rows of one Arrow batch; small enough that a batch of very long texts fits in a Python worker.
BATCH_ROWS = 256
#: Bytes of text that one NumPy pass works on.
BLOCK_BYTES = 1 << 21


def prepare(spark: SparkSession, rows: int = BATCH_ROWS) -> SparkSession:
    """Session settings that the operators of this subpackage count on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    configure(spark)
    return spark


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the cluster's shared checkpoint folder and read it again:
    one materialisation, lineage cut, readable by every executor."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text",
                limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text (one row at least); null text
    becomes the empty text."""
    for batch in batches:
        k = batch.schema.get_field_index(column)
        text = pc.fill_null(batch.column(k).cast(pa.large_string()), "")
        batch = batch.set_column(k, pa.field(column, pa.large_string()), text)
        size = pc.binary_length(text).to_numpy(zero_copy_only=False)
        first, held = 0, 0
        for i, n in enumerate(size):
            if i > first and held + n > limit:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        if first < batch.num_rows:
            yield batch.slice(first)


def labels_by_doc(labels: DataFrame) -> DataFrame:
    """One row per labelled document: the worst quality and toxicity stated for it."""
    from pyspark.sql import functions as F
    return (labels.where("doc_id IS NOT NULL").groupBy("doc_id")
            .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")))


#: A side is broadcast only up to this many rows, counted first.
BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint if a count shows at most ``limit`` (narrow) rows; otherwise the join shuffles."""
    from pyspark.sql import functions as F
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df

"""The per-category measures as published aggregates, maintained incrementally.

Layout under ``base``::

    base/data/measure=<m>/batch=<b>/part-*.parquet    rows of the categories computed in that batch
    base/state/<attempt>/part-*.parquet               (soc_code, fingerprint, batch): which batch holds a category
    base/_commits/version=<v>/part-*.json             written last, names the state

Every measure of a category follows from that category's own fact rows, so a publish hashes each
category's rows, recomputes only the categories whose hash is new, and lets the state point the others
at the batch that already holds them: unchanged rows are neither recomputed nor rewritten. All measures
of a version become visible with its marker. An attempt writes only into folders of its own, so a failed or
concurrent publish can't touch what a marker names. When a state would refer to more than ``MAX_BATCHES``
batches, the rows of the smallest ones are copied into the new batch.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens import schema
from marketlens.operators import competition, pool
from marketlens.plans.publish import PublishError
from marketlens.session import ensure_checkpoint_dir, shuffle_partitions

#: Batches that one state refers to at most.
MAX_BATCHES = 8
#: Part of every definition: raised when a measure changes its meaning, so that all is recomputed.
FORMAT = 1
MARKER = ("version string, committed_at string, state string, definition string, "
          "recomputed bigint, carried bigint, removed bigint")
STATE = "soc_code string, fingerprint string, batch string"


@dataclass(frozen=True)
class Measure:
    """``compute(market)`` gives one row per market row of a category that ``keeps`` it."""

    compute: Callable[[DataFrame], DataFrame]
    keeps: str = "true"


def measures(min_employment: float | None = None, weights: dict[str, float] | None = None) -> dict[str, Measure]:
    """The published measures (Q1, Q5) with their parameters."""
    floor = schema.MIN_EMPLOYMENT_FOR_INDEX if min_employment is None else min_employment
    return {"competition_index": Measure(lambda m: competition.competition_index(m, floor, weights),
                                         f"employment >= {float(floor)}"),
            "talent_pool": Measure(pool.talent_pool_summary)}


def definition(min_employment: float | None = None, weights: dict[str, float] | None = None) -> str:
    floor = schema.MIN_EMPLOYMENT_FOR_INDEX if min_employment is None else min_employment
    return json.dumps({"format": FORMAT, "floor": float(floor), "weights": weights or schema.INDEX_WEIGHTS}, sort_keys=True)


def fingerprints(market: DataFrame) -> DataFrame:
    """``(soc_code, fingerprint)``: row count and two independent sums of row hashes, so neither the order of
    rows nor where a null stands is lost, and repeated rows count. One partially aggregated pass."""
    cells = [F.col(c) for c in schema.MARKET_COLUMNS]
    cells += [c.isNull() for c in cells]
    return market.groupBy("soc_code").agg(F.concat_ws(
        "-", F.count(F.lit(1)), F.sum(F.xxhash64(*cells).cast("decimal(20,0)")),
        F.sum(F.xxhash64(F.lit("second"), *cells).cast("decimal(20,0)"))).alias("fingerprint"))


def _markers(spark: SparkSession, base: str) -> DataFrame:
    try:
        return spark.read.schema(MARKER).json(f"{base.rstrip('/')}/_commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MARKER)


def history(spark: SparkSession, base: str) -> DataFrame:
    """``(step, version, recomputed, carried, removed)`` of every committed publish, numbered from the oldest.
    One small row a publish: all of them are folded into one array to be numbered."""
    rows = _markers(spark, base).agg(F.sort_array(F.collect_list(F.struct(
        "committed_at", "version", "recomputed", "carried", "removed"))).alias("all"))
    return (rows.select(F.posexplode("all").alias("at", "r"))
            .select((F.col("at") + 1).alias("step"), "r.version", "r.recomputed", "r.carried", "r.removed"))


def _committed(spark: SparkSession, base: str, version: str | None):
    rows = _markers(spark, base)
    if version is not None:
        rows = rows.where(F.col("version") == version)
    return rows.orderBy(F.col("committed_at").desc(), F.col("version").desc()).first()


def _state(spark: SparkSession, base: str, marker) -> DataFrame:
    if marker is None:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(f"{base.rstrip('/')}/state/{marker['state']}")


def _rows(state: DataFrame, base: str, name: str, measure: Measure) -> DataFrame:
    """The rows of ``measure`` that ``state`` refers to: its batches' folders alone are listed and read."""
    spark = state.sparkSession
    empty = measure.compute(spark.createDataFrame([], schema.MARKET_SCHEMA))
    batches = [r["batch"] for r in state.select("batch").distinct().collect()]      # at most MAX_BATCHES + 1
    if not batches:
        return empty
    root = f"{base.rstrip('/')}/data/measure={name}"
    held = (spark.read.schema(T.StructType([*empty.schema, T.StructField("batch", T.StringType())])).option("basePath", root)
            .parquet(*[f"{root}/batch={b}" for b in sorted(batches)]))
    return held.join(state.select("soc_code", "batch"), ["soc_code", "batch"], "left_semi").select(*empty.columns)


def read(spark: SparkSession, base: str, name: str, version: str | None = None, **parameters) -> DataFrame:
    """A published measure at its newest (or the given) committed version."""
    marker = _committed(spark, base, version)
    if marker is None:
        raise LookupError(f"no committed aggregate under {base}" + (f" with version {version}" if version else ""))
    return _rows(_state(spark, base, marker), base, name, measures(**parameters)[name])


def _check(written: DataFrame, expected: DataFrame, name: str) -> None:
    """Every recomputed category has as many rows as its market rows ask for, one for each place."""
    got = written.groupBy("soc_code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("area_code").alias("places"))
    wrong = (expected.join(got, "soc_code", "full")
             .where("coalesce(n, 0) <> coalesce(wanted, 0) OR coalesce(places, 0) <> coalesce(n, 0)").limit(10).collect())
    if wrong:
        raise PublishError(f"{name} rejected: rows of {', '.join(r['soc_code'] for r in wrong)} don't match the "
                           "market; the previous version stays live", wrong)


def publish(market: DataFrame, base: str, version: str | None = None, **parameters) -> dict:
    """Publish every measure of ``market``, recomputing only categories whose rows changed since the last
    committed version (all of them if the parameters changed). Returns the marker."""
    spark, base = market.sparkSession, base.rstrip("/")
    v = version or dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    if not _markers(spark, base).where(F.col("version") == v).isEmpty():
        raise PublishError(f"version {v} is committed; a committed version is never rewritten", [])
    attempt = f"{v}-{uuid.uuid4().hex}"
    wanted, meaning = measures(**parameters), definition(**parameters)
    last = _committed(spark, base, None)
    old = _state(spark, base, last)
    known = old if last is not None and last["definition"] == meaning else old.where(F.lit(False))

    # one row a category: what it is now, and the batch that already holds exactly that
    ensure_checkpoint_dir(spark)
    now = (fingerprints(market).join(known, ["soc_code", "fingerprint"], "left")
           .select("soc_code", "fingerprint", "batch").checkpoint(eager=True))
    sizes = {r["batch"]: r["n"] for r in now.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}
    new = sizes.pop(None, 0)
    kept = sorted(sizes, key=lambda b: (-sizes[b], b))[:MAX_BATCHES - 1] if len(sizes) >= MAX_BATCHES else list(sizes)
    folded = sorted(set(sizes) - set(kept))
    changed = now.where("batch IS NULL").select("soc_code")
    moved = now.where(F.col("batch").isin(folded)) if folded else None

    facts = market.join(changed, "soc_code", "left_semi")
    parts = max(1, shuffle_partitions(spark))
    for name, measure in wanted.items():
        if not new and moved is None:
            continue
        out = f"{base}/data/measure={name}/batch={attempt}"
        rows = measure.compute(facts)
        if moved is not None:
            rows = rows.unionByName(_rows(moved, base, name, measure))
        (rows.repartitionByRange(parts, "soc_code", "area_code").sortWithinPartitions("soc_code", "area_code")
         .write.mode("errorifexists").parquet(out))
        due = facts.groupBy("soc_code").agg(F.count_if(F.expr(measure.keeps)).alias("wanted")).where("wanted > 0")
        _check(spark.read.schema(rows.schema).parquet(out).join(changed, "soc_code", "left_semi"), due, name)
    state = now.withColumn("batch", F.when(F.col("batch").isin(kept), F.col("batch")).otherwise(F.lit(attempt)))
    state.write.mode("errorifexists").parquet(f"{base}/state/{attempt}")
    removed = old.join(now, "soc_code", "left_anti").count()
    marker = {"version": v, "committed_at": dt.datetime.now(dt.timezone.utc).isoformat(timespec="microseconds"),
              "state": attempt, "definition": meaning, "recomputed": new, "carried": sum(sizes.values()), "removed": removed}
    (spark.createDataFrame([marker], MARKER).coalesce(1).write.mode("errorifexists").json(f"{base}/_commits/version={v}"))
    return marker

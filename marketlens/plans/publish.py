"""All-or-nothing publish of the two marts.

Layout under ``base``::

    base/version=<v>/market/occupation_group=.../part-*.parquet
    base/version=<v>/skills/part-*.parquet
    base/_commits/version=<v>/part-*.json        (written last)

A version becomes visible only when its commit marker exists, and the marker is
written only after both tables are on storage and every fatal rule passed on
what was actually written. Readers resolve the newest committed version; a
failed or interrupted publish leaves the previous version live. Storage paths
come from the caller (a shared, cluster-visible location).
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens import schema
from marketlens.operators import quality
from marketlens.session import shuffle_partitions


class PublishError(RuntimeError):
    def __init__(self, message: str, report: list):
        super().__init__(message)
        self.report = report


def write_market(market: DataFrame, path: str) -> None:
    """Parquet, partitioned by family, rows range-clustered by (family, category,
    place) so a hot family spreads over several writers and every file's
    min/max statistics on ``soc_code`` are tight (row-group skipping)."""
    parts = max(1, shuffle_partitions(market.sparkSession))
    (market.repartitionByRange(parts, "occupation_group", "soc_code", "area_code")
     .sortWithinPartitions("occupation_group", "soc_code", "area_code")
     .write.mode("overwrite").partitionBy("occupation_group").parquet(path))


def write_skills(skills: DataFrame, path: str) -> None:
    parts = max(1, shuffle_partitions(skills.sparkSession))
    (skills.repartitionByRange(parts, "soc_code", "skill")
     .sortWithinPartitions("soc_code", "skill").write.mode("overwrite").parquet(path))


def _commits(base: str) -> str:
    return f"{base.rstrip('/')}/_commits"


def committed_versions(spark: SparkSession, base: str) -> DataFrame:
    """Committed versions; a base without a commit has none. Any other storage error is raised."""
    try:
        return spark.read.schema("version string, committed_at string").json(_commits(base))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "version string, committed_at string")


def latest_version(spark: SparkSession, base: str) -> str | None:
    """The version committed last, whatever its name."""
    row = committed_versions(spark, base).agg(F.max(F.struct("committed_at", "version"))).first()
    return row[0]["version"] if row and row[0] else None


def read_published(spark: SparkSession, base: str, version: str | None = None
                   ) -> tuple[DataFrame, DataFrame]:
    v = version or latest_version(spark, base)
    if v is None:
        raise LookupError(f"no committed version under {base}")
    root = f"{base.rstrip('/')}/version={v}"
    market = spark.read.schema(schema.MARKET_SCHEMA).parquet(f"{root}/market")
    skills = spark.read.schema(schema.SKILLS_SCHEMA).parquet(f"{root}/skills")
    return market.select(*schema.MARKET_COLUMNS), skills


def publish(market: DataFrame, skills: DataFrame, base: str, scope: DataFrame | None = None,
            version: str | None = None) -> str:
    """Write a new version, validate what was written, then commit it."""
    spark = market.sparkSession
    v = version or dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    root = f"{base.rstrip('/')}/version={v}"
    if not committed_versions(spark, base).where(F.col("version") == v).isEmpty():
        raise PublishError(f"version {v} is committed; a committed version is never rewritten", [])
    write_market(market, f"{root}/market")
    write_skills(skills, f"{root}/skills")
    written_m = spark.read.schema(schema.MARKET_SCHEMA).parquet(f"{root}/market")
    written_s = spark.read.schema(schema.SKILLS_SCHEMA).parquet(f"{root}/skills")
    fatal = quality.fatal_violations(quality.quality_report(written_m, written_s, scope)).collect()
    if fatal:
        raise PublishError(f"version {v} rejected: {len(fatal)} fatal rule(s) failed; "
                           "the previous version stays live", fatal)
    quality.version_metrics(written_m, written_s).write.mode("overwrite").parquet(_metrics(base, v))
    marker = spark.range(1).select(F.lit(v).alias("version"),
                                   F.lit(dt.datetime.now(dt.timezone.utc).isoformat(timespec="microseconds"))
                                   .alias("committed_at"))
    marker.coalesce(1).write.mode("errorifexists").json(f"{_commits(base)}/version={v}")
    return v


def _metrics(base: str, version: str) -> str:
    return f"{base.rstrip('/')}/_metrics/version={version}"


def version_history(spark: SparkSession, base: str) -> DataFrame:
    """D17 over the committed versions: ``(committed_at, version, metric, value, typical, score, outlier)``, see
    :func:`quality.drift_history`. Metrics were written with each version, so its tables aren't read again;
    an attempt that was never committed isn't part of the series."""
    commits = committed_versions(spark, base)
    if commits.isEmpty():
        series = spark.createDataFrame([], "version string, committed_at string, metric string, value double")
    else:
        kept = spark.read.schema("metric string, value double, version string").parquet(f"{base.rstrip('/')}/_metrics")
        series = kept.join(commits, "version")
    return quality.drift_history(series)


def analyze(spark: SparkSession, table_name: str) -> None:
    """Refresh optimizer statistics of a catalog table."""
    spark.sql(f"ANALYZE TABLE {table_name} COMPUTE STATISTICS FOR ALL COLUMNS")


def ready(spark: SparkSession, base: str) -> bool:
    """A committed version exists and both of its tables are non-empty."""
    try:
        market, skills = read_published(spark, base)
    except LookupError:
        return False
    return not market.isEmpty() and not skills.isEmpty()


def publish_tables(market: DataFrame, skills: DataFrame, name: str = "ml",
                   buckets: int | None = None, scope: DataFrame | None = None,
                   version: str | None = None) -> str:
    """Publish both marts as catalog tables bucketed and sorted by ``soc_code``.

    Every measure partitions by the category key, so a bucketed scan already
    satisfies that distribution: windows and joins on ``soc_code`` over the
    published tables run without an exchange. Versioned tables are written and
    validated first; then the view ``{name}_live``, which names both tables of a version,
    is switched in one step (D12). ``read_tables`` goes through it. The stable names
    (``{name}_market``, ``{name}_skills``) follow it for readers of one table.
    """
    spark = market.sparkSession
    v = version or dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    n = buckets or max(1, shuffle_partitions(spark))
    m_table, s_table = f"{name}_market_v{v}", f"{name}_skills_v{v}"
    (market.write.bucketBy(n, "soc_code").sortBy("soc_code", "area_code")
     .mode("errorifexists").saveAsTable(m_table))
    (skills.write.bucketBy(n, "soc_code").sortBy("soc_code", "skill")
     .mode("errorifexists").saveAsTable(s_table))
    fatal = quality.fatal_violations(
        quality.quality_report(spark.table(m_table), spark.table(s_table), scope)).collect()
    if fatal:
        raise PublishError(f"version {v} rejected: {len(fatal)} fatal rule(s) failed; "
                           "the previous version stays live", fatal)
    analyze(spark, m_table)                      # D13: statistics for the optimizer
    analyze(spark, s_table)
    spark.sql(f"CREATE OR REPLACE VIEW {name}_live AS SELECT '{m_table}' AS market, '{s_table}' AS skills")
    spark.sql(f"CREATE OR REPLACE VIEW {name}_market AS SELECT * FROM {m_table}")
    spark.sql(f"CREATE OR REPLACE VIEW {name}_skills AS SELECT * FROM {s_table}")
    return v


def read_tables(spark: SparkSession, name: str = "ml") -> tuple[DataFrame, DataFrame]:
    """Both tables of the live version, named by one view, so never of two versions."""
    live = spark.table(f"{name}_live").first()
    return spark.table(live["market"]), spark.table(live["skills"])

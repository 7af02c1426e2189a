"""Metrics of committed versions and a robust test over their series."""
import tempfile

import pytest
from pyspark.sql import functions as F

from marketlens.operators import quality
from marketlens.plans import publish


def _series(spark, values, metric="m"):
    rows = [(f"v{i}", f"2024-01-{i + 1:02d}", metric, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "version string, committed_at string, metric string, value double")


def test_only_the_value_off_the_series_is_an_outlier(spark):
    got = {r.version: r for r in quality.drift_history(_series(spark, [100.0, 101.0, 99.0, 100.5, 150.0])).collect()}
    assert [v for v, r in sorted(got.items()) if r.outlier] == ["v4"]
    assert got["v4"].typical == 100.5 and abs(got["v4"].score - 49.5 / (0.5 * 1.4826)) < 1e-9    # median deviation 0.5


def test_a_series_that_stands_still(spark):
    still = quality.drift_history(_series(spark, [3.0, 3.0, 3.0 + 4e-15, 3.0])).collect()
    assert not any(r.outlier for r in still) and all(r.score is None for r in still)
    jump = {r.version: r.outlier for r in quality.drift_history(_series(spark, [3.0, 3.0, 3.0, 4.0])).collect()}
    assert jump == {"v0": False, "v1": False, "v2": False, "v3": True}


def test_single_null_and_no_versions(spark):
    assert [r.outlier for r in quality.drift_history(_series(spark, [5.0])).collect()] == [False]
    got = {r.version: r for r in quality.drift_history(_series(spark, [5.0, None, 5.0])).collect()}
    assert got["v1"].outlier is None and got["v1"].score is None and got["v0"].outlier is False
    assert publish.version_history(spark, tempfile.mkdtemp(prefix="ml-none-")).collect() == []


def test_history_holds_committed_versions_only(spark, market, skills):
    base = tempfile.mkdtemp(prefix="ml-hist-")
    publish.publish(market, skills, base, version="a")
    with pytest.raises(publish.PublishError):
        publish.publish(market.withColumn("employment", F.lit(-1.0)), skills, base, version="bad")
    publish.publish(market.where("soc_code <> 'Brand#11'"), skills.where("soc_code <> 'Brand#11'"), base, version="b")
    rows = publish.version_history(spark, base).collect()
    assert {r.version for r in rows} == {"a", "b"} and len(rows) == 16
    count = {(r.version, r.metric): r.value for r in rows}
    assert count["a", "market_rows"] == market.count() and count["b", "categories"] <= count["a", "categories"]

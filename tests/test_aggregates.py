"""Published measures are maintained incrementally and become visible as one version."""
import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from marketlens.operators import competition, pool
from marketlens.plans import aggregates
from marketlens.plans.publish import PublishError


def _same(a, b):
    cols = b.columns
    assert a.columns == cols
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(cols).collect()))


def _batches(base, name="competition_index"):
    return {os.path.basename(p).split("=")[1].split("-")[0] for p in glob.glob(f"{base}/data/measure={name}/batch=*")}


@pytest.fixture
def base():
    return tempfile.mkdtemp(prefix="ml-agg-")


@pytest.fixture(scope="module")
def cats(market):
    return sorted(r.soc_code for r in market.select("soc_code").distinct().collect())


def _touched(market, soc, factor):
    return market.withColumn("employment_per_1k", F.when(F.col("soc_code") == soc, F.col("employment_per_1k") * factor)
                             .otherwise(F.col("employment_per_1k")))


def test_only_changed_categories_are_recomputed(spark, market, cats, base):
    first = aggregates.publish(_touched(market, cats[0], 3).where(F.col("soc_code") != cats[1]), base, version="a")
    assert (first["recomputed"], first["carried"], first["removed"]) == (len(cats) - 1, 0, 0)
    second = aggregates.publish(market.where(F.col("soc_code") != cats[2]), base, version="b")
    assert (second["recomputed"], second["carried"], second["removed"]) == (2, len(cats) - 3, 1)
    # the rows of the second batch are those of the changed categories alone
    new = spark.read.parquet(*glob.glob(f"{base}/data/measure=competition_index/batch=b-*"))
    assert {r.soc_code for r in new.select("soc_code").distinct().collect()} == set(cats[:2])
    now = market.where(F.col("soc_code") != cats[2])
    _same(aggregates.read(spark, base, "competition_index"), competition.competition_index(now))
    _same(aggregates.read(spark, base, "talent_pool"), pool.talent_pool_summary(now))
    # the older version still reads as it was
    _same(aggregates.read(spark, base, "competition_index", "a"),
          competition.competition_index(_touched(market, cats[0], 3).where(F.col("soc_code") != cats[1])))


def test_an_unchanged_market_writes_no_batch(spark, market, base):
    aggregates.publish(market, base, version="a")
    again = aggregates.publish(market.repartition(3), base, version="b")       # another order of rows
    assert again["recomputed"] == 0 and _batches(base) == {"a"}
    _same(aggregates.read(spark, base, "competition_index"), competition.competition_index(market))
    assert [r.version for r in aggregates.history(spark, base).orderBy("step").collect()] == ["a", "b"]


def test_other_parameters_recompute_everything(spark, market, cats, base):
    aggregates.publish(market, base, version="a")
    other = aggregates.publish(market, base, version="b", min_employment=500.0)
    assert other["carried"] == 0 and other["recomputed"] == len(cats)
    _same(aggregates.read(spark, base, "competition_index", min_employment=500.0), competition.competition_index(market, 500.0))


def test_batches_of_a_state_stay_bounded(spark, market, cats, base, monkeypatch):
    monkeypatch.setattr(aggregates, "MAX_BATCHES", 3)
    now = market
    aggregates.publish(now, base, version="v0")
    for i in range(1, 5):
        now = _touched(now, cats[i], 1.5)
        aggregates.publish(now, base, version=f"v{i}")
        state = aggregates._state(spark, base, aggregates._committed(spark, base, None))
        assert state.select("batch").distinct().count() <= 3 and state.count() == len(cats)
    _same(aggregates.read(spark, base, "competition_index"), competition.competition_index(now))


def test_a_rejected_publish_leaves_the_last_version(spark, market, base, monkeypatch):
    aggregates.publish(market, base, version="a")
    good = aggregates.measures()
    doubled = {**good, "talent_pool": aggregates.Measure(lambda m: pool.talent_pool_summary(m).unionByName(pool.talent_pool_summary(m)))}
    monkeypatch.setattr(aggregates, "measures", lambda **_: doubled)
    with pytest.raises(PublishError, match="talent_pool rejected"):
        aggregates.publish(market.withColumn("wage_p50", F.col("wage_p50") + 1), base, version="b")
    monkeypatch.undo()
    assert [r.version for r in aggregates.history(spark, base).collect()] == ["a"]
    _same(aggregates.read(spark, base, "talent_pool"), pool.talent_pool_summary(market))
    with pytest.raises(PublishError, match="never rewritten"):
        aggregates.publish(market, base, version="a")


def test_empty_market_and_missing_base(spark, market, base):
    with pytest.raises(LookupError):
        aggregates.read(spark, base, "talent_pool")
    aggregates.publish(market.limit(0), base, version="a")
    assert aggregates.read(spark, base, "talent_pool").count() == 0
    got = aggregates.publish(market, base, version="b")
    assert got["carried"] == 0 and aggregates.read(spark, base, "talent_pool").count() == market.count()


def test_fingerprints_see_nulls_and_copies(spark, market):
    one = market.limit(1).select("*")
    swapped = one.withColumns({"wage_p10": F.col("wage_p25"), "wage_p25": F.lit(None).cast("double")})
    shifted = one.withColumns({"wage_p25": F.col("wage_p25"), "wage_p10": F.lit(None).cast("double")})
    prints = {aggregates.fingerprints(x).first()["fingerprint"] for x in (one, swapped, shifted, one.unionByName(one))}
    assert len(prints) == 4

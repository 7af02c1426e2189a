"""Quality rules and the all-or-nothing publish."""

import tempfile

import pytest
from pyspark.sql import functions as F

from marketlens.operators import quality
from marketlens.plans import publish


def test_clean_marts_pass(market, skills):
    fatal = quality.fatal_violations(quality.quality_report(market, skills)).collect()
    assert fatal == []


def test_rules_catch_violations(spark, market, skills):
    bad = market.limit(3).withColumn("wage_p25", F.lit(1e9))           # crossed, D1
    bad = bad.unionByName(market.limit(1))                              # duplicate key, D4
    rep = {(r.rule_id, r.description): r.violations
           for r in quality.quality_report(bad, skills).collect()}
    assert rep[("D1", "wage percentiles ordered (adjacent pairs)")] == 3
    assert rep[("D4", "unique key (soc_code, area_code)")] == 1


def test_ragged_vector_flagged(market, skills):
    short = skills.where(~((F.col("soc_code") == "Brand#1") & (F.col("skill") == "skill_00")))
    (r,) = quality.quality_report(market, short).where("rule_id = 'D8'").collect()
    assert r.violations == 1


def _counts(report):
    return {(r.rule_id, r.description): (r.violations, r.metric) for r in report.collect()}


def test_report_over_empty_tables_and_null_keys(spark, market, skills):
    scope = market.select("soc_code", "occupation", "occupation_group").distinct()
    empty = _counts(quality.quality_report(market.limit(0), skills.limit(0), scope))
    assert {v for v, _ in empty.values()} == {0} and empty["D11", "share of rows matched to the prior vintage"][1] is None
    # a null category is outside the scope, has no skills, and its rows share one key if their place is one
    lost = market.withColumn("soc_code", F.when(F.col("soc_code") != "Brand#1", F.col("soc_code")))
    n = market.where("soc_code = 'Brand#1'").count()
    got = _counts(quality.quality_report(lost.unionByName(lost), skills, scope.unionByName(scope)))
    assert got["D6", "category in scope"][0] == 2 * n
    bare = market.select("soc_code").distinct().join(skills, "soc_code", "left_anti").count()
    assert got["D9", "every market category has a skill vector"][0] == bare + 1
    assert got["D5", "required column soc_code not null"][0] == 2 * n
    assert got["D4", "unique key (soc_code, area_code)"][0] == market.count()
    assert got["D6", "labels agree with the scope dimension"][0] == 0


def test_report_reads_each_table_once(spark, market, skills):
    scope = market.select("soc_code", "occupation", "occupation_group").distinct()
    paths = []
    for name, df in (("m", market), ("s", skills), ("sc", scope)):
        paths.append(f"{tempfile.mkdtemp(prefix='ml-report-')}/{name}")
        df.write.parquet(paths[-1])
    report = quality.quality_report(*[spark.read.parquet(p) for p in paths])
    plan = report._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Scan parquet") == 3 and initial.count("Exchange") <= 4
    assert "Join" not in initial


def test_synthetic_flag(market, skills):
    report = quality.quality_report(market, skills)
    places = market.select("area_code").distinct().count()
    assert quality.is_synthetic(report).first().synthetic == (places <= 45)


def test_publish_commits_and_rejects(spark, market, skills):
    base = tempfile.mkdtemp(prefix="ml-publish-")
    v1 = publish.publish(market, skills, base, version="v1")
    assert publish.latest_version(spark, base) == "v1" and publish.ready(spark, base)
    bad = market.withColumn("wage_p25", F.col("wage_p90") + 1)
    with pytest.raises(publish.PublishError):
        publish.publish(bad, skills, base, version="v2")
    assert publish.latest_version(spark, base) == v1       # previous version stays live
    m, s = publish.read_published(spark, base)
    assert m.count() == market.count() and s.count() == skills.count()


def test_not_ready_without_commit(spark):
    assert not publish.ready(spark, tempfile.mkdtemp(prefix="ml-empty-"))


def test_drift(market):
    (r,) = quality.row_count_drift(market.limit(600), market, ["soc_code", "area_code"]).collect()
    assert r.added == 0 and r.removed == market.count() - 600


def test_bucketed_tables_need_no_shuffle(spark, market, skills):
    from marketlens.operators import competition, profile
    v = publish.publish_tables(market, skills, name="mlb", buckets=4, version="1")
    m = spark.table("mlb_market")
    plan = competition.competition_index(m)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan                       # bucketed on soc_code: windows co-located
    assert competition.competition_index(m).count() == competition.competition_index(market).count()
    assert spark.table("mlb_skills").count() == skills.count() and v == "1"
    stats = spark.sql("DESCRIBE TABLE EXTENDED mlb_market_v1").where("col_name = 'Statistics'").collect()
    assert stats and "rows" in stats[0].data_type                # analyzed on publish (D13)
    # a failing version leaves the views on the previous one
    bad = market.withColumn("wage_p25", F.col("wage_p90") + 1)
    with pytest.raises(publish.PublishError):
        publish.publish_tables(bad, skills, name="mlb", buckets=4, version="2")
    assert spark.table("mlb_market").count() == market.count()
    assert "mlb_market_v1" in spark.sql("SHOW CREATE TABLE mlb_market").first()[0]


def test_crash_mid_publish_leaves_previous_version(spark, market, skills):
    base = tempfile.mkdtemp(prefix="ml-crash-")
    publish.publish(market, skills, base, version="v1")
    # the skills write fails while executing (after the market table was written)
    broken = skills.withColumn("importance", F.when(F.col("skill") == "skill_63",
                                                    F.raise_error(F.lit("disk gone")))
                               .otherwise(F.col("importance")))
    with pytest.raises(Exception):
        publish.publish(market, broken, base, version="v2")
    assert publish.latest_version(spark, base) == "v1"
    m, s = publish.read_published(spark, base)
    assert m.count() == market.count() and s.count() == skills.count()

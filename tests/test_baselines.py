"""Q2j: every place as the baseline, against scenario-by-scenario arbitrage."""
import random

import pytest
from pyspark.sql import functions as F

from marketlens import schema
from marketlens.operators import arbitrage


def _market(spark, n=60, seed=3):
    rng = random.Random(seed)
    rows = []
    for soc, places in (("a", n), ("b", 7), ("c", 1)):
        for i in range(places):
            wage = rng.choice([None, 40.0, 50.0, 60.0, 70.0 + i])
            rows.append((soc, f"{i:03d}", f"place {i}", float(rng.choice([90, 100, 900, 1000, 5000])), wage, wage and wage + 5))
    return spark.createDataFrame(rows, "soc_code string, area_code string, metro string, employment double, wage_p50 double, wage_p75 double")


def _brute(rows, headcount, k):
    out = {}
    big = [r for r in rows if r.employment >= schema.MIN_EMPLOYMENT_FOR_INDEX and r.wage_p50 is not None]
    for b in big:
        viable = sorted((r.wage_p50, r.area_code) for r in big
                        if r.soc_code == b.soc_code and r.employment * 0.02 >= headcount and r.wage_p50 < b.wage_p50)
        out[b.soc_code, b.area_code] = (len(viable), [a for _, a in viable[:k]])
    return out


@pytest.mark.parametrize("strategy", ["window", "distributed"])
@pytest.mark.parametrize("headcount", [1, 20])
def test_every_baseline_equals_pairwise_search(spark, strategy, headcount):
    m = _market(spark)
    got = {}
    for r in arbitrage.all_baselines(m, (headcount,), ("p50",), 4, strategy=strategy).orderBy("rank").collect():
        n, places = got.setdefault((r.soc_code, r.baseline_area), (r.viable_places, []))
        assert n == r.viable_places
        if r.area_code is not None:
            assert r.rank == len(places) + 1 and r.wage_at_percentile - r.baseline_wage == r.wage_delta_per_hire < 0
            places.append(r.area_code)
    assert got == _brute(m.collect(), headcount, 4)


def test_agrees_with_the_scenario_form(spark):
    m = (_market(spark, 20).withColumn("occupation", F.col("soc_code")).withColumn("state", F.lit("s"))
         .withColumn("employment_per_1k", F.lit(1.0)).withColumn("supply_growth_3y", F.lit(0.0))
         .withColumns({c: F.col("wage_p50") for c in ("wage_p10", "wage_p25", "wage_p90")}))
    scenarios = m.select("soc_code", F.col("area_code").alias("baseline_area"), F.lit(20).cast("long").alias("headcount"),
                         F.lit("p50").alias("percentile"))
    want = {(r.soc_code, r.baseline_area, r.area_code, r.annual_delta_total)
            for r in arbitrage.viable_alternatives(arbitrage.wage_arbitrage(m, scenarios)).collect()}
    got = {(r.soc_code, r.baseline_area, r.area_code, r.annual_delta_total)
           for r in arbitrage.all_baselines(m, k=1000).where("area_code IS NOT NULL").collect()}
    assert got == want and want


def test_no_step_is_wider_than_k_rows_a_baseline(spark):
    """The plan joins baselines to one list a category and never places to places."""
    m = _market(spark)
    df = arbitrage.all_baselines(m, (1, 20), ("p50", "p75"), 2)
    priced = m.where("employment >= 100").count() * 4
    assert df.count() <= 2 * priced
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan


def test_arguments_and_empty_market(spark):
    m = _market(spark)
    for bad in ({"headcounts": (0,)}, {"percentiles": ("p51",)}, {"strategy": "guess"}):
        with pytest.raises(ValueError):
            arbitrage.all_baselines(m, **bad)
    assert arbitrage.all_baselines(m.where(F.lit(False))).collect() == []

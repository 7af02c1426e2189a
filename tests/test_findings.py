"""Findings: words agree with the signs of the numbers; no null/NaN text leaks."""

import pytest
from pyspark.sql import functions as F

from marketlens.operators import adjacency, arbitrage, competition, findings, pool, profile, usage


@pytest.fixture(scope="module")
def index(market):
    return competition.competition_index(market)


def test_extremes_hardest_above_easiest(index):
    ex = findings.market_extremes(index).toPandas()
    assert (ex.hardest_index >= ex.easiest_index).all()
    assert ex.driver.isin(findings.DRIVER_WORDS).all()
    assert len(ex) == index.select("soc_code").distinct().count()


def test_fact_sheet_words_match_signs(market):
    s = pool.talent_pool_summary(market)
    f = pool.pool_fact_sheet(s).join(s, ["soc_code", "area_code"]).toPandas()
    assert ((f.pay_direction == "above") == (f.wage_premium >= 0)).all()
    grew = f[~f.growth_unavailable]
    assert ((grew.growth_direction == "grew") == (grew.supply_growth_3y >= 0)).all()
    assert (f[f.growth_unavailable].growth_direction == "unavailable").all()
    assert (f[f.concentration_ratio >= 1.25].concentration_band == "specialist").all()
    assert (f[f.rank_by_size == 1].rank_note == "largest").all()


def test_arbitrage_outcomes_consistent(market):
    arb = arbitrage.wage_arbitrage(market, arbitrage.largest_pool_scenarios(market))
    out = findings.arbitrage_sentence(arbitrage.cheapest_vs_viable(arb)).toPandas()
    none = out[out.outcome == "none_cheaper"]
    assert (none.cheapest_annual_delta >= 0).all()
    viable = out[out.outcome == "cheapest_viable"]
    assert (viable.cheapest_area == viable.viable_area).all()
    alt = out[out.outcome == "cheapest_thin_with_alternative"]
    assert (alt.cheapest_pool_depth == "Thin").all()
    assert (alt.viable_annual_delta >= alt.cheapest_annual_delta).all()


def _no_leaks(texts):
    for t in texts:
        assert t is not None
        low = t.lower()
        assert "nan" not in low.split() and "none" not in low.split() and "null" not in low


def test_no_null_text(market, skills, usage_log):
    idx = competition.competition_index(market)
    _no_leaks(r.finding for r in findings.market_extremes(idx).collect())
    arb = arbitrage.wage_arbitrage(market, arbitrage.largest_pool_scenarios(market))
    _no_leaks(r.finding for r in findings.arbitrage_sentence(arbitrage.cheapest_vs_viable(arb)).collect())
    _no_leaks(r.finding for r in findings.usage_sentence(
        usage.usage_headline(usage_log, 30, "2024-01-30"), 30).collect())
    _no_leaks(r.distinctive_skills for r in profile.distinctive_skills(
        profile.skill_profile(skills)).collect())
    _no_leaks(r.finding for r in pool.pool_fact_sheet(pool.talent_pool_summary(market)).collect())
    _no_leaks(r.finding for r in profile.distinctive_skills(profile.skill_profile(skills)).collect())
    _no_leaks(r.finding for r in adjacency.adjacency_bench(
        adjacency.skill_adjacency(skills, limit=8)).collect())


def test_adjacency_bench_outcomes(skills):
    adj = adjacency.skill_adjacency(skills, limit=8)
    b = adjacency.adjacency_bench(adj).toPandas()
    assert (b[b.outcome == "bench"].strong_neighbours > 1).all()
    assert (b[b.outcome == "specialised"].nearest_similarity < 0.4).all()
    top = adj.groupBy("target_soc").agg(F.max("similarity").alias("m")).toPandas()
    m = b.merge(top, on="target_soc")
    assert (m.nearest_similarity == m.m).all()


@pytest.mark.parametrize("ratio, band", [(1.25, "specialist"), (1.2499999999, "typical"),
                                         (0.7500000001, "typical"), (0.75, "under-represented")])
def test_bands_use_the_unrounded_ratio(market, ratio, band):
    one = market.select("soc_code", "area_code").first()
    s = (pool.talent_pool_summary(market).where((F.col("soc_code") == one[0]) & (F.col("area_code") == one[1]))
         .withColumn("concentration_ratio", F.lit(ratio)))
    assert pool.pool_fact_sheet(s).first().concentration_band == band


def test_pool_ratios_are_not_cut(market):
    rows = pool.talent_pool_summary(market).select(
        "employment_per_1k", "national_per_1k_avg", "concentration_ratio").collect()
    assert rows and all(r.concentration_ratio == r.employment_per_1k / r.national_per_1k_avg
                        for r in rows if r.employment_per_1k is not None)


def test_strong_cut_uses_the_unrounded_similarity(spark):
    rows = [("a", "b", 0.3999999996, "x"), ("c", "d", 0.4, "x")]
    got = {r.target_soc: r.strong_neighbours for r in adjacency.adjacency_bench(spark.createDataFrame(
        rows, "target_soc string, soc_code string, similarity double, shared_strengths string")).collect()}
    assert got == {"a": 0, "c": 1}


def test_skill_means_keep_every_digit(spark):
    rows = [("a", "x", 1.00000049), ("a", "y", 0.1), ("b", "y", 0.2)]
    stats = {r.skill: r for r in profile.skill_stats(
        spark.createDataFrame(rows, "soc_code string, skill string, importance double")).collect()}
    assert stats["x"].mean_importance == 1.00000049 and stats["x"].sd_importance is None
    assert stats["y"].mean_importance == 0.15

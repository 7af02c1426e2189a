"""Invariants on real measure output (test mart at sf0.01)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens import schema
from marketlens.operators import adjacency, arbitrage, competition, overview, pool, profile


@pytest.fixture(scope="module")
def index(market):
    return competition.competition_index(market).toPandas()


def test_scores_bounded(index):
    for c in ["scarcity_score", "wage_premium_score", "growth_score", "competition_index"]:
        assert index[c].between(0, 100).all()


def test_composite_is_weighted_sum(index):
    w = schema.INDEX_WEIGHTS
    want = (w["scarcity"] * index.scarcity_score + w["wage_premium"] * index.wage_premium_score
            + w["growth"] * index.growth_score)
    assert np.allclose(index.competition_index, want)


def test_scarcity_sign(index):
    # the score is a descending rank of supply per 1k: perfectly anti-monotone
    for _, g in index.groupby("soc_code"):
        assert g.employment_per_1k.rank().corr(g.scarcity_score.rank()) == pytest.approx(-1.0)


def test_imputed_flag(index):
    assert (index.growth_imputed == index.supply_growth_3y.isna()).all()


def test_floor_applied(market, index):
    assert index.employment.min() >= schema.MIN_EMPLOYMENT_FOR_INDEX


def test_rank_one_is_max(index):
    for _, g in index.groupby("soc_code"):
        assert g.loc[g.difficulty_rank == 1, "competition_index"].iloc[0] == g.competition_index.max()


def test_weights_validated(market):
    with pytest.raises(ValueError):
        competition.competition_index(market, weights={"scarcity": .5, "wage_premium": .5, "growth": .5})


def test_distributed_strategy_equal(market, index):
    d = competition.competition_index(market, strategy="distributed").toPandas()
    a = index.sort_values(["soc_code", "area_code"]).reset_index(drop=True)
    b = d.sort_values(["soc_code", "area_code"]).reset_index(drop=True)
    for c in ["scarcity_score", "wage_premium_score", "growth_score", "difficulty_rank"]:
        assert np.allclose(a[c], b[c])


@pytest.fixture(scope="module")
def arb(market):
    sc = arbitrage.largest_pool_scenarios(market, headcount=20, percentile="p50")
    return arbitrage.wage_arbitrage(market, sc)


def test_baseline_delta_zero(arb):
    base = arb.where("is_baseline").toPandas()
    assert (base.wage_delta_per_hire == 0).all() and (base.annual_delta_total == 0).all()
    assert base.soc_code.is_unique


def test_linear_in_headcount(market):
    a = arbitrage.wage_arbitrage(market, arbitrage.scenarios_for(market, "0", 10)).toPandas()
    b = arbitrage.wage_arbitrage(market, arbitrage.scenarios_for(market, "0", 30)).toPandas()
    m = a.merge(b, on=["soc_code", "area_code"])
    assert np.allclose(m.annual_delta_total_y, 3 * m.annual_delta_total_x)


def test_depth_thresholds(arb):
    p = arb.toPandas()
    cap = p.employment * schema.ANNUAL_POOL_CAPTURE_LIMIT
    assert (p[cap >= 3 * p.headcount].pool_depth == "Deep").all()
    assert (p[(cap >= p.headcount) & (cap < 3 * p.headcount)].pool_depth == "Adequate").all()
    assert (p[cap < p.headcount].pool_depth == "Thin").all()


def test_percentile_control_is_live(market):
    lo = arbitrage.wage_arbitrage(market, arbitrage.scenarios_for(market, "0", 20, "p10"))
    hi = arbitrage.wage_arbitrage(market, arbitrage.scenarios_for(market, "0", 20, "p90"))
    assert lo.agg(F.sum("annual_cost_total")).first()[0] < hi.agg(F.sum("annual_cost_total")).first()[0]


def test_missing_baseline_gives_no_rows(market):
    assert arbitrage.wage_arbitrage(market, arbitrage.scenarios_for(market, "no-such")).count() == 0


def test_bad_arguments(market):
    with pytest.raises(ValueError):
        arbitrage.scenarios_for(market, "0", 0)
    with pytest.raises(ValueError):
        arbitrage.scenarios_for(market, "0", 20, "p99")


def test_shares_sum_to_one(market):
    s = pool.talent_pool_summary(market).groupBy("soc_code").agg(
        F.sum("share_of_national_pool").alias("s")).toPandas()
    assert np.allclose(s.s, 1.0)


def test_pool_lookup_reports_absent(spark, market):
    summary = pool.talent_pool_summary(market)
    req = spark.createDataFrame([("Brand#1", "0"), ("Brand#1", "nowhere")], "soc_code string, area_code string")
    found, absent = pool.lookup(summary, req)
    assert found.count() == 1 and [r.area_code for r in absent.collect()] == ["nowhere"]


def test_overview_one_row(market, skills):
    (r,) = overview.mart_overview(market, skills).collect()
    assert r.talent_rows == market.count() and r.skills_tracked == 64


def test_profile_distinctive(skills):
    p = profile.skill_profile(skills).toPandas()
    # distinctiveness centres every skill: sums to ~0 across categories
    assert np.allclose(p.groupby("skill").distinctive.sum(), 0, atol=1e-9)
    assert p.within_role_rank.between(0, 1).all()


def test_adjacency_matches_brute_force(skills):
    got = adjacency.skill_adjacency(skills, limit=3, block_size=3).toPandas()
    s = skills.toPandas().pivot(index="soc_code", columns="skill", values="importance")
    dev = s - s.mean(axis=0)
    socs = list(dev.index)
    for t in socs:
        sims = []
        for c in socs:
            if c == t:
                continue
            a, b = dev.loc[t].to_numpy(), dev.loc[c].to_numpy()
            sims.append((-(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)), c))
        want = [c for _, c in sorted(sims)[:3]]
        have = list(got[got.target_soc == t].sort_values("similarity", ascending=False).soc_code)
        assert have == want


def test_adjacency_symmetric(skills):
    full = adjacency.skill_adjacency(skills, limit=20).toPandas()
    m = full.merge(full, left_on=["target_soc", "soc_code"], right_on=["soc_code", "target_soc"])
    assert np.allclose(m.similarity_x, m.similarity_y)


def test_centring_widens_spread(skills):
    r = adjacency.similarity_spread(skills).toPandas()
    assert (r.centered_spread >= 3 * r.raw_spread).all()
    assert (r.centered_min >= -1 - 1e-9).all() and (r.centered_max <= 1 + 1e-9).all()


def test_block_sizes_agree(spark):
    from marketlens.sources import testmart
    vec = testmart.skills(spark, "/root/testdata/sf0.001", "vector")
    a = adjacency.neighbour_candidates(vec, 5, block_size=64).toPandas()
    b = adjacency.neighbour_candidates(vec, 5, block_size=10_000).toPandas()
    key = ["target_soc", "soc_code"]
    a, b = a.sort_values(key).reset_index(drop=True), b.sort_values(key).reset_index(drop=True)
    assert (a[key] == b[key]).all().all() and np.allclose(a.similarity, b.similarity)


def test_adjacency_needs_a_common_skill(spark):
    rows = [("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 3.0), ("b", "y", 1.0),
            ("c", "z", 2.0), ("c", "w", 4.0), ("d", "z", 4.0), ("d", "w", 2.0)]
    sk = spark.createDataFrame(rows, "soc_code string, skill string, importance double")
    got = {(r.target_soc, r.soc_code) for r in adjacency.neighbour_candidates(sk, 5).collect()}
    # a/b share skills x, y; c/d share z, w; no pair crosses the two groups
    assert got == {("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")}


def test_viable_alternatives_filter(arb):
    v = arbitrage.viable_alternatives(arb).toPandas()
    assert (v.annual_delta_total < 0).all() and (v.pool_depth != "Thin").all()
    full = arb.toPandas()
    assert len(v) == ((full.annual_delta_total < 0) & (full.pool_depth != "Thin")).sum()


@pytest.mark.parametrize("target", ["Brand#1", "Brand#6"])
def test_single_target_equals_all_targets(skills, target):
    one = adjacency.neighbours_of(skills, target, 5).toPandas()
    all_ = adjacency.skill_adjacency(skills, 5).toPandas()
    all_ = all_[all_.target_soc == target]
    cols = ["soc_code", "similarity", "shared_strength_count", "shared_strengths"]
    a = one[cols].sort_values("soc_code").reset_index(drop=True)
    b = all_[cols].sort_values("soc_code").reset_index(drop=True)
    assert list(a.soc_code) == list(b.soc_code)
    assert np.allclose(a.similarity, b.similarity, atol=1e-8)
    assert list(a.shared_strengths) == list(b.shared_strengths)

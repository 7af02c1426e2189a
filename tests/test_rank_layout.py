"""Several orders ranked from one range layout equal their windows; the index has both strategies equal."""
import random

import pytest
from pyspark.sql import functions as F

from marketlens import schema
from marketlens.operators import competition
from marketlens.operators.ranking import Order, attach_ranks, rank_layout

ORDERS = {"up": Order("a", True, False), "down": Order("a", False, True), "other": Order("b", False, False), "first": Order("b", True, True)}


def _rows(seed, hot=300):
    rng = random.Random(seed)
    pick = lambda: rng.choice([None, 0.0, -0.0, 1.5, -2.0, rng.random()])
    return [("hot" if i < hot else f"k{i % 9}", str(i), pick(), pick()) for i in range(hot + 60)] + [("single", "x", None, 1.0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_layout_equals_windows(spark, seed):
    from pyspark.sql import Window
    df = spark.createDataFrame(_rows(seed), "key string, id string, a double, b double").repartition(5)
    got = attach_ranks(df, ["key"], ["key", "id"], ORDERS, rank_layout(df, ["key"], list(ORDERS.values())))
    for name, order in ORDERS.items():
        got = got.withColumn(f"w_{name}", F.rank().over(Window.partitionBy("key").orderBy(order.sort())) - 1)
    got = got.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).collect()
    assert len(got) == 361
    for r in got:
        assert r["_total"] == r["n"]
        for name in ORDERS:
            assert r[f"_before_{name}"] == r[f"w_{name}"], (r, name)


def test_a_hot_key_spans_several_ranges(spark):
    df = spark.createDataFrame(_rows(5, 3000), "key string, id string, a double, b double").withColumn("a", F.rand(3))
    ranged = rank_layout(df, ["key"], [ORDERS["up"]])
    plan = ranged._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert ranged.where("key = 'hot'").agg(F.max("_before") + 1).first()[0] == 3000


def _market(spark, rng, places):
    rows = []
    for soc, n in places.items():
        growth = [None] * n if soc == "none" else [rng.choice([None, None, 0.0, 0.1, rng.random() - 0.5]) for _ in range(n)]
        for i in range(n):
            med = rng.choice([None, 40.0, 50.0 + i])
            rows.append((soc, "o", "g", f"{i:04d}", "m", "s", float(rng.choice([90, 100, 900])), rng.choice([None, 1.0, 2.5, rng.random()]),
                         None, growth[i], None, None, med, med, med, None, rng.choice([None, 0.0, 45.0])))
    return spark.createDataFrame(rows, schema.MARKET_SCHEMA, verifySchema=False)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_both_strategies_of_the_index_are_equal(spark, seed):
    rng = random.Random(seed)
    m = _market(spark, rng, {"big": 120, "two": 2, "one": 1, "none": 9, "odd": 13, "even": 14})
    one, two = (sorted(map(str, competition.competition_index(m, strategy=s).collect())) for s in ("window", "distributed"))
    assert one == two and len(one) > 90


def test_empty_market(spark):
    m = _market(spark, random.Random(1), {"one": 1}).where(F.lit(False))
    assert competition.competition_index(m, strategy="distributed").collect() == []
    with pytest.raises(ValueError, match="unknown strategy"):
        competition.competition_index(m, strategy="guess")

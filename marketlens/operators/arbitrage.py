"""Q2 wage arbitrage over scenarios, plus the findings built on it.

A *scenario* is ``(soc_code, baseline_area, headcount, percentile)``. The result
has one row per (scenario, place with a wage at that percentile), priced against
the scenario's baseline place. A scenario whose baseline place is missing or
below the floor yields no rows (the reference's CROSS JOIN with an empty
baseline). The output size is (#scenarios x #places of the category): it grows
with what is asked, not with all place pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens import schema
from marketlens.functions.columns import nullif_zero, pick_percentile, safe_div
from marketlens.operators.ranking import Order, cumulative_before

SCENARIO_KEYS = ["soc_code", "baseline_area", "headcount", "percentile"]
OUTPUT_COLUMNS = [
    "soc_code", "baseline_area", "headcount", "percentile", "occupation", "area_code",
    "metro", "state", "baseline_metro", "employment", "employment_per_1k",
    "supply_growth_3y", "wage_at_percentile", "baseline_wage", "wage_delta_per_hire",
    "wage_delta_pct", "annual_delta_total", "annual_cost_total", "hires_supportable",
    "pool_depth_ratio", "pool_depth", "is_baseline",
]


def scenarios_for(market: DataFrame, baseline_area: str, headcount: int = 20,
                  percentile: str = "p50") -> DataFrame:
    """One scenario per category present in ``market`` with a fixed baseline."""
    validate(headcount, percentile)
    return (market.select("soc_code").distinct()
            .select("soc_code", F.lit(str(baseline_area)).alias("baseline_area"),
                    F.lit(int(headcount)).cast("long").alias("headcount"),
                    F.lit(percentile).alias("percentile")))


def largest_pool_scenarios(market: DataFrame, headcount: int = 20, percentile: str = "p50",
                           min_employment: float | None = None) -> DataFrame:
    """Scenarios whose baseline is each category's largest scoped pool (area breaks ties)."""
    validate(headcount, percentile)
    floor = schema.MIN_EMPLOYMENT_FOR_INDEX if min_employment is None else min_employment
    pick = (market.where(F.col("employment") >= F.lit(float(floor)))
            .groupBy("soc_code")
            .agg(F.min_by("area_code", F.struct(-F.col("employment"), F.col("area_code")))
                 .alias("baseline_area")))
    return pick.select("soc_code", "baseline_area",
                       F.lit(int(headcount)).cast("long").alias("headcount"),
                       F.lit(percentile).alias("percentile"))


def validate(headcount: int, percentile: str) -> None:
    if percentile not in schema.VALID_PERCENTILES:
        raise ValueError(f"percentile must be one of {schema.VALID_PERCENTILES}, got {percentile!r}")
    if headcount < 1:
        raise ValueError(f"headcount must be at least 1, got {headcount}")


def invalid_scenarios(scenarios: DataFrame, market: DataFrame) -> DataFrame:
    """Scenario rows that break the argument rules (unknown category, bad percentile,
    headcount below 1), returned as data instead of raised one by one."""
    known = market.select("soc_code").distinct()
    bad_args = scenarios.where(~F.col("percentile").isin(*schema.VALID_PERCENTILES)
                               | (F.col("headcount") < 1))
    unknown = scenarios.join(known, "soc_code", "left_anti")
    return bad_args.unionByName(unknown).distinct()


def wage_arbitrage(market: DataFrame, scenarios: DataFrame,
                   min_employment: float | None = None) -> DataFrame:
    floor = schema.MIN_EMPLOYMENT_FOR_INDEX if min_employment is None else min_employment
    scoped = market.where(F.col("employment") >= F.lit(float(floor)))
    priced = (scoped.join(scenarios.select(*SCENARIO_KEYS), "soc_code")
              .withColumn("wage_at_percentile", pick_percentile(F.col("percentile"))))
    baseline = (priced.where(F.col("area_code") == F.col("baseline_area"))
                .select(*SCENARIO_KEYS, F.col("metro").alias("baseline_metro"),
                        F.col("wage_at_percentile").alias("baseline_wage"),
                        F.col("employment").alias("baseline_employment")))
    capacity = F.col("employment") * F.lit(schema.ANNUAL_POOL_CAPTURE_LIMIT)
    hc = F.col("headcount")
    delta = F.col("wage_at_percentile") - F.col("baseline_wage")
    return (priced.where(F.col("wage_at_percentile").isNotNull())
            .join(baseline, SCENARIO_KEYS)
            .withColumn("wage_delta_per_hire", delta)
            .withColumn("wage_delta_pct", safe_div(delta, "baseline_wage"))
            .withColumn("annual_delta_total", hc * delta)
            .withColumn("annual_cost_total", hc * F.col("wage_at_percentile"))
            .withColumn("hires_supportable", F.floor(capacity).cast("double"))
            .withColumn("pool_depth_ratio", capacity / nullif_zero(hc))
            .withColumn("pool_depth",
                        F.when(capacity >= hc * schema.DEEP_POOL_MULTIPLE, F.lit("Deep"))
                        .when(capacity >= hc, F.lit("Adequate")).otherwise(F.lit("Thin")))
            .withColumn("is_baseline", F.col("area_code") == F.col("baseline_area"))
            .select(*OUTPUT_COLUMNS))


def ordered(result: DataFrame) -> DataFrame:
    return result.orderBy(*SCENARIO_KEYS, F.col("annual_delta_total").asc_nulls_last(),
                          "area_code")


def viable() -> Column:
    """A place is a viable alternative when it is cheaper than the baseline and its
    pool is not Thin."""
    return (F.col("pool_depth") != "Thin") & (F.col("annual_delta_total") < 0)


def viable_alternatives(arbitrage: DataFrame) -> DataFrame:
    """Scenario rows worth keeping when scenarios are many: the filter runs on the
    executors before anything is written (SURVEY §4.6)."""
    return arbitrage.where(viable())


# ---------------------------------------------------------------- every baseline --
def all_baselines(market: DataFrame, headcounts: tuple[int, ...] = (20,), percentiles: tuple[str, ...] = ("p50",),
                  k: int = 3, min_employment: float | None = None, strategy: str = "window") -> DataFrame:
    """Q2j: for every place as the baseline, its first ``k`` viable places in delta order, and how many there are.

    Which places are deep enough depends on the plan alone, and the order by wage not on the baseline: a place is
    viable for a baseline if it isn't Thin and its wage is below the baseline's. So a (category, plan) has one
    list, its ``k`` cheapest places that aren't Thin, and a baseline's first ``k`` viable places are the part of
    that list below its own wage. No place meets another: the ``k`` entries are found under a rank limit that Spark
    applies before the shuffle, and each baseline row is widened to at most ``k`` rows.

    ``viable_places`` counts all viable places: the deep enough ones strictly ahead in wage order, by a window
    over the category (bounded by the place dimension) or, with ``strategy="distributed"``, by the range
    layout of :mod:`ranking`, which splits a category over many tasks. Baselines without a viable place have one
    row, with a null place. Rows: one per (category, headcount, percentile, baseline, rank)."""
    for h in headcounts:
        for p in percentiles:
            validate(h, p)
    if strategy not in ("window", "distributed"):
        raise ValueError(f"unknown strategy {strategy!r}")
    floor = schema.MIN_EMPLOYMENT_FOR_INDEX if min_employment is None else min_employment
    plans = F.array(*[F.struct(F.lit(int(h)).cast("long").alias("headcount"), F.lit(p).alias("percentile"),
                               F.col(f"wage_{p}").alias("pay")) for h in headcounts for p in percentiles])
    capacity = F.col("employment") * F.lit(schema.ANNUAL_POOL_CAPTURE_LIMIT)
    keys = ["soc_code", "headcount", "percentile"]
    priced = (market.where(F.col("employment") >= F.lit(float(floor)))
              .select("soc_code", "area_code", "metro", "employment", F.explode(plans).alias("plan"))
              .select("soc_code", "area_code", "metro", "employment", "plan.*")
              .where(F.col("pay").isNotNull())
              .withColumn("ample", (capacity >= F.col("headcount")).cast("long")))

    order = Window.partitionBy(*keys).orderBy("pay", "area_code")
    listed = (priced.where("ample = 1").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
              .groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
                  "rank", "area_code", "metro", "pay", "employment"))).alias("listed")))
    if strategy == "window":
        here, same = Window.partitionBy(*keys).orderBy("pay"), Window.partitionBy(*keys, "pay")
        counted = priced.withColumn("viable_places", F.sum("ample").over(here) - F.sum("ample").over(same))
    else:
        ahead = (cumulative_before(priced.select(*keys, "pay", "ample"), keys, Order("pay"), weight="ample")
                 .select(*keys, "pay", F.col("_before").alias("viable_places")))
        counted = priced.join(ahead, [*keys, "pay"])

    found = F.filter("listed", lambda x: x["pay"] < F.col("pay"))
    delta = F.col("v.pay") - F.col("pay")
    return (counted.join(listed, keys, "left")
            .select(*keys, F.col("area_code").alias("baseline_area"), F.col("metro").alias("baseline_metro"),
                    F.col("pay"), "viable_places", F.explode_outer(found).alias("v"))
            .select(*keys, "baseline_area", "baseline_metro", F.col("pay").alias("baseline_wage"), "viable_places",
                    F.col("v.rank").alias("rank"), F.col("v.area_code").alias("area_code"), F.col("v.metro").alias("metro"),
                    F.col("v.pay").alias("wage_at_percentile"), delta.alias("wage_delta_per_hire"),
                    safe_div(delta, "pay").alias("wage_delta_pct"), (F.col("headcount") * delta).alias("annual_delta_total"),
                    F.floor(F.col("v.employment") * schema.ANNUAL_POOL_CAPTURE_LIMIT).cast("double").alias("hires_supportable")))


# ---------------------------------------------------------------- findings --
def cheapest_vs_viable(arbitrage: DataFrame) -> DataFrame:
    """per scenario, the cheapest place and the first viable one (not Thin and
    cheaper than the baseline) in delta order, with the outcome class."""
    order_key = F.struct(F.col("annual_delta_total"), F.col("area_code"))
    is_viable = viable()
    pick = F.struct("area_code", "metro", "annual_delta_total", "wage_delta_pct",
                    "employment", "hires_supportable", "pool_depth")
    agg = (arbitrage.where(F.col("annual_delta_total").isNotNull())
           .groupBy(*SCENARIO_KEYS)
           .agg(F.first("baseline_metro").alias("baseline_metro"),
                F.min_by(pick, order_key).alias("cheapest"),
                F.min_by(F.when(is_viable, pick), F.when(is_viable, order_key)).alias("best_viable")))
    outcome = (F.when(F.col("cheapest.annual_delta_total") >= 0, F.lit("none_cheaper"))
               .when(F.col("best_viable").isNull(), F.lit("every_cheaper_thin"))
               .when(F.col("best_viable.area_code") == F.col("cheapest.area_code"),
                     F.lit("cheapest_viable"))
               .otherwise(F.lit("cheapest_thin_with_alternative")))
    return agg.select(*SCENARIO_KEYS, "baseline_metro",
                      F.col("cheapest.area_code").alias("cheapest_area"),
                      F.col("cheapest.metro").alias("cheapest_metro"),
                      F.col("cheapest.annual_delta_total").alias("cheapest_annual_delta"),
                      F.col("cheapest.pool_depth").alias("cheapest_pool_depth"),
                      F.col("best_viable.area_code").alias("viable_area"),
                      F.col("best_viable.metro").alias("viable_metro"),
                      F.col("best_viable.annual_delta_total").alias("viable_annual_delta"),
                      outcome.alias("outcome"))


def head_tail_slice(arbitrage: DataFrame, n: int = 12) -> DataFrame:
    """F8: cheapest floor(n/2) + priciest remainder + the baseline row, per scenario."""
    k = n // 2
    w = Window.partitionBy(*SCENARIO_KEYS)
    asc = F.row_number().over(w.orderBy(F.col("annual_delta_total").asc_nulls_last(), "area_code"))
    # "tail" of the (delta ASC NULLS LAST, area) order = head of its exact reverse
    desc = F.row_number().over(w.orderBy(F.col("annual_delta_total").desc_nulls_first(),
                                         F.col("area_code").desc()))
    return (arbitrage.withColumn("_a", asc).withColumn("_d", desc)
            .where((F.col("_a") <= k) | (F.col("_d") <= n - k) | F.col("is_baseline"))
            .drop("_a", "_d"))


def pool_needed(arbitrage: DataFrame) -> DataFrame:
    """pool size needed for each plan and the count of places per depth class."""
    return (arbitrage.groupBy(*SCENARIO_KEYS, "pool_depth")
            .agg(F.count(F.lit(1)).alias("places"),
                 F.first(F.col("headcount") / F.lit(schema.ANNUAL_POOL_CAPTURE_LIMIT))
                 .alias("pool_needed")))

"""Q1: talent competition index, every category at once.

Per category (``soc_code``), over the places with ``employment >= floor``:
median-imputed growth with a flag, wage premium and dispersion, three percent
ranks (scarcity: supply per 1k DESC NULLS FIRST; premium: ASC NULLS LAST;
growth: filled growth DESC NULLS FIRST), the weighted composite and a RANK by it.

All windows share one hash exchange on ``soc_code``. Partitions hold one row
per place (the mart key is unique per (soc_code, area_code)), so their size is
bounded by the place dimension; ``strategy="distributed"`` swaps in the
range-partitioned exact ranks for marts whose place dimension is unbounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens import schema
from marketlens.functions.columns import safe_div
from marketlens.operators.ranking import Order, attach_ranks, percent_rank_window, rank_layout

OUTPUT_COLUMNS = [
    "soc_code", "occupation", "occupation_group", "area_code", "metro", "state",
    "employment", "employment_per_1k", "supply_growth_3y", "growth_imputed",
    "proj_growth_10y", "wage_p10", "wage_p25", "wage_p50", "wage_p75", "wage_p90",
    "national_wage_p50", "wage_premium", "wage_dispersion", "scarcity_score",
    "wage_premium_score", "growth_score", "competition_index", "difficulty_rank",
]

SCORE_ORDERS = {
    "scarcity_score": Order("employment_per_1k", ascending=False, nulls_first=True),
    "wage_premium_score": Order("wage_premium", ascending=True, nulls_first=False),
    "growth_score": Order("growth_filled", ascending=False, nulls_first=True),
}
BY_INDEX = Order("competition_index", ascending=False, nulls_first=True)


def competition_index(market: DataFrame, min_employment: float | None = None,
                      weights: dict[str, float] | None = None,
                      strategy: str = "window") -> DataFrame:
    weights = schema.validate_weights(weights or schema.INDEX_WEIGHTS)
    floor = schema.MIN_EMPLOYMENT_FOR_INDEX if min_employment is None else min_employment
    if strategy not in ("window", "distributed"):
        raise ValueError(f"unknown strategy {strategy!r}")
    signals = (market.where(F.col("employment") >= F.lit(float(floor)))
               .withColumn("growth_imputed", F.col("supply_growth_3y").isNull())
               .withColumn("wage_premium", safe_div("wage_p50", "national_wage_p50") - 1.0)
               .withColumn("wage_dispersion",
                           safe_div(F.col("wage_p75") - F.col("wage_p25"), "wage_p50")))
    ranked = _window_scores(signals) if strategy == "window" else _distributed_scores(signals)
    composite = (F.lit(weights["scarcity"]) * F.col("scarcity_score")
                 + F.lit(weights["wage_premium"]) * F.col("wage_premium_score")
                 + F.lit(weights["growth"]) * F.col("growth_score"))
    out = ranked.withColumn("competition_index", composite)
    if strategy == "window":
        out = out.withColumn("difficulty_rank", F.rank().over(
            Window.partitionBy("soc_code").orderBy(BY_INDEX.sort())).cast("long"))
    else:
        out = out.checkpoint(eager=True)            # mart-sized, read by the layout and by the join
        layout = rank_layout(out, ["soc_code"], [BY_INDEX])
        out = (attach_ranks(out, ["soc_code"], schema.MARKET_KEYS, {"index": BY_INDEX}, layout)
               .withColumn("difficulty_rank", (F.col("_before_index") + 1).cast("long")))
    return out.select(*OUTPUT_COLUMNS)


def _window_scores(signals: DataFrame) -> DataFrame:
    """Median and percent ranks as windows over the category."""
    median = F.median("supply_growth_3y").over(Window.partitionBy("soc_code"))
    out = signals.withColumn("growth_filled", F.coalesce("supply_growth_3y", median))
    for name, order in SCORE_ORDERS.items():
        out = out.withColumn(name, 100.0 * percent_rank_window(["soc_code"], order))
    return out


def _distributed_scores(signals: DataFrame) -> DataFrame:
    """The same scores from one range layout of the three measures.

    Growth is laid out as reported, nulls last, highest first, so that its layout gives the median as well. A row
    without growth stands at the median: ahead of it are the reported values above the median; ahead of a
    reported value are the higher ones and, if the median is higher, all rows without growth."""
    orders = SCORE_ORDERS | {"growth_score": Order("supply_growth_3y", ascending=False, nulls_first=False)}
    layout = rank_layout(signals, ["soc_code"], list(orders.values()))
    growth = layout.where(F.col("_measure") == list(orders).index("growth_score"))

    values = F.col("_total") - F.col("_nulls")
    nulls = growth.where(F.col("_null") == 1).select("soc_code", F.col("_w").alias("_nulls"))     # a row a category
    held = growth.where(F.col("_null") == 0).join(nulls, "soc_code", "left").na.fill(0, ["_nulls"])
    last = F.col("_before") + F.col("_w") - 1
    high, low = F.floor((values - 1) / 2), F.ceil((values - 1) / 2)      # places of the two middle values, from above
    middle = held.groupBy("soc_code").agg(
        F.max(F.when((F.col("_before") <= low) & (low <= last), F.struct(-F.col("_v"), "_before"))).alias("_low"),
        F.max(F.when((F.col("_before") <= high) & (high <= last), F.struct(-F.col("_v"), "_before"))).alias("_high"),
        F.max("_nulls").alias("_nulls"), F.max(((values - 1) % 2) / 2.0).alias("_half"))
    low_v, high_v = F.col("_low.col1"), F.col("_high.col1")
    median = (low_v + (high_v - low_v) * F.col("_half")).alias("_median")
    middle = middle.select("soc_code", "_nulls", median, "_low", "_high").select(
        "soc_code", "_nulls", "_median",
        F.when(F.col("_median") == F.col("_high.col1"), F.col("_high._before")).otherwise(F.col("_low._before")).alias("_above"))

    out = attach_ranks(signals, ["soc_code"], schema.MARKET_KEYS, orders, layout).join(middle, "soc_code", "left")
    reported = F.col("_before_growth_score") + F.when(F.col("_median") > F.col("supply_growth_3y"), F.col("_nulls")).otherwise(0)
    out = out.withColumn("_before_growth_score", F.when(F.col("supply_growth_3y").isNull(), F.coalesce("_above", F.lit(0)))
                         .otherwise(reported))
    for name in orders:
        out = out.withColumn(name, 100.0 * F.when(F.col("_total") <= 1, F.lit(0.0))
                             .otherwise(F.col(f"_before_{name}") / (F.col("_total") - 1)))
    return out


def ordered(result: DataFrame) -> DataFrame:
    """Presentation order: hardest first within each category (area breaks ties)."""
    return result.orderBy("soc_code", F.col("competition_index").desc(), "area_code")

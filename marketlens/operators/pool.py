"""Q5 talent pool summary for every (category, place), Q11 places, and the
findings on Q5 (F2, F12).

National aggregates are one ``groupBy(soc_code)`` (partial aggregation), joined
back on the category key; positions are windows partitioned by category (one
row per place, so bounded by the place dimension). No employment floor here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens import schema
from marketlens.functions.columns import nullif_zero, safe_div
from marketlens.functions.text import ordinal_text, percent_text

OUTPUT_COLUMNS = [
    "soc_code", "occupation", "occupation_group", "area_code", "metro", "state",
    "employment", "employment_per_1k", "supply_growth_3y", "growth_unavailable",
    "proj_growth_10y", "national_employment", "share_of_national_pool",
    "national_per_1k_avg", "concentration_ratio", "national_growth_weighted",
    "wage_p10", "wage_p25", "wage_p50", "wage_p75", "wage_p90", "national_wage_p50",
    "national_wage_weighted", "wage_premium", "wage_dispersion", "rank_by_size",
    "rank_by_wage", "metros_total", "wage_percentile_nationally", "metros_reporting",
]


def national_aggregates(market: DataFrame) -> DataFrame:
    has_growth = F.col("supply_growth_3y").isNotNull()
    return market.groupBy("soc_code").agg(
        F.sum("employment").alias("national_employment"),
        safe_div(F.sum(F.col("employment") * F.col("wage_p50")), F.sum("employment"))
        .alias("national_wage_weighted"),
        F.avg("employment_per_1k").alias("_per_1k_avg"),
        safe_div(F.sum(F.when(has_growth, F.col("employment") * F.col("supply_growth_3y"))),
                 F.sum(F.when(has_growth, F.col("employment"))))
        .alias("national_growth_weighted"),
        F.count(F.lit(1)).alias("metros_reporting"))


def talent_pool_summary(market: DataFrame) -> DataFrame:
    by_soc = Window.partitionBy("soc_code")
    ranked = (market
              .withColumn("rank_by_size", F.rank().over(
                  by_soc.orderBy(F.col("employment").desc_nulls_first())).cast("long"))
              .withColumn("rank_by_wage", F.rank().over(
                  by_soc.orderBy(F.col("wage_p50").desc_nulls_first())).cast("long"))
              .withColumn("metros_total", F.count(F.lit(1)).over(by_soc))
              .withColumn("wage_percentile_nationally", F.percent_rank().over(
                  by_soc.orderBy(F.col("wage_p50").asc_nulls_last()))))
    return (ranked.join(national_aggregates(market), "soc_code")
            .withColumn("growth_unavailable", F.col("supply_growth_3y").isNull())
            .withColumn("share_of_national_pool", safe_div("employment", "national_employment"))
            .withColumn("concentration_ratio",
                        F.col("employment_per_1k") / nullif_zero("_per_1k_avg"))
            .withColumn("national_per_1k_avg", F.col("_per_1k_avg"))
            .withColumn("wage_premium", safe_div("wage_p50", "national_wage_p50") - 1.0)
            .withColumn("wage_dispersion",
                        safe_div(F.col("wage_p75") - F.col("wage_p25"), "wage_p50"))
            .select(*OUTPUT_COLUMNS))


def lookup(summary: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Point lookups as a join: (found rows, requested pairs with no row)."""
    keys = ["soc_code", "area_code"]
    req = requests.select(*keys).distinct()
    return summary.join(req, keys, "left_semi"), req.join(summary.select(*keys), keys, "left_anti")


def available_metros(market: DataFrame, per_category: bool = True) -> DataFrame:
    """Q11: distinct places (optionally per category), ordered by name when shown."""
    cols = (["soc_code"] if per_category else []) + ["area_code", "metro", "state"]
    return market.select(*cols).distinct()


# ---------------------------------------------------------------- findings --
def pool_fact_sheet(summary: DataFrame) -> DataFrame:
    """F2 + F12: direction words and bands that agree with the numbers' signs, and
    a one-paragraph finding built from them."""
    words = _fact_words(summary)
    s = summary.alias("s")
    conc = F.col("s.concentration_ratio")
    pay = F.when(F.col("s.wage_premium").isNull(),
                 F.lit(" No national median to compare pay with.")).otherwise(F.concat(
                     F.lit(" Median pay $"), F.format_number("s.wage_p50", 0), F.lit(", "),
                     percent_text(F.abs(F.col("s.wage_premium"))), F.lit(" "),
                     F.col("w.pay_direction"), F.lit(" the national median.")))
    band = (F.when(F.col("w.concentration_band") == "specialist",
                   F.concat(F.lit(" A specialist market ("), F.format_number(conc, 1),
                            F.lit("x the average concentration).")))
            .when(F.col("w.concentration_band") == "under-represented",
                  F.concat(F.lit(" Under-represented here ("), F.format_number(conc, 1),
                           F.lit("x the average concentration).")))
            .otherwise(F.lit("")))
    growth = (F.when(F.col("w.growth_direction") == "unavailable",
                     F.lit(" Three-year growth is unavailable (prior estimate suppressed)."))
              .otherwise(F.concat(F.lit(" The pool "), F.col("w.growth_direction"), F.lit(" "),
                                  percent_text(F.abs(F.col("s.supply_growth_3y"))),
                                  F.lit(" over three years."))))
    text = F.concat(F.col("s.metro"), F.lit(": "), F.format_number("s.employment", 0),
                    F.lit(" employed, the "), F.col("w.size_position"), F.lit(" ("),
                    percent_text(F.col("s.share_of_national_pool"), 1),
                    F.lit(" of the national pool)."), pay, band, growth)
    return (words.alias("w").join(s, ["soc_code", "area_code"])
            .select("soc_code", "area_code", "w.pay_direction", "w.concentration_band",
                    "w.growth_direction", "w.rank_note", "w.size_position", text.alias("finding")))


def _fact_words(summary: DataFrame) -> DataFrame:
    conc = F.col("concentration_ratio")
    return summary.select(
        "soc_code", "area_code",
        F.when(F.col("wage_premium") >= 0, F.lit("above")).otherwise(F.lit("below"))
        .alias("pay_direction"),
        F.when(conc >= schema.SPECIALIST_CONCENTRATION, F.lit("specialist"))
        .when(conc <= schema.UNDER_REPRESENTED_CONCENTRATION, F.lit("under-represented"))
        .otherwise(F.lit("typical")).alias("concentration_band"),
        F.when(F.col("growth_unavailable"), F.lit("unavailable"))
        .when(F.col("supply_growth_3y") >= 0, F.lit("grew")).otherwise(F.lit("shrank"))
        .alias("growth_direction"),
        F.when(F.col("rank_by_size") == 1, F.lit("largest"))
        .when(F.col("rank_by_size") == F.col("metros_total"), F.lit("smallest"))
        .otherwise(F.lit("ranked")).alias("rank_note"),
        F.concat(ordinal_text("rank_by_size"), F.lit(" largest of "),
                 F.col("metros_total").cast("string")).alias("size_position"))

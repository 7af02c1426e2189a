"""Table-wide findings over the measures (F1, F11 and the sentence columns).

The reference renders one sentence per call; here each finding is one row per
category (or scenario) computed by a partial-aggregated ``groupBy`` with
``min_by``/``max_by`` (no per-group collection), and the sentence is a column
expression over that row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.text import money_text, percent_text

# The words naming the driver of a competition gap, in the
# declared order (the first wins ties).
DRIVER_WORDS = ("thin supply", "wage premiums", "a shrinking pool")


def _whole(x):
    """Round half to even to a whole number, as Python's ``{:.0f}`` does."""
    return F.bround(x, 0).cast("long").cast("string")


def market_extremes(index: DataFrame) -> DataFrame:
    """hardest and easiest place per category and what drives the gap.

    Hardest = first in (index DESC, area ASC), easiest = last in that order.
    """
    pick = F.struct("area_code", "metro", "competition_index", "scarcity_score",
                    "wage_premium_score", "growth_score")
    order = F.struct(-F.col("competition_index"), F.col("area_code"))
    agg = index.groupBy("soc_code").agg(F.first("occupation").alias("occupation"),
                                        F.min_by(pick, order).alias("h"),
                                        F.max_by(pick, order).alias("e"))
    g1 = F.col("h.scarcity_score") - F.col("e.scarcity_score")
    g2 = F.col("h.wage_premium_score") - F.col("e.wage_premium_score")
    g3 = F.col("h.growth_score") - F.col("e.growth_score")
    driver = (F.when((g1 >= g2) & (g1 >= g3), F.lit(DRIVER_WORDS[0]))
              .when(g2 >= g3, F.lit(DRIVER_WORDS[1])).otherwise(F.lit(DRIVER_WORDS[2])))
    out = agg.select(
        "soc_code",
        F.col("h.area_code").alias("hardest_area"), F.col("h.metro").alias("hardest_metro"),
        F.col("h.competition_index").alias("hardest_index"),
        F.col("e.area_code").alias("easiest_area"), F.col("e.metro").alias("easiest_metro"),
        F.col("e.competition_index").alias("easiest_index"),
        driver.alias("driver"), "occupation")
    return out.withColumn("finding", F.concat(
        F.col("hardest_metro"), F.lit(" is the hardest market for "), F.col("occupation"),
        F.lit(" ("), _whole(F.col("hardest_index")), F.lit("/100); "), F.col("easiest_metro"),
        F.lit(" is the easiest ("), _whole(F.col("easiest_index")),
        F.lit("). Main driver: "), F.col("driver"), F.lit("."))).drop("occupation")


def top_markets(index: DataFrame, n: int = 15) -> DataFrame:
    """the first ``n`` places per category by index (area breaks ties)."""
    w = Window.partitionBy("soc_code").orderBy(F.col("competition_index").desc(), "area_code")
    return (index.withColumn("position", F.row_number().over(w).cast("long"))
            .where(F.col("position") <= n)
            .select("soc_code", "position", "area_code", "metro", "competition_index",
                    "wage_p10", "wage_p25", "wage_p50", "wage_p75", "wage_p90"))


def arbitrage_sentence(outcomes: DataFrame) -> DataFrame:
    """F3 sentence: the saving, and whether a deep-enough pool backs it."""
    saving = money_text(F.abs(F.col("cheapest_annual_delta")))
    viable = money_text(F.abs(F.col("viable_annual_delta")))
    text = (F.when(F.col("outcome") == "none_cheaper",
                   F.concat(F.lit("No place is cheaper than "), F.col("baseline_metro"), F.lit(".")))
            .when(F.col("outcome") == "every_cheaper_thin",
                  F.concat(F.col("cheapest_metro"), F.lit(" saves "), saving,
                           F.lit(" a year, but every cheaper pool is thin.")))
            .when(F.col("outcome") == "cheapest_viable",
                  F.concat(F.col("cheapest_metro"), F.lit(" saves "), saving,
                           F.lit(" a year and its pool can absorb the plan.")))
            .otherwise(F.concat(F.col("cheapest_metro"), F.lit(" saves "), saving,
                                F.lit(" a year but is thin; "), F.col("viable_metro"),
                                F.lit(" still saves "), viable, F.lit("."))))
    return outcomes.withColumn("finding", text)


def usage_sentence(headline: DataFrame, days: int) -> DataFrame:
    """F6 sentence (views over the window, top view and its share)."""
    return headline.withColumn("finding", F.when(
        F.col("total_events") == 0, F.lit("No usage recorded yet.")).otherwise(F.concat(
            F.format_number(F.col("total_events"), 0), F.lit(" views over "), F.lit(str(days)),
            F.lit(" days; "), F.col("top_view"), F.lit(" leads with "),
            percent_text(F.col("top_view_events") / F.col("total_events")), F.lit(".")))
    )

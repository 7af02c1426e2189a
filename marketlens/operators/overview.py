"""Q6 mart overview: one row of counts and coverage.

Both tables are reduced to a single partial-aggregated row each; the two rows
are stacked and folded by one more aggregate (no join between them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.columns import safe_div


def mart_overview(market: DataFrame, skills: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = (lambda c: F.approx_count_distinct(c)) if approximate else F.countDistinct
    t = market.agg(
        F.count(F.lit(1)).alias("talent_rows"),
        distinct("soc_code").alias("occupations"),
        distinct("area_code").alias("metros"),
        distinct("state").alias("states"),
        F.count_if(F.col("supply_growth_3y").isNotNull()).alias("rows_with_growth"),
        F.min("wage_p50").alias("wage_p50_min"),
        F.max("wage_p50").alias("wage_p50_max"))
    s = skills.agg(
        F.count(F.lit(1)).alias("skill_rows"),
        distinct("skill").alias("skills_tracked"),
        distinct("soc_code").alias("occupations_with_skills"))
    stacked = t.unionByName(s, allowMissingColumns=True)
    one = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    return one.select(
        "talent_rows", "occupations", "metros", "states", "rows_with_growth",
        F.round(safe_div(100.0 * F.col("rows_with_growth"), "talent_rows"), 1)
        .alias("growth_coverage_pct"),
        "wage_p50_min", "wage_p50_max", "skill_rows", "skills_tracked",
        "occupations_with_skills")

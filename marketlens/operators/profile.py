"""Q4 skill profile for every category, and the findings on it.

Skill means and sample deviations run over all categories (the target
included), then every (category, skill) row gets its distinctiveness, z-score
and within-category percent rank (partition = one category's skills, bounded
by the skill dimension).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.columns import exact_mean, safe_div

ROUND = 6


def skill_stats(skills: DataFrame) -> DataFrame:
    """Per-skill mean and sample deviation over all categories. The mean's sum is taken in fixed
    point, so it is identical for any partitioning of the input; the deviation is the built-in one."""
    return skills.groupBy("skill").agg(
        exact_mean("importance").alias("mean_importance"),
        F.stddev_samp("importance").alias("sd_importance"))


def skill_profile(skills: DataFrame, top_n: int | None = None) -> DataFrame:
    by_soc = Window.partitionBy("soc_code")
    out = (skills.join(skill_stats(skills), "skill")
           .withColumn("distinctive", F.col("importance") - F.col("mean_importance"))
           .withColumn("z_score", safe_div("distinctive", "sd_importance"))
           .withColumn("within_role_rank",
                       F.percent_rank().over(by_soc.orderBy(F.col("importance").asc()))))
    if top_n:
        out = (out.withColumn("_rn", F.row_number().over(
            by_soc.orderBy(F.col("importance").desc(), "skill")))
            .where(F.col("_rn") <= top_n).drop("_rn"))
    return out.select("soc_code", "skill", "importance", "mean_importance", "distinctive",
                      "z_score", "within_role_rank")


def distinctive_skills(profile: DataFrame, n: int = 3) -> DataFrame:
    """per category the n most distinctive skills (joined in order) and the top
    raw skill."""
    w = Window.partitionBy("soc_code").orderBy(F.col("distinctive").desc(), "skill")
    top = profile.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    listed = top.groupBy("soc_code").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "skill"))),
                                 lambda s: s["skill"]), ", ").alias("distinctive_skills"))
    raw = profile.groupBy("soc_code").agg(
        F.min_by(F.struct("skill", "importance"),
                 F.struct(-F.col("importance"), F.col("skill"))).alias("_top"))
    out = (listed.join(raw, "soc_code")
           .select("soc_code", "distinctive_skills",
                   F.col("_top.skill").alias("top_raw_skill"),
                   F.col("_top.importance").alias("top_raw_importance")))
    return out.withColumn("finding", F.concat(
        F.lit("Most distinctive: "), F.col("distinctive_skills"), F.lit(". Top raw skill: "),
        F.col("top_raw_skill"), F.lit(" ("), F.format_number("top_raw_importance", 1), F.lit(" / 5).")))


def largest_deviations(profile: DataFrame, n: int = 14) -> DataFrame:
    """the n skills with the largest |distinctive| per category."""
    w = Window.partitionBy("soc_code").orderBy(F.abs("distinctive").desc(), "skill")
    return (profile.withColumn("deviation_rank", F.row_number().over(w).cast("long"))
            .where(F.col("deviation_rank") <= n))

"""Usage measures over the append-only event log.

``as_of`` replaces CURRENT_DATE; a window of ``days`` covers
``as_of - (days - 1)`` .. ``as_of`` inclusive. The lower bound is a literal of
the column's own type so it reaches the Parquet scan as a pushed filter; like
the reference there is no upper bound, rows after ``as_of`` fall off at the
calendar join (Q7) and are kept elsewhere.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens import schema
from marketlens.functions.columns import safe_div


def _start(days: int, as_of: str) -> dt.date:
    if days < 1:
        raise ValueError(f"days must be at least 1, got {days}")
    return dt.date.fromisoformat(as_of) - dt.timedelta(days=days - 1)


def in_window(log: DataFrame, days: int, as_of: str) -> DataFrame:
    start = _start(days, as_of).isoformat()
    ts_type = log.schema["occurred_at"].dataType
    return log.where(F.col("occurred_at") >= F.lit(start).cast(ts_type))


def usage_by_day(log: DataFrame, days: int, as_of: str) -> DataFrame:
    """Q7: views per calendar day over the window, empty days filled with 0."""
    start = _start(days, as_of)
    spine = log.sparkSession.range(1).select(F.explode(F.sequence(
        F.lit(start), F.lit(dt.date.fromisoformat(as_of)), F.expr("INTERVAL 1 DAY"))).alias("day"))
    counts = (in_window(log, days, as_of)
              .groupBy(F.to_date("occurred_at").alias("day"))
              .agg(F.count(F.lit(1)).alias("events")))
    return (spine.join(counts, "day", "left")
            .select("day", F.coalesce("events", F.lit(0)).cast("long").alias("events")))


def usage_by_view(log: DataFrame, days: int, as_of: str,
                  approximate: bool = False) -> DataFrame:
    """Q8: events, distinct sessions and last event per view."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    return (in_window(log, days, as_of).groupBy("view_name")
            .agg(F.count(F.lit(1)).alias("events"),
                 distinct("session_id").alias("sessions"),
                 F.max("occurred_at").alias("last_seen")))


def category_labels(market: DataFrame) -> DataFrame:
    """One label row per category (the lateral LIMIT 1, made deterministic).
    Accepts the market table or any (soc_code, occupation, occupation_group) frame."""
    return market.groupBy("soc_code").agg(F.min("occupation").alias("occupation"),
                                          F.min("occupation_group").alias("occupation_group"))


def top_requests(log: DataFrame, market: DataFrame, days: int,
                 as_of: str, limit: int = 10) -> DataFrame:
    """Q9: most requested categories; counted before the label join so a label can
    never fan the counts out; top ``limit`` by events (category breaks ties)."""
    counts = (in_window(log, days, as_of).where(F.col("soc_code").isNotNull())
              .groupBy("soc_code")
              .agg(F.count(F.lit(1)).alias("events"),
                   F.countDistinct("session_id").alias("sessions")))
    labelled = (counts.join(category_labels(market), "soc_code", "left")
                .select("soc_code",
                        F.coalesce("occupation", "soc_code").alias("occupation"),
                        F.coalesce("occupation_group", F.lit("Unknown")).alias("occupation_group"),
                        "events", "sessions"))
    return labelled.orderBy(F.col("events").desc(), "soc_code").limit(limit)


def usage_summary(log: DataFrame, days: int, as_of: str,
                  top_n: int = 10) -> DataFrame:
    """Q10: one row. ``sessions`` and ``occupations`` keep the reference's meaning
    (max of per-view distinct sessions; rows of the top-n list); the true distinct
    counts sit alongside."""
    win = in_window(log, days, as_of)
    by_view = usage_by_view(log, days, as_of).select(
        F.lit("view").alias("_part"), "events", F.col("sessions").alias("view_sessions"))
    totals = win.agg(F.countDistinct("session_id").alias("distinct_sessions"),
                     F.countDistinct("soc_code").alias("distinct_occupations")) \
        .select(F.lit("total").alias("_part"), "*")
    stacked = by_view.unionByName(totals, allowMissingColumns=True)
    return stacked.agg(
        F.coalesce(F.sum("events"), F.lit(0)).cast("long").alias("total_events"),
        F.coalesce(F.max("view_sessions"), F.lit(0)).cast("long").alias("sessions"),
        F.least(F.lit(int(top_n)).cast("long"), F.max("distinct_occupations"))
        .alias("occupations"),
        F.max("distinct_sessions").alias("distinct_sessions"),
        F.max("distinct_occupations").alias("distinct_occupations"))


# ------------------------------------------------- distinct over windows --
def rolling_users(log: DataFrame, window: int, days: int, as_of: str) -> DataFrame:
    """For each of the last ``days`` days the exact number of distinct session keys seen in the ``window`` days
    that end with it (null keys aren't counted, days without any count 0).

    A key seen on a day is in the windows that end on that day and the ``window - 1`` days after it; its days merge
    into intervals, of which only the ends are kept: +1 where one begins, -1 after it ends. One shuffle, on the
    key, of its distinct days (at most ``days + window - 1``); sums of differences by day do the rest."""
    if window < 1:
        raise ValueError(f"window must be at least 1, got {window}")
    start, last = _start(days, as_of), dt.date.fromisoformat(as_of)
    held = (in_window(log, days + window - 1, as_of).where(F.col("session_id").isNotNull())
            .select("session_id", F.date_diff(F.to_date("occurred_at"), F.lit(start)).alias("n"))
            .where(F.col("n") < days))                                   # day numbers from the first window's end
    seen = held.groupBy("session_id").agg(F.array_sort(F.collect_set("n")).alias("d"))
    begins = F.filter("d", lambda x, i: (i == 0) | (x - F.element_at("d", F.greatest(i, F.lit(1))) > window))
    ends = F.filter("d", lambda x, i: (i == F.size("d") - 1) | (F.element_at("d", F.least(i + 2, F.size("d"))) - x > window))
    changes = F.concat(F.transform(begins, lambda x: F.struct(F.greatest(x, F.lit(0)).alias("n"), F.lit(1).alias("by"))),
                       F.transform(ends, lambda x: F.struct(F.greatest(x + window, F.lit(0)).alias("n"), F.lit(-1).alias("by"))))
    by_day = seen.select(F.inline(changes)).groupBy("n").agg(F.sum("by").alias("by"))
    folded = by_day.agg(F.collect_list(F.struct("n", "by")).alias("all"))       # one entry a day
    at = F.explode(F.sequence(F.lit(0), F.lit((last - start).days)))
    total = F.expr("aggregate(filter(all, x -> x.n <= at), 0L, (s, x) -> s + x.by)")
    return folded.select("all", at.alias("at")).select(F.date_add(F.lit(start), F.col("at")).alias("day"), total.alias("users"))


#: Log2 of an HLL sketch's registers, and the relative error it is trusted to (three standard errors, 3 * 1.04 / 64).
SKETCH_LOG2, SKETCH_ERROR = 12, 0.05


def daily_sketches(log: DataFrame) -> DataFrame:
    """Q8a, stored form: per (day, view) events, last event and a mergeable sketch of the session keys; a few KB a
    row whatever the number of events."""
    return log.groupBy(F.to_date("occurred_at").alias("day"), "view_name").agg(
        F.count(F.lit(1)).alias("events"), F.max("occurred_at").alias("last_seen"),
        F.hll_sketch_agg("session_id", SKETCH_LOG2).alias("sketch"))


def window_from_sketches(daily: DataFrame, days: int, as_of: str) -> DataFrame:
    """Q8a over any window from the stored rows, without reading events: sketches are united per view.
    ``sessions`` is within ``SKETCH_ERROR`` of the exact count with three standard errors."""
    start = _start(days, as_of).isoformat()
    return (daily.where(F.col("day") >= F.lit(start).cast("date")).groupBy("view_name")
            .agg(F.sum("events").alias("events"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("sessions"),
                 F.max("last_seen").alias("last_seen")))


# ---------------------------------------------------------------- findings --
def usage_headline(log: DataFrame, days: int, as_of: str) -> DataFrame:
    """total views, the top view, its share and the concentration flag."""
    by_view = usage_by_view(log, days, as_of)
    agg = by_view.agg(F.sum("events").alias("total_events"),
                      F.min_by(F.struct("view_name", "events"),
                               F.struct(-F.col("events"), F.col("view_name"))).alias("_top"),
                      F.count(F.lit(1)).alias("views"))
    share = safe_div(F.col("_top.events"), "total_events")
    return agg.select(
        F.coalesce("total_events", F.lit(0)).cast("long").alias("total_events"),
        F.col("_top.view_name").alias("top_view"),
        F.col("_top.events").alias("top_view_events"),
        share.alias("top_view_share"),
        ((F.col("views") > 1) & (share > schema.USAGE_CONCENTRATION_SHARE)).alias("concentrated"))


# ---------------------------------------------------- documented measures --
def adoption_funnel(log: DataFrame) -> DataFrame:
    """Per session key, activated (any event), returned (an event more than
    24 h after the first) and habitual (3+ distinct weeks); one row of totals."""
    per = (log.where(F.col("session_id").isNotNull()).groupBy("session_id")
           .agg(F.min("occurred_at").alias("first_at"),
                F.max("occurred_at").alias("last_at"),
                F.countDistinct(F.date_trunc("week", "occurred_at")).alias("weeks")))
    returned = F.col("last_at") > F.col("first_at") + F.expr("INTERVAL 24 HOURS")
    totals = per.agg(F.count(F.lit(1)).alias("activated"),
                     F.count_if(returned).alias("returned"),
                     F.count_if(F.col("weeks") >= 3).alias("habitual"))
    return totals.withColumn("return_rate", safe_div(F.col("returned").cast("double"), "activated"))


def family_share(log: DataFrame, market: DataFrame, days: int, as_of: str) -> DataFrame:
    """Share of windowed lookups per category family (unlabelled -> Unknown)."""
    counts = (in_window(log, days, as_of).where(F.col("soc_code").isNotNull())
              .groupBy("soc_code").agg(F.count(F.lit(1)).alias("events")))
    fam = (counts.join(category_labels(market), "soc_code", "left")
           .groupBy(F.coalesce("occupation_group", F.lit("Unknown")).alias("occupation_group"))
           .agg(F.sum("events").alias("events")))
    total = fam.select(F.sum("events")).scalar()       # one value, a scalar subquery
    return fam.withColumn("share", F.col("events") / total)


def pool_shrink_alerts(market: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Places whose pool fell by at least ``threshold`` since the prior vintage."""
    return (market.where(F.col("supply_growth_3y") <= -abs(threshold))
            .select("soc_code", "area_code", "metro", "employment", "employment_prior",
                    "supply_growth_3y"))

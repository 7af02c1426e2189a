"""Registered queries and their DuckDB oracles.

Each query takes ``(spark, sf_dir)``, derives the marts from the driver tables
with Spark, runs one operator for every category at once and returns a lazy
DataFrame. ``ORACLES`` holds the matching SQL (same column names).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens import schema
from marketlens.operators import (
    adjacency, arbitrage, competition, findings, ingest, overview, pool, profile, quality, usage,
)
from marketlens.plans import aggregates, build, publish
from marketlens.plans.oracle import (
    INGEST_SQL, MARKET_CTE, SKILLS_LABEL_CTE, SKILLS_VECTOR_CTE, USAGE_CTE, with_ctes,
)
from marketlens.session import ensure_checkpoint_dir
from marketlens.sources import raw, testmart
from marketlens.streaming import event_log, late_rows, usage_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- Q1 -------
# Scores are counted, not windowed: a cell's score is the share of the category's other cells ahead
# of it, its rank one more than the cells with a higher index.
Q1_BODY = """
big AS (SELECT *, wage_p50 / NULLIF(national_wage_p50, 0) - 1.0 AS premium
        FROM market WHERE employment >= 100.0),
middle AS (SELECT soc_code AS k, MEDIAN(supply_growth_3y) AS usual FROM big GROUP BY k),
cell AS (SELECT big.*, IFNULL(supply_growth_3y, usual) AS g FROM big JOIN middle ON k = soc_code),
ahead AS (
    SELECT a.soc_code AS k, a.area_code AS p, COUNT(*) - 1 AS others,
           COUNT(*) FILTER (b.employment_per_1k > a.employment_per_1k
               OR (b.employment_per_1k IS NULL AND a.employment_per_1k IS NOT NULL)) AS by_supply,
           COUNT(*) FILTER (b.premium < a.premium OR (a.premium IS NULL AND b.premium IS NOT NULL)) AS by_pay,
           COUNT(*) FILTER (b.g > a.g OR (b.g IS NULL AND a.g IS NOT NULL)) AS by_growth
    FROM cell a JOIN cell b ON a.soc_code = b.soc_code GROUP BY k, p
),
scored AS (
    SELECT k, p, 100.0 * IFNULL(by_supply / NULLIF(others, 0), 0) AS s1,
           100.0 * IFNULL(by_pay / NULLIF(others, 0), 0) AS s2,
           100.0 * IFNULL(by_growth / NULLIF(others, 0), 0) AS s3,
           0.5 * s1 + 0.3 * s2 + 0.2 * s3 AS total
    FROM ahead
)
SELECT soc_code, occupation, occupation_group, area_code, metro, state, employment,
       employment_per_1k, supply_growth_3y, supply_growth_3y IS NULL AS growth_imputed, proj_growth_10y,
       wage_p10, wage_p25, wage_p50, wage_p75, wage_p90, national_wage_p50, premium AS wage_premium,
       (wage_p75 - wage_p25) / NULLIF(wage_p50, 0) AS wage_dispersion,
       s1 AS scarcity_score, s2 AS wage_premium_score, s3 AS growth_score, total AS competition_index,
       1 + (SELECT COUNT(*) FROM scored o WHERE o.k = scored.k AND o.total > scored.total) AS difficulty_rank
FROM scored JOIN cell ON k = soc_code AND p = area_code
"""
Q1_SQL = with_ctes(MARKET_CTE, Q1_BODY)


@register("q1_competition_index", Q1_SQL)
def q1_competition_index(spark, sf_dir):
    return competition.competition_index(testmart.market(spark, sf_dir))


@register("q1_competition_index_distributed", Q1_SQL)
def q1_competition_index_distributed(spark, sf_dir):
    return competition.competition_index(testmart.market(spark, sf_dir), strategy="distributed")


# ---------------------------------------------------------------- Q2 -------
Q2_BODY = """
open_cells AS (SELECT *, wage_{percentile} AS pay, employment * 0.02 AS reachable, {headcount}::BIGINT AS wanted
               FROM market WHERE employment >= 100.0),
home AS (SELECT DISTINCT ON (soc_code) soc_code, area_code AS home_area, metro AS home_metro, pay AS home_pay
         FROM open_cells ORDER BY soc_code, employment DESC, area_code)
SELECT soc_code, occupation, area_code, metro, state, employment, employment_per_1k, supply_growth_3y,
       home_area AS baseline_area, home_metro AS baseline_metro, home_pay AS baseline_wage,
       wanted AS headcount, '{percentile}' AS percentile, pay AS wage_at_percentile,
       pay - home_pay AS wage_delta_per_hire, (pay - home_pay) / NULLIF(home_pay, 0) AS wage_delta_pct,
       wanted * (pay - home_pay) AS annual_delta_total, wanted * pay AS annual_cost_total,
       FLOOR(reachable) AS hires_supportable, reachable / NULLIF(wanted, 0) AS pool_depth_ratio,
       ['Thin', 'Adequate', 'Deep'][1 + (reachable >= wanted)::INT + (reachable >= 3 * wanted)::INT] AS pool_depth,
       area_code = home_area AS is_baseline
FROM home JOIN open_cells USING (soc_code) WHERE pay IS NOT NULL
"""


def _q2(headcount, percentile):
    def run(spark, sf_dir):
        m = testmart.market(spark, sf_dir)
        return arbitrage.wage_arbitrage(
            m, arbitrage.largest_pool_scenarios(m, headcount=headcount, percentile=percentile))
    return run


register("q2_wage_arbitrage", with_ctes(MARKET_CTE, Q2_BODY.format(headcount=20, percentile="p50"))
         )(_q2(20, "p50"))
register("q2_wage_arbitrage_p75_h60",
         with_ctes(MARKET_CTE, Q2_BODY.format(headcount=60, percentile="p75")))(_q2(60, "p75"))

# every place as the baseline; the SQL meets all pairs of places, the operator none
Q2J = {"headcounts": (5, 20, 60), "percentiles": ("p25", "p50", "p90"), "k": 3}
Q2J_SQL = with_ctes(MARKET_CTE, """
plan AS (SELECT * FROM (VALUES """ + ", ".join(f"({h}::BIGINT, '{p}')" for h in Q2J["headcounts"] for p in Q2J["percentiles"]) + """) v(headcount, percentile)),
cell AS (SELECT soc_code, headcount, percentile, area_code, metro, employment * 0.02 AS reachable,
                CASE percentile WHEN 'p25' THEN wage_p25 WHEN 'p50' THEN wage_p50 ELSE wage_p90 END AS pay
         FROM market, plan WHERE employment >= 100.0),
pair AS (SELECT a.*, b.area_code AS to_area, b.metro AS to_metro, b.pay AS to_pay, FLOOR(b.reachable) AS hires,
                COUNT(b.area_code) OVER (PARTITION BY a.soc_code, a.headcount, a.percentile, a.area_code) AS viable_places,
                ROW_NUMBER() OVER (PARTITION BY a.soc_code, a.headcount, a.percentile, a.area_code
                                   ORDER BY a.headcount * (b.pay - a.pay), b.area_code) AS n
         FROM cell a LEFT JOIN cell b ON a.soc_code = b.soc_code AND a.headcount = b.headcount AND a.percentile = b.percentile
              AND b.reachable >= b.headcount AND b.headcount * (b.pay - a.pay) < 0
         WHERE a.pay IS NOT NULL)
SELECT soc_code, headcount, percentile, area_code AS baseline_area, metro AS baseline_metro, pay AS baseline_wage, viable_places,
       CASE WHEN to_area IS NOT NULL THEN n END::INTEGER AS rank, to_area AS area_code, to_metro AS metro, to_pay AS wage_at_percentile,
       to_pay - pay AS wage_delta_per_hire, (to_pay - pay) / NULLIF(pay, 0) AS wage_delta_pct,
       headcount * (to_pay - pay) AS annual_delta_total, hires AS hires_supportable
FROM pair WHERE n <= """ + str(Q2J["k"]))


@register("q2j_viable_alternatives", Q2J_SQL)
def q2j_viable_alternatives(spark, sf_dir):
    return arbitrage.all_baselines(testmart.market(spark, sf_dir), **Q2J)


@register("q2j_viable_alternatives_distributed", Q2J_SQL)
def q2j_viable_alternatives_distributed(spark, sf_dir):
    return arbitrage.all_baselines(testmart.market(spark, sf_dir), **Q2J, strategy="distributed")


# ---------------------------------------------------------------- Q4 -------
Q4_BODY = """
usual AS (SELECT skill, SUM(importance::DECIMAL(18,6))::DOUBLE / COUNT(importance) AS mean_importance,
                 STDDEV_SAMP(importance) AS sd FROM skills GROUP BY skill)
SELECT soc_code, skill, importance, mean_importance, importance - mean_importance AS distinctive,
       ROUND((importance - mean_importance) / NULLIF(sd, 0), 8) AS z_score,
       IFNULL((RANK() OVER (PARTITION BY soc_code ORDER BY importance) - 1)
              / NULLIF(COUNT(*) OVER (PARTITION BY soc_code) - 1, 0), 0) AS within_role_rank
FROM skills JOIN usual USING (skill)
"""


def _profile(skills, **kw):
    """The profile, its scores rounded for the comparison (the operator doesn't round)."""
    return profile.skill_profile(skills, **kw).withColumn("z_score", F.round("z_score", 8))


@register("q4_skill_profile", with_ctes(MARKET_CTE, SKILLS_LABEL_CTE, Q4_BODY))
def q4_skill_profile(spark, sf_dir):
    return _profile(testmart.skills(spark, sf_dir, "label"))


@register("q4_skill_profile_vectors", with_ctes(SKILLS_VECTOR_CTE, Q4_BODY))
def q4_skill_profile_vectors(spark, sf_dir):
    return _profile(testmart.skills(spark, sf_dir, "vector"))


# ---------------------------------------------------------------- Q5 -------
Q5_BODY = """
nation AS (
    SELECT soc_code AS k, SUM(employment) AS pool, AVG(employment_per_1k) AS density, COUNT(*) AS places,
           SUM(employment * wage_p50) / NULLIF(SUM(employment), 0) AS pay,
           SUM(employment * supply_growth_3y)
               / NULLIF(SUM(employment) FILTER (supply_growth_3y IS NOT NULL), 0) AS growth
    FROM market GROUP BY k
),
ahead AS (
    SELECT a.soc_code AS k, a.area_code AS p,
           COUNT(*) FILTER (b.employment > a.employment
               OR (b.employment IS NULL AND a.employment IS NOT NULL)) AS bigger,
           COUNT(*) FILTER (b.wage_p50 > a.wage_p50 OR (b.wage_p50 IS NULL AND a.wage_p50 IS NOT NULL)) AS dearer,
           COUNT(*) FILTER (b.wage_p50 < a.wage_p50 OR (a.wage_p50 IS NULL AND b.wage_p50 IS NOT NULL)) AS cheaper
    FROM market a JOIN market b ON a.soc_code = b.soc_code GROUP BY k, p
)
SELECT soc_code, occupation, occupation_group, area_code, metro, state, employment, employment_per_1k,
       supply_growth_3y, supply_growth_3y IS NULL AS growth_unavailable, proj_growth_10y,
       pool AS national_employment, employment / NULLIF(pool, 0) AS share_of_national_pool,
       density AS national_per_1k_avg, employment_per_1k / NULLIF(density, 0) AS concentration_ratio,
       growth AS national_growth_weighted, wage_p10, wage_p25, wage_p50, wage_p75, wage_p90,
       national_wage_p50, pay AS national_wage_weighted,
       wage_p50 / NULLIF(national_wage_p50, 0) - 1.0 AS wage_premium,
       (wage_p75 - wage_p25) / NULLIF(wage_p50, 0) AS wage_dispersion,
       bigger + 1 AS rank_by_size, dearer + 1 AS rank_by_wage, places AS metros_total,
       IFNULL(cheaper / NULLIF(places - 1, 0), 0) AS wage_percentile_nationally, places AS metros_reporting
FROM market JOIN nation ON nation.k = soc_code JOIN ahead ON ahead.k = soc_code AND p = area_code
"""
Q5_SQL = with_ctes(MARKET_CTE, Q5_BODY)
#: Sums of doubles depend on their order in the last bits; both sides round them to be compared.
Q5_PLACES = {"national_wage_weighted": 4, "national_per_1k_avg": 8, "concentration_ratio": 8,
             "national_growth_weighted": 8}
Q5_ROUNDED = "* REPLACE (" + ", ".join(f"ROUND({c}, {n}) AS {c}" for c, n in Q5_PLACES.items()) + ")"


def _rounded(df: DataFrame, places: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


@register("q5_talent_pool_summary", f"SELECT {Q5_ROUNDED} FROM ({Q5_SQL})")
def q5_talent_pool_summary(spark, sf_dir):
    return _rounded(pool.talent_pool_summary(testmart.market(spark, sf_dir)), Q5_PLACES)


# ---------------------------------------------------------------- Q6 -------
@register("q6_mart_overview", with_ctes(MARKET_CTE, SKILLS_LABEL_CTE, """
SELECT COUNT(*) AS talent_rows, COUNT(DISTINCT soc_code) AS occupations, COUNT(DISTINCT area_code) AS metros,
       COUNT(DISTINCT state) AS states, COUNT(supply_growth_3y) AS rows_with_growth,
       ROUND(100.0 * COUNT(supply_growth_3y) / NULLIF(COUNT(*), 0), 1) AS growth_coverage_pct,
       MIN(wage_p50) AS wage_p50_min, MAX(wage_p50) AS wage_p50_max,
       (SELECT COUNT(*) FROM skills) AS skill_rows,
       (SELECT COUNT(DISTINCT skill) FROM skills) AS skills_tracked,
       (SELECT COUNT(DISTINCT soc_code) FROM skills) AS occupations_with_skills
FROM market
"""))
def q6_mart_overview(spark, sf_dir):
    return overview.mart_overview(testmart.market(spark, sf_dir),
                                  testmart.skills(spark, sf_dir, "label"))


# ---------------------------------------------------------------- Q11 ------
@register("q11_available_metros", with_ctes(MARKET_CTE, """
SELECT DISTINCT soc_code, area_code, metro, state FROM market
"""))
def q11_available_metros(spark, sf_dir):
    return pool.available_metros(testmart.market(spark, sf_dir))


# ---------------------------------------------------------------- Q7-Q10 ---
USAGE_WINDOW = "occurred_at >= TIMESTAMP '2024-01-01'"


@register("q7_usage_by_day", with_ctes(USAGE_CTE, f"""
calendar AS (
    SELECT CAST(d AS DATE) AS day
    FROM generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY) AS g(d)
),
ev AS (
    SELECT CAST(occurred_at AS DATE) AS day, COUNT(*) AS events
    FROM usage_log WHERE {USAGE_WINDOW} GROUP BY 1
)
SELECT c.day, CAST(COALESCE(e.events, 0) AS BIGINT) AS events
FROM calendar c LEFT JOIN ev e ON c.day = e.day
"""))
def q7_usage_by_day(spark, sf_dir):
    return usage.usage_by_day(testmart.usage_log(spark, sf_dir), 30, testmart.AS_OF)


@register("q8_usage_by_view", with_ctes(USAGE_CTE, f"""
SELECT view_name, COUNT(*) AS events, COUNT(DISTINCT session_id) AS sessions,
       MAX(occurred_at) AS last_seen
FROM usage_log WHERE {USAGE_WINDOW} GROUP BY view_name
"""))
def q8_usage_by_view(spark, sf_dir):
    return usage.usage_by_view(testmart.usage_log(spark, sf_dir), 30, testmart.AS_OF)


@register("q9_top_requests", with_ctes(MARKET_CTE, USAGE_CTE, f"""
labels AS (
    SELECT soc_code, MIN(occupation) AS occupation, MIN(occupation_group) AS occupation_group
    FROM market GROUP BY soc_code
),
counts AS (
    SELECT soc_code, COUNT(*) AS events, COUNT(DISTINCT session_id) AS sessions
    FROM usage_log WHERE {USAGE_WINDOW} AND soc_code IS NOT NULL GROUP BY soc_code
)
SELECT c.soc_code, COALESCE(l.occupation, c.soc_code) AS occupation,
       COALESCE(l.occupation_group, 'Unknown') AS occupation_group, c.events, c.sessions
FROM counts c LEFT JOIN labels l ON c.soc_code = l.soc_code
ORDER BY c.events DESC, c.soc_code LIMIT 10
"""))
def q9_top_requests(spark, sf_dir):
    return usage.top_requests(testmart.usage_log(spark, sf_dir), testmart.labels(spark, sf_dir),
                              30, testmart.AS_OF, 10)


@register("q10_usage_summary", with_ctes(USAGE_CTE, f"""
w AS (SELECT * FROM usage_log WHERE {USAGE_WINDOW}),
by_view AS (SELECT view_name, COUNT(*) AS events, COUNT(DISTINCT session_id) AS s
            FROM w GROUP BY view_name)
SELECT CAST(COALESCE((SELECT SUM(events) FROM by_view), 0) AS BIGINT) AS total_events,
       CAST(COALESCE((SELECT MAX(s) FROM by_view), 0) AS BIGINT) AS sessions,
       LEAST(CAST(10 AS BIGINT), (SELECT COUNT(DISTINCT soc_code) FROM w)) AS occupations,
       (SELECT COUNT(DISTINCT session_id) FROM w) AS distinct_sessions,
       (SELECT COUNT(DISTINCT soc_code) FROM w) AS distinct_occupations
"""))
def q10_usage_summary(spark, sf_dir):
    return usage.usage_summary(testmart.usage_log(spark, sf_dir), 30, testmart.AS_OF, 10)


# ---------------------------------------------------------------- Q3 -------
CENTERED_CTE = """
usual AS (SELECT skill, SUM(importance::DECIMAL(18,6))::DOUBLE / COUNT(importance) AS mean FROM skills GROUP BY skill),
dev AS (SELECT soc_code AS who, skill, importance - mean AS d FROM skills JOIN usual USING (skill))
"""
RAW_CTE = """
dev AS (SELECT soc_code AS who, skill, importance AS d FROM skills)
"""
# pairs meet on skills; the best eight of each target are numbered in a second step
PAIRS_BODY = """
size AS (SELECT who, SQRT(SUM(d * d)) AS len FROM dev GROUP BY who),
meet AS (
    SELECT x.who AS me, y.who AS other, SUM(y.d * x.d) AS dot,
           STRING_AGG(x.skill, ', ' ORDER BY LEAST(x.d, y.d) DESC, x.skill) FILTER (x.d > 0 AND y.d > 0) AS common,
           COUNT(*) FILTER (x.d > 0 AND y.d > 0) AS n_common
    FROM dev x JOIN dev y USING (skill) WHERE x.who <> y.who GROUP BY me, other
),
best AS (
    SELECT me, other, dot, common, n_common, dot / NULLIF(b.len * a.len, 0) AS cosine
    FROM meet JOIN size a ON a.who = me JOIN size b ON b.who = other
    WHERE dot / NULLIF(b.len * a.len, 0) IS NOT NULL
    QUALIFY ROW_NUMBER() OVER (PARTITION BY me ORDER BY cosine DESC, other) <= 8
)
"""
Q3_SELECT = """
SELECT me AS target_soc, other AS soc_code, {dot} AS dot_product, {cosine} AS similarity,
       n_common AS shared_strength_count, common AS shared_strengths{label_cols}
FROM best{label_join}
"""
LABELS_CTE = """
labels AS (
    SELECT soc_code, MIN(occupation) AS occupation, MIN(occupation_group) AS occupation_group
    FROM market GROUP BY soc_code
)
"""
_EXACT, _COMPARED = {"dot": "dot", "cosine": "cosine"}, {"dot": "ROUND(dot, 8)", "cosine": "ROUND(cosine, 8)"}
_NAMED = {"label_cols": ", occupation, occupation_group", "label_join": " LEFT JOIN labels ON labels.soc_code = other"}
Q3_LABELLED = Q3_SELECT.format(**_COMPARED, **_NAMED)
Q3_PLAIN = Q3_SELECT.format(**_COMPARED, label_cols="", label_join="")
Q3_PLACES = {"dot_product": 8, "similarity": 8}


def _adjacency(spark, sf_dir):
    return adjacency.skill_adjacency(testmart.skills(spark, sf_dir, "label"), limit=8,
                                     labels=testmart.labels(spark, sf_dir))


@register("q3_skill_adjacency", with_ctes(MARKET_CTE, LABELS_CTE, SKILLS_LABEL_CTE, CENTERED_CTE,
                                          PAIRS_BODY + Q3_LABELLED))
def q3_skill_adjacency(spark, sf_dir):
    return _rounded(_adjacency(spark, sf_dir), Q3_PLACES)


@register("q3_skill_adjacency_vectors",
          with_ctes(SKILLS_VECTOR_CTE, CENTERED_CTE, PAIRS_BODY + Q3_PLAIN))
def q3_skill_adjacency_vectors(spark, sf_dir):
    return _rounded(adjacency.skill_adjacency(testmart.skills(spark, sf_dir, "vector"), limit=8), Q3_PLACES)


@register("q3_raw_cosine_vectors", with_ctes(SKILLS_VECTOR_CTE, RAW_CTE, PAIRS_BODY + Q3_PLAIN))
def q3_raw_cosine_vectors(spark, sf_dir):
    return _rounded(adjacency.skill_adjacency(testmart.skills(spark, sf_dir, "vector"), limit=8,
                                              centered=False), Q3_PLACES)


SPREAD_PART = """
{name}_size AS (SELECT who, SQRT(SUM(d * d)) AS len FROM {src} GROUP BY who),
{name}_dots AS (SELECT x.who AS me, y.who AS other, SUM(x.d * y.d) AS dot
                FROM {src} x JOIN {src} y USING (skill) WHERE x.who <> y.who GROUP BY me, other),
{name}_range AS (
    SELECT me, MIN(dot / NULLIF(a.len * b.len, 0)) AS lo, MAX(dot / NULLIF(a.len * b.len, 0)) AS hi,
           COUNT(dot / NULLIF(a.len * b.len, 0)) AS candidates
    FROM {name}_dots JOIN {name}_size a ON a.who = me JOIN {name}_size b ON b.who = other
    GROUP BY me HAVING candidates > 0
)"""
SPREAD_PLACES = dict.fromkeys(["raw_min", "raw_max", "centered_min", "centered_max", "raw_spread",
                               "centered_spread"], 8)


@register("q3j_similarity_spread", with_ctes(
    SKILLS_LABEL_CTE, CENTERED_CTE,
    "plain AS (SELECT soc_code AS who, skill, importance AS d FROM skills),"
    + SPREAD_PART.format(name="r", src="plain") + ","
    + SPREAD_PART.format(name="c", src="dev") + """
SELECT r.me AS target_soc, r.candidates, ROUND(r.lo, 8) AS raw_min, ROUND(r.hi, 8) AS raw_max,
       ROUND(c.lo, 8) AS centered_min, ROUND(c.hi, 8) AS centered_max,
       ROUND(r.hi - r.lo, 8) AS raw_spread, ROUND(c.hi - c.lo, 8) AS centered_spread
FROM r_range r JOIN c_range c USING (me)
"""))
def q3j_similarity_spread(spark, sf_dir):
    return _rounded(adjacency.similarity_spread(testmart.skills(spark, sf_dir, "label")), SPREAD_PLACES)


# ---------------------------------------------------------------- findings --
def nest(name: str, sql: str) -> str:
    return f"{name} AS ({sql})"


ORDINAL_SQL = """(CAST({n} AS VARCHAR) || CASE WHEN {n} % 100 BETWEEN 10 AND 20 THEN 'th'
    WHEN {n} % 10 = 1 THEN 'st' WHEN {n} % 10 = 2 THEN 'nd' WHEN {n} % 10 = 3 THEN 'rd'
    ELSE 'th' END)"""
MONEY_SQL = """(CASE WHEN {v} IS NULL THEN NULL
    WHEN ABS({v}) >= 1000000 THEN '$' || format('{{:,.1f}}',
        CAST(ROUND(CAST({v} / 1000000.0 AS DECIMAL(38,10)), 1) AS DOUBLE)) || 'M'
    WHEN ABS({v}) >= 10000 THEN '$' || format('{{:,.0f}}',
        CAST(ROUND(CAST({v} / 1000.0 AS DECIMAL(38,10)), 0) AS DOUBLE)) || 'k'
    ELSE '$' || format('{{:,.0f}}', CAST(ROUND(CAST({v} AS DECIMAL(38,10)), 0) AS DOUBLE)) END)"""


def _q1_index(spark, sf_dir):
    return competition.competition_index(testmart.market(spark, sf_dir))


@register("f1_market_extremes", "WITH " + nest("q1", Q1_SQL) + """,
ranked AS (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY soc_code ORDER BY competition_index DESC, area_code) AS rn_h,
              ROW_NUMBER() OVER (PARTITION BY soc_code ORDER BY competition_index ASC, area_code DESC) AS rn_e
    FROM q1
),
pair AS (
    SELECT h.soc_code, h.occupation, h.area_code AS hardest_area, h.metro AS hardest_metro,
           h.competition_index AS hardest_index, e.area_code AS easiest_area,
           e.metro AS easiest_metro, e.competition_index AS easiest_index,
           h.scarcity_score - e.scarcity_score AS g1,
           h.wage_premium_score - e.wage_premium_score AS g2,
           h.growth_score - e.growth_score AS g3
    FROM ranked h JOIN ranked e ON h.soc_code = e.soc_code AND h.rn_h = 1 AND e.rn_e = 1
),
driven AS (
    SELECT *, CASE WHEN g1 >= g2 AND g1 >= g3 THEN 'thin supply'
                   WHEN g2 >= g3 THEN 'wage premiums' ELSE 'a shrinking pool' END AS driver
    FROM pair
)
SELECT soc_code, hardest_area, hardest_metro, hardest_index, easiest_area, easiest_metro,
       easiest_index, driver,
       hardest_metro || ' is the hardest market for ' || occupation || ' ('
       || CAST(CAST(ROUND_EVEN(hardest_index, 0) AS BIGINT) AS VARCHAR) || '/100); '
       || easiest_metro || ' is the easiest ('
       || CAST(CAST(ROUND_EVEN(easiest_index, 0) AS BIGINT) AS VARCHAR) || '). Main driver: '
       || driver || '.' AS finding
FROM driven
""")
def f1_market_extremes(spark, sf_dir):
    return findings.market_extremes(_q1_index(spark, sf_dir))


@register("f11_top_markets", "WITH " + nest("q1", Q1_SQL) + """
SELECT soc_code, position, area_code, metro, competition_index,
       wage_p10, wage_p25, wage_p50, wage_p75, wage_p90
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY soc_code ORDER BY competition_index DESC, area_code)
                AS position FROM q1)
WHERE position <= 15
""")
def f11_top_markets(spark, sf_dir):
    return findings.top_markets(_q1_index(spark, sf_dir), 15)


@register("f2_pool_fact_sheet", "WITH " + nest("q5", Q5_SQL) + f""",
w AS (
    SELECT soc_code, area_code,
           CASE WHEN wage_premium >= 0 THEN 'above' ELSE 'below' END AS pay_direction,
           CASE WHEN concentration_ratio >= 1.25 THEN 'specialist'
                WHEN concentration_ratio <= 0.75 THEN 'under-represented'
                ELSE 'typical' END AS concentration_band,
           CASE WHEN growth_unavailable THEN 'unavailable'
                WHEN supply_growth_3y >= 0 THEN 'grew' ELSE 'shrank' END AS growth_direction,
           CASE WHEN rank_by_size = 1 THEN 'largest'
                WHEN rank_by_size = metros_total THEN 'smallest' ELSE 'ranked' END AS rank_note,
           {ORDINAL_SQL.format(n="rank_by_size")} || ' largest of ' || CAST(metros_total AS VARCHAR)
               AS size_position
    FROM q5
)
SELECT w.*,
       q5.metro || ': ' || format('{{:,.0f}}', q5.employment) || ' employed, the ' || w.size_position
       || ' (' || format('{{:,.1f}}', q5.share_of_national_pool * 100) || '% of the national pool).'
       || CASE WHEN q5.wage_premium IS NULL THEN ' No national median to compare pay with.'
               ELSE ' Median pay $' || format('{{:,.0f}}', q5.wage_p50) || ', '
                    || format('{{:,.0f}}', ABS(q5.wage_premium) * 100) || '% ' || w.pay_direction
                    || ' the national median.' END
       || CASE w.concentration_band
              WHEN 'specialist' THEN ' A specialist market ('
                   || format('{{:,.1f}}', q5.concentration_ratio) || 'x the average concentration).'
              WHEN 'under-represented' THEN ' Under-represented here ('
                   || format('{{:,.1f}}', q5.concentration_ratio) || 'x the average concentration).'
              ELSE '' END
       || CASE w.growth_direction
              WHEN 'unavailable' THEN ' Three-year growth is unavailable (prior estimate suppressed).'
              ELSE ' The pool ' || w.growth_direction || ' '
                   || format('{{:,.0f}}', ABS(q5.supply_growth_3y) * 100) || '% over three years.' END
           AS finding
FROM w JOIN q5 ON w.soc_code = q5.soc_code AND w.area_code = q5.area_code
""")
def f2_pool_fact_sheet(spark, sf_dir):
    return pool.pool_fact_sheet(pool.talent_pool_summary(testmart.market(spark, sf_dir)))


Q2_SQL = with_ctes(MARKET_CTE, Q2_BODY.format(headcount=20, percentile="p50"))
SCEN = "soc_code, baseline_area, headcount, percentile"


def _q2_default(spark, sf_dir):
    return _q2(20, "p50")(spark, sf_dir)


@register("f3_cheapest_vs_viable", "WITH " + nest("q2", Q2_SQL) + f""",
c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {SCEN} ORDER BY annual_delta_total, area_code) AS rn
      FROM q2 WHERE annual_delta_total IS NOT NULL),
v AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {SCEN} ORDER BY annual_delta_total, area_code) AS rn
      FROM q2 WHERE pool_depth <> 'Thin' AND annual_delta_total < 0),
o AS (
    SELECT c.soc_code, c.baseline_area, c.headcount, c.percentile, c.baseline_metro,
           c.area_code AS cheapest_area, c.metro AS cheapest_metro,
           c.annual_delta_total AS cheapest_annual_delta, c.pool_depth AS cheapest_pool_depth,
           v.area_code AS viable_area, v.metro AS viable_metro,
           v.annual_delta_total AS viable_annual_delta,
           CASE WHEN c.annual_delta_total >= 0 THEN 'none_cheaper'
                WHEN v.area_code IS NULL THEN 'every_cheaper_thin'
                WHEN v.area_code = c.area_code THEN 'cheapest_viable'
                ELSE 'cheapest_thin_with_alternative' END AS outcome
    FROM c LEFT JOIN v ON c.soc_code = v.soc_code AND c.baseline_area = v.baseline_area
        AND c.headcount = v.headcount AND c.percentile = v.percentile AND v.rn = 1
    WHERE c.rn = 1
)
SELECT *, CASE outcome
    WHEN 'none_cheaper' THEN 'No place is cheaper than ' || baseline_metro || '.'
    WHEN 'every_cheaper_thin' THEN cheapest_metro || ' saves '
        || {MONEY_SQL.format(v="ABS(cheapest_annual_delta)")} || ' a year, but every cheaper pool is thin.'
    WHEN 'cheapest_viable' THEN cheapest_metro || ' saves '
        || {MONEY_SQL.format(v="ABS(cheapest_annual_delta)")} || ' a year and its pool can absorb the plan.'
    ELSE cheapest_metro || ' saves ' || {MONEY_SQL.format(v="ABS(cheapest_annual_delta)")}
        || ' a year but is thin; ' || viable_metro || ' still saves '
        || {MONEY_SQL.format(v="ABS(viable_annual_delta)")} || '.' END AS finding
FROM o
""")
def f3_cheapest_vs_viable(spark, sf_dir):
    return findings.arbitrage_sentence(arbitrage.cheapest_vs_viable(_q2_default(spark, sf_dir)))


@register("f8_head_tail_slice", "WITH " + nest("q2", Q2_SQL) + f"""
SELECT * EXCLUDE (a, d) FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY {SCEN} ORDER BY annual_delta_total ASC NULLS LAST, area_code) AS a,
              ROW_NUMBER() OVER (PARTITION BY {SCEN} ORDER BY annual_delta_total DESC NULLS FIRST, area_code DESC) AS d
    FROM q2)
WHERE a <= 6 OR d <= 6 OR is_baseline
""")
def f8_head_tail_slice(spark, sf_dir):
    return arbitrage.head_tail_slice(_q2_default(spark, sf_dir), 12)


@register("f10_pool_needed", "WITH " + nest("q2", Q2_SQL) + f"""
SELECT {SCEN}, pool_depth, COUNT(*) AS places, headcount / 0.02 AS pool_needed
FROM q2 GROUP BY {SCEN}, pool_depth
""")
def f10_pool_needed(spark, sf_dir):
    return arbitrage.pool_needed(_q2_default(spark, sf_dir))


Q4_SQL = with_ctes(MARKET_CTE, SKILLS_LABEL_CTE, Q4_BODY)


@register("f4_distinctive_skills", "WITH " + nest("q4", Q4_SQL) + """,
d AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY soc_code ORDER BY distinctive DESC, skill) AS rn FROM q4),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY soc_code ORDER BY importance DESC, skill) AS rn FROM q4),
l AS (SELECT soc_code, string_agg(skill, ', ' ORDER BY rn) AS distinctive_skills FROM d WHERE rn <= 3
      GROUP BY soc_code)
SELECT l.soc_code, l.distinctive_skills, r.skill AS top_raw_skill, r.importance AS top_raw_importance,
       'Most distinctive: ' || l.distinctive_skills || '. Top raw skill: ' || r.skill || ' ('
       || format('{:,.1f}', r.importance) || ' / 5).' AS finding
FROM l JOIN r ON l.soc_code = r.soc_code AND r.rn = 1
""")
def f4_distinctive_skills(spark, sf_dir):
    return profile.distinctive_skills(profile.skill_profile(testmart.skills(spark, sf_dir, "label")))


@register("f9_largest_deviations", "WITH " + nest("q4", Q4_SQL) + """
SELECT * FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY soc_code ORDER BY ABS(distinctive) DESC, skill)
              AS deviation_rank FROM q4)
WHERE deviation_rank <= 14
""")
def f9_largest_deviations(spark, sf_dir):
    return profile.largest_deviations(
        _profile(testmart.skills(spark, sf_dir, "label")), 14)


Q3_SQL = with_ctes(MARKET_CTE, LABELS_CTE, SKILLS_LABEL_CTE, CENTERED_CTE,
                   PAIRS_BODY + Q3_SELECT.format(**_EXACT, **_NAMED))


@register("f5_adjacency_bench", "WITH " + nest("q3", Q3_SQL) + """,
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY target_soc ORDER BY similarity DESC, soc_code) AS rn
      FROM q3),
s AS (SELECT target_soc, COUNT(*) FILTER (WHERE similarity >= 0.4) AS strong_neighbours
      FROM q3 GROUP BY target_soc),
o AS (
    SELECT n.target_soc, n.soc_code AS nearest_soc, n.similarity AS nearest_similarity,
           NULLIF(array_to_string(string_split(COALESCE(n.shared_strengths, ''), ', ')[1:3], ', '), '')
               AS nearest_shared,
           s.strong_neighbours,
           CASE WHEN s.strong_neighbours > 1 THEN 'bench'
                WHEN n.similarity < 0.4 THEN 'specialised' ELSE 'single' END AS outcome
    FROM n JOIN s ON n.target_soc = s.target_soc WHERE n.rn = 1
)
SELECT * REPLACE (ROUND(nearest_similarity, 8) AS nearest_similarity), 'Closest: ' || nearest_soc || ' (similarity ' || format('{:,.2f}', nearest_similarity) || ')'
       || CASE WHEN nearest_shared IS NOT NULL THEN ', sharing strength in ' || nearest_shared ELSE '' END
       || '.'
       || CASE outcome WHEN 'bench' THEN ' ' || CAST(strong_neighbours AS VARCHAR)
                                         || ' listed neighbours reach 0.40: a real adjacent bench.'
                       WHEN 'specialised' THEN ' No neighbour reaches 0.40: a specialised profile.'
                       ELSE '' END AS finding
FROM o
""")
def f5_adjacency_bench(spark, sf_dir):
    return _rounded(adjacency.adjacency_bench(_adjacency(spark, sf_dir)), {"nearest_similarity": 8})


Q8_SQL = with_ctes(USAGE_CTE, f"""
SELECT view_name, COUNT(*) AS events, COUNT(DISTINCT session_id) AS sessions,
       MAX(occurred_at) AS last_seen
FROM usage_log WHERE {USAGE_WINDOW} GROUP BY view_name
""")


@register("f6_usage_headline", "WITH " + nest("q8", Q8_SQL) + """,
t AS (SELECT SUM(events) AS total_events, COUNT(*) AS views FROM q8),
top AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY events DESC, view_name) AS rn FROM q8)
        WHERE rn = 1),
h AS (
    SELECT CAST(COALESCE(t.total_events, 0) AS BIGINT) AS total_events, top.view_name AS top_view,
           top.events AS top_view_events,
           ROUND(top.events / NULLIF(t.total_events, 0), 6) AS top_view_share,
           t.views > 1 AND top.events / NULLIF(t.total_events, 0) > 0.6 AS concentrated
    FROM t CROSS JOIN top
)
SELECT *, CASE WHEN total_events = 0 THEN 'No usage recorded yet.'
    ELSE format('{:,}', total_events) || ' views over 30 days; ' || top_view || ' leads with '
         || format('{:,.0f}', CAST(top_view_events AS DOUBLE) / total_events * 100)
         || '%.' END AS finding
FROM h
""")
def f6_usage_headline(spark, sf_dir):
    return _rounded(findings.usage_sentence(
        usage.usage_headline(testmart.usage_log(spark, sf_dir), 30, testmart.AS_OF), 30), {"top_view_share": 6})


# ---------------------------------------------------------------- ingest ---
def _marts(spark, sf_dir):
    cube = raw._line_cube(spark, sf_dir)
    return build.build_marts(raw.raw_oes(spark, sf_dir, cube), raw.raw_national(spark, sf_dir, cube),
                             raw.raw_projections(spark, sf_dir), raw.raw_onet(spark, sf_dir),
                             raw.ingest_scope(spark, sf_dir))


@register("i_build_market", INGEST_SQL + """
SELECT soc_code, occupation, occupation_group, area_code, metro, state, employment,
       employment_per_1k, employment_prior, supply_growth_3y, proj_growth_10y,
       wage_p10, wage_p25, wage_p50, wage_p75, wage_p90, national_wage_p50
FROM market_built
""")
def i_build_market(spark, sf_dir):
    return _marts(spark, sf_dir).market


def _landing(df: DataFrame, path: str, sep: str = ",", vintage: str | None = None, files: int = 3) -> None:
    """Rows as the delimited files of one landing folder, in file order of ``src_row``."""
    order = [c for c in ("src_row",) if c in df.columns]
    part = df.repartitionByRange(files, *order) if order else df.repartition(files)
    part = part.sortWithinPartitions(*order) if order else part
    out = f"{path}/vintage={vintage}" if vintage else path
    (part.drop("src_row", "vintage").write.option("header", True).option("sep", sep)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("emptyValue", "").csv(out))


@register("i_build_from_landing", ORACLES["i_build_market"])
def i_build_from_landing(spark, sf_dir):
    """The build over landing files in the shared folder: several files a vintage, the prior
    vintage with its columns in another order and one more; restated rows lie in later files."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/landing-{uuid.uuid4().hex}"
    cube = raw._line_cube(spark, sf_dir)
    oes = raw.raw_oes(spark, sf_dir, cube)
    _landing(oes.where("vintage = 'current'"), f"{root}/oes", vintage="current")
    prior = oes.where("vintage = 'prior'")
    _landing(prior.select(F.lit("x").alias("NOTE"), *reversed(prior.columns)), f"{root}/oes", vintage="prior")
    _landing(raw.raw_national(spark, sf_dir, cube), f"{root}/national", vintage="current")
    _landing(raw.raw_projections(spark, sf_dir), f"{root}/projections")
    _landing(raw.raw_onet(spark, sf_dir), f"{root}/onet", sep="\t")
    return build.build_marts(raw.read_oes(spark, f"{root}/oes"), raw.read_oes(spark, f"{root}/national"),
                             raw.read_projections(spark, f"{root}/projections"),
                             raw.read_onet(spark, f"{root}/onet"), raw.ingest_scope(spark, sf_dir)).market


YEARS = (1993, 1995, 1996, 1998)
_CUT = "CASE WHEN l.l_shipdate >= TIMESTAMP '1998-07-01' THEN 'current' ELSE 'prior' END AS vintage"
_LAST_JOIN = "JOIN region r ON n.n_regionkey = r.r_regionkey\n)"
assert _CUT in INGEST_SQL and _LAST_JOIN in INGEST_SQL
YEARLY_SQL = INGEST_SQL.replace(_CUT, "CAST(year(l.l_shipdate) AS VARCHAR) AS vintage").replace(
    _LAST_JOIN, _LAST_JOIN[:-1] + f"""WHERE year(l.l_shipdate) IN {YEARS}
      AND (CAST(split_part(p.p_brand, '#', 2) AS INTEGER) + s.s_nationkey + year(l.l_shipdate)) % 5 <> 0
)""")


def _yearly(spark, sf_dir) -> DataFrame:
    """Raw rows of four vintages with uneven gaps; each lacks another fifth of the cells."""
    year = F.year("l_shipdate")
    held = year.isin(*YEARS) & ((F.col("brand") + F.col("s_nationkey") + year) % 5 != 0)
    return raw.raw_oes(spark, sf_dir, raw._line_cube(spark, sf_dir, F.when(held, year.cast("string"))))


@register("i_vintage_growth", YEARLY_SQL.rstrip() + """,
dated AS (SELECT *, CAST(vintage AS INTEGER) AS year FROM cleaned)
SELECT a.vintage, a.soc_code, a.area_code, a.employment, b.vintage AS prior_vintage, b.employment AS employment_prior,
       (a.year - b.year)::INTEGER AS gap_years, a.employment / NULLIF(b.employment, 0) - 1.0 AS growth,
       ROUND(POW(a.employment / NULLIF(b.employment, 0), 1.0 / (a.year - b.year)) - 1.0, 8) AS growth_per_year
FROM dated a ASOF LEFT JOIN dated b ON a.soc_code = b.soc_code AND a.area_code = b.area_code AND a.year > b.year
""")
def i_vintage_growth(spark, sf_dir):
    """I1 / I16 over landing folders of four vintages named by year."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/landing-{uuid.uuid4().hex}"
    rows = _yearly(spark, sf_dir)
    for year in YEARS:
        _landing(rows.where(F.col("vintage") == str(year)), root, vintage=str(year))
    cleaned = ingest.clean_vintage(raw.read_oes(spark, root), raw.ingest_scope(spark, sf_dir))
    return _rounded(ingest.vintage_growth(cleaned).select(
        "vintage", "soc_code", "area_code", "employment", "prior_vintage", "employment_prior", "gap_years", "growth",
        "growth_per_year"), {"growth_per_year": 8})


@register("i_header_contract", INGEST_SQL.rstrip() + """,
parts AS (SELECT vintage, ascii(right("OCC_CODE", 1)) % 3 AS part, COUNT(*) AS n FROM raw_oes GROUP BY ALL)
SELECT 'good' AS vintage, part, 15 AS n_columns, n AS n_rows, '' AS missing, 'ok' AS verdict FROM parts WHERE vintage = 'current'
UNION ALL SELECT 'padded', part, 16, n, '', 'ok' FROM parts WHERE vintage = 'prior'
UNION ALL SELECT 'short', part, 13, n, 'A_MEDIAN, NAICS', 'missing' FROM parts WHERE vintage = 'prior'
UNION ALL SELECT 'twice', part, 16, n, '', 'repeated' FROM parts WHERE vintage = 'prior'
UNION ALL SELECT 'mixed', part, 15, n, '', CASE WHEN part = (SELECT MIN(part) FROM parts WHERE vintage = 'prior') THEN 'ok'
                                               ELSE 'disagrees' END FROM parts WHERE vintage = 'prior'
UNION ALL SELECT 'broken', part, 15, 2 * n, '', 'open quote' FROM parts WHERE vintage = 'prior'
""")
def i_header_contract(spark, sf_dir):
    """One verdict a file over vintages that keep or break the contract, each in several files."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/landing-{uuid.uuid4().hex}"
    oes = raw.raw_oes(spark, sf_dir, raw._line_cube(spark, sf_dir)).drop("src_row")
    oes = oes.withColumn("part", F.ascii(F.right("OCC_CODE", F.lit(1))) % 3)
    prior = oes.where("vintage = 'prior'").drop("vintage")
    names = [c for c in prior.columns if c != "part"]

    def write(df: DataFrame, vintage: str) -> None:
        (df.repartition("part").write.mode("append").partitionBy("part").option("header", True)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .option("emptyValue", "").csv(f"{root}/vintage={vintage}"))
    write(oes.where("vintage = 'current'").drop("vintage"), "good")
    write(prior.select(F.lit("x").alias("NOTE"), *[F.col(c).alias(f" {c.lower()} ") for c in reversed(names)], "part"), "padded")
    write(prior.drop("NAICS", "A_MEDIAN"), "short")
    write(prior.withColumn(" naics", F.lit("0")), "twice")
    first = prior.select(F.min("part")).scalar()
    write(prior.where(F.col("part") == first), "mixed")
    write(prior.where(F.col("part") != first).select(*reversed(names), "part"), "mixed")
    write(prior.withColumn("AREA_TITLE", F.concat(F.lit("line\n"), F.col("AREA_TITLE"))), "broken")
    found = raw.header_contract(spark, root, list(schema.OES_COLUMNS.values()), upper=True)
    return found.select("vintage", F.regexp_extract("file", "/part=([0-9]+)/", 1).cast("int").alias("part"), "n_columns",
                        "n_rows", "missing", "verdict")


TOP_PLACES = 10


@register("i_top_areas_10", INGEST_SQL + f"""
SELECT soc_code, area_code, metro, employment FROM cur
WHERE area_code IN (SELECT area_code FROM cur GROUP BY area_code
                    ORDER BY SUM(employment) DESC, area_code LIMIT {TOP_PLACES})
""")
def i_top_areas_10(spark, sf_dir):
    """I15 where the limit bites: fewer places than there are."""
    cleaned = _marts(spark, sf_dir).steps["deduplicated"]
    return (ingest.top_areas(cleaned.where("vintage = 'current'"), TOP_PLACES)
            .select("soc_code", "area_code", "metro", "employment"))


@register("i_build_skills", INGEST_SQL + "SELECT soc_code, skill, importance FROM skills_built")
def i_build_skills(spark, sf_dir):
    return _marts(spark, sf_dir).skills


@register("i_monotonic_quarantine", INGEST_SQL + """
SELECT soc_code, area_code, metro, wage_p10, wage_p25, wage_p50, wage_p75, wage_p90
FROM full_rows WHERE NOT monotonic
""")
def i_monotonic_quarantine(spark, sf_dir):
    return _marts(spark, sf_dir).quarantine


@register("i_row_accounting", INGEST_SQL + """
SELECT * FROM (VALUES
    (0, 'raw', (SELECT COUNT(*) FROM raw_oes)),
    (1, 'scoped', (SELECT COUNT(*) FROM scoped)),
    (2, 'single_industry', (SELECT COUNT(*) FROM single_industry)),
    (3, 'usable', (SELECT COUNT(*) FROM usable)),
    (4, 'deduplicated', (SELECT COUNT(*) FROM cleaned)),
    (5, 'current_top_areas', (SELECT COUNT(*) FROM kept)),
    (6, 'with_prior', (SELECT COUNT(*) FROM with_prior WHERE employment_prior IS NOT NULL)),
    (7, 'market', (SELECT COUNT(*) FROM market_built)),
    (8, 'skills', (SELECT COUNT(*) FROM skills_built))
) AS t(step_order, step, "rows")
""")
def i_row_accounting(spark, sf_dir):
    return build.row_accounting(_marts(spark, sf_dir))


# ---------------------------------------------------------------- quality --
QUALITY_BODY = """
rules AS (
    SELECT COUNT(*) FILTER (WHERE NOT (COALESCE(wage_p10 <= wage_p25, true)
               AND COALESCE(wage_p25 <= wage_p50, true) AND COALESCE(wage_p50 <= wage_p75, true)
               AND COALESCE(wage_p75 <= wage_p90, true))) AS d1,
           COUNT(*) FILTER (WHERE COALESCE(wage_p50 <= 0, false) OR COALESCE(employment <= 0, false)) AS d2,
           {d5},
           COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE employment_prior IS NOT NULL) AS matched
    FROM {m}
),
dup_m AS (SELECT COUNT(*) AS v FROM (SELECT soc_code, area_code FROM {m} GROUP BY 1, 2 HAVING COUNT(*) > 1)),
dup_s AS (SELECT COUNT(*) AS v FROM (SELECT soc_code, skill FROM {s} GROUP BY 1, 2 HAVING COUNT(*) > 1)),
d7 AS (SELECT COUNT(*) AS v FROM (SELECT soc_code FROM {m} GROUP BY 1
                                  HAVING COUNT(DISTINCT national_wage_p50) > 1)),
d3 AS (SELECT COUNT(*) FILTER (WHERE NOT COALESCE(importance BETWEEN 1.0 AND 5.0, true)) AS v FROM {s}),
skill_n AS (SELECT soc_code, COUNT(DISTINCT skill) AS n FROM {s} GROUP BY 1),
d8 AS (SELECT COUNT(*) FILTER (WHERE n <> (SELECT MAX(n) FROM skill_n)) AS v FROM skill_n),
d9 AS (SELECT COUNT(*) AS v FROM (SELECT DISTINCT soc_code FROM {m}
                                  WHERE soc_code NOT IN (SELECT soc_code FROM {s}))),
d16 AS (SELECT COUNT(DISTINCT area_code) AS v FROM {m}),
d6a AS (SELECT COUNT(*) AS v FROM {m} WHERE soc_code NOT IN (SELECT soc_code FROM {sc})),
d6b AS (SELECT COUNT(*) AS v FROM (SELECT DISTINCT soc_code, occupation, occupation_group FROM {m}) x
        JOIN {sc} y ON x.soc_code = y.soc_code
        WHERE x.occupation IS DISTINCT FROM y.occupation
           OR x.occupation_group IS DISTINCT FROM y.occupation_group)
SELECT * FROM (VALUES
    ('D1', 'wage percentiles ordered (adjacent pairs)', 'fatal', 'market', (SELECT d1 FROM rules), NULL),
    ('D2', 'positive median wage and employment', 'fatal', 'market', (SELECT d2 FROM rules), NULL),
    {d5_rows},
    ('D11', 'share of rows matched to the prior vintage', 'warn', 'market', 0,
        (SELECT CAST(matched AS DOUBLE) / NULLIF(n_rows, 0) FROM rules)),
    ('D4', 'unique key (soc_code, area_code)', 'fatal', 'market', (SELECT v FROM dup_m), NULL),
    ('D7', 'national_wage_p50 constant within soc_code', 'fatal', 'market', (SELECT v FROM d7), NULL),
    ('D3', 'importance between 1 and 5', 'fatal', 'skills', (SELECT v FROM d3), NULL),
    ('D4', 'unique key (soc_code, skill)', 'fatal', 'skills', (SELECT v FROM dup_s), NULL),
    ('D8', 'every category carries the full skill vector', 'fatal', 'skills', (SELECT v FROM d8), NULL),
    ('D9', 'every market category has a skill vector', 'warn', 'market', (SELECT v FROM d9), NULL),
    ('D16', 'synthetic if at most 45 places', 'note', 'market', 0, (SELECT CAST(v AS DOUBLE) FROM d16)),
    ('D6', 'category in scope', 'fatal', 'market', (SELECT v FROM d6a), NULL),
    ('D6', 'labels agree with the scope dimension', 'fatal', 'market', (SELECT v FROM d6b), NULL)
) AS t(rule_id, description, severity, table_name, violations, metric)
"""
_REQ = ["soc_code", "occupation", "occupation_group", "area_code", "metro", "state",
        "employment", "wage_p50"]


TEST_SCOPE_CTE = """
scope_dim AS (
    SELECT DISTINCT p_brand AS soc_code,
           'Role ' || CAST(CAST(split_part(p_brand, '#', 2) AS INTEGER) AS VARCHAR) AS occupation,
           'Family ' || CAST(CAST(split_part(p_brand, '#', 2) AS INTEGER) % 5 AS VARCHAR)
               AS occupation_group
    FROM part
)
"""


def _quality_sql(m: str, s: str, sc: str) -> str:
    d5 = ",\n           ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL) AS d5_{c}" for c in _REQ)
    d5_rows = ",\n    ".join(
        f"('D5', 'required column {c} not null', 'fatal', 'market', (SELECT d5_{c} FROM rules), NULL)"
        for c in _REQ)
    return QUALITY_BODY.format(m=m, s=s, sc=sc, d5=d5, d5_rows=d5_rows)


@register("d_quality_report", with_ctes(MARKET_CTE, SKILLS_LABEL_CTE, TEST_SCOPE_CTE,
                                        _quality_sql("market", "skills", "scope_dim")))
def d_quality_report(spark, sf_dir):
    return quality.quality_report(testmart.market(spark, sf_dir),
                                  testmart.skills(spark, sf_dir, "label"),
                                  testmart.scope(spark, sf_dir))


# every rule has rows that break it: told from the keys, so they grow with the mart
DEFECTS_CTE = """
numbered AS (SELECT *, CAST(split_part(soc_code, '#', 2) AS INTEGER) AS b, CAST(area_code AS INTEGER) AS a FROM market),
market_bad AS (
    SELECT CASE WHEN b % 7 = 3 THEN soc_code || 'x' ELSE soc_code END AS soc_code,
           CASE WHEN b % 11 = 4 THEN occupation || ' II' ELSE occupation END AS occupation,
           occupation_group, CASE WHEN a = 24 THEN '23' ELSE area_code END AS area_code,
           CASE WHEN (a + b) % 13 = 5 THEN NULL ELSE metro END AS metro, state,
           CASE WHEN (a + b) % 17 = 6 THEN 0.0 ELSE employment END AS employment,
           employment_per_1k, employment_prior, supply_growth_3y, proj_growth_10y,
           CASE WHEN (a + b) % 5 = 0 THEN wage_p90 + 1 ELSE wage_p10 END AS wage_p10,
           wage_p25, wage_p50, wage_p75, wage_p90,
           CASE WHEN a % 9 = 1 AND b % 3 = 0 THEN national_wage_p50 + 1 ELSE national_wage_p50 END AS national_wage_p50
    FROM numbered
),
skill_numbered AS (SELECT *, CAST(split_part(soc_code, '#', 2) AS INTEGER) AS b, CAST(split_part(skill, '_', 2) AS INTEGER) AS k FROM skills),
skills_bad AS (
    SELECT soc_code, CASE WHEN k = 1 AND b % 2 = 0 THEN 'skill_00' ELSE skill END AS skill,
           CASE WHEN (k + b) % 4 = 0 THEN 5.5 ELSE importance END AS importance FROM skill_numbered
)
"""


@register("d_quality_report_defects", with_ctes(MARKET_CTE, SKILLS_LABEL_CTE, TEST_SCOPE_CTE, DEFECTS_CTE,
                                                _quality_sql("market_bad", "skills_bad", "scope_dim")))
def d_quality_report_defects(spark, sf_dir):
    """D1-D9 over marts in which rows break each rule."""
    b, a = testmart.brand_number(), F.col("area_code").cast("int")
    k = F.substring_index("skill", "_", -1).cast("int")

    def spoil(df, changes):
        return df.withColumns({c: F.when(cond, to).otherwise(F.col(c)) for c, (cond, to) in changes.items()})
    market = spoil(testmart.market(spark, sf_dir), {
        "soc_code": (b % 7 == 3, F.concat("soc_code", F.lit("x"))),
        "occupation": (b % 11 == 4, F.concat("occupation", F.lit(" II"))),
        "area_code": (a == 24, F.lit("23")),
        "metro": ((a + b) % 13 == 5, F.lit(None)),
        "employment": ((a + b) % 17 == 6, F.lit(0.0)),
        "wage_p10": ((a + b) % 5 == 0, F.col("wage_p90") + 1),
        "national_wage_p50": ((a % 9 == 1) & (b % 3 == 0), F.col("national_wage_p50") + 1)})
    skills = spoil(testmart.skills(spark, sf_dir, "label"), {
        "skill": ((k == 1) & (b % 2 == 0), F.lit("skill_00")),
        "importance": ((k + b) % 4 == 0, F.lit(5.5))})
    return quality.quality_report(market, skills, testmart.scope(spark, sf_dir))


@register("d12_published_overview", ORACLES["q6_mart_overview"])
def d12_published_overview(spark, sf_dir):
    """Publish both marts under a new base, read the committed version back."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/published-{uuid.uuid4().hex}"
    publish.publish(testmart.market(spark, sf_dir), testmart.skills(spark, sf_dir, "label"), base,
                    testmart.scope(spark, sf_dir))
    return overview.mart_overview(*publish.read_published(spark, base))


@register("d_quality_report_built", INGEST_SQL.rstrip() + ",\n"
          + _quality_sql("market_built", "skills_built", "scope"))
def d_quality_report_built(spark, sf_dir):
    marts = _marts(spark, sf_dir)
    return quality.quality_report(marts.market, marts.skills, raw.ingest_scope(spark, sf_dir))


@register("d14_load_summary", with_ctes(MARKET_CTE, SKILLS_LABEL_CTE, """
SELECT (SELECT COUNT(*) FROM market) AS market_rows,
       (SELECT COUNT(DISTINCT soc_code) FROM market) AS occupations,
       (SELECT COUNT(DISTINCT area_code) FROM market) AS metros,
       (SELECT COUNT(*) FROM skills) AS skill_rows
"""))
def d14_load_summary(spark, sf_dir):
    return quality.load_summary(testmart.market(spark, sf_dir),
                                testmart.skills(spark, sf_dir, "label"))


# ---------------------------------------------------------------- streaming --
def _events_glob(sf_dir: str) -> str:
    return f"{sf_dir.rstrip('/')}/events.parque[t]"


@register("q7d_daily_counts_stream", """
SELECT CAST(ts AS DATE) AS day, COUNT(*) AS events FROM events GROUP BY 1
""")
def q7d_daily_counts_stream(spark, sf_dir):
    stream = usage_stream.events_stream(usage_stream.stream_session(spark), _events_glob(sf_dir))
    return usage_stream.materialize(usage_stream.daily_counts(stream), "q7d", ["day"])


@register("q8s_view_stats_stream", """
SELECT CAST(ts AS DATE) AS day, event_type AS view_name, COUNT(*) AS events, MAX(ts) AS last_seen
FROM events GROUP BY 1, 2
""")
def q8s_view_stats_stream(spark, sf_dir):
    stream = usage_stream.events_stream(usage_stream.stream_session(spark), _events_glob(sf_dir))
    return usage_stream.materialize(usage_stream.view_stats(stream), "q8s", ["day", "view_name"])


@register("q8s_view_sessions_stream", """
SELECT CAST(ts AS DATE) AS day, event_type AS view_name,
       COUNT(DISTINCT CAST(user_id AS VARCHAR)) AS sessions
FROM events GROUP BY 1, 2
""")
def q8s_view_sessions_stream(spark, sf_dir):
    stream = usage_stream.events_stream(usage_stream.stream_session(spark), _events_glob(sf_dir))
    return usage_stream.materialize(usage_stream.view_sessions(stream), "q8sess",
                                    ["day", "view_name"])


# events land in waves of six days; every 17th event comes one wave late
_WAVE_DAYS = 6


@register("q7d_dropped_late_rows", f"""
WITH e AS (
    SELECT ts, CAST(ts AS DATE) AS day,
           COALESCE(date_diff('day', (SELECT MIN(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) // {_WAVE_DAYS}, 0)
               + CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS wave
    FROM events
),
marks AS (
    SELECT wave, MAX(MAX(ts)) OVER (ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark
    FROM e GROUP BY wave
),
judged AS (
    SELECT day, COALESCE(CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <= mark - INTERVAL 1 DAY, false) AS late
    FROM e JOIN marks ON e.wave = marks.wave
)
SELECT day, COUNT(*) FILTER (WHERE NOT late) AS events, COUNT(*) FILTER (WHERE late) AS dropped
FROM judged GROUP BY day
""")
def q7d_dropped_late_rows(spark, sf_dir):
    """Every wave is landed and read by a run of its own, which goes on where the last one stopped."""
    ev = testmart.table(spark, sf_dir, "events")
    first = ev.select(F.min(F.to_date("ts"))).scalar()
    ev = ev.withColumn("_wave", F.coalesce(F.floor(F.date_diff(F.to_date("ts"), first) / _WAVE_DAYS), F.lit(0))
                       + F.when(F.col("event_id") % 17 == 0, 1).otherwise(0))
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/late-{uuid.uuid4().hex}"
    ss, base = usage_stream.stream_session(spark), None
    waves = _by_wave(ev, f"{root}/waves")
    # one number for each six days
    for (wave,) in sorted(waves.select("_wave").distinct().collect()):
        waves.where(F.col("_wave") == wave).drop("_wave").write.mode("append").parquet(f"{root}/landing")
        query, base = late_rows.run_counts(usage_stream.events_stream(ss, f"{root}/landing"), "days", root=root)
        query.awaitTermination()
    if base is None:
        return spark.createDataFrame([], "day date, events bigint, dropped bigint")
    return late_rows.daily(spark, base)


def _by_wave(df, path):
    """``df`` written by wave, so that a wave's rows are read without the others."""
    df.write.partitionBy("_wave").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@register("i24_appended_events", """
SELECT CAST(ts AS DATE) AS day, event_type AS view_name, COUNT(*) AS events FROM events GROUP BY 1, 2
""")
def i24_appended_events(spark, sf_dir):
    """Each week of events appended as a batch, and every batch sent twice, as after a lost answer."""
    log = usage_stream.usage_from_events(testmart.table(spark, sf_dir, "events"))
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/event-log-{uuid.uuid4().hex}"
    week = F.coalesce(F.date_trunc("week", "occurred_at").cast("date").cast("string"), F.lit("none"))
    for (key,) in sorted(log.select(week).distinct().collect()) * 2:
        event_log.append_batch(log.where(week == key), base, key)
    return (event_log.read(spark, base, log.schema)
            .groupBy(F.to_date("occurred_at").alias("day"), "view_name").agg(F.count(F.lit(1)).alias("events")))


@register("d16_synthetic_flag", with_ctes(MARKET_CTE, """
SELECT COUNT(DISTINCT area_code) <= 45 AS synthetic FROM market
"""))
def d16_synthetic_flag(spark, sf_dir):
    return quality.is_synthetic(quality.quality_report(testmart.market(spark, sf_dir),
                                                       testmart.skills(spark, sf_dir, "label")))


# ---------------------------------------------------------------- extensions --
@register("x1_adoption_funnel", with_ctes(USAGE_CTE, """
per AS (
    SELECT session_id, MIN(occurred_at) AS first_at, MAX(occurred_at) AS last_at,
           COUNT(DISTINCT date_trunc('week', occurred_at)) AS weeks
    FROM usage_log WHERE session_id IS NOT NULL GROUP BY session_id
),
t AS (
    SELECT COUNT(*) AS activated,
           COUNT(*) FILTER (WHERE last_at > first_at + INTERVAL 24 HOURS) AS returned,
           COUNT(*) FILTER (WHERE weeks >= 3) AS habitual
    FROM per
)
SELECT activated, returned, habitual,
       ROUND(CAST(returned AS DOUBLE) / NULLIF(activated, 0), 6) AS return_rate
FROM t
"""))
def x1_adoption_funnel(spark, sf_dir):
    return _rounded(usage.adoption_funnel(testmart.usage_log(spark, sf_dir)), {"return_rate": 6})


@register("x4_family_share", with_ctes(MARKET_CTE, USAGE_CTE, LABELS_CTE, f"""
counts AS (
    SELECT soc_code, COUNT(*) AS events FROM usage_log
    WHERE {USAGE_WINDOW} AND soc_code IS NOT NULL GROUP BY soc_code
),
fam AS (
    SELECT COALESCE(l.occupation_group, 'Unknown') AS occupation_group,
           CAST(SUM(c.events) AS BIGINT) AS events
    FROM counts c LEFT JOIN labels l ON c.soc_code = l.soc_code GROUP BY 1
)
SELECT occupation_group, events, ROUND(events / SUM(events) OVER (), 6) AS share FROM fam
"""))
def x4_family_share(spark, sf_dir):
    return _rounded(usage.family_share(testmart.usage_log(spark, sf_dir), testmart.labels(spark, sf_dir),
                                       30, testmart.AS_OF), {"share": 6})


@register("x5_pool_shrink_alerts", with_ctes(MARKET_CTE, """
SELECT soc_code, area_code, metro, employment, employment_prior, supply_growth_3y
FROM market WHERE supply_growth_3y <= -0.05
"""))
def x5_pool_shrink_alerts(spark, sf_dir):
    return usage.pool_shrink_alerts(testmart.market(spark, sf_dir), 0.05)


# ---------------------------------------------------------------- lookups / drift --
REQUESTS_CTE = """
requests AS (
    SELECT DISTINCT soc_code, area_code FROM usage_log
    WHERE soc_code IS NOT NULL AND area_code IS NOT NULL
)
"""


def _requests(spark, sf_dir):
    return (testmart.usage_log(spark, sf_dir)
            .where("soc_code IS NOT NULL AND area_code IS NOT NULL")
            .select("soc_code", "area_code"))


@register("q5g_requested_pools", "WITH " + nest("q5", Q5_SQL) + ",\n" + USAGE_CTE.strip() + ",\n"
          + REQUESTS_CTE.strip() + " SELECT " + Q5_ROUNDED + " FROM q5 WHERE (soc_code, area_code) IN (SELECT soc_code, area_code FROM requests)")
def q5g_requested_pools(spark, sf_dir):
    summary = pool.talent_pool_summary(testmart.market(spark, sf_dir))
    return _rounded(pool.lookup(summary, _requests(spark, sf_dir))[0], Q5_PLACES)


@register("q5g_absent_requests", "WITH " + nest("q5", Q5_SQL) + ",\n" + USAGE_CTE.strip() + ",\n"
          + REQUESTS_CTE.strip() + """
SELECT r.soc_code, r.area_code FROM requests r
WHERE NOT EXISTS (SELECT 1 FROM q5 WHERE q5.soc_code = r.soc_code AND q5.area_code = r.area_code)
""")
def q5g_absent_requests(spark, sf_dir):
    summary = pool.talent_pool_summary(testmart.market(spark, sf_dir))
    return pool.lookup(summary, _requests(spark, sf_dir))[1]


@register("q4d_skill_profile_top5", "WITH " + nest("q4", with_ctes(SKILLS_LABEL_CTE, Q4_BODY)) + """
SELECT * EXCLUDE (rn) FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY soc_code ORDER BY importance DESC, skill) AS rn FROM q4)
WHERE rn <= 5
""")
def q4d_skill_profile_top5(spark, sf_dir):
    return _profile(testmart.skills(spark, sf_dir, "label"), top_n=5)


@register("d17_vintage_drift", INGEST_SQL.rstrip() + """
SELECT (SELECT COUNT(*) FROM (SELECT soc_code, area_code FROM cur EXCEPT SELECT soc_code, area_code FROM pri))
           AS added,
       (SELECT COUNT(*) FROM (SELECT soc_code, area_code FROM pri EXCEPT SELECT soc_code, area_code FROM cur))
           AS removed
""")
def d17_vintage_drift(spark, sf_dir):
    cleaned = _marts(spark, sf_dir).steps["deduplicated"]
    keys = ["soc_code", "area_code"]
    return quality.row_count_drift(cleaned.where("vintage = 'current'"),
                                   cleaned.where("vintage = 'prior'"), keys)


# ---------------------------------------------------------------- X6 -------
def _republished(spark, sf_dir) -> str:
    """A base with two versions of the published measures: first of an older market, in which every third category
    has other figures, some are not there yet and one is there that ends later; then of the market itself."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/aggregates-{uuid.uuid4().hex}"
    market = testmart.market(spark, sf_dir)
    n = F.substring_index("soc_code", "#", -1).cast("int")
    older = (market.withColumn("employment_per_1k", F.when(n % 3 == 0, F.col("employment_per_1k") * 2)
                               .otherwise(F.col("employment_per_1k")))
             .where((n % 7 != 1) | (n % 3 == 0)))
    first = market.select(F.min("soc_code")).scalar()
    ended = market.where(F.col("soc_code") == first).withColumn("soc_code", F.lit("Brand#999"))
    aggregates.publish(older.unionByName(ended), base, version="older")
    aggregates.publish(market, base, version="newer")
    return base


@register("x6_published_index", Q1_SQL)
def x6_published_index(spark, sf_dir):
    return aggregates.read(spark, _republished(spark, sf_dir), "competition_index")


@register("x6_published_pool", ORACLES["q5_talent_pool_summary"])
def x6_published_pool(spark, sf_dir):
    return _rounded(aggregates.read(spark, _republished(spark, sf_dir), "talent_pool"), Q5_PLACES)


@register("x6_publish_history", with_ctes(MARKET_CTE, """
cats AS (SELECT DISTINCT soc_code, CAST(split_part(soc_code, '#', 2) AS INTEGER) AS n FROM market)
SELECT 1 AS step, 'older' AS version, COUNT(*) FILTER (n % 7 <> 1 OR n % 3 = 0) + 1 AS recomputed,
       0::BIGINT AS carried, 0::BIGINT AS removed FROM cats
UNION ALL
SELECT 2, 'newer', COUNT(*) FILTER (n % 3 = 0 OR n % 7 = 1), COUNT(*) FILTER (n % 3 <> 0 AND n % 7 <> 1), 1 FROM cats
"""))
def x6_publish_history(spark, sf_dir):
    return aggregates.history(spark, _republished(spark, sf_dir))


# ------------------------------------------------- distinct over windows ---
@register("x3_rolling_users", with_ctes(USAGE_CTE, f"""
ends AS (SELECT CAST(unnest(generate_series(DATE '{testmart.AS_OF}' - 29, DATE '{testmart.AS_OF}', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT day, COUNT(DISTINCT session_id) AS users
FROM ends LEFT JOIN usage_log ON CAST(occurred_at AS DATE) BETWEEN day - 6 AND day GROUP BY day
"""))
def x3_rolling_users(spark, sf_dir):
    return usage.rolling_users(testmart.usage_log(spark, sf_dir), 7, 30, testmart.AS_OF)


@register("q8_sketch_window", ORACLES["q8_usage_by_view"])
def q8_sketch_window(spark, sf_dir):
    """The window from stored daily sketches; the estimate is replaced by the exact count where it lies within the
    stated error, so the comparison fails only where it doesn't."""
    log = testmart.usage_log(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sketches-{uuid.uuid4().hex}"
    usage.daily_sketches(log).write.parquet(path)
    found = usage.window_from_sketches(spark.read.parquet(path), 30, testmart.AS_OF)
    exact = usage.usage_by_view(log, 30, testmart.AS_OF).select("view_name", F.col("sessions").alias("exact"))
    near = F.abs(F.col("sessions") - F.col("exact")) <= usage.SKETCH_ERROR * F.col("exact")
    return (found.join(exact, "view_name", "left")
            .select("view_name", "events", F.when(near, F.col("exact")).otherwise(F.col("sessions")).alias("sessions"), "last_seen"))


# ---------------------------------------------------------- drift history --
#: Pool sizes of five published versions against the market's: the last is far off.
DRIFT = (1.0, 1.01, 1.02, 0.99, 1.5)


@register("d17_version_history", with_ctes(MARKET_CTE, SKILLS_LABEL_CTE, """
version AS (SELECT * FROM (VALUES """ + ", ".join(f"('v{i}', {f}::DOUBLE)" for i, f in enumerate(DRIFT)) + """) v(version, factor)),
one AS (SELECT COUNT(*)::DOUBLE AS market_rows, COUNT(DISTINCT soc_code)::DOUBLE AS categories, COUNT(DISTINCT area_code)::DOUBLE AS places,
               SUM(employment) AS employment, AVG(wage_p50) AS mean_median_wage,
               AVG((employment_prior IS NOT NULL)::INTEGER) AS prior_match_rate FROM market),
two AS (SELECT COUNT(*)::DOUBLE AS skill_rows, AVG(importance) AS mean_importance FROM skills),
series AS (
    SELECT version, unnest(['market_rows', 'categories', 'places', 'employment', 'mean_median_wage', 'prior_match_rate',
                            'skill_rows', 'mean_importance']) AS metric,
           unnest([market_rows, categories, places, employment * factor, mean_median_wage, prior_match_rate,
                   skill_rows, mean_importance]) AS value FROM version, one, two),
typical AS (SELECT metric, MEDIAN(value) AS typical FROM series GROUP BY metric),
spread AS (SELECT metric, MEDIAN(ABS(value - typical)) * 1.4826 AS spread FROM series JOIN typical USING (metric) GROUP BY metric)
SELECT version, metric, ROUND(value, 4) AS value, ROUND(typical, 4) AS typical,
       CASE WHEN spread > 1e-6 THEN ROUND((value - typical) / spread, 4) END AS score,
       CASE WHEN spread > 1e-6 THEN ABS(value - typical) / spread > 3.5 ELSE ABS(value - typical) > 1e-6 END AS outlier
FROM series JOIN typical USING (metric) JOIN spread USING (metric)
"""))
def d17_version_history(spark, sf_dir):
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/history-{uuid.uuid4().hex}"
    market, skills = testmart.market(spark, sf_dir), testmart.skills(spark, sf_dir, "label").checkpoint()
    for i, factor in enumerate(DRIFT):
        publish.publish(market.withColumn("employment", F.col("employment") * factor), skills, base, version=f"v{i}")
    found = publish.version_history(spark, base)
    return _rounded(found.drop("committed_at"), {"value": 4, "typical": 4, "score": 4})

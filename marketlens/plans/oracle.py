"""Oracle SQL (DuckDB dialect) for every registered query.

The driver pre-registers the driver tables as views; the marts are rebuilt here
as CTEs with the same mapping as :mod:`marketlens.sources.testmart`. Every
computed column carries the same alias as the Spark result, floats that depend
on summation order are rounded identically on both sides.
"""

from __future__ import annotations

MARKET_CTE = """
facts AS (
    SELECT p.p_brand AS soc_code, CAST(s.s_nationkey AS VARCHAR) AS area_code,
           l.l_quantity, l.l_extendedprice,
           l.l_shipdate >= TIMESTAMP '1998-07-01' AS is_current
    FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
    JOIN supplier s ON l.l_suppkey = s.s_suppkey
),
pools AS (
    SELECT soc_code, area_code,
           SUM(CASE WHEN is_current THEN l_quantity END) AS employment,
           SUM(CASE WHEN NOT is_current THEN l_quantity END) AS employment_prior,
           ROUND(quantile_cont(CASE WHEN is_current THEN l_extendedprice END, 0.10), 4) AS wage_p10,
           ROUND(quantile_cont(CASE WHEN is_current THEN l_extendedprice END, 0.25), 4) AS wage_p25,
           ROUND(quantile_cont(CASE WHEN is_current THEN l_extendedprice END, 0.50), 4) AS wage_p50,
           ROUND(quantile_cont(CASE WHEN is_current THEN l_extendedprice END, 0.75), 4) AS wage_p75,
           ROUND(quantile_cont(CASE WHEN is_current THEN l_extendedprice END, 0.90), 4) AS wage_p90
    FROM facts GROUP BY soc_code, area_code
),
national AS (
    SELECT soc_code, ROUND(quantile_cont(l_extendedprice, 0.5), 4) AS national_wage_p50
    FROM facts WHERE is_current GROUP BY soc_code
),
projections AS (
    SELECT p_brand AS soc_code, ROUND(AVG(p_retailprice) / 1000.0 - 1.0, 4) AS proj_growth_10y
    FROM part GROUP BY p_brand
),
market AS (
    SELECT po.soc_code,
           'Role ' || CAST(CAST(split_part(po.soc_code, '#', 2) AS INTEGER) AS VARCHAR) AS occupation,
           'Family ' || CAST(CAST(split_part(po.soc_code, '#', 2) AS INTEGER) % 5 AS VARCHAR)
               AS occupation_group,
           po.area_code, n.n_name AS metro, r.r_name AS state,
           CAST(po.employment AS DOUBLE) AS employment,
           1000.0 * po.employment / SUM(po.employment) OVER (PARTITION BY po.area_code)
               AS employment_per_1k,
           CAST(po.employment_prior AS DOUBLE) AS employment_prior,
           CASE WHEN po.employment_prior >= 200.0
                THEN po.employment / po.employment_prior - 1.0 END AS supply_growth_3y,
           pr.proj_growth_10y,
           po.wage_p10, po.wage_p25, po.wage_p50, po.wage_p75, po.wage_p90,
           na.national_wage_p50
    FROM pools po
    JOIN nation n ON CAST(n.n_nationkey AS VARCHAR) = po.area_code
    JOIN region r ON n.n_regionkey = r.r_regionkey
    LEFT JOIN national na ON na.soc_code = po.soc_code
    LEFT JOIN projections pr ON pr.soc_code = po.soc_code
    WHERE po.employment > 0 AND po.wage_p50 IS NOT NULL
)
"""

SKILLS_LABEL_CTE = """
skill_components AS (
    SELECT e.label, u.dim - 1 AS dim, CAST(u.x AS DOUBLE) AS x
    FROM embeddings e, UNNEST(e.embedding) WITH ORDINALITY AS u(x, dim)
),
skills AS (
    SELECT 'Brand#' || CAST(label + 1 AS VARCHAR) AS soc_code,
           'skill_' || lpad(CAST(dim AS VARCHAR), 2, '0') AS skill,
           ROUND(3.0 + 2.0 * AVG(x), 6) AS importance
    FROM skill_components GROUP BY label, dim
)
"""

SKILLS_VECTOR_CTE = """
skill_components AS (
    SELECT e.vec_id, u.dim - 1 AS dim, CAST(u.x AS DOUBLE) AS x
    FROM embeddings e, UNNEST(e.embedding) WITH ORDINALITY AS u(x, dim)
),
skills AS (
    SELECT 'V' || CAST(vec_id AS VARCHAR) AS soc_code,
           'skill_' || lpad(CAST(dim AS VARCHAR), 2, '0') AS skill,
           ROUND(3.0 + 2.0 * x, 6) AS importance
    FROM skill_components
)
"""

USAGE_CTE = """
usage_log AS (
    SELECT event_id, ts AS occurred_at, event_type AS view_name,
           CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 <> 0
                THEN 'Brand#' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS VARCHAR)
           END AS soc_code,
           CAST(user_id % 25 AS VARCHAR) AS area_code,
           CAST(user_id AS VARCHAR) AS session_id,
           props AS detail
    FROM events
)
"""


def with_ctes(*parts: str) -> str:
    """``WITH`` the given mart CTEs; the last part is either a ``SELECT`` or more
    CTE definitions followed by the final ``SELECT``."""
    *ctes, body = parts
    joiner = "\n" if body.lstrip().upper().startswith("SELECT") else ",\n"
    return "WITH " + ",\n".join(c.strip() for c in ctes) + joiner + body


# ------------------------------------------------------------- raw ingest --
def clean_sql(x: str) -> str:
    """DuckDB twin of :func:`marketlens.functions.columns.clean_number`."""
    t = f"trim(CAST({x} AS VARCHAR))"
    v = f"TRY_CAST(replace(replace({t}, ',', ''), '$', '') AS DOUBLE)"
    return (f"(CASE WHEN {t} IS NULL OR {t} IN ('*', '**', '#', '~', '', '-') THEN NULL "
            f"WHEN isnan({v}) THEN NULL ELSE {v} END)")


def _render_sql(src: str, area: str, area_title: str, area_type: str, state: str, naics: str,
                occ: str, occ_title: str, o_group: str, kind: int, emp_factor: str = "1.0",
                naics_num: str = "0") -> str:
    emp = f"(_emp * {emp_factor})"
    return f"""
    SELECT vintage, {area} AS "AREA", {area_title} AS "AREA_TITLE", {area_type} AS "AREA_TYPE",
           {state} AS "PRIM_STATE", {naics} AS "NAICS", {occ} AS "OCC_CODE",
           {occ_title} AS "OCC_TITLE", {o_group} AS "O_GROUP",
           CASE WHEN {emp} < 30 THEN '~' ELSE format('{{:,.0f}}', {emp}) END AS "TOT_EMP",
           format('{{:,.1f}}', CAST(_n AS DOUBLE) / 10.0) AS "JOBS_1000",
           '$' || format('{{:,.0f}}', _mn) AS "A_PCT10",
           format('{{:,.0f}}', (_mn + _av) / 2) AS "A_PCT25",
           CASE WHEN _n < 3 THEN '*' ELSE ' ' || format('{{:,.0f}}', _av) || ' ' END AS "A_MEDIAN",
           format('{{:,.0f}}', (_av + _mx) / 2) AS "A_PCT75",
           CASE WHEN _mx >= 100000 THEN '#' ELSE format('{{:,.0f}}', _mx) END AS "A_PCT90",
           CAST({kind * 10_000_000} + {naics_num} AS BIGINT) AS src_row
    FROM {src}"""


_MEASURES = """SUM(l_quantity) AS _emp, COUNT(*) AS _n, MIN(l_extendedprice) AS _mn,
    CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(COUNT(l_extendedprice) AS DOUBLE) AS _av,
    MAX(l_extendedprice) AS _mx"""
_OCC = "'BR-' || lpad(CAST(brand AS VARCHAR), 4, '0')"
_TITLE = "'Role ' || CAST(brand AS VARCHAR)"
_PLACE = "CAST(s_nationkey AS VARCHAR)"
_PLACE_TITLE = "n_name || ', ' || r_name"
_NAICS_NUM = "(540000 + ascii(l_returnflag))"


def _typed_sql(src: str) -> str:
    wages = ", ".join(f'{clean_sql(c)} AS {w}' for c, w in zip(
        ['"A_PCT10"', '"A_PCT25"', '"A_MEDIAN"', '"A_PCT75"', '"A_PCT90"'],
        ["wage_p10", "wage_p25", "wage_p50", "wage_p75", "wage_p90"]))
    return f"""
    SELECT vintage, src_row, trim("OCC_CODE") AS soc_code, trim("AREA") AS area_code,
           trim("AREA_TITLE") AS metro, trim("PRIM_STATE") AS state,
           lower(trim("O_GROUP")) AS o_group, {clean_sql('"AREA_TYPE"')} AS area_type,
           trim("NAICS") AS naics, {clean_sql('"TOT_EMP"')} AS employment,
           {clean_sql('"JOBS_1000"')} AS employment_per_1k, {wages}
    FROM {src}"""


INGEST_SQL = f"""
WITH lines AS (
    SELECT CASE WHEN l.l_shipdate >= TIMESTAMP '1998-07-01' THEN 'current' ELSE 'prior' END AS vintage,
           CAST(split_part(p.p_brand, '#', 2) AS INTEGER) AS brand, s.s_nationkey, n.n_name,
           n.n_regionkey, r.r_name, l.l_returnflag, l.l_quantity, l.l_extendedprice
    FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
    JOIN supplier s ON l.l_suppkey = s.s_suppkey
    JOIN nation n ON s.s_nationkey = n.n_nationkey
    JOIN region r ON n.n_regionkey = r.r_regionkey
),
scope AS (
    SELECT DISTINCT 'BR-' || lpad(CAST(CAST(split_part(p_brand, '#', 2) AS INTEGER) AS VARCHAR), 4, '0')
           AS soc_code,
           'Role ' || CAST(CAST(split_part(p_brand, '#', 2) AS INTEGER) AS VARCHAR) AS occupation,
           'Family ' || CAST(CAST(split_part(p_brand, '#', 2) AS INTEGER) % 5 AS VARCHAR)
           AS occupation_group
    FROM part
),
cells AS (SELECT vintage, brand, s_nationkey, n_name, r_name, {_MEASURES} FROM lines
          GROUP BY vintage, brand, s_nationkey, n_name, r_name),
industry AS (SELECT vintage, brand, s_nationkey, n_name, r_name, l_returnflag, {_MEASURES}
             FROM lines GROUP BY vintage, brand, s_nationkey, n_name, r_name, l_returnflag),
regions AS (SELECT vintage, brand, n_regionkey, r_name, {_MEASURES} FROM lines
            GROUP BY vintage, brand, n_regionkey, r_name),
fam AS (SELECT vintage, brand % 5 AS family, s_nationkey, n_name, r_name, {_MEASURES} FROM lines
        GROUP BY vintage, brand % 5, s_nationkey, n_name, r_name),
raw_oes AS (
    {_render_sql("cells", _PLACE, _PLACE_TITLE, "'4'", "r_name", "'000000'", _OCC, _TITLE, "'detailed'", 0)}
    UNION ALL
    {_render_sql("cells WHERE s_nationkey % 7 = 0", _PLACE, _PLACE_TITLE, "'4'", "r_name", "'000000'",
                 _OCC, _TITLE, "'detailed'", 4, emp_factor="2.0")}
    UNION ALL
    {_render_sql("industry", _PLACE, _PLACE_TITLE, "'4'", "r_name",
                 f"lpad(CAST({_NAICS_NUM} AS VARCHAR), 6, '0')", _OCC, _TITLE, "'detailed'", 1,
                 naics_num=_NAICS_NUM)}
    UNION ALL
    {_render_sql("regions", "'R' || CAST(n_regionkey AS VARCHAR)", "r_name || ' nonmetropolitan area'",
                 "'2'", "r_name", "'000000'", _OCC, _TITLE, "'detailed'", 2)}
    UNION ALL
    {_render_sql("fam", _PLACE, _PLACE_TITLE, "'4'", "r_name", "'000000'",
                 "'FM-' || lpad(CAST(family AS VARCHAR), 4, '0')",
                 "'Family ' || CAST(family AS VARCHAR)", "'Major'", 3)}
),
nat_cells AS (SELECT vintage, brand, {_MEASURES} FROM lines WHERE vintage = 'current'
              GROUP BY vintage, brand),
raw_national AS (
    {_render_sql("nat_cells", "'99'", "'U.S.'", "'1'", "'US'", "'000000'", _OCC, _TITLE, "'detailed'", 1)}
    UNION ALL
    SELECT * REPLACE ('*' AS "A_MEDIAN") FROM (
    {_render_sql("nat_cells WHERE brand % 5 = 0", "'99'", "'U.S.'", "'1'", "'US'", "'000000'",
                 _OCC, _TITLE, "'detailed'", 0)})
),
typed AS ({_typed_sql("raw_oes")}),
scoped AS (
    SELECT * FROM typed
    WHERE o_group = 'detailed' AND area_type = 4.0 AND soc_code IN (SELECT soc_code FROM scope)
),
has_total AS (
    SELECT vintage, BOOL_OR(COALESCE(naics = '000000', false)) AS has_total
    FROM scoped GROUP BY vintage
),
single_industry AS (
    SELECT s.* FROM scoped s JOIN has_total h ON s.vintage = h.vintage
    WHERE NOT h.has_total OR COALESCE(s.naics = '000000', false)
),
usable AS (
    SELECT * FROM single_industry
    WHERE employment IS NOT NULL AND wage_p50 IS NOT NULL AND employment >= 50.0
),
cleaned AS (
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY vintage, soc_code, area_code ORDER BY src_row) AS rn
        FROM usable) WHERE rn = 1
),
cur AS (SELECT * FROM cleaned WHERE vintage = 'current'),
pri AS (SELECT * FROM cleaned WHERE vintage = 'prior'),
top_area AS (
    SELECT area_code FROM (SELECT area_code, SUM(employment) AS total FROM cur GROUP BY area_code)
    ORDER BY total DESC, area_code LIMIT 150
),
kept AS (SELECT * FROM cur WHERE area_code IN (SELECT area_code FROM top_area)),
with_prior AS (
    SELECT k.*, p.employment AS employment_prior,
           CASE WHEN p.employment > 0 THEN k.employment / p.employment - 1.0 END AS supply_growth_3y
    FROM kept k LEFT JOIN pri p ON k.soc_code = p.soc_code AND k.area_code = p.area_code
),
nat_typed AS ({_typed_sql("raw_national")}),
nat AS (
    SELECT soc_code, wage_p50 AS national_wage_p50 FROM (
        SELECT soc_code, wage_p50,
               ROW_NUMBER() OVER (PARTITION BY soc_code ORDER BY src_row) AS rn
        FROM nat_typed
        WHERE o_group = 'detailed' AND soc_code IN (SELECT soc_code FROM scope))
    WHERE rn = 1 AND wage_p50 IS NOT NULL
),
raw_proj AS (
    SELECT 'BR-' || lpad(CAST(brand AS VARCHAR), 4, '0') AS "Occupation code",
           format('{{:,.1f}}', (avg_price / 1000.0 - 1.0) * 100.0) AS "Employment change, percent",
           CAST(brand AS BIGINT) AS src_row
    FROM (SELECT CAST(split_part(p_brand, '#', 2) AS INTEGER) AS brand,
                 CAST(SUM(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE)
                 / CAST(COUNT(p_retailprice) AS DOUBLE) AS avg_price
          FROM part GROUP BY 1)
),
proj AS (
    SELECT soc_code, proj_growth_10y FROM (
        SELECT trim("Occupation code") AS soc_code,
               {clean_sql('"Employment change, percent"')} / 100.0 AS proj_growth_10y,
               ROW_NUMBER() OVER (PARTITION BY trim("Occupation code") ORDER BY src_row) AS rn
        FROM raw_proj)
    WHERE rn = 1 AND proj_growth_10y IS NOT NULL
),
full_rows AS (
    SELECT w.*, n.national_wage_p50, pr.proj_growth_10y, sc.occupation, sc.occupation_group,
           list_filter([w.wage_p10, w.wage_p25, w.wage_p50, w.wage_p75, w.wage_p90], lambda x: x IS NOT NULL)
           = list_sort(list_filter([w.wage_p10, w.wage_p25, w.wage_p50, w.wage_p75, w.wage_p90],
                                   lambda x: x IS NOT NULL)) AS monotonic
    FROM with_prior w LEFT JOIN nat n ON w.soc_code = n.soc_code
    LEFT JOIN proj pr ON w.soc_code = pr.soc_code
    LEFT JOIN scope sc ON w.soc_code = sc.soc_code
),
market_pre AS (
    SELECT soc_code, occupation, occupation_group, area_code, metro, state, employment,
           employment_per_1k, employment_prior, supply_growth_3y, proj_growth_10y,
           wage_p10, wage_p25, wage_p50, wage_p75, wage_p90, national_wage_p50
    FROM full_rows
    WHERE monotonic AND soc_code IS NOT NULL AND occupation IS NOT NULL
      AND occupation_group IS NOT NULL AND area_code IS NOT NULL AND metro IS NOT NULL
      AND state IS NOT NULL AND employment IS NOT NULL AND wage_p50 IS NOT NULL
),
onet AS (
    SELECT e.vec_id, e.label, u.dim - 1 AS dim, CAST(u.x AS DOUBLE) AS x
    FROM embeddings e, UNNEST(e.embedding) WITH ORDINALITY AS u(x, dim)
),
raw_onet AS (
    SELECT 'BR-' || lpad(CAST(label + 1 AS VARCHAR), 4, '0') || '.0' || CAST(vec_id % 3 AS VARCHAR)
               AS "O*NET-SOC Code",
           'skill_' || lpad(CAST(dim AS VARCHAR), 2, '0') AS "Element Name",
           'IM' AS "Scale ID", format('{{:,.2f}}', 3.0 + 2.0 * x) AS "Data Value",
           CASE WHEN vec_id % 11 = 0 THEN 'Y' WHEN vec_id % 2 = 0 THEN NULL ELSE 'n' END
               AS "Recommend Suppress"
    FROM onet
    UNION ALL
    SELECT 'BR-' || lpad(CAST(label + 1 AS VARCHAR), 4, '0') || '.0' || CAST(vec_id % 3 AS VARCHAR),
           'skill_' || lpad(CAST(dim AS VARCHAR), 2, '0'), 'LV',
           format('{{:,.2f}}', (3.0 + 2.0 * x) * 1.4), 'N'
    FROM onet
),
onet_rows AS (
    SELECT substring(trim("O*NET-SOC Code"), 1, 7) AS soc_code, trim("Element Name") AS skill,
           CAST(ROUND({clean_sql('"Data Value"')} * 100) AS BIGINT) AS units
    FROM raw_onet
    WHERE "Scale ID" = 'IM' AND upper(COALESCE("Recommend Suppress", 'N')) <> 'Y'
),
onet_sums AS (
    SELECT soc_code, skill, SUM(units) * 10 AS num, COUNT(units) AS den
    FROM onet_rows WHERE soc_code IN (SELECT soc_code FROM scope)
    GROUP BY soc_code, skill
),
onet_q AS (
    SELECT soc_code, skill, den, ((num % den) + den) % den AS r,
           (num - (((num % den) + den) % den)) // den AS q
    FROM onet_sums WHERE den > 0
),
skills_prof AS (
    SELECT soc_code, skill,
           CAST(q + CASE WHEN 2 * r > den OR (2 * r = den AND q % 2 <> 0) THEN 1 ELSE 0 END AS DOUBLE)
           / 1000.0 AS importance
    FROM onet_q
),
skill_counts AS (SELECT soc_code, COUNT(DISTINCT skill) AS n FROM skills_prof GROUP BY soc_code),
skills_full AS (
    SELECT * FROM skills_prof
    WHERE soc_code IN (SELECT soc_code FROM skill_counts
                       WHERE n = (SELECT MAX(n) FROM skill_counts))
),
market_built AS (SELECT * FROM market_pre WHERE soc_code IN (SELECT soc_code FROM skills_full)),
skills_built AS (SELECT * FROM skills_full WHERE soc_code IN (SELECT soc_code FROM market_built))
"""

"""Null-ordering and tie edge cases the driver tables never produce: the same
oracle SQL bodies run in DuckDB over an inline mart, compared with Spark."""

import math

import duckdb
import pandas as pd
import pyarrow as pa
import pytest

from marketlens import schema
from marketlens.operators import arbitrage, competition, pool
from marketlens.plans import catalog


def _row(soc, area, emp, per1k, growth, p50, nat, p25=None, p75=None):
    return dict(soc_code=soc, occupation=f"Occ {soc}", occupation_group="G", area_code=area,
                metro=f"M{area}", state="S", employment=float(emp), employment_per_1k=per1k,
                employment_prior=None if growth is None else emp / (1 + growth),
                supply_growth_3y=growth, proj_growth_10y=None, wage_p10=None,
                wage_p25=p25, wage_p50=float(p50), wage_p75=p75, wage_p90=None,
                national_wage_p50=nat)


ROWS = [
    # A: a null supply-per-1k, a tie in supply, one row under the floor
    _row("A", "1", 500, None, 0.10, 100.0, 90.0, 80.0, 120.0),
    _row("A", "2", 400, 5.0, None, 95.0, 90.0),
    _row("A", "3", 300, 5.0, -0.05, 110.0, 90.0, 90.0, 130.0),
    _row("A", "4", 200, 7.5, 0.20, 85.0, 90.0),
    _row("A", "5", 50, 9.0, 0.30, 70.0, 90.0),
    # B: national median missing (premium null everywhere)
    _row("B", "1", 300, 2.0, 0.01, 60.0, None),
    _row("B", "2", 250, 3.0, 0.02, 65.0, None),
    # C: zero national median (NULLIF path) and no growth at all
    _row("C", "1", 800, 1.0, None, 50.0, 0.0),
    _row("C", "2", 700, 1.5, None, 55.0, 0.0),
    _row("C", "3", 600, 1.5, None, 55.0, 0.0),
    # D: a single place
    _row("D", "9", 1000, 4.0, 0.5, 75.0, 70.0),
]


@pytest.fixture(scope="module")
def frames(spark):
    pdf = pd.DataFrame(ROWS)[schema.MARKET_COLUMNS]
    rows = [tuple(None if (isinstance(v, float) and math.isnan(v)) else v for v in r)
            for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, schema.MARKET_SCHEMA), pdf


def _duck(pdf, body):
    con = duckdb.connect()
    con.register("market_df", pa.Table.from_pandas(pdf))      # NaN -> NULL, as Spark sees it
    con.execute("CREATE VIEW market AS SELECT * FROM market_df")
    return con.sql("WITH " + body.strip()).df()


def _same(spark_df, duck_df, keys):
    a = spark_df.toPandas().sort_values(keys).reset_index(drop=True)
    b = duck_df[a.columns].sort_values(keys).reset_index(drop=True)
    assert len(a) == len(b)
    for c in a.columns:
        for x, y in zip(a[c], b[c]):
            if x is None or (isinstance(x, float) and math.isnan(x)):
                assert y is None or (isinstance(y, float) and math.isnan(y)) or pd.isna(y), (c, x, y)
            elif isinstance(x, float):
                assert x == pytest.approx(float(y), rel=1e-12, abs=1e-12), (c, x, y)
            else:
                assert x == y, (c, x, y)


def test_competition_index_edges(frames):
    sdf, pdf = frames
    _same(competition.competition_index(sdf), _duck(pdf, catalog.Q1_BODY), ["soc_code", "area_code"])


def test_competition_index_distributed_edges(frames):
    sdf, pdf = frames
    _same(competition.competition_index(sdf, strategy="distributed"), _duck(pdf, catalog.Q1_BODY),
          ["soc_code", "area_code"])


def test_pool_summary_edges(frames):
    sdf, pdf = frames
    _same(pool.talent_pool_summary(sdf), _duck(pdf, catalog.Q5_BODY), ["soc_code", "area_code"])


def test_arbitrage_edges(frames):
    sdf, pdf = frames
    body = catalog.Q2_BODY.format(headcount=20, percentile="p75")
    got = arbitrage.wage_arbitrage(sdf, arbitrage.largest_pool_scenarios(sdf, 20, "p75"))
    _same(got, _duck(pdf, body), ["soc_code", "area_code"])

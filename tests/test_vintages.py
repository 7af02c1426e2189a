"""Any number of vintages, the header contract over all their files, growth from uneven gaps."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from marketlens import schema
from marketlens.operators import ingest
from marketlens.sources import raw

COLS = list(schema.OES_COLUMNS.values())


def _row(**over):
    base = {c: "1" for c in COLS}
    base |= {"AREA": "777", "AREA_TITLE": "Old Town, ZZ", "AREA_TYPE": "4", "NAICS": "000000", "OCC_CODE": "11-1111",
             "O_GROUP": "detailed", "TOT_EMP": "900", "A_PCT10": "10", "A_PCT25": "20", "A_MEDIAN": "30", "A_PCT75": "40", "A_PCT90": "50"}
    return base | over


def _write(root, vintage, name, cols, rows, head=None):
    os.makedirs(f"{root}/vintage={vintage}", exist_ok=True)
    with open(f"{root}/vintage={vintage}/{name}", "w") as f:
        for line in [head or cols, *([r.get(c, "") for c in cols] for r in rows)]:
            f.write(",".join(f'"{x}"' for x in line) + "\n")


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="ml-vintages-")


@pytest.fixture
def scope(spark):
    return spark.createDataFrame([("11-1111", "Miller", "Food")], "soc_code string, occupation string, occupation_group string")


def test_a_vintage_without_a_required_column_is_fatal_and_named(spark, root):
    _write(root, "current", "a.csv", COLS, [_row()])
    _write(root, "prior", "a.csv", [c for c in COLS if c != "A_MEDIAN"], [_row()])
    with pytest.raises(raw.LandingError, match="vintage prior: 1 of its files.*missing A_MEDIAN") as e:
        raw.read_oes(spark, root)
    assert [r["vintage"] for r in e.value.faults] == ["prior"]


def test_padded_and_lower_case_headers_of_one_vintage(spark, root, scope):
    _write(root, "2021", "a.csv", COLS, [_row()])
    _write(root, "2018", "a.csv", COLS, [_row(TOT_EMP="450")], head=[f"  {c.lower()} " for c in COLS])
    got = {r.vintage: r.employment for r in ingest.clean_vintage(raw.read_oes(spark, root), scope).collect()}
    assert got == {"2021": 900.0, "2018": 450.0}


def test_a_cell_with_a_line_break_is_rejected(spark, root):
    _write(root, "current", "a.csv", COLS, [_row(AREA_TITLE="two\nlines")])
    with pytest.raises(raw.LandingError, match="open quote"):
        raw.read_oes(spark, root)


def test_repeated_names_and_header_only_files(spark, root, scope):
    _write(root, "current", "a.csv", COLS, [_row()])
    _write(root, "current", "b.csv", COLS, [])
    found = {os.path.basename(r.file): r.verdict for r in raw.header_contract(spark, root, COLS).collect()}
    assert found == {"a.csv": "ok", "b.csv": "no rows"}
    assert ingest.clean_vintage(raw.read_oes(spark, root), scope).count() == 1
    _write(root, "prior", "a.csv", [*COLS, "area "], [_row()])
    with pytest.raises(raw.LandingError, match="repeated"):
        raw.read_oes(spark, root)


def test_folder_names_with_special_characters(spark, root, scope):
    _write(root, "a%3Ab c+2020", "a.csv", COLS, [_row()])       # the folder of vintage "a:b c+2020"
    got = ingest.clean_vintage(raw.read_oes(spark, root), scope).collect()
    assert [r.vintage for r in got] == ["a:b c+2020"]


def test_the_number_of_jobs_does_not_follow_the_number_of_files(spark, root):
    def jobs(path, group):
        spark.sparkContext.setJobGroup(group, group)
        raw.read_oes(spark, path)
        spark.sparkContext.setJobGroup("other", "other")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    for i in range(2):
        _write(f"{root}/few", "2020", f"{i}.csv", COLS, [_row()])
    for v in range(2015, 2020):
        for i in range(20):
            _write(f"{root}/many", str(v), f"{i}.csv", COLS, [_row()])
    few, many = jobs(f"{root}/few", "few"), jobs(f"{root}/many", "many")
    assert many <= few + 3, (few, many)             # listing many folders may itself be a job


CELLS = [("2010", "a", "x", 100.0), ("2013", "a", "x", 133.1), ("2015", "a", "x", 161.051), ("2015", "a", "y", 50.0),
         ("2010", "a", "z", 0.0), ("2015", "a", "z", 10.0), ("2010", "b", "x", 80.0), ("2014", "b", "x", 80.0)]


def test_growth_takes_the_nearest_earlier_vintage_of_the_cell(spark):
    df = spark.createDataFrame(CELLS, "vintage string, soc_code string, area_code string, employment double").repartition(3)
    got = {(r.vintage, r.soc_code, r.area_code): r for r in ingest.vintage_growth(df).collect()}
    assert len(got) == len(CELLS)
    far = got["2015", "a", "x"]
    assert (far.prior_vintage, far.gap_years) == ("2013", 2) and abs(far.growth_per_year - 0.1) < 1e-9
    assert abs(got["2013", "a", "x"].growth - 0.331) < 1e-9 and got["2013", "a", "x"].gap_years == 3
    assert got["2015", "a", "y"].prior_vintage is None and got["2015", "a", "y"].growth is None
    zero = got["2015", "a", "z"]
    assert (zero.prior_vintage, zero.employment_prior, zero.growth, zero.growth_per_year) == ("2010", 0.0, None, None)
    assert got["2014", "b", "x"].growth_per_year == 0.0 and got["2010", "a", "x"].employment_prior is None


def test_the_market_takes_the_newest_vintage_at_a_three_year_rate(spark):
    df = spark.createDataFrame(CELLS, "vintage string, soc_code string, area_code string, employment double")
    got = {(r.soc_code, r.area_code): r.supply_growth_3y for r in ingest.newest_with_prior(df).collect()}
    assert set(got) == {("a", "x"), ("a", "y"), ("a", "z")} and abs(got["a", "x"] - 0.331) < 1e-9 and got["a", "y"] is None
    two = spark.createDataFrame([("current", "a", "x", 150.0), ("prior", "a", "x", 100.0), ("current", "a", "y", 9.0),
                                 ("prior", "a", "z", 9.0)], df.schema)
    assert {(r.area_code, r.employment_prior, r.supply_growth_3y) for r in ingest.newest_with_prior(two).collect()} == {
        ("x", 100.0, 0.5), ("y", None, None)}


def test_vintages_of_one_year_and_without_a_year(spark):
    schema_ = "vintage string, soc_code string, area_code string, employment double"
    same = spark.createDataFrame([("2010-may", "a", "x", 1.0), ("2010-nov", "a", "x", 2.0), ("2012", "a", "x", 4.0)], schema_)
    got = {r.vintage: (r.prior_vintage, r.gap_years) for r in ingest.vintage_growth(same).collect()}
    assert got == {"2010-may": (None, None), "2010-nov": (None, None), "2012": ("2010-nov", 2)}
    odd = spark.createDataFrame([("spring", "a", "x", 1.0)], schema_)
    with pytest.raises(Exception, match="no year is known for vintage spring"):
        ingest.vintage_growth(odd).collect()
    assert ingest.vintage_growth(odd, {"spring": 7}).first()["year"] == 7
    assert ingest.vintage_growth(odd.where(F.lit(False))).collect() == []

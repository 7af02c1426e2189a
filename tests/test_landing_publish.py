"""Landing files whose vintages differ in layout, true file order, title rows, safe publishing."""
import os
import tempfile

import pytest

from marketlens import schema
from marketlens.operators import ingest
from marketlens.plans import publish
from marketlens.sources import raw

COLS = list(schema.OES_COLUMNS.values())


def _row(**over):
    base = {c: "1" for c in COLS}
    base |= {"AREA": "777", "AREA_TITLE": "Old Town, ZZ", "AREA_TYPE": "4", "NAICS": "000000", "OCC_CODE": "11-1111",
             "O_GROUP": "detailed", "TOT_EMP": "900", "A_PCT10": "10", "A_PCT25": "20", "A_MEDIAN": "30", "A_PCT75": "40", "A_PCT90": "50"}
    return base | over


def _write(root, vintage, name, cols, rows):
    os.makedirs(f"{root}/vintage={vintage}", exist_ok=True)
    with open(f"{root}/vintage={vintage}/{name}", "w") as f:
        for line in [cols, *([r.get(c, "") for c in cols] for r in rows)]:
            f.write(",".join(f'"{x}"' for x in line) + "\n")


@pytest.fixture
def scope(spark):
    return spark.createDataFrame([("11-1111", "Miller", "Food")], "soc_code string, occupation string, occupation_group string")


def test_vintages_with_different_columns(spark, scope):
    root = tempfile.mkdtemp(prefix="ml-landing-")
    _write(root, "current", "a.csv", COLS, [_row()])
    swapped = ["EXTRA", *reversed(COLS)]
    _write(root, "prior", "a.csv", swapped, [_row(TOT_EMP="600", A_MEDIAN="25", EXTRA="x")])
    got = {r.vintage: (r.employment, r.wage_p50) for r in ingest.clean_vintage(raw.read_oes(spark, root), scope).collect()}
    assert got == {"current": (900.0, 30.0), "prior": (600.0, 25.0)}


def test_missing_column_in_one_vintage_is_named(spark, scope):
    root = tempfile.mkdtemp(prefix="ml-landing-")
    _write(root, "current", "a.csv", COLS, [_row()])
    _write(root, "current", "b.csv", [c for c in COLS if c != "TOT_EMP"], [_row()])
    with pytest.raises(ValueError, match="disagree"):
        raw.read_oes(spark, root)


def test_first_file_wins_whatever_its_size(spark, scope):
    root = tempfile.mkdtemp(prefix="ml-landing-")
    _write(root, "current", "a.csv", COLS, [_row(TOT_EMP="700")])
    _write(root, "current", "b.csv", COLS, [_row(TOT_EMP="800")] + [_row(AREA=str(i)) for i in range(3000)])
    got = ingest.clean_vintage(raw.read_oes(spark, root), scope).where("area_code = '777'").collect()
    assert [r.employment for r in got] == [700.0]


def test_projection_title_row(spark, scope):
    root = tempfile.mkdtemp(prefix="ml-proj-")
    with open(f"{root}/p.csv", "w") as f:
        f.write('"Table 1. Jobs, 2024 and projected 2034"\n"Occupation code","Employment change, percent"\n"11-1111","12.5"\n')
    got = ingest.projections(raw.read_projections(spark, root), scope).collect()
    assert [(r.soc_code, r.proj_growth_10y) for r in got] == [("11-1111", 0.125)]


def test_committed_versions_are_final_and_last_commit_wins(spark, market, skills):
    base = tempfile.mkdtemp(prefix="ml-pub-")
    assert publish.latest_version(spark, base) is None
    publish.publish(market, skills, base, version="v9")
    with pytest.raises(publish.PublishError, match="never rewritten"):
        publish.publish(market.limit(1), skills, base, version="v9")
    assert publish.read_published(spark, base)[0].count() == market.count()
    publish.publish(market, skills, base, version="v10")
    assert publish.latest_version(spark, base) == "v10"


def test_storage_errors_are_not_an_empty_base(spark):
    with pytest.raises(Exception, match="(?i)scheme|filesystem"):
        publish.latest_version(spark, "nosuchscheme://x/y")

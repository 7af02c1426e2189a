"""Landing-file readers (I1, I3, I23), published layout (I22), statistics (D13),
scenario validation (Q2i), profile head (Q4d) and the streaming view measure."""

import glob
import os
import tempfile

from pyspark.sql import functions as F

from marketlens import schema
from marketlens.operators import arbitrage, ingest, profile
from marketlens.plans import publish
from marketlens.sources import raw
from marketlens.streaming import usage_stream

HEADER = ["AREA", "AREA_TITLE", "AREA_TYPE", "PRIM_STATE", "NAICS", "OCC_CODE", "OCC_TITLE",
          "O_GROUP", "TOT_EMP", "JOBS_1000", "A_PCT10", "A_PCT25", "A_MEDIAN", "A_PCT75", "A_PCT90"]
ROW = ["31500", "Lakeport-Elm Grove, OR", "4", "OR", "000000", "15-1252", "Software Developers",
       "detailed", "6,400", "3.2", "61,500", "78,250", "98,000", "123,750", "161,000"]


def _csv_line(values, sep):
    return sep.join(f'"{v}"' if sep in v or "," in v else v for v in values)


def test_oes_landing_folder_with_vintages(spark):
    root = tempfile.mkdtemp(prefix="ml-landing-")
    for vintage, emp in (("current", "6,400"), ("prior", "5,120")):
        os.makedirs(f"{root}/vintage={vintage}")
        row = list(ROW)
        row[8] = emp
        with open(f"{root}/vintage={vintage}/part.csv", "w") as f:
            f.write(_csv_line(HEADER, ",") + "\n" + _csv_line(row, ",") + "\n")
    df = raw.read_oes(spark, root)
    assert {f.dataType.simpleString() for f in df.schema.fields if f.name != "src_row"} == {"string"}
    scope = spark.createDataFrame([("15-1252", "Software Developers", "Engineering")],
                                  "soc_code string, occupation string, occupation_group string")
    got = {r.vintage: r.employment for r in ingest.clean_vintage(df, scope).collect()}
    assert got == {"current": 6400.0, "prior": 5120.0}


def test_onet_tab_file(spark):
    root = tempfile.mkdtemp(prefix="ml-onet-")
    cols = schema.ONET_COLUMNS
    with open(f"{root}/Skills.txt", "w") as f:
        f.write("\t".join(cols) + "\n")
        f.write("\t".join(["15-1252.00", "Programming", "IM", "4.12", "N"]) + "\n")
        f.write("\t".join(["15-1252.00", "Programming", "LV", "6.00", "N"]) + "\n")
    df = raw.read_onet(spark, root)
    assert df.columns[:5] == cols
    assert ingest.onet_filter(df).count() == 1


def test_publish_layout_and_typed_read(spark, market, skills):
    base = tempfile.mkdtemp(prefix="ml-layout-")
    v = publish.publish(market, skills, base, version="v7")
    parts = glob.glob(f"{base}/version={v}/market/occupation_group=*")
    assert len(parts) == market.select("occupation_group").distinct().count()
    m = raw.read_mart(spark, f"{base}/version={v}/market")
    assert m.schema["employment"].dataType.simpleString() == "double"
    # pruning by the partition column reaches the file listing
    plan = m.where(F.col("occupation_group") == "Family 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "occupation_group" in plan


def test_analyze_catalog_table(spark, market):
    market.write.mode("overwrite").saveAsTable("ml_market_stats")
    publish.analyze(spark, "ml_market_stats")
    stats = spark.sql("DESCRIBE TABLE EXTENDED ml_market_stats").where("col_name = 'Statistics'").collect()
    assert stats and "rows" in stats[0].data_type


def test_invalid_scenarios_reported(spark, market):
    sc = spark.createDataFrame([("Brand#1", "0", 20, "p50"), ("Brand#1", "0", 0, "p50"),
                                ("Brand#1", "0", 5, "p99"), ("Nope", "0", 5, "p50")],
                               "soc_code string, baseline_area string, headcount long, percentile string")
    bad = arbitrage.invalid_scenarios(sc, market).collect()
    assert sorted((r.soc_code, r.headcount, r.percentile) for r in bad) == \
        [("Brand#1", 0, "p50"), ("Brand#1", 5, "p99"), ("Nope", 5, "p50")]


def test_profile_top_n(skills):
    p = profile.skill_profile(skills, top_n=5)
    counts = {r.soc_code: r["count"] for r in p.groupBy("soc_code").count().collect()}
    assert set(counts.values()) == {5}
    full = profile.skill_profile(skills).toPandas()
    top = p.toPandas()
    for soc, g in top.groupby("soc_code"):
        assert g.importance.min() >= full[full.soc_code == soc].importance.nlargest(5).min()


def test_stream_view_stats_events_exact(spark):
    path = "/root/testdata/sf0.001/events.parque[t]"
    s = usage_stream.events_stream(usage_stream.stream_session(spark, 4), path)
    got = usage_stream.materialize(usage_stream.view_stats(s, approx_sessions=0.01), "vs",
                                   ["day", "view_name"])
    ev = usage_stream.usage_from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    want = ev.groupBy(F.to_date("occurred_at").alias("day"), "view_name").agg(
        F.count(F.lit(1)).alias("want_events"), F.countDistinct("session_id").alias("sessions"))
    m = got.join(want, ["day", "view_name"], "full").toPandas()
    assert (m.events == m.want_events).all()
    assert ((m.sessions_approx - m.sessions).abs() <= (0.05 * m.sessions).clip(lower=1)).all()


def test_single_category_filter_reaches_scan(spark, market, skills):
    """A one-category question over the all-category index is pushed below the
    windows into the Parquet scan (row-group skipping on sorted soc_code)."""
    from marketlens.operators import competition
    base = tempfile.mkdtemp(prefix="ml-push-")
    publish.publish(market, skills, base, version="v1")
    pm, _ = publish.read_published(spark, base)
    q = competition.competition_index(pm).where(F.col("soc_code") == "Brand#7")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")   # untruncated scan text
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(soc_code,Brand#7)" in plan
    assert plan.count("Exchange hashpartitioning") == 1      # one shuffle feeds every window
    assert q.count() == market.where("soc_code = 'Brand#7' AND employment >= 100").count()

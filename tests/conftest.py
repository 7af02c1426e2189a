import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from marketlens.session import configure
    s = (SparkSession.builder.master("local[4]")
         .config("spark.sql.shuffle.partitions", "8")
         # keep 8 ranges even for tiny inputs so the distributed rank / percentile
         # paths always run across several partitions
         .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="ml-test-ckpt-"))
         .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="ml-test-wh-"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    configure(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def market(spark):
    from marketlens.sources import testmart
    return testmart.market(spark, SF01)


@pytest.fixture(scope="session")
def skills(spark):
    from marketlens.sources import testmart
    return testmart.skills(spark, SF01, "label").checkpoint(eager=True)


@pytest.fixture(scope="session")
def usage_log(spark):
    from marketlens.sources import testmart
    return testmart.usage_log(spark, SF01)

"""Run by test_retries.py in its own JVM: tasks may be retried (local[4,3]); one
attempt of one task fails before the range layout and one after it."""

import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark import TaskContext  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from marketlens.operators.ranking import percentile_cont_distributed  # noqa: E402
from marketlens.session import configure  # noqa: E402


def fail_first_attempt(tag):
    @F.udf(T.DoubleType())
    def f(v):
        ctx = TaskContext.get()
        if ctx.attemptNumber() == 0 and ctx.partitionId() == 1:
            raise RuntimeError(f"injected task loss ({tag})")
        return v
    return f


def main():
    spark = (SparkSession.builder.master("local[4,3]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "4")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="ml-retry-"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    configure(spark)
    rows = [("hot", float(i % 997)) for i in range(20000)] + [("a", float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    fr = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    clean = {r.k: (r.p10, r.p50, r.p90) for r in
             percentile_cont_distributed(df, ["k"], "v", fr).collect()}
    flaky_in = df.withColumn("v", fail_first_attempt("input")("v"))
    out = percentile_cont_distributed(flaky_in, ["k"], "v", fr)
    out = out.repartition(4).withColumn("p50", fail_first_attempt("output")("p50"))
    flaky = {r.k: (r.p10, r.p50, r.p90) for r in out.collect()}
    print(json.dumps({"clean": clean, "flaky": flaky}))
    spark.stop()


if __name__ == "__main__":
    main()

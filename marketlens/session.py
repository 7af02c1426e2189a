"""Session construction and shared runtime settings.

On a cluster the session is supplied by the platform and only the settings that
change semantics (UTC session time zone, ANSI mode) are enforced here. The
checkpoint folder is read from ``spark.checkpoint.dir``; a private folder is
created only when that setting is absent (local tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "marketlens",
                  shuffle_partitions: int | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Settings every job relies on, applied to any session (ours or the platform's).

    In local mode, when the launcher left ``spark.sql.shuffle.partitions`` unset,
    it is sized to the local cores (the default 200 only adds empty tasks on one
    machine); a cluster's setting is never touched."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    sc = spark.sparkContext
    if sc.master.startswith("local") and not sc.getConf().contains("spark.sql.shuffle.partitions") \
            and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        spark.conf.set("spark.sql.shuffle.partitions", str(max(1, sc.defaultParallelism)))
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``marketlens`` importable by Python workers (pandas UDFs reference it):
    zip the package once per application and distribute it with ``addPyFile``.

    Automatic only for local masters (``spark.marketlens.shipPackage=auto``). On a
    cluster the package is deployed with the job (``--py-files`` or a wheel);
    ``spark.marketlens.shipPackage=true`` forces shipping from the driver."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    mode = (spark.conf.get("spark.marketlens.shipPackage", None) or "auto").lower()
    if mode == "false" or (mode == "auto" and not sc.master.startswith("local")):
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="marketlens-pkg-"), "marketlens.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that setting wins
    and is required there. Only a local session without it gets a private folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared, cluster-visible folder: "
                               "marketlens cuts lineage with reliable checkpoints")
        configured = tempfile.mkdtemp(prefix="marketlens-ckpt-")   # local runs and tests only
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

"""Spark session settings shared by tests, bench and the entry module.

On a cluster the session comes from the launcher; ``configure`` only fills
settings the cluster left unset, so cluster-wide values always win.
"""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on.  UTC and ANSI keep results equal to the
# DuckDB oracle; AQE re-plans joins and partition counts from real sizes.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Fact tables are never broadcast by accident: the static threshold only
    # admits small dimension sides; AQE may still switch a join to broadcast
    # when the runtime size of a side is below its own threshold.
    "spark.sql.autoBroadcastJoinThreshold": str(16 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(16 * 1024 * 1024),
}


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "shopfront",
                  extra: dict | None = None) -> SparkSession:
    """A local session for tests and benchmarks (UI off, no server ports)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SHOPFRONT_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.default.parallelism", str(partitions))
    )
    for k, v in {**BASE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply BASE_CONF to an existing session where a value is still unset."""
    for k, v in BASE_CONF.items():
        if spark.conf.get(k, None) in (None, ""):
            spark.conf.set(k, v)
    # The comparison with the oracle and the NTZ fixture columns need UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A folder that the launcher set (by configuration or through the API) is
    kept.  Only a local master without one gets a scratch folder; a cluster
    without one is an error, as its executors could not share the files.
    """
    sc = spark.sparkContext
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return conf_dir or current.get()
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="shopfront-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, wherever their Python starts."""
    sc = spark.sparkContext
    if getattr(sc, "_shopfront_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    # the driver's own folder: Spark serves the file to the executors from here
    folder = tempfile.mkdtemp(prefix="shopfront-ship-")
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "shopfront"), "zip", os.path.dirname(package),
                                     os.path.basename(package)))
    sc._shopfront_shipped = True

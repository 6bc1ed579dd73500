"""SparkSession helpers.

The library never creates machine-local scratch space on a cluster: lineage is
cut with ``checkpoint()`` into the directory named by ``spark.checkpoint.dir``.
Only when that setting is absent and the master is local (tests) a directory under the
system temp folder is chosen; on a cluster a missing setting is an error.
"""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.scheduler.mode": "FAIR",            # the fits of run families share the executors
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # wide feature projections generate very large methods; above 8000 bytes of
    # bytecode the JVM does not JIT-compile them, so let such stages fall back
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # many small MLlib jobs leave shuffle files and broadcasts behind; the context
    # cleaner frees them after a JVM GC, which by default is forced only every 30 min
    "spark.cleaner.periodicGC.interval": "2min",
}


def get_spark(app: str = "foldspark", master: str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the library relies on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in _LOCAL_DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("FOLDSPARK_DRIVER_MEMORY", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory, setting a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # unset: local run or test session
        conf_dir = tempfile.mkdtemp(prefix="foldspark-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir

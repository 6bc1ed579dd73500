"""Intermediate tables in the shared folder that ``spark.checkpoint.dir`` names."""
from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from foldspark.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/foldspark-scratch/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: later steps read files that survive a lost executor.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a table that ``stored`` made and that nothing reads any more."""
    path = getattr(df, "_stored_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps.

    Its cleaner acts when the driver collects garbage, which a long job with little
    work on the driver seldom does by itself.
    """
    gc.collect()
    spark._jvm.System.gc()

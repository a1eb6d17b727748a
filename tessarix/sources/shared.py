"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Of tables that a job writes for itself; texts of rows resemble each other, so it takes far less room than the default one.
CODEC = "zstd"
_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; it goes when the driver ends.

    A local session without that setting gets a temporary one; on a cluster its lack is an error.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _own:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = base or tempfile.mkdtemp(prefix="spark-shared-")
        _own[sc.applicationId] = f"{base.rstrip('/')}/tables-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _own[sc.applicationId])
    return _own[sc.applicationId]


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the session has been stopped, and with it the way to the file system
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table that is read again: computed once however often it is used, and kept when executors are lost."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", CODEC).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.path = path
    return out

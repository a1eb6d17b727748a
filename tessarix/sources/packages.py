"""Release packages: written beside their place, published in one step, never over another one, and checked again later."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import Spark

#: Parts of a path that leave a package or hide in it.
UNSAFE = r"(^/)|(^|/)\.{1,2}(/|$)|\\|^$|//"


def manifest(entries: DataFrame) -> DataFrame:
    """path, bytes, sha256 of the entries (subject, study, path, content)."""
    return entries.select("path", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(entries: DataFrame, root: str, export_id: str) -> str:
    """Write the package and its manifests (JSON and CSV) to a staging folder, then rename that into its place.

    A package that is there already is an error, and so is an unsafe or repeated path; both leave nothing behind.
    """
    spark = entries.sparkSession
    final, staging = f"{root}/{export_id}", f"{root}/_staging/{export_id}"
    place, system = _place(spark, final)
    if system.exists(place):
        raise ValueError("this package has been published")
    listed = manifest(entries)
    bad = listed.groupBy("path").agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col("path").rlike(UNSAFE)).limit(5).collect()
    if bad:
        raise ValueError(f"paths must be relative and unique: {[r['path'] for r in bad]}")
    entries.write.mode("overwrite").partitionBy("subject", "study").parquet(f"{staging}/files")
    written = manifest(spark.read.parquet(f"{staging}/files"))  # of what is on disk, not of what was meant
    written.write.mode("overwrite").json(f"{staging}/manifest.json")
    written.write.mode("overwrite").option("header", True).csv(f"{staging}/manifest.csv")
    begun, _ = _place(spark, staging)
    if not system.rename(begun, place):
        raise ValueError("this package could not be published")
    return final


def checked(spark: SparkSession, root: str, export_id: str) -> DataFrame:
    """Path, status of each file in manifest or package: unchanged, changed, missing, unlisted or unsafe."""
    package = f"{root}/{export_id}"
    said = spark.read.schema("path string, bytes long, sha256 string").json(f"{package}/manifest.json")
    there = manifest(spark.read.parquet(f"{package}/files")).select(F.col("path").alias("t_path"), F.col("bytes").alias("t_bytes"), F.col("sha256").alias("t_sha"))
    both = said.join(there, F.col("path") == F.col("t_path"), "full_outer")
    same = (F.col("bytes") == F.col("t_bytes")) & (F.col("sha256") == F.col("t_sha"))
    status = F.when(F.coalesce("path", "t_path").rlike(UNSAFE), "unsafe").when(F.col("t_path").isNull(), "missing").when(F.col("path").isNull(), "unlisted").when(same, "unchanged").otherwise("changed")
    return both.select(F.coalesce("path", "t_path").alias("path"), status.alias("status"))


def audited(events: DataFrame, root: str, key: bytes) -> None:
    """Append events (action, target, at) to the audit log below ``root``; the log holds a keyed token of each target, not the target."""
    token = F.expr(Spark().hmac(key, "target"))
    events.select("action", F.substring(token, 1, 32).alias("target"), "at").write.mode("append").json(f"{root}/_audit")


def audit_log(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("action string, target string, at long").json(f"{root}/_audit")


def sizes(spark: SparkSession, root: str) -> DataFrame:
    """Package, files, bytes of all packages below ``root``."""
    files = spark.read.schema("path string, bytes long, sha256 string").json(f"{root}/*/manifest.json").withColumn("package", F.regexp_extract(F.input_file_name(), r"([^/]+)/manifest\.json/", 1))
    return files.groupBy("package").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))

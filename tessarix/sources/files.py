"""Source trees: listings, reports and the incremental inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a report, at most.
LONGEST_REPORT = 10 << 20


def listing(spark: SparkSession, *roots: str) -> DataFrame:
    """path, size, mtime, kind of all files below the roots; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots)).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    suffix = F.regexp_extract(F.lower("path"), r"\.([^./]+)$", 1)
    return files.withColumn("kind", F.when(suffix == "txt", "report").when(suffix == "sql", "sql").when(suffix == "dcm", "dicom").otherwise("other"))


# What cp1252 has in place of the controls 80 to 9F, and the bytes that it doesn't have.
_CONTROLS, _SIGNS, _NONE = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f", "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ", r"[\x81\x8D\x8F\x90\x9D]"


def cp1252(column):
    """Text of cp1252 bytes, null where they aren't; in the JVM."""
    text = F.decode(F.col(column) if isinstance(column, str) else column, "ISO-8859-1")
    return F.when(~text.rlike(_NONE), F.translate(text, _CONTROLS, _SIGNS))


def reports(spark: SparkSession, *roots: str, encoding: str = "utf-8-sig", most: int = LONGEST_REPORT) -> DataFrame:
    """path, text, hash, status of text reports: too large, undecodable or with a NUL is an error with no text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(list(roots))
    sound = F.col("length") <= most
    if encoding == "cp1252":
        text = cp1252("content")
    elif encoding == "utf-16":
        text = F.decode("content", "UTF-16")
    else:
        text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", ""))
    read = files.select("path", F.when(sound, text).alias("text"), F.sha2("content", 256).alias("hash"), "length")
    good = F.col("text").isNotNull() & (F.instr("text", "\0") == 0)
    return read.select("path", F.when(good, F.col("text")).alias("text"), "hash", F.when(good, "ok").otherwise("error").alias("status"))


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files that the inventory doesn't hold with the same size and time."""
    return files.join(known.where("status in ('ok', 'ignored')").select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")


def upsert(known: DataFrame, news: DataFrame) -> DataFrame:
    """The inventory with rows replaced by path; of several news of a path the last run counts."""
    every = known.unionByName(news, allowMissingColumns=True)
    newest = Window.partitionBy("path").orderBy(F.desc("run"))
    return every.withColumn("_at", F.row_number().over(newest)).where("_at = 1").drop("_at")


def reconcile(known: DataFrame, listed: DataFrame, complete: bool) -> DataFrame:
    """After a complete listing, rows whose path has gone turn inactive; after an incomplete one nothing does."""
    if not complete:
        return known
    there = listed.select("path", F.lit(True).alias("_there")).distinct()
    return known.join(there, "path", "left").withColumn("active", F.col("active") & F.coalesce("_there", F.lit(False))).drop("_there")

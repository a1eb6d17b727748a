"""A query that publishes a package, looks at it again and reads its log, and the check."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import Duck
from ..sources import packages
from ..sources.shared import folder
from .given import oracle

KEY = b"audit-key"


def package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package of all documents is published in two steps and audited; files that come later are unlisted, publishing again is refused."""
    root = f"{folder(spark)}/packages-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null")
    entry = lambda suffix: docs.select(F.col("source").alias("subject"), F.coalesce("lang", F.lit("none")).alias("study"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(suffix)).alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"), "doc_id")
    entries = entry(".txt").drop("doc_id")
    place = packages.publish(entries, root, "first")
    packages.audited(spark.range(1).select(F.lit("published").alias("action"), F.lit("first").alias("target"), F.lit(1).cast("long").alias("at")), root, KEY)
    try:
        packages.publish(entries, root, "first")
        again = "published twice"
    except ValueError:
        again = "refused"
    packages.audited(spark.range(1).select(F.lit(again).alias("action"), F.lit("first").alias("target"), F.lit(2).cast("long").alias("at")), root, KEY)
    entry(".more").where("doc_id % 13 = 0").drop("doc_id").write.mode("append").partitionBy("subject", "study").parquet(f"{place}/files")
    no = F.lit(None).cast("long")
    files = packages.checked(spark, root, "first").select(F.lit("file").alias("kind"), F.col("path").alias("name"), "status", no.alias("bytes"))
    sizes = packages.sizes(spark, root).select(F.lit("package"), "package", F.col("files").cast("string"), F.col("bytes").cast("long"))
    log = packages.audit_log(spark, root).select(F.lit("audit"), "target", "action", "at")
    return files.union(sizes).union(log)


def _sql() -> str:
    token = f"substr({Duck().hmac(KEY, chr(39) + 'first' + chr(39))}, 1, 32)"
    return f"""select 'file' as kind, concat('docs/', doc_id, '.txt') as name, 'unchanged' as status, cast(null as bigint) as bytes from documents union all select 'file', concat('docs/', doc_id, '.more'), 'unlisted', null from documents where doc_id % 13 = 0
union all select 'package', 'first', cast(count(*) as varchar), cast(sum(octet_length(encode(coalesce(text, '')))) as bigint) from documents union all select 'audit', {token}, 'published', 1 union all select 'audit', {token}, 'refused', 2"""


QUERIES = {"S13_package": package}
ORACLES = {"S13_package": oracle(_sql())}

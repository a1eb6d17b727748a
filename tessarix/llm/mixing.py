"""Mixing sources to target weights, in DataFrame operations only.

Every row gets a hash-random key. Keys are uniform, so equal key ranges cut each source - a source with a third of
all rows too - into buckets of like size without sampling; each bucket is sorted on its own and the prefix sum of a row
is its bucket's offset plus the running sum inside the bucket. A source's budget then cuts that order exactly, after as
many whole epochs as the budget holds.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, last in order; repeated rows
are rows like any other (equal rows tie, and swap without effect); an empty table gives an empty result; further
columns of the input are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, few, table, unused

WORDS = r"[^\x20\x09-\x0D]+"
#: A row can be taken this many times at most.
MOST_EPOCHS = 3
#: Weights by source in code point order, over again.
WEIGHTS = (1, 2, 3)
#: Rows that one sorted bucket should hold, and bits of the keys that cut them.
BUCKET_ROWS, KEY_BITS = 8_192, 60


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and the hash-random key of every row."""
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(F.concat_ws("|", "doc_id", F.length("text"), "source").cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """One row per source: source_size and target.

    Pouring the whole by weight into sources that hold ``most`` times their size, and the excess again until none runs
    over, ends at one level: target = least(cap, weight * level). Sorted by cap / weight, the level follows from prefix
    sums. The table has one row per source; nothing of the documents reaches it.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_source) - 1) % len(weights) + 1).cast("int"))
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    per = per.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    per = per.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    per = per.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    per = per.withColumn("level_here", F.col("left") / F.col("open"))
    level = F.min(F.when(F.col("ratio") >= F.col("level_here"), F.struct("ratio", "level_here"))).over(every)["level_here"]
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * level, F.col("cap").cast("double"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of ``docs``."""
    sized = cut(sizes(docs), "mix")
    bits = max(0, (max(1, sized.count()) // bucket_rows).bit_length())
    bucketed = sized.withColumn("bucket", F.shiftright("key", KEY_BITS - bits))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("held")).withColumn("offset", F.coalesce(F.sum("held").over(ahead), F.lit(0)))
    per = targets(sized, weights, most)
    offsets = offsets.alias("o").join(per.alias("p"), F.col("o.source").eqNullSafe(F.col("p.source"))).select("o.source", "bucket", "offset", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = bucketed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = ordered.join(offsets, same(ordered, offsets) & (ordered["bucket"] == offsets["bucket"])).drop(offsets["source"]).drop(offsets["bucket"])
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - epochs * F.col("source_size") - F.col("offset") - F.col("inside")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def copies(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it: a row cut by the budget counts when half of it is taken.

    Rows are matched to their mix by doc_id, source and size; of rows equal in all three the mean taken counts. Rows
    without words are taken never; columns of any name are carried along.
    """
    size, name, source, held, times, again = unused(docs, "size", "name", "origin", "held", "times", "again")
    own = docs.withColumn(size, F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long"))
    plan = mix(docs).groupBy("doc_id", "source", "size").agg(F.avg("taken").alias("taken"))
    plan = plan.select(F.col("doc_id").alias(name), F.col("source").alias(source), F.col("size").alias(held), F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + F.lit(0.5))).otherwise(0).cast("int").alias(times)).where(F.col(times) > 0)
    kept = own.join(few(cut(plan, "plan")), F.col("doc_id").eqNullSafe(F.col(name)) & own["source"].eqNullSafe(F.col(source)) & (F.col(size) == F.col(held)))
    return kept.withColumn(again, F.explode(F.sequence(F.lit(1), times))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")

"""Approximate nearest neighbours by inner product along shifted Hilbert curves.

Vectors are lifted to one length, so that the largest inner product is the smallest angle, and projected to a few
dimensions by seeded orthonormal axes, anew for each curve. Shift and scale come from a bounded sample; every row gets a
Hilbert key on each curve. Spark range-partitions the keys; a row's rank follows from its place in its partition. A
bounded sample of the queries is compared with all rows; how far from a query its true neighbours lie on the curves
decides how many curves are used and how wide the window is: the cheapest choice that holds RECALL of them. Where the
curves tell too little, that choice is one curve as a whole, which is exact. Ranks cut the curves into blocks of like
size; each query visits the blocks within its window on each curve, and what the blocks find is merged and ranked again
on the original vectors in double precision.

Of equal vectors only those with the k + 1 smallest ids are candidates: no list can hold more of them, as ties go to the
smaller id; the rank is cut before the shuffle too. Queries are all rows asked for. Defined results: vectors that are null, zero, of another length than most,
or hold null or non-finite numbers take no part; rows that share a vec_id are candidates each, none for its own id;
fewer than k candidates are all returned by a window that spans them; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, in_batches, table

#: Curves at most, dimensions and bits of each, rows of a block, rows of the fitted sample.
CURVES, DIMENSIONS, BITS, BLOCK, SAMPLE = 4, 8, 7, 4096, 2000
#: Share of the sampled queries' true neighbours that the windows must hold, queries in that sample, blocks that wide
#: windows take at once, queries that meet a block in one task.
RECALL, ASKED, WIDE, TOGETHER = 0.97, 200, 8, 8192


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of ``cells``, unsigned numbers of ``bits`` bits each."""
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        top = np.uint64(1 << b)
        low = top - one
        for i in range(n):
            on = (x[i] & top) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] & np.uint64(1 << b)) != 0, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << one | (x[i] >> np.uint64(b) & one)
    return key.astype(np.int64)


def axes(curves: int, length: int, dimensions: int) -> np.ndarray:
    made = np.random.default_rng(41).normal(size=(curves, length, max(dimensions, 1)))
    return np.stack([np.linalg.qr(m)[0] for m in made])


def lifted(x: np.ndarray, longest: float, query: np.ndarray) -> np.ndarray:
    """Unit vectors: candidates get one more coordinate that fills their length up, queries none."""
    norm = np.sqrt((x * x).sum(axis=1))
    scale = np.where(query, norm, longest)
    more = np.where(query, 0.0, np.sqrt(np.maximum(0.0, longest**2 - norm**2)))
    return np.concatenate([x, more[:, None]], axis=1) / scale[:, None]


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and v (array<double>) of the rows that take part."""
    v = vectors.where("vec_id is not null").select("vec_id", F.col(column).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where(F.col("v").isNotNull() & sound)
    lengths = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return v.where(F.size("v") == (lengths[0]["n"] if lengths else 0))


def nearest(rows: DataFrame, asked: list, length: int, k: int) -> DataFrame:
    """query_id, vec_id: the true ``k`` nearest of a few queries, by brute force over all rows."""
    ids, x = np.array([r["vec_id"] for r in asked]), np.array([r["v"] for r in asked])

    def best(batches):
        near, at = np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64)
        for b in batches:
            theirs = b.column("vec_id").to_numpy()
            more = x @ b.column("v").flatten().to_numpy().reshape(-1, length).T
            more[ids[:, None] == theirs[None, :]] = -np.inf
            near, at = np.concatenate([near, more], axis=1), np.concatenate([at, np.broadcast_to(theirs, more.shape)], axis=1)
            top = np.lexsort((at, -near), axis=1)[:, :k]
            near, at = np.take_along_axis(near, top, 1), np.take_along_axis(at, top, 1)
        fine = near > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(fine)[0], pa.int32()), pa.array(at[fine]), pa.array(near[fine])], names=["q", "vec_id", "near"])

    found = in_batches(rows.where("not query").select("vec_id", "v"), best, "q int, vec_id long, near double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "vec_id"))
    return found.withColumn("at", place).where(F.col("at") <= k).select("q", "vec_id")


def choose(apart: np.ndarray, total: int, block: int, recall: float = RECALL) -> tuple[int, int]:
    """Curves and window, the cheapest that hold ``recall`` of the true pairs; ``apart``: places between each, by curve."""
    best = (total, 1, total)
    for c in range(1, apart.shape[1] + 1 if len(apart) else 1):
        window = int(np.sort(apart[:, :c].min(axis=1))[max(int(np.ceil(recall * len(apart))) - 1, 0)])
        best = min(best, (c * min(2 * window + block, total), c, window))
    return best[1:]


def neighbours(vectors: DataFrame, wanted: Column, k: int = 20, curves: int = CURVES, dimensions: int = DIMENSIONS, bits: int = BITS, window: int | None = None, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row where ``wanted`` holds.

    With a ``window``, that many rows on either side on all ``curves``; without, what the sampled queries call for.
    """
    spark = vectors.sparkSession
    sound = usable(vectors)
    same = Window.partitionBy("v").orderBy("vec_id")
    asked = sound.where(wanted).select("vec_id", "v", F.lit(True).alias("query")).distinct()
    offered = sound.withColumn("at", F.dense_rank().over(same)).where(F.col("at") <= k + 1).select("vec_id", "v", F.lit(False).alias("query"))
    rows = cut(asked.unionByName(offered), "vectors")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    picked = rows.where("not query").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
    if not picked:
        return empty
    longest = rows.where("not query").agg(F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    base = np.array([r["v"] for r in picked])
    length = base.shape[1]
    dimensions = min(dimensions, length + 1)
    turned = axes(curves, length + 1, dimensions)
    shown = np.einsum("nd,cdm->cnm", lifted(base, longest, np.zeros(len(base), bool)), turned)
    middle, spread = shown.mean(axis=1), shown.std(axis=1) + 1e-12
    shift = np.random.default_rng(43).uniform(-0.5, 0.5, size=(curves, dimensions))

    def keys(batches):
        for b in batches:
            x = b.column("v").flatten().to_numpy().reshape(-1, length)
            query = b.column("query").to_numpy(zero_copy_only=False)
            unit = lifted(x, longest, query)
            for c in range(curves):
                z = (unit @ turned[c] - middle[c]) / spread[c]
                cells = np.clip(((1 / (1 + np.exp(-1.7 * z)) + shift[c] / 8) * (1 << bits)), 0, (1 << bits) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c), pa.int32()), pa.array(hilbert_keys(cells.astype(np.uint64), bits)), b.column("vec_id"), b.column("query")], names=["curve", "key", "vec_id", "query"])

    keyed = in_batches(rows, keys, "curve int, key long, vec_id long, query boolean")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["curve", "key", "vec_id", "query"]
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ranged = cut(ranged.select("curve", "vec_id", "query", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("inside")), "ranged")
    # one row for each partition
    before = ranged.groupBy("part").agg((F.max("inside") + 1).alias("held"))
    before = before.select(F.col("part").alias("p"), F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    total = rows.count()
    ranks = ranged.join(before, F.col("part") == F.col("p")).select("curve", "vec_id", "query", (F.col("before") + F.col("inside") - F.col("curve") * F.lit(total)).alias("place"))
    if window is None:
        asked = rows.where("query").orderBy(F.xxhash64("vec_id"), "vec_id").limit(ASKED).select("vec_id", "v").collect()
        if not asked:
            return empty
        true = nearest(rows, asked, length, k).collect()
        some = spark.createDataFrame([(i, True) for i in {r["vec_id"] for r in asked}] + [(i, False) for i in {r["vec_id"] for r in true}], "vec_id long, query boolean")
        at = {}
        for r in ranks.join(F.broadcast(some), ["vec_id", "query"]).collect():
            at.setdefault((r["vec_id"], r["query"]), np.zeros(curves))[r["curve"]] = r["place"]
        curves, window = choose(np.array([np.abs(at[asked[r["q"]]["vec_id"], True] - at[r["vec_id"], False]) for r in true]).reshape(len(true), curves), total, block)
        ranks = ranks.where(F.col("curve") < curves)
        block = block * max(1, min(WIDE, window // block))
    last = (total - 1) // block
    near = F.sequence(F.greatest(F.lit(0), F.floor((F.col("place") - window) / block)), F.least(F.lit(last), F.floor((F.col("place") + window) / block)))
    # queries that meet a block are dealt over as many tasks as keep each small; the block's rows go to each of these
    meet = rows.where("query").count() * min(2 * window + 2 * block, total) // total
    deal = max(1, -(-meet // TOGETHER))
    slices = F.when(F.col("query"), F.array(F.pmod(F.xxhash64("vec_id"), F.lit(deal)))).otherwise(F.sequence(F.lit(0).cast("long"), F.lit(deal - 1).cast("long")))
    visits = F.when(F.col("query"), near).otherwise(F.array(F.floor(F.col("place") / block)))
    blocks = ranks.select("curve", "vec_id", "query", F.explode(visits).alias("block"), slices.alias("slices"))
    blocks = blocks.select("curve", "block", "vec_id", "query", F.explode("slices").alias("slice"))
    filled = blocks.distinct().join(rows.withColumnRenamed("vec_id", "i").withColumnRenamed("query", "q"), (F.col("vec_id") == F.col("i")) & (F.col("query") == F.col("q"))).select("curve", "block", "slice", "query", "vec_id", "v")

    def visit(t: pa.Table) -> pa.Table:
        query = t.column("query").to_numpy()
        ids = t.column("vec_id").to_numpy()
        x = t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, length)
        mine, theirs = ids[query], ids[~query]
        order = np.argsort(theirs, kind="stable")
        theirs, offered = theirs[order], x[~query][order]
        out = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        most = min(2 * k, len(theirs))
        for a in range(0, len(mine) if most else 0, 256):
            near = x[query][a : a + 256] @ offered.T
            near[mine[a : a + 256, None] == theirs[None, :]] = -np.inf
            top = np.argpartition(-near, most - 1, axis=1)[:, :most]
            got = np.take_along_axis(near, top, 1)
            fine = got > -np.inf
            out[0].append(np.repeat(mine[a : a + 256], most)[fine.ravel()])
            out[1].append(theirs[top][fine])
            out[2].append(got[fine])
        return pa.table({"query_id": np.concatenate(out[0]), "vec_id": np.concatenate(out[1]), "near": np.concatenate(out[2])})

    found = filled.groupBy("curve", "block", "slice").applyInArrow(visit, "query_id long, vec_id long, near double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("near").alias("near"))
    best = found.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id"))).where(F.col("at") <= 2 * k).drop("at")
    mine = rows.where("query").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    theirs = rows.where("not query").select("vec_id", F.col("v").alias("cv"))
    product = F.aggregate(F.zip_with("qv", "cv", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scored = best.join(mine, "query_id").join(theirs, "vec_id").select("query_id", "vec_id", product.alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)

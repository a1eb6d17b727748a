"""N-gram Jaccard join by grouped prefixes, exact at any size.

1. Each text becomes the set of its 5-word shingles (64-bit hashes); equal sets are one class from here on.
2. Shingles in a fixed part of the hash range are counted over all documents. A shingle that one document alone has
   can't be shared, so a document with more of those than its threshold forgives has no partner and leaves.
3. All shingles of the rest are counted among them and ordered from rare to common, private ones first. Each set keeps
   its prefix: two sets that link share one, and what is left behind its place bounds all that they share. Classes with
   like size and like prefix are one group; shared prefix shingles of groups give the group pairs.
4. A first round verifies each group against one pivot of its rarest shingles only, and closes the links to components.
   A second takes, where a prefix shingle still holds several components, the members of all group pairs across them.
   What two groups share of their prefixes, with what is left behind the last such shingle, bounds all that they share;
   and the shingles of one member whose bits the other's sketch lacks aren't shared. Pairs that neither bound rules out
   are compared on whole sets.

Defined results: a null or empty text has no shingles and is its own component; fewer than five words are one shingle;
equal rows, and rows with one doc_id, are one document; a null doc_id takes no part and has a null component; an empty
table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BASE, cut, few, free, in_batches, joined, mixed, slices, table, unused, word_hashes

SHINGLE, PERCENT = 5, 75
#: The part of the hash range in which private shingles are counted, in 1/1024.
COUNTED = 400
#: Pivots that a group is verified against in the first round.
PIVOTS = 2
#: 64-bit words of a set's sketch; one bit for each shingle, by its hash.
SKETCH = 16
_U = np.uint64
_PLACES = np.random.default_rng(7).integers(1, 1 << 63, 8, dtype=np.uint64) * _U(2) + _U(1)


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, computed for all of them at once."""
    data, starts = joined(texts)
    begin, _, word = word_hashes(data)
    counts = np.diff(np.searchsorted(begin, starts))
    ends = np.cumsum(counts)
    many = len(word) - width + 1
    if many > 0:
        run = np.zeros(many, dtype=np.uint64)
        for k in range(width):
            run += word[k : k + many] * _PLACES[k]
        run = mixed(run)
    out = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        start = end - n
        if n >= width:
            out.append(np.unique(run[start : end - width + 1]))
        elif n:
            out.append(mixed((word[start:end] * _PLACES[:n]).sum(keepdims=True) + np.array([n], np.uint64) * BASE))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _arrays(sets: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(flat, pa.int64()))


def _low(x: np.ndarray) -> np.ndarray:
    return x[: np.searchsorted(x, _U(COUNTED) << _U(54))]


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n, two hashes of the whole set, and the shingles in the counted part of the hash range."""

    def run(batches):
        for batch in slices(batches, "text", 1 << 20):
            sets = shingle_sets(batch.column("text"))
            with np.errstate(over="ignore"):
                one = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
                two = np.array([mixed(s ^ BASE).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two), _arrays([_low(s) for s in sets])], names=["doc_id", "n", "one", "two", "low"])

    return in_batches(docs.select("doc_id", "text"), run, "doc_id long, n long, one long, two long, low array<long>")


def sketch(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * SKETCH, np.uint8)
    bits[(tokens % _U(64 * SKETCH)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def whole_sets(docs: DataFrame) -> DataFrame:
    """doc_id, the whole set of each row and its sketch."""

    def run(batches):
        for batch in slices(batches, "text", 1 << 20):
            sets = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _arrays(sets), _arrays([sketch(s) for s in sets])], names=["doc_id", "tokens", "bits"])

    return in_batches(docs.select("doc_id", "text"), run, "doc_id long, tokens array<long>, bits array<long>")


def components(links: DataFrame) -> DataFrame:
    """node, root of all nodes in ``links`` (a, b); root is the smallest node that it reaches.

    Large-star and small-star steps in turn, each a join on the node; a node's smallest neighbour is aggregated before
    the shuffle, so a hub costs its edges once a round.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = large.unionByName(least.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, F.col("a") == F.col("u"))
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        old, edges = edges, cut(small.distinct(), "links")
        free(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now


def promising(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches don't rule a link out: a shingle whose bit the other sketch lacks isn't shared."""
    narrow = lambda x: sets.select(F.col("doc_id").alias(x), F.size("tokens").alias(f"n{x}"), F.col("bits").alias(f"s{x}"))
    alone = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, v: s + v)
    most = F.least(F.col("na") - alone("sa", "sb"), F.col("nb") - alone("sb", "sa"))
    return pairs.join(narrow("a"), "a").join(narrow("b"), "b").where(most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("i"))
    return both.where(F.col("i") * 100 >= (F.col("nx") + F.col("ny") - F.col("i")) * percent).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs``."""
    docs = docs.select("doc_id", "text")
    forgiven = F.floor(F.col("n") * (100 - percent) / 100).cast("long")

    # 1. profiles and classes of equal sets; a class of many copies is one row, and the join of its members can be split
    found = cut(profiles(docs), "profiles")
    same = ["n", "one", "two"]
    classes = found.where("n > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c")
    classes = cut(classes, "classes")
    rep = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", F.when(F.col("n") > 0, F.col("doc_id")))).alias("rep")
    members = cut(found.select("doc_id", *same).join(few(classes), same, "left").select("doc_id", "n", rep), "members")

    # 2. documents with too many private shingles leave
    private = found.where("doc_id is not null").select("doc_id", F.explode("low").alias("t")).groupBy("t").agg(F.min("doc_id").alias("d"), F.max("doc_id").alias("e")).where("d = e").groupBy("d").agg(F.count("*").alias("private"))
    alive = members.where("doc_id = rep").select(F.col("doc_id").alias("d"), "n").distinct().join(private, "d", "left").where(F.coalesce("private", F.lit(0)) <= forgiven).select("d", "n")
    alive = cut(alive, "alive")
    free(found, classes)
    sets = cut(whole_sets(docs.join(few(alive.select("d").distinct()), F.col("doc_id") == F.col("d"), "left_semi")).distinct(), "sets")

    # 3. all shingles of those left are counted; prefixes from rare to common, private ones first
    rows = sets.select("doc_id", F.size("tokens").cast("long").alias("n"), F.explode("tokens").alias("t"))
    shared = rows.join(rows.groupBy("t").agg(F.count("*").alias("df")).where("df > 1"), "t")
    own = Window.partitionBy("doc_id", "n")
    ranked = shared.withColumn("lone", F.col("n") - F.count("*").over(own)).withColumn("at", F.row_number().over(own.orderBy("df", "t")))
    # a set with too many private ones leaves here; all that two sets share from a place on is at most what is left there
    prefix = ranked.where(F.col("lone") + F.col("at") <= forgiven + 1)
    prefix = cut(prefix.select("doc_id", "n", "t", "lone", (F.col("n") - F.col("lone") - F.col("at") + 1).alias("left")), "prefix")

    # groups of like size and prefix
    listed = F.sort_array(F.collect_list("t"))
    marks = prefix.groupBy("doc_id", "n", "lone").agg(F.xxhash64(F.lit(1), listed).alias("p"), F.xxhash64(F.lit(2), listed).alias("q"))
    marks = cut(marks, "marks")
    like = ["n", "lone", "p", "q"]
    many = cut(marks.groupBy(*like).agg(F.min("doc_id").alias("g"), F.count("*").alias("c")).where("c > 1").drop("c"), "many")
    keyed = cut(marks.join(few(many), like, "left").select("doc_id", F.coalesce("g", "doc_id").alias("g")), "groups")
    free(marks, many)
    posts = cut(prefix.join(keyed.where("doc_id = g").select("g").distinct(), F.col("doc_id") == F.col("g"), "left_semi").select("t", F.col("doc_id").alias("g"), "n", "left").distinct(), "posts")

    # 4a. one pivot for each shingle, each group against the pivots that it shares most with
    pivots = posts.groupBy("t").agg(F.min_by(F.struct("g", "n", "left"), F.struct(-F.col("left") / F.col("n"), F.xxhash64("g", "t"))).alias("v"), F.count("*").alias("c")).where("c > 1").select("t", F.col("v.g").alias("b"), F.col("v.n").alias("k"), F.col("v.left").alias("left_k"))
    like = (F.least("n", "k") * 100 >= F.greatest("n", "k") * percent) & (F.least("left", "left_k") * (100 + percent) >= (F.col("n") + F.col("k")) * percent)
    tried = posts.join(pivots, "t").where((F.col("g") != F.col("b")) & like).groupBy(F.col("g").alias("a"), "b").agg(F.count("*").alias("c"))
    tried = tried.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("c"), "b"))).where(F.col("r") <= PIVOTS).select("a", "b")
    inside = keyed.where("doc_id <> g").select(F.col("doc_id").alias("a"), F.col("g").alias("b"))
    links = cut(verified(tried.unionByName(inside).distinct(), sets, percent), "first")
    roots = components(links)

    # 4b. members across components that still share a prefix shingle
    placed = cut(keyed.join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", "g", F.coalesce("root", "doc_id").alias("root")), "placed")
    spread = placed.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    posted = posts.join(spread, "g")
    mixed = posted.groupBy("t").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).where("least <> most").select("t")
    left = posted.join(mixed, "t")
    a = left.select("t", F.col("g").alias("ga"), F.col("n").alias("na"), F.col("left").alias("ea"), F.col("lo").alias("la"), F.col("hi").alias("ha"))
    b = left.select("t", F.col("g").alias("gb"), F.col("n").alias("nb"), F.col("left").alias("eb"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
    one_component = (F.col("la") == F.col("hb")) & (F.col("lb") == F.col("ha")) & (F.col("la") == F.col("lb"))
    like = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (F.least("ea", "eb") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
    # shared prefix shingles up to the last one, and what is left behind it
    both = a.join(b, "t").where((F.col("ga") < F.col("gb")) & ~one_component & like).groupBy("ga", "gb", "na", "nb").agg(F.count("*").alias("seen"), F.min(F.least("ea", "eb")).alias("behind"))
    across = both.where((F.col("seen") + F.col("behind") - 1) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("ga", "gb")
    across = across.unionByName(spread.where("lo <> hi").select(F.col("g").alias("ga"), F.col("g").alias("gb")))
    ma = placed.select(F.col("g").alias("ga"), F.col("doc_id").alias("a"), F.col("root").alias("ra"))
    mb = placed.select(F.col("g").alias("gb"), F.col("doc_id").alias("b"), F.col("root").alias("rb"))
    rest = across.join(ma, "ga").join(mb, "gb").where("ra <> rb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = cut(verified(promising(rest, sets, percent), sets, percent), "second")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    whole = members.join(roots, F.col("rep") == F.col("node"), "left")
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id; of rows with one doc_id the first text stays."""
    name, place = unused(docs, "name", "place")
    gone = cut(near_duplicates(docs, percent).where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    kept = docs.join(few(gone), F.col("doc_id") == F.col(name), "left_anti")
    again = cut(kept.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 and doc_id is not null").select(F.col("doc_id").alias(name)), "again")
    if again.isEmpty():
        return kept
    same = F.col("doc_id") == F.col(name)
    first = Window.partitionBy("doc_id").orderBy("text")
    repeated = kept.join(few(again), same, "left_semi").withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place)
    return kept.join(few(again), same, "left_anti").unionByName(repeated)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

"""Ranked lexical search over an index that is stratified by length.

A document's length enters its score by the whole number m alone, so documents of equal m form a stratum. Spark deals
the documents by range of (m, doc_id) - a stratum of any size spreads over tasks - and each task writes its strata in
blocks: the documents, and for each term the postings by tf, highest first. Inside a block the impact of a posting follows from tf alone and
is computed once per tf. The best impact of each term bounds what a block can give an item; blocks are sorted by that
bound and visited in this order, and items whose 20th score is above a block's bound leave it unread. Items come in
blocks too, so what is sent to the tasks is bounded however many items there are.

Defined results: null and empty texts have no terms, don't count and are never found; a null doc_id is a document like any
other, last among equal scores; repeated rows are documents each; equal rows of items are one item, and different texts of one
item_id are one item with the terms of all; an item without known terms has no rows; empty tables give no rows; further columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, in_batches, joined, plus, slices, table
from .words import TERM, cut_words

TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents returned for each item.
MOST = 20
#: Documents of a block at most; (item, term) rows of items that are searched at once; sums that a step adds up at once.
BLOCK_DOCS, ITEM_TERMS, STEP = 4096, 200_000, 1 << 19
#: Bytes of texts that are cut into terms at once.
TEXT_BYTES = 1 << 20
#: Of the score.
SCALE, TF, LENGTH, LEAST_M = 1_000_000_000, 1000, 12, 75
#: A null doc_id inside the index.
_NONE = (1 << 63) - 1
#: Lists are compressed blobs, so that a reader that takes many blocks at once holds no more than their files do.
_INDEX = "m long, docs array<long>, terms binary, held binary, tf binary, place binary"
_NARROW = "m long, bound long, docs array<long>, terms binary, held binary, tf binary, place binary"


def _lengths(texts: pa.Array) -> np.ndarray:
    """Terms of each text."""
    data, starts = joined(texts)
    solid = TERM[data]
    begin = np.flatnonzero(solid & ~np.concatenate(([False], solid[:-1])))
    return np.diff(np.searchsorted(begin, starts))


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text", TEXT_BYTES):
            n = _lengths(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["docs", "terms"])

    one = in_batches(docs.select("text"), run, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    return one[0], one[1]


def index(docs: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """A row for each block: its m, documents, sorted terms, how many documents hold each, and their tf and place."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text", TEXT_BYTES):
            n = _lengths(batch.column("text"))
            m = [LEAST_M + (25 * x * n_docs) // max(1, n_terms) for x in n.tolist()]  # whole numbers of any size
            yield plus(batch, ["doc_id", "text"], m=pa.array(m, pa.int64())).filter(pa.array(n > 0))

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = in_batches(docs.select(F.coalesce("doc_id", F.lit(_NONE)).cast("long").alias("doc_id"), "text"), run, "doc_id long, text string, m long")
    return in_batches(dealt.repartitionByRange(parts, "m", "doc_id").sortWithinPartitions("m", "doc_id"), _blocks, _INDEX)


def _pack(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers, np.int32).tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int32).astype(np.int64)


def _said(blob: bytes) -> pa.Array:
    """The sorted terms of a block."""
    return pc.split_pattern(pa.array([zstandard.ZstdDecompressor().decompress(blob).decode()]), "\n").values


def _table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", TEXT_BYTES):
        found = cut_words(batch.column("text"), TERM)
        m, docs, rows = batch.column("m").to_numpy(), batch.column("doc_id"), batch.num_rows
        first = np.concatenate(([True], m[1:] != m[:-1]))
        since = np.arange(rows) - np.maximum.accumulate(np.where(first, np.arange(rows), 0))
        first |= since % BLOCK_DOCS == 0
        block, starts = np.cumsum(first) - 1, np.flatnonzero(first)
        order = pc.sort_indices(found.known).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        held_terms = len(order)
        # (block, term, row) in one number, in this order
        keys, tf = np.unique((block[found.row] * held_terms + rank[found.code]) * rows + found.row, return_counts=True)
        group, row = np.divmod(keys, rows)
        best = np.lexsort((-tf, group))
        group, row, tf = group[best], row[best], tf[best]
        new = np.flatnonzero(np.diff(group, prepend=-1))
        of, term = np.divmod(group[new], held_terms)
        held, place = np.diff(new, append=len(group)), row - starts[block[row]]
        edges, ends = np.searchsorted(of, np.arange(len(starts) + 1)), np.append(new, len(group))
        words, numbers = found.known.take(pa.array(order[term])).to_pylist(), docs.to_numpy()
        for i, (low, high) in enumerate(zip(edges, edges[1:])):
            a, b = ends[low], ends[high]
            yield _table(_INDEX, [(m[starts[i]], numbers[starts[i] : starts[i + 1] if i + 1 < len(starts) else rows], zstandard.ZstdCompressor(level=1).compress("\n".join(words[low:high]).encode()), _pack(held[low:high]), _pack(tf[a:b]), _pack(place[a:b]))])


def items_of(items: DataFrame) -> DataFrame:
    """item_id, term, q: each item's terms and how often it has them."""
    words = items.select("item_id", "text").distinct().select("item_id", F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERMS), F.lit(0))).alias("term"))
    return words.groupBy("item_id", "term").agg(F.count("*").alias("q"))


def item_blocks(items: DataFrame) -> Iterator[list]:
    """The rows of whole items, some ITEM_TERMS at a time."""
    rows, last = [], object()
    for row in items_of(items).orderBy("item_id").toLocalIterator():
        if len(rows) >= ITEM_TERMS and row.item_id != last:
            yield rows
            rows = []
        rows.append(row)
        last = row.item_id
    if rows:
        yield rows


class Asked:
    """A block of items: ids, distinct terms, and for each term the items that hold it with weight times repeats."""

    def __init__(self, rows: list):
        self.ids = list(dict.fromkeys(r.item_id for r in rows))
        self.terms = sorted({r.term for r in rows})
        item, term = {x: i for i, x in enumerate(self.ids)}, {x: i for i, x in enumerate(self.terms)}
        pairs = np.array(sorted((term[r.term], item[r.item_id], r.q) for r in rows), np.int64).reshape(-1, 3)
        self.items, self.q = pairs[:, 1], pairs[:, 2]
        self.starts = np.searchsorted(pairs[:, 0], np.arange(len(self.terms) + 1))

    def weigh(self, df: np.ndarray, n_docs: int) -> None:
        w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        self.weights = self.q * np.repeat(w, np.diff(self.starts))
        #: Sums of doubles are exact while they stay below 2**53; an impact is below 10**6.
        self.exact = np.bincount(self.items, weights=self.weights, minlength=len(self.ids)).max() * 1e6 < 2**53

    def pairs(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``terms`` its items: (which of ``terms``, which entry of items and weights)."""
        many = self.starts[terms + 1] - self.starts[terms]
        which = np.repeat(np.arange(len(terms)), many)
        return which, _ranges(self.starts[terms], many)


def _ranges(starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    ends = np.cumsum(many)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - many), many)


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    known, at = np.unique(tf, return_inverse=True)
    return ((SCALE * known.astype(np.int64)) // (TF * known.astype(np.int64) + LENGTH * m))[at]


def _asked_terms(asked: Asked, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of asked terms among those of a block, and which they are."""
    at = pc.index_in(_said(blob), value_set=pa.array(asked.terms, pa.string()))
    some = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    return some, pc.fill_null(at, 0).to_numpy()[some].astype(np.int64)


def _frequencies(asked: Asked):
    """df of the asked terms, from each block's counts."""

    def run(batches):
        df = np.zeros(len(asked.terms), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                some, terms = _asked_terms(asked, row["terms"])
                df[terms] += _unpack(row["held"])[some]  # a block has each term once
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], names=["term", "df"])

    return run


def _narrowed(asked: Asked):
    """Of each block the asked terms' postings alone, with the most that any item can get from it."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                some, terms = _asked_terms(asked, row["terms"])
                held, tf = _unpack(row["held"]), _unpack(row["tf"])
                begins = np.cumsum(held) - held
                which, entry = asked.pairs(terms)
                bounds = np.zeros(len(asked.ids), np.int64)
                np.add.at(bounds, asked.items[entry], asked.weights[entry] * impact(tf[begins[some]], row["m"])[which])
                if bounds.max() > 0:
                    take = _ranges(begins[some], held[some])
                    yield _table(_NARROW, [(row["m"], bounds.max(), row["docs"], _pack(terms), _pack(held[some]), _pack(tf[take]), _pack(_unpack(row["place"])[take]))])

    return run


class Best:
    """The best documents of each item so far, in arrays."""

    def __init__(self, n_items: int, most: int):
        self.most, self.item, self.score, self.doc = most, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.least = np.ones(n_items, np.int64)  # what a document needs to enter

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = np.concatenate((self.item, item)), np.concatenate((self.score, score)), np.concatenate((self.doc, doc))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == self.most - 1
        self.least[item[last]] = score[last]
        kept = place < self.most
        self.item, self.score, self.doc = item[kept], score[kept], doc[kept]


def _scored(asked: Asked, most: int):
    """The best documents of each item among a task's blocks, which come by falling bound."""

    def run(batches):
        best = Best(len(asked.ids), most)
        for batch in batches:
            for row in batch.to_pylist():
                if row["bound"] < best.least.min():
                    continue
                m, docs = row["m"], np.array(row["docs"], np.int64)
                terms, held, tf, place = (_unpack(row[c]) for c in ("terms", "held", "tf", "place"))
                begins, gain = np.cumsum(held) - held, impact(tf, m)
                which, entry = asked.pairs(terms)
                items, weights = asked.items[entry], asked.weights[entry]
                bound = np.zeros(len(asked.ids), np.int64)
                np.add.at(bound, items, weights * gain[begins][which])
                open_items = np.flatnonzero(bound >= best.least)
                local = np.full(len(asked.ids), -1)
                local[open_items] = np.arange(len(open_items))
                keep = np.flatnonzero(local[items] >= 0)
                keep = keep[np.argsort(local[items[keep]], kind="stable")]
                which, items, weights = which[keep], local[items[keep]], weights[keep]
                # whole items, about STEP sums at a time
                ends = np.cumsum(held[which])
                while len(which):
                    cut_at = min(len(which), int(np.searchsorted(ends - (ends[0] - held[which[0]]), STEP)) + 1)
                    cut_at = int(np.searchsorted(items, items[cut_at - 1], side="right"))
                    low, high = int(items[0]), int(items[cut_at - 1]) + 1
                    some = which[:cut_at]
                    at = _ranges(begins[some], held[some])
                    cell = np.repeat(items[:cut_at] - low, held[some]) * len(docs) + place[at]
                    value = np.repeat(weights[:cut_at], held[some]) * gain[at]
                    if asked.exact:
                        sums = np.bincount(cell, weights=value, minlength=(high - low) * len(docs)).astype(np.int64)
                    else:
                        sums = np.zeros((high - low) * len(docs), np.int64)
                        np.add.at(sums, cell, value)
                    sums = sums.reshape(high - low, len(docs))
                    item, doc = np.nonzero(sums >= best.least[open_items[low:high], None])
                    if len(item):
                        best.add(open_items[low + item], sums[item, doc], docs[doc])
                    which, items, weights, ends = which[cut_at:], items[cut_at:], weights[cut_at:], ends[cut_at:]
        ids = [asked.ids[i] for i in best.item.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(best.doc, pa.int64()), pa.array(best.score, pa.int64())], names=["item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, most: int = MOST) -> DataFrame:
    """item_id, rank, doc_id, score: the ``most`` best documents of each item."""
    n_docs, n_terms = totals(docs)
    written = cut(index(docs, n_docs, n_terms), "strata")
    found = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for rows in item_blocks(items):
        asked = Asked(rows)
        df = np.zeros(len(asked.terms), np.int64)
        for row in in_batches(written.select("terms", "held"), _frequencies(asked), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
            df[row.term] = row.df  # a row for each asked term at most
        asked.weigh(df, n_docs)
        # a table of its own, so that no task runs both steps' workers at once
        ordered = cut(in_batches(written, _narrowed(asked), _NARROW), "asked").sortWithinPartitions(F.desc("bound"))
        found = found.unionByName(in_batches(ordered, _scored(asked, most), "item_id long, doc_id long, score long"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    ranked = found.withColumn("rank", place).where(F.col("rank") <= most)
    return ranked.select("item_id", "rank", F.when(F.col("doc_id") < _NONE, F.col("doc_id")).alias("doc_id"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

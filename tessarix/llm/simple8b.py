"""Token ids in Simple-8b words: a 4-bit selector says how many ids share the 60 bits below it.

A block holds the ids of whole documents, encoded as

    magic "TS8B", version 1 (1 byte), 3 zero bytes, ids (u64), words (u64), escapes (u64), words (u64 each), escapes (u64 each)

all little-endian. Selector 15 is an escape: its 60 bits index the values of 2^60 and more at the block's end. So each
word tells its own count, and a block decodes without a loop over words. Blocks are rows of a table written by Spark
- one file for each doc_id range, blocks numbered inside - so any store that Spark writes can hold them.

Defined results: rows are ordered by doc_id (nulls first), then text; a null or empty text has the end id alone;
repeated rows are encoded each; an empty table gives no blocks. A document is never split, however long.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import WordCoder, held
from .common import in_batches, shared_dir, slices, table

#: (ids, bits of each) by selector; a fixed value of the format.
SELECTORS = [(240, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
MAGIC = b"TS8B\x01\0\0\0"
#: A block ends with the document that brings it to so many ids.
BLOCK_IDS = 1 << 16
END_ID = 1
_COUNTS = np.array([n for n, _ in SELECTORS] + [1], dtype=np.int64)
_WIDTHS = np.array([i.bit_length() for i in range(1 << 16)], dtype=np.uint8)


def widths(ids: np.ndarray) -> np.ndarray:
    """The bits of each id, 61 for those that a word can't hold."""
    if not len(ids) or ids.max() < len(_WIDTHS):
        return _WIDTHS[ids]
    inexact = ids >> np.uint64(52) != 0  # too long for a double's fraction
    out = np.frexp(np.where(inexact, np.uint64(0), ids).astype(np.float64))[1].astype(np.uint8)
    out[inexact] = [min(int(v).bit_length(), 61) for v in ids[inexact]]
    return out


def pack(ids: np.ndarray) -> bytes:
    """The block of unsigned ids."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    width = np.zeros(n + 256, dtype=np.uint8)
    width[:n] = widths(ids)
    big = width[:n] == 61
    escapes = ids[big]
    select = np.where(big, ESCAPE, len(SELECTORS) - 1).astype(np.uint8)
    most, reach = width, 1  # most[i]: the widest of the ids i to i + reach - 1
    for s in range(len(SELECTORS) - 2, -1, -1):  # the most ids that fit are taken, so later, longer runs win
        count, bits = SELECTORS[s]
        while reach * 2 <= count:
            most = np.maximum(most, np.concatenate([most[reach:], np.zeros(reach, np.uint8)]))
            reach *= 2
        np.copyto(select, np.uint8(s), where=np.maximum(most[:n], most[count - reach : n + count - reach]) <= bits)
    at, i, steps = [], 0, _COUNTS[select].tolist()
    while i < n:
        at.append(i)
        i += steps[i]
    at = np.array(at, dtype=np.int64)
    chosen = select[at].astype(np.int64)
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([np.where(big, np.uint64(0), ids), np.zeros(256, np.uint64)])
    for s, (count, bits) in enumerate(SELECTORS):
        here = np.flatnonzero(chosen == s)
        if bits and len(here):
            held = words[here]
            for k in range(count):
                held |= padded[at[here] + k] << np.uint64(bits * k)
            words[here] = held
    words[chosen == ESCAPE] |= np.arange(len(escapes), dtype=np.uint64)
    return MAGIC + struct.pack("<QQQ", n, len(words), len(escapes)) + words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()


def unpack(block: bytes) -> np.ndarray:
    """The ids of a block."""
    if block[:8] != MAGIC:
        raise ValueError("not a block of this format")
    n, n_words, n_escapes = struct.unpack_from("<QQQ", block, 8)
    words = np.frombuffer(block, "<u8", n_words, 32)
    escapes = np.frombuffer(block, "<u8", n_escapes, 32 + 8 * n_words)
    select = (words >> np.uint64(60)).astype(np.int64)
    at = np.cumsum(_COUNTS[select]) - _COUNTS[select]
    out = np.zeros(n + 256, dtype=np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        here = np.flatnonzero(select == s)
        if bits and len(here):
            mask = np.uint64((1 << bits) - 1)
            for k in range(count):
                out[at[here] + k] = (words[here] >> np.uint64(bits * k)) & mask
    here = np.flatnonzero(select == ESCAPE)
    if len(here):
        out[at[here]] = escapes[(words[here] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out[:n]


def write(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of ``docs`` in ascending doc_id order: rows (shard, block, n_ids, doc_ids, lengths, payload)."""

    def run(batches):
        coder, shard = held(WordCoder, tokenizer_path), None
        number, names, lengths, parts, size = 0, [], [], [], 0

        def block():
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "block": pa.array([number], pa.int64()), "n_ids": pa.array([size], pa.int64()), "doc_ids": pa.array([names], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int64())), "payload": pa.array([pack(np.concatenate(parts))], pa.binary())}
            )

        for batch in slices(batches, "text", 4 << 20):
            ids, ends = coder.encode_all(batch.column("text"))
            ids = np.insert(ids, ends, end_id)
            ends = ends + np.arange(1, len(ends) + 1)
            begin = 0
            for pid, name, end in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                shard = pid
                names.append(name)
                lengths.append(end - begin)
                parts.append(ids[begin:end])
                size += end - begin
                begin = end
                if size >= block_ids:
                    yield block()
                    number, names, lengths, parts, size = number + 1, [], [], [], 0
        if names:
            yield block()

    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").withColumn("shard", F.spark_partition_id())
    in_batches(ordered, run, "shard int, block long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id, shard, block, inside, n_tokens, ids (binary, unsigned 32-bit little-endian) of each document; shard, block, start of each block."""
    blocks = spark.read.parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("held"))
    # one row a file, so these sums are over as many rows as the table has files
    before = shards.withColumn("before", F.coalesce(F.sum("held").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("held")
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("shard", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside")).join(before, "shard").select("shard", "block", (F.col("before") + F.col("inside")).alias("start"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"]).astype("<u4")
                ends = np.cumsum(row["lengths"])
                begins = ends - np.array(row["lengths"])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "shard": pa.array([row["shard"]] * len(ends), pa.int32()),
                        "block": pa.array([row["block"]] * len(ends), pa.int64()),
                        "inside": pa.array(begins, pa.int64()),
                        "n_tokens": pa.array(row["lengths"], pa.int64()),
                        "ids": pa.array([ids[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary()),
                    }
                )

    documents = in_batches(blocks.select("shard", "block", "doc_ids", "lengths", "payload"), run, "doc_id long, shard int, block long, inside long, n_tokens long, ids binary")
    return documents, starts


def report(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    documents, starts = read(spark, path)
    digests = documents.select("doc_id", "shard", "block", "inside", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return digests.join(starts, ["shard", "block"]).select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/simple8b-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return report(spark, path)

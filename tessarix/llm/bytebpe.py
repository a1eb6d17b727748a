"""Byte-level BPE encoding and decoding over Arrow batches.

Defined results: a null or empty text has no ids; equal rows give equal results; an empty table gives an empty
result; the operators add their columns to those named in ``keep`` and read no others. Whole texts are encoded.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ByteLevelCoder, held
from .common import in_batches, plus, schema_of, slices, table


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32(), safe=False))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] = ["doc_id"], offsets: bool = True, back: bool = False) -> DataFrame:  # noqa: B006
    """``keep``, ids array<int>; with ``offsets``, ends array<int>: the byte offset at which each id ends; with ``back``,
    decoded binary: what ``decode`` gives for the ids, without a second way through Python."""

    def run(batches):
        coder = held(ByteLevelCoder, ranks_path, pattern)
        for batch in slices(batches, text, 4 << 20):
            ids, ends = coder.encode_all(batch.column(text))
            more = {"ids": _lists(ids, ends)}
            if offsets:
                more["ends"] = _lists(coder.byte_ends(ids, ends), ends)
            if back:
                more["decoded"] = coder.decode_all(ids, ends)
            yield plus(batch, keep, **more)

    kinds = "ids array<int>" + ", ends array<int>" * offsets + ", decoded binary" * back
    return in_batches(df.select(*keep, *[text][: text not in keep]), run, schema_of(df, keep, kinds))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", keep: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """``keep`` and decoded binary: the bytes that the ids stand for. Null ids give no bytes."""

    def run(batches):
        coder = held(ByteLevelCoder, ranks_path, pattern)
        for batch in batches:
            column = batch.column(ids)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
            yield plus(batch, keep, decoded=coder.decode_all(column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)))

    return in_batches(df.select(*keep, *[ids][: ids not in keep]), run, schema_of(df, keep, "decoded binary"))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    ids = F.col("ids")
    coded = encode(docs, ranks_path, pattern, offsets=False, back=True)
    return coded.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)

"""Shared helpers of the corpus operators: table access, lineage cuts, Arrow batches, hashes of words."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a batch that goes to a Python worker, about; one long text alone may hold more.
BATCH_BYTES = 2 << 20
#: A table of ids is sent to all executors only if it has this many rows at most (some 50 bytes each there).
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that all executors share, spark.checkpoint.dir; it goes with the application.

    Without that setting a local session gets a temporary folder. On a cluster that would be one folder for each
    machine, so there it is an error.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _own:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
        if not base:
            if not sc.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="spark-shared-")
        _own[sc.applicationId] = f"{base.rstrip('/')}/{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _own[sc.applicationId])
    return _own[sc.applicationId]


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has been stopped, and with it the way to the file system
        return
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` wrote, once nothing that is still to run reads them."""
    for t in tables:
        _remove(t.sparkSession, t.cut_path)


def few(ids: DataFrame) -> DataFrame:
    """``ids``, a narrow table that ``cut`` wrote, to be sent to all executors if it is small enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def ordered(df: DataFrame, *order) -> DataFrame:
    """``df`` sorted over all its partitions, with ``part`` and ``inside``: where a row stands. To be written by ``cut``."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("inside", F.monotonically_increasing_id())
    return at.withColumn("part", F.shiftright("inside", 33)).withColumn("inside", F.col("inside").bitwiseAND(F.lit((1 << 33) - 1)))


def numbered(written: DataFrame, name: str) -> DataFrame:
    """A written table of ``ordered`` with the place of each row from 0 on instead of part and inside."""
    held = written.groupBy("part").agg((F.max("inside") + 1).alias("held"))  # one row for each partition
    before = F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = held.select("part", before.alias("before"))
    return written.join(F.broadcast(offsets), "part").withColumn(name, F.col("before") + F.col("inside")).drop("part", "inside", "before")


def ascii_lower(column):
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def in_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow``, in batches of few bytes: the session's bound is lowered to BATCH_BYTES where it is wider."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that ``column`` holds about ``most_bytes`` in each (one long text alone may hold more)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def plus(batch: pa.RecordBatch, keep: list[str], **columns) -> pa.RecordBatch:
    """``keep`` of the batch, then the new columns."""
    return pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + list(columns.values()), names=[*keep, *columns])


def schema_of(df: DataFrame, keep: list[str], more: str) -> str:
    """DDL of the kept columns and of ``more``."""
    return ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [more])


def unused(df: DataFrame, *names: str) -> list[str]:
    """A name for each of ``names`` that no column of ``df`` has, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


_U = np.uint64
_rng = np.random.default_rng(20240229)
#: Fixed by its seed: a factor for each byte.
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
BASE = _U(0x9E3779B97F4A7C15)
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bytes that are hashed at once, so that the arrays of a step stay small however long a text is.
_BLOCK = 1 << 17
with np.errstate(over="ignore"):
    _POWERS = np.concatenate([[_U(1)], np.cumprod(np.full(_BLOCK, BASE, dtype=np.uint64))])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, hash) of the words in UTF-8 ``data``; ASCII white space parts words, A-Z count as a-z."""
    begins, ends, hashes = [], [], []
    inside, place, carry = False, 0, 0  # of a word that goes on from the block before
    for start in range(0, len(data), _BLOCK):
        block = data[start : start + _BLOCK]
        space = _SPACES[block]
        before = np.concatenate(([not inside], space[:-1]))
        begin = np.flatnonzero(~space & before)
        end = np.flatnonzero(space & ~before)
        solid = np.flatnonzero(~space)
        if inside and len(solid) and solid[0] == 0:
            segments = np.concatenate(([0], begin))
        else:
            segments = begin
        if len(solid):
            offset = np.searchsorted(solid, segments)
            step = np.arange(len(solid)) - np.repeat(offset, np.diff(np.append(offset, len(solid))))
            sums = np.add.reduceat(_BYTES[_FOLD[block[solid]]] * _POWERS[step], offset)
            if len(segments) > len(begin):
                carry = (carry + int(sums[0]) * pow(int(BASE), place, 1 << 64)) % (1 << 64)
                sums = sums[1:]
        else:
            sums = np.empty(0, np.uint64)
        begins.append(begin + start)
        ends.append(end + start)
        # a word that ends in this block and began before it takes what was carried
        if inside and len(end):
            hashes.append(np.array([carry], np.uint64))
            inside = False
        goes_on = not space[-1]
        if goes_on:
            if len(begin):
                carry, place, inside = int(sums[-1]), len(block) - int(begin[-1]), True
                sums = sums[:-1]
            else:
                place += len(block)
        hashes.append(sums)
    if inside:
        hashes.append(np.array([carry], np.uint64))
        ends.append(np.array([len(data)]))
    if not begins:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(begins), np.concatenate(ends), mixed(np.concatenate(hashes))


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with a space behind each, and where each text begins; nulls count as empty."""
    parts = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.string()), ""), "", " ")
    offsets = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1].astype(np.int64)
    data = np.frombuffer(parts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(parts) else np.empty(0, np.uint8)
    return data, offsets - offsets[0]

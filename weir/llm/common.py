"""Shared pieces of the training-data operators: work folders and vectorised text hashing.

Every text is read whole. Null texts count as empty.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Records in one Arrow batch sent to Python. Long texts make batches heavy, so they hold few rows.
ARROW_ROWS = 256
#: Bytes of text hashed in one go; bounds the memory of the numpy temporaries.
SEGMENT_BYTES = 1 << 19
#: Bytes of text that are tokenised in one go.
GATHERED_BYTES = 4 << 20

#: Neighbouring whole numbers that one task works through where an order over all of them is needed.
NEIGHBOURS_LOG2 = 10

_workspaces: dict[str, str] = {}


def tune(spark: SparkSession) -> None:
    """Small Arrow batches for operators that move whole texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def workspace(spark: SparkSession) -> str:
    """A folder of this session under spark.checkpoint.dir, which all executors share.

    Where the setting is absent a temporary folder takes its place, but only in local mode: elsewhere executors would not
    share it, so that is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _workspaces:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = base or "file://" + tempfile.mkdtemp(prefix="weir-checkpoint-")
        _workspaces[app] = f"{base.rstrip('/')}/weir-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _workspaces[app])
    return _workspaces[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is only scratch
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def make_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sums_before(df: DataFrame, key: str, value: str) -> DataFrame:
    """key (distinct whole numbers) and `before`, the sum of value over all smaller keys.

    Sums run inside blocks of neighbouring keys, and once over the blocks, of which there is one in 1,024 keys.
    """
    rows = df.select(F.col(key).alias("key"), F.col(value).alias("value"), F.shiftright(key, NEIGHBOURS_LOG2).alias("block"))
    inside = W.partitionBy("block").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    over = W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy(F.col("block").alias("b")).agg(F.sum("value").alias("total")).select("b", F.coalesce(F.sum("total").over(over), F.lit(0)).alias("base"))
    near = rows.withColumn("near", F.coalesce(F.sum("value").over(inside), F.lit(0)))
    return near.join(blocks, F.col("block") == F.col("b")).select(F.col("key").alias(key), (F.col("base") + F.col("near")).alias("before"))


def next_numbers(df: DataFrame, key: str) -> DataFrame:
    """key (distinct whole numbers) and `next`, the next larger one; the largest is followed by the smallest. By blocks as above."""
    rows = df.select(F.col(key).alias("key"), F.shiftright(key, NEIGHBOURS_LOG2).alias("block"))
    firsts = rows.groupBy(F.col("block").alias("b")).agg(F.min("key").alias("first"))
    every = W.orderBy("b").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    firsts = firsts.select("b", F.coalesce(F.lead("first").over(W.orderBy("b")), F.min("first").over(every)).alias("after"))
    near = rows.withColumn("near", F.lead("key").over(W.partitionBy("block").orderBy("key")))
    return near.join(firsts, F.col("block") == F.col("b")).select(F.col("key").alias(key), F.coalesce("near", "after").alias("next"))


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id's decimal text, mod 5, is 0; a null id counts as the empty text and so is held out."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    lo, hi = offsets[0], offsets[-1]
    raw = np.frombuffer(data, dtype=np.uint8)[lo:hi] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - lo


def trim() -> None:
    """Gives freed memory back to the system; allocators keep it otherwise, and workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run):
    """run, with a trim at the end of a task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return wrapped


def gathered(batches: Iterator[pa.RecordBatch], text_bytes: int = GATHERED_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches joined up to about so many bytes, for work that gains from many rows at once."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= text_bytes:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
            trim()
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def binary_rows(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """values[offsets[k]:offsets[k + 1]] as the bytes of row k."""
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * data.itemsize).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def _pow(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        top = np.uint64(int(_powers[-1]) * int(_STEP) & 0xFFFFFFFFFFFFFFFF)
        _powers = np.concatenate([_powers, _powers * top])
    return _powers


def _segments(raw: np.ndarray, offsets: np.ndarray):
    """(first row, row after the last, start, end): runs of whole rows, or parts of one long row cut before white space."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(int(np.searchsorted(offsets, offsets[i] + SEGMENT_BYTES, side="right")) - 1, i + 1)
        if offsets[j] - offsets[i] <= 2 * SEGMENT_BYTES:
            yield i, j, int(offsets[i]), int(offsets[j])
        else:
            at, end = int(offsets[i]), int(offsets[j])
            while at < end:
                stop = min(at + SEGMENT_BYTES, end)
                while stop < end and not _IS_SPACE[raw[stop]]:
                    stop += 1
                yield i, j, at, stop
                at = stop
        i = j


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of other bytes than ASCII white space, A-Z lower-cased) and the n + 1 word offsets of the rows."""
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for i, j, lo, hi in _segments(raw, offsets):
        if hi == lo:
            continue
        part = raw[lo:hi]
        solid = ~_IS_SPACE[part]
        first = np.empty(hi - lo, bool)
        first[0] = True
        first[1:] = ~solid[:-1]
        if j - i > 1:
            bounds = offsets[i + 1 : j] - lo
            first[bounds[bounds < hi - lo]] = True
        keep = np.flatnonzero(solid)
        if not len(keep):
            continue
        starts = np.flatnonzero(first[keep])
        lengths = np.diff(np.append(starts, len(keep)))
        within = np.arange(len(keep)) - np.repeat(starts, lengths)
        values = _BYTE_LOWER[part[keep]] * _pow(int(lengths.max()))[within]
        hashes.append(mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64)))
        rows = np.searchsorted(offsets, keep[starts] + lo, side="right") - 1
        counts += np.bincount(rows, minlength=len(counts))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the rows' shingles in order, with repeats, and row offsets. A row of fewer words is one shingle; an empty row has none."""
    counts = np.diff(offsets)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out = np.zeros(int(n.sum()), np.uint64)
    where = np.concatenate([[0], np.cumsum(n)])
    if len(words) >= width:
        rolled = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            rolled = rolled * _MIX2 + words[k : k + len(rolled)]
        rolled = mix(rolled + np.uint64(width))
        long = np.repeat(counts >= width, n)
        rows = np.repeat(np.arange(len(counts)), n)
        source = np.arange(len(out)) - where[rows] + offsets[rows]
        out[long] = rolled[source[long]]
    for r in np.flatnonzero((counts > 0) & (counts < width)):
        value = np.uint64(0)
        for w in words[offsets[r] : offsets[r + 1]]:
            value = np.uint64((int(value) * int(_MIX2) + int(w)) & 0xFFFFFFFFFFFFFFFF)
        out[where[r]] = mix(np.array([(int(value) + int(counts[r])) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]
    return out, where


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct shingle hashes."""
    raw, offsets = utf8(column)
    words, at = word_hashes(raw, offsets)
    values, where = shingle_hashes(words, at, width)
    return [np.unique(values[where[k] : where[k + 1]]) for k in range(len(where) - 1)]

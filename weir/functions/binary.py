"""Expressions over binary columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

BLOCK = 64


def lit_bytes(data: bytes) -> Column:
    return F.lit(bytearray(data))


def sha256(data: Column) -> Column:
    return F.sha2(data, 256)


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """HMAC with a key known to the plan: two digests over padded keys."""
    import hashlib

    key = hashlib.sha256(secret).digest() if len(secret) > BLOCK else secret
    key = key.ljust(BLOCK, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    return F.sha2(F.concat(lit_bytes(outer), F.unhex(F.sha2(F.concat(lit_bytes(inner), message), 256))), 256)


def unsigned(data: Column, start: int, size: int, little: bool = False) -> Column:
    """The unsigned number in `size` bytes from the 1-based place `start`; null beyond the end."""
    digits = F.hex(F.substring(data, start, size))
    if little:
        digits = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])
    return F.when(F.length(data) >= start + size - 1, F.conv(digits, 16, 10).cast("long"))


def synchsafe(data: Column, start: int) -> Column:
    """Four bytes of seven bits, without masking the high ones."""
    byte = [unsigned(data, start + k, 1) for k in range(4)]
    return (F.shiftleft(byte[0], 21)).bitwiseOR(F.shiftleft(byte[1], 14)).bitwiseOR(F.shiftleft(byte[2], 7)).bitwiseOR(byte[3])


def _entropy(data: bytes | None) -> float | None:
    if data is None:
        return None
    if not data:
        return 0.0
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = n[n > 0] / len(data)
    return max(0.0, -float((p * np.log2(p)).sum()))


#: Bytes that are counted in one go; bounds the memory of the temporaries.
COUNTED = 1 << 22


def flat_bytes(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array's rows one after another (nulls are empty) and the n + 1 offsets of its rows."""
    data = data.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
    raw = data.buffers()[2] if len(data) else None
    return (np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)), at - at[0]


def byte_counts(data: pa.Array, groups: np.ndarray, n_groups: int) -> np.ndarray:
    """How often each byte occurs in the rows of each group (numbered from 0): groups x 256."""
    raw, at = flat_bytes(data)
    out = np.zeros(n_groups * 256, np.int64)
    for lo in range(0, len(raw), COUNTED):
        hi = min(lo + COUNTED, len(raw))
        first, last = np.searchsorted(at, lo, side="right") - 1, np.searchsorted(at, hi, side="left")
        sizes = np.minimum(at[first + 1 : last + 1], hi) - np.maximum(at[first:last], lo)
        out += np.bincount(np.repeat(groups[first:last].astype(np.int64) * 256, sizes) + raw[lo:hi], minlength=len(out))
    return out.reshape(n_groups, 256)


def _entropies(data: pa.Array) -> np.ndarray:
    out = np.zeros(len(data))
    for lo in range(0, len(data), 1024):
        part = data.slice(lo, 1024)
        n = byte_counts(part, np.arange(len(part)), len(part)).astype(np.float64)
        p = n / np.maximum(n.sum(axis=1, keepdims=True), 1)
        out[lo : lo + len(part)] = np.abs((p * np.log2(np.where(p > 0, p, 1))).sum(axis=1))
    return out


@F.arrow_udf(DoubleType())
def byte_entropy(data: pa.Array) -> pa.Array:
    """Shannon entropy of the byte frequencies in bits; 0 for no bytes, null for null."""
    return pa.array(_entropies(data), mask=data.is_null().to_numpy(zero_copy_only=False))


def byte_histogram(rows: DataFrame, part_col: str, data_col: str) -> DataFrame:
    """part_col (whole numbers), byte (two hex digits) and how often it occurs; each task sends 256 sums a part at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int | None, np.ndarray] = {}
        for batch in batches:
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            counts = byte_counts(batch.column(1), coded.indices.to_numpy(), len(coded.dictionary))
            for part, n in zip(coded.dictionary.to_pylist(), counts):
                total[part] = total.get(part, 0) + n
        for part, n in total.items():
            used = np.flatnonzero(n)
            arrays = [pa.array([part] * len(used), pa.int64()), pa.array([f"{b:02X}" for b in used], pa.string()), pa.array(n[used])]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "byte", "n"])

    counted = rows.select(F.col(part_col).cast("long").alias("part"), F.col(data_col).cast("binary").alias("data")).mapInArrow(run, "part long, byte string, n long")
    return counted.groupBy(F.col("part").alias(part_col), "byte").agg(F.sum("n").alias("n"))

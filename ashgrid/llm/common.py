"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashgrid.session import cut_lineage


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder (survives a lost executor)."""
    return cut_lineage(df)


def likely(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str, bits: int = 1 << 23) -> DataFrame:
    """The rows of ``df`` whose 64-bit ``key`` may occur among ``wanted_key`` (no wanted row is lost), so
    that a join that follows moves little else.

    A bitmap of ``bits`` bits, built by Spark and broadcast (its size is fixed); it fills up as
    ``wanted`` grows, and lets more rows through, never fewer."""
    place = lambda c: F.pmod(c, F.lit(bits)) + 1
    maps = wanted.select(place(F.col(wanted_key)).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("map_no")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("map_bits"))
    at = F.bitmap_bit_position(place(F.col(key)))
    byte = F.conv(F.hex(F.substring("map_bits", F.floor(at / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    met = df.join(F.broadcast(maps), F.bitmap_bucket_number(place(F.col(key))) == F.col("map_no"))
    return met.filter(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1).drop("map_no", "map_bits")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a string or binary Arrow array, without a copy; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    n = len(col)
    if n == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    starts, ends = off[:-1], off[1:].copy()
    if col.null_count:
        gone = np.asarray(col.is_null())
        ends[gone] = starts[gone]
    return raw, starts, ends


def spans_of(starts: np.ndarray, ends: np.ndarray, limit: int):
    """Index ranges (i, j) of consecutive rows holding about ``limit`` bytes each, so that the
    working arrays of a task stay bounded whatever the batch; one long row is a range by itself."""
    i, n = 0, len(starts)
    while i < n:
        j, size = i, 0
        while j < n and (j == i or size + ends[j] - starts[j] <= limit):
            size += int(ends[j] - starts[j])
            j += 1
        yield i, j
        i = j


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (the public splitmix64 steps)."""
    h = h ^ (h >> _S30)
    h *= _MIX1
    h ^= h >> _S27
    h *= _MIX2
    h ^= h >> _S31
    return h


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class RollingHash:
    """Hashes of any substring of a byte array from one prefix sum, modulo 2**64.

    Bytes go through a random table, so the sum over byte * base**position is a polynomial in an
    odd base; multiplying by the inverse power makes equal substrings hash alike wherever they are."""

    _table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    _power = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._power) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("_power", _BASE), ("_inverse", _INVERSE)):
                full = np.full(n, base, np.uint64)
                full[0] = 1
                setattr(cls, name, np.multiply.accumulate(full))

    def __init__(self, data: np.ndarray):
        self._grow(len(data) + 1)
        term = self._table[data]
        term *= self._power[:len(data)]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(term, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.sums[ends]
        h -= self.sums[starts]
        h *= self._inverse[starts]
        return mix(h)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the ``k`` bytes from every position on."""
        h = self.sums[k:] - self.sums[:-k]
        h *= self._inverse[:len(h)]
        return mix(h)


def longs(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as the signed longs that Spark stores."""
    return pa.array(np.ascontiguousarray(values).view(np.int64), pa.int64())

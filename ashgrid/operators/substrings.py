"""Occurrences of many keys in many names without pairs and without shuffling every substring.

The keys set bits in a table of fixed size, addressed by a hash of their characters.  Every stretch of
a name that is as long as some key is hashed by differences of prefix sums, a whole batch at a time, and
only stretches whose bit is set leave the task.  What comes through by chance is dropped by the equi-join
with the keys, so the size of the table decides the cost and never the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["key_bits", "possible_keys"]

ODD = 0x9E3779B97F4A7C15        # any odd number: it has an inverse modulo 2^64
CHUNK = 1 << 18                 # characters hashed in one go


def _slots(codes: np.ndarray, starts: np.ndarray, length: int, bits: int) -> np.ndarray:
    """Bit of every stretch ``codes[s:s + length]``; equal stretches have equal bits."""
    n = len(codes)
    up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, ODD, np.uint64)]), dtype=np.uint64)
    down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(ODD, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
    mixed = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * up[:n], dtype=np.uint64)])
    h = (sums[starts + length] - sums[starts]) * down[starts]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _key_slots(batches, bits: int):
    for b in batches:
        keys = b.column(0).to_pylist()
        slots = [int(_slots(_codes(k), np.zeros(1, np.int64), len(k), bits)[0]) for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array([len(k) for k in keys], pa.int32())], ["slot", "n"])


def key_bits(keys: DataFrame, bits: int) -> tuple[np.ndarray, list[int]]:
    """The bit table of a one-column table of non-null keys, and the lengths that occur among them.

    At most ``bits`` / 64 words reach the driver, however many keys there are."""
    if bits < 64 or bits & (bits - 1):
        raise ValueError("bits is a power of two, 64 or more")
    slots = keys.mapInArrow(lambda b: _key_slots(b, bits), "slot long, n int")
    one = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    words = np.zeros(bits // 64, np.int64)
    lengths: set[int] = set()
    for r in slots.groupBy(F.expr("slot div 64").alias("w")).agg(F.bit_or(one).alias("b"), F.collect_set("n").alias("n")).collect():
        words[r.w] = r.b
        lengths.update(r.n)
    return words.view(np.uint64), sorted(lengths)


def _hits(names: list[str], words: np.ndarray, lengths: list[int], bits: int):
    """(name, stretch) for the stretches of ``names`` whose bit is set, each once per name."""
    text = "".join(names)
    codes = _codes(text)
    ends = np.cumsum([len(n) for n in names])
    owner = np.repeat(np.arange(len(names)), [len(n) for n in names])
    room = ends[owner] - np.arange(len(codes)) if len(codes) else np.zeros(0, np.int64)
    found: set[tuple[int, str]] = set()
    for n in lengths:
        if n == 0:
            found.update((i, "") for i in range(len(names)))
            continue
        at = np.flatnonzero(room >= n)
        if len(at):
            s = _slots(codes, at, n, bits)
            at = at[(words[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1) == 1]
            found.update((int(owner[i]), text[i:i + n]) for i in at)
    return [(names[i], sub) for i, sub in sorted(found)]


def _probe(batches, words: np.ndarray, lengths: list[int], bits: int):
    for b in batches:
        part, size = [], 0
        for name in [*b.column(0).to_pylist(), None]:
            if part and (name is None or size + len(name) > CHUNK):
                got = _hits(part, words, lengths, bits)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.string()),
                                                  pa.array([x for _, x in got], pa.string())], ["name", "sub"])
                part, size = [], 0
            if name is not None:
                part.append(name)
                size += len(name)


def possible_keys(names: DataFrame, keys: DataFrame, bits: int = 1 << 22) -> DataFrame:
    """(name, sub): every substring of a name that is a key, and a few that are not (join with the keys).

    ``names`` and ``keys`` are tables of one string column; nulls take no part.  The empty key is in every name."""
    names, keys = names.na.drop(), keys.na.drop()
    words, lengths = key_bits(keys, bits)
    return names.mapInArrow(lambda b: _probe(b, words, lengths, bits), "name string, sub string")

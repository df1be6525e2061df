"""Periodic runs of words, from the Lyndon arrays that the first phase of a suffix sorter yields.

A run is a longest stretch of words with a smallest period q, at least LEAST words and TIMES periods long.

1. Words that occur fewer than TIMES times in a stretch lie in no run of it; they cut the stretch, again
   and again, until nothing changes.  A run lies whole in one of the remaining stretches.
2. Baier's grouping, the first phase of his suffix sorter: suffixes start grouped by their first word;
   groups are taken in falling order, and each appends its context to the nearest earlier suffix of
   a smaller group, which moves to a new group just above its old one, the higher the more
   contexts it took.  A suffix's context is then its longest Lyndon prefix: the Lyndon array.  It is
   done under the order of the words and under its reverse.
3. Every run has a Lyndon root of its period's length under one of the orders.  Roots that repeat are
   extended to both sides by longest common extensions (prefix hashes and bisection); the runs
   found are compared word by word at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashgrid.llm.common import RollingHash

LEAST, TIMES = 6, 4                # a run has max(LEAST, TIMES * q) words or more
WORD = r"[^\x20\x09-\x0D]+"


def lyndon_array(codes: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each position, by Baier's grouping.

    Positions that are not yet grouped form a linked list.  The highest group leaves the list; each
    stretch of l of its members that follow one another is appended to the position before them."""
    if not codes:
        return []
    n = len(codes)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    group, length = [0] * n, [1] * n
    symbols = sorted(set(codes))
    place = {s: g for g, s in enumerate(symbols)}
    members: list[list[int]] = [[] for _ in symbols]
    below = list(range(-1, len(symbols) - 1))
    above = list(range(1, len(symbols) + 1))
    above[-1] = -1
    for i, s in enumerate(codes):
        g = place[s]
        group[i] = g
        members[g].append(i)
    top = len(symbols) - 1
    while top >= 0:
        taken: dict[int, list[int]] = {}
        for i in members[top]:
            if group[i] != top:
                continue                     # has moved to a higher group
            j = left[i]
            if j >= 0 and group[j] == top:
                continue                     # not the first of its stretch
            count, r = 1, right[i]
            while r < n and group[r] == top:
                count += 1
                r = right[r]
            if r < n:
                left[r] = j
            if j >= 0:
                right[j] = r
                length[j] += count * length[i]
                if count in taken:
                    taken[count].append(j)
                else:
                    taken[count] = [j]
        for count in sorted(taken, reverse=True):
            made: dict[int, int] = {}
            for j in taken[count]:
                g = group[j]
                new = made.get(g)
                if new is None:
                    new = made[g] = len(members)
                    members.append([])
                    up = above[g]
                    below.append(g)
                    above.append(up)
                    above[g] = new
                    if up >= 0:
                        below[up] = new
                members[new].append(j)
                group[j] = new
        top = below[top]
    return length


def _stretches(codes: np.ndarray) -> list[tuple[int, int]]:
    """The stretches [i, j) of ``codes`` in which every word occurs TIMES times or more."""
    at = np.arange(len(codes))
    stretch = np.zeros(len(codes), np.int64)
    while len(at):
        _, back, count = np.unique(stretch * (int(codes.max()) + 1) + codes[at], return_inverse=True, return_counts=True)
        keep = count[back] >= TIMES
        whole = bool(keep.all())
        at = at[keep]
        if not len(at):
            break
        cut = np.ones(len(at), bool)
        cut[1:] = (np.diff(at) > 1) | (np.diff(stretch[keep]) != 0)
        stretch = np.cumsum(cut) - 1
        size = np.bincount(stretch)
        long = size[stretch] >= LEAST
        whole &= bool(long.all())
        at, stretch = at[long], stretch[long]
        if whole:
            break
    if not len(at):
        return []
    first = np.flatnonzero(np.r_[True, np.diff(at) > 1])
    last = np.r_[first[1:], len(at)] - 1
    return list(zip(at[first].tolist(), (at[last] + 1).tolist()))


def _extension(same, limit: np.ndarray) -> np.ndarray:
    """Greatest m <= limit with same(m), for every element, by bisection."""
    lo, hi = np.zeros(len(limit), np.int64), limit.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi + 1) >> 1
        ok = same(mid) & open_
        lo = np.where(ok, mid, lo)
        hi = np.where(open_ & ~ok, mid - 1, hi)


def _found(words: np.ndarray) -> set[tuple[int, int, int]]:
    """(start, end, period) of the runs of one stretch."""
    n = len(words)
    sums = _Sums(words)
    out: set[tuple[int, int, int]] = set()
    for order in (words, words.max() - words):
        q = np.array(lyndon_array(order.tolist()), np.int64)
        i = np.arange(n)
        # a first root lies in the first period of its run, so two more copies follow it
        fits = np.flatnonzero(i + 3 * q <= n)
        i, q = i[fits], q[fits]
        again = sums.of(i, i + q) == sums.of(i + q, i + 2 * q)
        i, q = i[again], q[again]
        again = sums.of(i, i + q) == sums.of(i + 2 * q, i + 3 * q)
        i, q = i[again], q[again]
        if not len(i):
            continue
        ahead = _extension(lambda m: sums.of(i, i + m) == sums.of(i + q, i + q + m), n - i - q)
        back = _extension(lambda m: sums.of(i - m, i) == sums.of(i + q - m, i + q), i)
        start, end = i - back, i + q + ahead
        enough = end - start >= np.maximum(LEAST, TIMES * q)
        got = set(zip(start[enough].tolist(), end[enough].tolist(), q[enough].tolist()))
        if not all(_is_run(words, *r) for r in got):  # unequal stretches of one hash: compare the words instead
            got = {r for r in {_extended(words, a, b) for a, b in zip(i.tolist(), q.tolist())}
                   if r[1] - r[0] >= max(LEAST, TIMES * r[2])}
        out |= got
    return out


def _is_run(words: np.ndarray, s: int, e: int, q: int) -> bool:
    """The stretch [s, e) has period q, and no neighbour keeps it."""
    return np.array_equal(words[s:e - q], words[s + q:e]) and (s == 0 or words[s - 1] != words[s + q - 1]) and (
        e == len(words) or words[e] != words[e - q])


def _extended(words: np.ndarray, i: int, q: int) -> tuple[int, int, int]:
    """(start, end, q) of the longest stretch of period q around the root at i, word by word."""
    ahead = np.flatnonzero(words[i:len(words) - q] != words[i + q:])
    back = np.flatnonzero(words[:i] != words[q:i + q])
    return (int(back[-1]) + 1 if len(back) else 0, i + q + int(ahead[0]) if len(ahead) else len(words), q)


class _Sums:
    """Hashes of any stretch of words from one prefix sum (see ``common.RollingHash``)."""

    def __init__(self, codes: np.ndarray):
        RollingHash._grow(len(codes) + 1)
        spread = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        spread ^= spread >> np.uint64(29)
        spread *= np.uint64(0xBF58476D1CE4E5B9)
        spread ^= spread >> np.uint64(32)
        self.sums = np.r_[np.zeros(1, np.uint64), np.cumsum(spread * RollingHash._power[:len(codes)], dtype=np.uint64)]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * RollingHash._inverse[starts]


def word_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of words, by start, then period."""
    if len(words) < LEAST:
        return []
    names = dict.fromkeys(words)
    if len(names) == len(words):
        return []
    for k, w in enumerate(names):
        names[w] = k
    codes = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
    found: list[tuple[int, int, int]] = []
    for a, b in _stretches(codes):
        _, local = np.unique(codes[a:b], return_inverse=True)
        found += [(a + s, e - s, q) for s, e, q in _found(local.astype(np.int64))]
    return sorted(found, key=lambda r: (r[0], r[2]))


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _run_batches(batches):
    for b in batches:
        runs, kept = [], []
        for text in b.column(1).to_pylist():
            words = (text or b"").split()    # bytes split at 0x20 and 0x09-0x0D only
            got = word_runs(words)
            if got:
                drop = np.zeros(len(words) + 1, np.int64)
                for s, m, q in got:
                    drop[s + q] += 1
                    drop[s + m] -= 1
                gone = np.cumsum(drop)[:-1] > 0
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            runs.append([{"start": s, "length": m, "period": q} for s, m, q in got])
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(runs, _RUN), pa.array(kept, pa.string())], ["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (array of start, length, period in words, by start, then period), collapsed (the text's
    words without those that a run holds after its first period, joined by one space).

    Words are runs of characters other than space and 0x09-0x0D.  A null, empty or blank text has no
    words and no run.  Every row gives a row, repeated ids and texts too; a null doc_id stays null; an empty
    table gives none; other columns are ignored.  Runs of one document may overlap, a word is dropped if
    any run drops it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(
        _run_batches, f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_period(text: Column, doc_id: Column) -> Column:
    """The text with a periodic end in about a tenth of the documents, by a rule on the id: with
    h = crc32(decimal id), g = h // 10 and n words, if h % 10 = 0 every word i from a = g % n on becomes
    word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8).  Other texts, and those without words or id, stay."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))

    def ended(w):
        n = F.size(w).cast("long")
        a = F.when(n > 0, g % F.greatest(n, F.lit(1).cast("long"))).otherwise(0)
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(w, (a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")).otherwise(text)

    # the array is bound once, not evaluated again for every element
    return F.when(h % 10 == 0, F.get(F.transform(F.array(words), ended), F.lit(0))).otherwise(text)


def run_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the longest run (ties: smallest start, then
    period), runs_sha256, collapsed_sha256 for every row of ``docs`` (see ``periodic_runs``)."""
    found = periodic_runs(docs)
    runs = F.col("runs")
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"),
                                                            (-r["period"]).alias("q"))))
    listed = F.array_join(F.transform(runs, lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    named = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"),
                         F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return named.select("doc_id", "n_runs", (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"),
                        (-F.col("best.q")).alias("period"),
                        F.expr("1000 * best.length div -best.q").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

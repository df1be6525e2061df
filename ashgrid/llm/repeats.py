"""Exact removal of long repeats with a run-length index.

A byte goes when a string of ``span`` bytes that covers it also starts earlier in the corpus.

1. Anchors.  Of every ``span`` consecutive bytes the gram with the smallest hash is the anchor
   (winnowing).  The windows of ``span`` bytes that share an anchor occurrence form a region, every
   window lies in exactly one, and equal windows have equal anchors.  Only windows with the same
   anchor hash can be equal.
2. Regions of one anchor hash meet in one shuffle of short rows (hashes and positions, no text).
   Equal regions but the first are repeats as a whole.  An anchor hash with one kind of region is
   done.
3. The first regions of the remaining anchor hashes are cut from the texts, dealt to buckets, and
   indexed: suffix order, Burrows-Wheeler transform in runs, and at the head of every run a sample
   of its text position, of the position before it in suffix order, and of their common length.
   Streaming the text through the samples gives every position's matching statistic; windows that
   match over ``span`` bytes form groups of which all but the first are repeats.
   An anchor hash whose regions alone would overfill a bucket goes through window hashes instead,
   grouped by Spark with map-side combination, which is exact as well.
4. The marks of a document are merged into removed runs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ashgrid.llm.common import RollingHash, likely, longs, mix, shuffle_width, spans_of, stored, utf8
from ashgrid.operators.ranks import running_totals

SPAN, GRAM = 100, 32
BUCKET_BYTES = 1 << 20     # bytes of regions indexed together
CHUNK = 1 << 18            # bytes of text whose hashes a task holds at once


def sliding_argmin(hashes: np.ndarray, width: int) -> np.ndarray:
    """Index of the first smallest of every ``width`` consecutive hashes (their upper 33 bits count).

    Hash and index share one number, so doubling passes of plain minima do it."""
    low = np.uint64((1 << 31) - 1)
    val = hashes & ~low
    val |= np.arange(len(hashes), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        val = np.minimum(val[:-step], val[step:])
        have += step
    return (val & low).astype(np.int64)


def anchors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """Regions of the rows [starts, ends) of ``raw``: (owner, first window start in the row, number of
    windows, anchor hash, hash of the region's bytes)."""
    base, stop = (int(starts[0]), int(ends[-1])) if len(starts) else (0, 0)
    data = raw[base:stop]
    s, e = starts - base, ends - base
    empty = np.empty(0, np.int64)
    if len(data) < span:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    rolling = RollingHash(data)
    grams = rolling.grams(gram)
    low = sliding_argmin(grams, span - gram + 1)          # per window start of the whole buffer
    owner = np.full(len(low), -1, np.int32)
    for k in np.flatnonzero(e - s >= span):               # windows that lie inside one row
        owner[s[k]:e[k] - span + 1] = k
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(low)])
    own = owner[first]
    live = own >= 0
    first, count, own = first[live], count[live], own[live].astype(np.int64)
    g = grams[low[first]]
    region = rolling.of(first, first + count + span - 1)
    offset = (low[first] - first).astype(np.uint64)
    return own, first - s[own], count, g, mix(region + offset * np.uint64(0x9E37) + count.astype(np.uint64))


def _dense(key: np.ndarray) -> np.ndarray:
    """Rank of each key among the distinct ones, from 0."""
    by = np.argsort(key)
    key = key[by]
    rank = np.empty(len(key), np.int32)
    if len(key):
        rank[by] = np.r_[0, np.cumsum(key[1:] != key[:-1], dtype=np.int32)]
    return rank


class RunLengthIndex:
    """Run-length compressed Burrows-Wheeler transform of a list of byte strings, with samples at the
    heads of its runs.

    The strings are kept apart (every one ends in its own terminator); ``depth`` is at least the
    longest.  ``runs`` are the run heads in suffix order, ``symbols`` their letters (-1 at the start
    of a string); ``sample_at``, ``sample_prev`` and ``sample_len`` hold, by text position, the
    position of a run head, the position before it in suffix order and their common prefix length.
    Between samples all three continue by one letter per step, so ``matching()`` needs no more."""

    def __init__(self, strings: list[np.ndarray]):
        size = np.array([len(x) for x in strings], np.int64)
        self.begin = np.r_[0, np.cumsum(size)]
        n = int(self.begin[-1])
        text = np.concatenate(strings) if n else np.empty(0, np.uint8)
        self.piece = np.repeat(np.arange(len(strings), dtype=np.int32), size)
        left = (np.repeat(self.begin[1:], size) - np.arange(n)).astype(np.int32)
        packed = np.zeros(n, np.uint64)
        for k in range(8):  # eight letters at once, padded beyond the string's end
            packed <<= np.uint64(8)
            inside = np.flatnonzero(left > k)
            packed[inside] |= text[inside + k]
        levels, rank, h = [], _dense(packed), 8
        depth = int(size.max(initial=0))
        while True:
            levels.append((h, rank))
            if h >= depth:
                break
            key = rank.astype(np.int64) << 32
            inside = np.flatnonzero(left > h)
            key[inside] |= rank[inside + h] + 1
            rank = _dense(key)
            h *= 2
        # equal suffixes: the shorter first, then by position
        order = np.argsort((rank.astype(np.int64) << 32) | left, kind="stable").astype(np.int32)
        before = np.full(n, -1, np.int16)
        inner = np.ones(n, bool)
        inner[self.begin[:-1][size > 0]] = False
        inner = np.flatnonzero(inner)
        before[inner] = text[inner - 1]
        bwt = before[order]
        head = np.ones(n, bool)
        head[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] < 0)
        self.order, self.left = order, left
        self.runs = np.flatnonzero(head)
        self.symbols = bwt[self.runs]
        at = order[self.runs].astype(np.int64)
        prev = np.where(self.runs > 0, order[self.runs - 1], -1).astype(np.int64)
        length = self._common(packed, levels, at, prev)
        by = np.argsort(at)
        self.sample_at, self.sample_prev, self.sample_len = at[by], prev[by], length[by]

    def _common(self, packed, levels, a, b):
        """Common prefix length of the suffixes at ``a`` and ``b`` (0 where b is -1)."""
        off = np.zeros(len(a), np.int64)
        most = np.where(b >= 0, np.minimum(self.left[a], self.left[b]), 0)
        for h, rank in reversed(levels):
            ok = np.flatnonzero(off + h <= most)
            same = rank[a[ok] + off[ok]] == rank[b[ok] + off[ok]]
            off[ok[same]] += h
        rest = np.flatnonzero(off < most)
        x = packed[a[rest] + off[rest]] ^ packed[b[rest] + off[rest]]
        equal = np.full(len(rest), 8, np.int64)
        for k in range(8):
            byte = (x >> np.uint64(56 - 8 * k)) & np.uint64(255)
            equal = np.where((equal == 8) & (byte != 0), k, equal)
        off[rest] += equal
        return np.minimum(off, most)

    def matching(self) -> np.ndarray:
        """Per text position the length of its longest match with the suffix before it in suffix
        order, streamed from the samples."""
        n = len(self.order)
        if not n:
            return np.empty(0, np.int64)
        step = np.diff(np.r_[self.sample_at, n])  # positions that follow each sample
        return np.maximum(np.repeat(self.sample_len + self.sample_at, step) - np.arange(n), 0)

    def repeats(self, span: int) -> np.ndarray:
        """Text positions (ascending) whose ``span`` letters also occur at a smaller position."""
        stat = self.matching()[self.order]
        if not len(stat):
            return np.empty(0, np.int64)
        lead = stat < span
        start = np.flatnonzero(lead)
        first = np.minimum.reduceat(self.order, start)
        group = np.cumsum(lead) - 1
        return np.sort(self.order[self.order != first[group]])


def _numbered(docs: DataFrame) -> DataFrame:
    """id (doc_id as it is), doc_id (a long in the order of the ids) and text.  Whole numbers keep their value; ids of
    other types are numbered in their order, strings by their bytes."""
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return rows.withColumn("doc_id", F.col("id").cast("long"))
    ids = stored(rows.select("id").filter("id is not null").distinct().withColumn("one", F.lit(1).cast("long")))
    place = running_totals(ids, [], "id", ["one"]).select(F.col("id").alias("p_id"), F.col("one_before").alias("doc_id"))
    return rows.join(place, F.col("id") == F.col("p_id"), "left").drop("p_id")


def _order_key(docs: DataFrame) -> DataFrame:
    """d (doc_id as a long, null first), key (64-bit hash of the text) and text."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"),
                       F.xxhash64(text).alias("key"), text.alias("text"))


def _region_batches(batches, span: int, gram: int, flush: int):
    """Arrow batches (d, key, text) -> (g, rh, d, key, at); see ``region_rows``."""
    met: dict[bytes, int] = {}
    held, n = [], 0

    def out():
        g, rh, d, key, start, count = (np.concatenate(c) for c in zip(*held))
        by = np.lexsort((start, key, d, rh, g))
        seen = np.zeros(len(g), bool)
        seen[by[1:]] = (g[by[1:]] == g[by[:-1]]) & (rh[by[1:]] == rh[by[:-1]])
        apart = mix(g + mix(d.view(np.uint64) + mix(key.view(np.uint64) + start.astype(np.uint64))))
        # rows stay in the order of the texts, so d and key repeat from row to row and compress
        return pa.RecordBatch.from_arrays(
            [longs(np.where(seen, apart, g)), longs(rh), pa.array(d, pa.int64()), pa.array(key, pa.int64()),
             pa.array((seen.astype(np.int64) << 62) | (count << 31) | start, pa.int64())],
            ["g", "rh", "d", "key", "at"])

    for b in batches:
        raw, starts, ends = utf8(b.column(2))
        d = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        key = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        use = []
        for k in np.flatnonzero(ends - starts >= span):
            name = hashlib.md5(raw[starts[k]:ends[k]], usedforsecurity=False).digest()
            if name not in met or d[k] < met[name]:
                met[name] = int(d[k])
                use.append(k)
        use = np.array(use, np.int64)
        for i, j in spans_of(starts[use], ends[use], CHUNK):
            rows = use[i:j]
            own, start, count, g, rh = anchors(raw, starts[rows], ends[rows], span, gram)
            held.append((g, rh, d[rows][own], key[rows][own], start, count))
            n += len(g)
            if n >= flush:
                yield out()
                held, n = [], 0
    if held:
        yield out()


def region_rows(docs: DataFrame, span: int = SPAN, gram: int = GRAM, flush: int = 1 << 17) -> DataFrame:
    """g, rh, d, key, at: one row per region.  ``at`` packs (seen, windows, first start); ``seen``
    marks regions for which this task has an earlier equal one among the last ``flush`` regions, so
    frequent regions are combined before the shuffle (they get a hash of their own to travel
    with).  A text that the task has met under a smaller or equal doc_id is left out (see
    ``copies``)."""
    return _order_key(docs).select("d", "key", "text").mapInArrow(
        lambda batches: _region_batches(batches, span, gram, flush), "g long, rh long, d long, key long, at long")


# 31 bits each for the start and the number of windows, as texts are shorter than 2 GB
_START, _COUNT, _SEEN = "cast(at & 2147483647 as int)", "cast((at >> 31) & 2147483647 as int)", "(at >> 62) = 1"


def candidate_regions(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """g, d, key, start, count, whole: regions that are repeats as a whole (``whole``), and the first
    region of each kind where an anchor hash has several kinds (not ``whole``)."""
    rows = region_rows(docs, span, gram).repartition("g")
    rank = F.rank().over(Window.partitionBy("g", "rh")  # equal for repeated rows of one document
                         .orderBy("d", "key", F.expr(_START)))
    of_g = Window.partitionBy("g")
    met = rows.withColumn("rank", rank).withColumn("lo", F.min("rh").over(of_g)).withColumn("hi", F.max("rh").over(of_g))
    whole = F.expr(_SEEN) | (F.col("rank") > 1)
    return met.filter(whole | (F.col("lo") < F.col("hi"))).select(
        "g", "d", "key", F.expr(_START).alias("start"), F.expr(_COUNT).alias("count"), whole.alias("whole"))


def region_bytes(docs: DataFrame, regions: DataFrame, span: int = SPAN) -> DataFrame:
    """g, d, key, start, many, bytes: the regions' bytes, cut from the texts."""
    per = regions.groupBy(F.col("d").alias("r_d"), F.col("key").alias("r_key")).agg(
        F.collect_list(F.struct("g", "start", "count", "many")).alias("regions"))
    t = likely(_order_key(docs), "key", regions, "key", 1 << 26)  # texts without such regions stay where they are
    met = t.join(per, (t["d"] == per["r_d"]) & (t["key"] == per["r_key"])).select("d", "key", "text", "regions")

    def cut(batches):
        for b in batches:
            raw, starts, ends = utf8(b.column(2))
            d, key = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k in range(b.num_rows):
                r = b.column(3)[k].values
                g, s, c, m = (r.field(x).to_numpy(zero_copy_only=False) for x in range(4))
                base = int(starts[k])
                size = int(ends[k]) - base
                ok = s + c + span - 1 <= size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[ok], pa.int64()), pa.array(np.full(ok.sum(), d[k]), pa.int64()),
                     pa.array(np.full(ok.sum(), key[k]), pa.int64()), pa.array(s[ok], pa.int32()), pa.array(m[ok].astype(bool)),
                     pa.array([raw[base + x:base + x + y + span - 1].tobytes() for x, y in zip(s[ok], c[ok])], pa.binary())],
                    ["g", "d", "key", "start", "many", "bytes"])

    rows = met.mapInArrow(cut, "g long, d long, key long, start int, many boolean, bytes binary")
    return rows.dropDuplicates(["d", "key", "start"])  # repeated rows are one document


def _indexed(pieces: DataFrame, buckets: int, span: int) -> DataFrame:
    """d, key, start, count: runs of repeated windows among regions, found by one index per bucket."""
    def index(t: pa.Table) -> pa.Table:
        d, key, start = (t.column(c).to_numpy().astype(np.int64) for c in ("d", "key", "start"))
        by = np.lexsort((start, key, d))
        raw, s, e = utf8(t.column("bytes"))
        idx = RunLengthIndex([raw[s[k]:e[k]] for k in by])
        hit = idx.repeats(span)
        hit = hit[idx.left[hit] >= span]
        own = idx.piece[hit]
        off = hit - idx.begin[own]
        new = np.ones(len(hit), bool)
        new[1:] = (own[1:] != own[:-1]) | (off[1:] != off[:-1] + 1)
        at = np.flatnonzero(new)
        row = by[own[at]]
        return pa.table({"d": pa.array(d[row], pa.int64()), "key": pa.array(key[row], pa.int64()),
                         "start": pa.array(start[row] + off[at], pa.int32()),
                         "count": pa.array(np.diff(np.r_[at, len(hit)]), pa.int32())})

    return (pieces.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets)))
            .select("bucket", "d", "key", "start", "bytes").groupBy("bucket")
            .applyInArrow(index, "d long, key long, start int, count int"))


def _hashed(pieces: DataFrame, span: int) -> DataFrame:
    """The same by window hashes, for anchor hashes whose regions do not fit a bucket."""
    def windows(batches):
        for b in batches:
            raw, s, e = utf8(b.column(4))
            for k in range(b.num_rows):
                n = int(e[k] - s[k]) - span + 1
                at = np.arange(n)
                h = RollingHash(raw[s[k]:e[k]]).of(at, at + span)
                yield pa.RecordBatch.from_arrays(
                    [longs(h), pa.array(np.full(n, b.column(1)[k].as_py()), pa.int64()),
                     pa.array(np.full(n, b.column(2)[k].as_py()), pa.int64()), pa.array(b.column(3)[k].as_py() + at, pa.int32())],
                    ["h", "d", "key", "start"])

    rows = stored(pieces.select("g", "d", "key", "start", "bytes").mapInArrow(windows, "h long, d long, key long, start int"))
    # the earliest occurrence of a window: the smallest document by a plain minimum, which combines before
    # the shuffle, then the smallest (key, start) in it
    d0 = rows.groupBy("h").agg(F.min("d").alias("d0"), F.count("*").alias("n")).filter("n > 1").drop("n")
    at_d0 = rows.join(d0, "h")
    p0 = at_d0.filter("d = d0").groupBy("h").agg(F.min(F.struct("key", "start")).alias("p0"))
    late = at_d0.join(p0, "h").filter((F.col("d") > F.col("d0")) | (F.struct("key", "start") > F.col("p0")))
    return late.select("d", "key", "start", F.lit(1).alias("count"))


def copies(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """d, key, start, count marking whole documents whose text an earlier document has."""
    t = _order_key(docs)
    slim = t.select("d", "key", F.octet_length("text").alias("n"), F.xxhash64("text").alias("h1"),
                    F.xxhash64(F.lit("second"), "text").alias("h2")).filter(F.col("n") >= span)
    first = slim.groupBy("h1", "h2", "n").agg(F.min("d").alias("d0"), F.max("d").alias("d1")).filter("d0 < d1").drop("d1")
    return slim.join(first, ["h1", "h2", "n"]).filter("d > d0").select(
        "d", "key", F.lit(0).alias("start"), (F.col("n") - (span - 1)).alias("count"))


def repeat_marks(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """d, key, start, count: every window of ``span`` bytes that also starts earlier, in runs."""
    found = stored(candidate_regions(docs, span, gram))
    cols = ["d", "key", "start", "count"]
    open_ = found.filter(~F.col("whole"))
    kinds = open_.groupBy("g").agg(F.sum(F.col("count") + span - 1).alias("size"))
    total = kinds.agg(F.sum("size")).first()[0] or 0
    many = open_.join(kinds.filter(F.col("size") > BUCKET_BYTES).select("g", F.lit(True).alias("many")), "g", "left").select(
        "g", "d", "key", "start", "count", F.coalesce("many", F.lit(False)).alias("many"))
    pieces = stored(region_bytes(docs, many, span))
    buckets = max(shuffle_width(docs.sparkSession), -(-2 * total // BUCKET_BYTES))  # half full on average
    inner = _indexed(pieces.filter(~F.col("many")), buckets, span).unionByName(_hashed(pieces.filter("many"), span))
    return found.filter("whole").select(*cols).unionByName(inner.select(*cols)).unionByName(copies(docs, span))


def _merged(start: np.ndarray, count: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of the byte ranges [start, start + count + span - 1) as maximal runs."""
    by = np.argsort(start, kind="stable")
    lo, hi = start[by], np.maximum.accumulate(start[by] + count[by] + span - 1)
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    first = np.flatnonzero(new)
    return lo[first], hi[np.r_[first[1:], len(lo)] - 1]


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and with ``with_text`` the remaining bytes
    as ``kept`` and the removed runs as ``spans``) for every row of ``docs``.

    A null text is empty.  Earlier means a smaller doc_id (null is the smallest), for rows with equal
    doc_id and different texts a smaller hash of the text, and within a text a smaller start; rows
    with equal doc_id and text are the same document and get equal results.  Ids that are no whole numbers
    are ordered as Spark sorts them.  ``span`` may be any length of ``gram`` bytes or more.  An empty
    table gives no rows; other columns are ignored."""
    if span < gram:
        raise ValueError("a span holds at least one gram")
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = _numbered(docs)
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        docs = stored(docs)
    marks = repeat_marks(docs, span, gram).groupBy(F.col("d").alias("m_d"), F.col("key").alias("m_key")).agg(
        F.collect_list(F.struct("start", "count")).alias("marks"))
    text = F.col("text").cast("string")
    base = docs.select("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"),
                       F.xxhash64(text).alias("key"), text.alias("text"))
    met = base.join(marks, (F.col("d") == F.col("m_d")) & (F.col("key") == F.col("m_key")), "left").select("id", "text", "marks")

    def finish(batches):
        for b in batches:
            raw, starts, ends = utf8(b.column(1))
            marked = b.column(2)
            n, gone, runs, sha, kept, spans = [], [], [], [], [], []
            for k in range(b.num_rows):
                body = raw[starts[k]:ends[k]]
                lo = hi = np.empty(0, np.int64)
                if marked[k].is_valid:
                    v = marked[k].values
                    lo, hi = _merged(v.field(0).to_numpy().astype(np.int64), v.field(1).to_numpy().astype(np.int64), span)
                    hi = np.minimum(hi, len(body))
                cut = np.r_[0, np.stack([lo, hi], 1).ravel(), len(body)].reshape(-1, 2)
                rest = b"".join(body[x:y].tobytes() for x, y in cut)
                n.append(len(body))
                gone.append(len(body) - len(rest))
                runs.append(len(lo))
                sha.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    kept.append(rest)
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(lo, hi)])
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols += [pa.array(kept, pa.binary()),
                         pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                names += ["kept", "spans"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_text:
        schema += ", kept binary, spans array<struct<start: bigint, end: bigint>>"
    return met.mapInArrow(finish, schema)

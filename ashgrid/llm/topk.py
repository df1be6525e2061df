"""Exact top-k inner-product search with multi-resolution segment statistics.

Each vector is cut into segments at several resolutions, coarse to fine.  With segment length L,
segment mean m and deviation norm s (root of the summed squared deviations from the mean),

    |q - x|^2  >=  sum over segments of  L (m_q - m_x)^2 + (s_q - s_x)^2,

and, as q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2, the same sums bound the inner product from above:
q.x <= sum of L m_q m_x + s_q s_x.  Candidates are dropped as soon as a resolution bounds them below
the k-th best exact score known; only survivors get an exact integer score.

Queries are a stated set.  They meet all rows in blocks: rows are cut into shards of bounded size,
queries into blocks of bounded size, and every (block, shard) pair is one task-sized group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashgrid.llm.common import shuffle_width, stored

ROWS_PER_SHARD = 8192
QUERIES_PER_BLOCK = 2048
RESOLUTIONS = (1, 4, 16)


def quantised(embedding: Column) -> Column:
    """floor(256 * x) of each component; null where the vector is null or holds a null, NaN or infinity."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(embedding.isNotNull() & ~bad,
                  F.transform(embedding, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long")))


def vectors(table: DataFrame) -> DataFrame:
    """row, vec_id, v: the usable vectors, each with a number of its own.  Rows without an id or a usable vector
    take no part; equal vectors of one id are one row, different ones stay apart."""
    return (table.select("vec_id", quantised(F.col("embedding")).alias("v"))
            .filter(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).distinct()
            .select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"))


def _matrix(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per dimension: row numbers, ids (ascending) and the integer matrix."""
    ids, number = (t.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "row"))
    col = t.column("v").combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    size = np.asarray(col.value_lengths()).astype(np.int64)
    flat = col.flatten().to_numpy().astype(np.int64)
    at = np.r_[0, np.cumsum(size)]
    out = {}
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        x = flat[(at[rows][:, None] + np.arange(d)[None, :])] if d else np.zeros((len(rows), 0), np.int64)
        out[int(d)] = (number[rows], ids[rows], x)
    return out


def summaries(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows [sqrt(L) m | s] over ``parts`` segments; the inner product of two rows bounds q.x."""
    cut = np.linspace(0, x.shape[1], min(parts, max(x.shape[1], 1)) + 1).astype(int)
    cols = []
    for a, b in zip(cut[:-1], cut[1:]):
        seg = x[:, a:b].astype(np.float64)
        m = seg.mean(1) if b > a else np.zeros(len(x))
        cols.append((np.sqrt(b - a) * m, np.sqrt(np.maximum(((seg - m[:, None]) ** 2).sum(1), 0))))
    return np.stack([c[0] for c in cols] + [c[1] for c in cols], 1)


def _exact(q: np.ndarray, x: np.ndarray, large: bool) -> np.ndarray:
    if large:  # beyond 2**53 a double no longer holds every integer
        return np.array([sum(int(a) * int(b) for a, b in zip(q, r)) for r in x], dtype=object)
    return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)


def search(q_rows, q_ids, q, c_ids, c, k: int, resolutions=RESOLUTIONS):
    """(query row, vec_id, score) of the k best candidates of another id per query; ties go to the smaller
    vec_id.  ``c_ids`` must ascend."""
    top = float(max(np.abs(q).max(initial=0), np.abs(c).max(initial=0)))
    large = top * top * max(c.shape[1], 1) >= 2.0 ** 53
    qs = [summaries(q, p) for p in resolutions]
    cs = [summaries(c, p) for p in resolutions]
    slack = 1.0 + 1e-9 * float(np.linalg.norm(q.astype(float), axis=1).max(initial=0)
                               * np.linalg.norm(c.astype(float), axis=1).max(initial=0))
    found = []
    for lo in range(0, len(q), 256):
        bound = qs[0][lo:lo + 256] @ cs[0].T
        for i in range(len(bound)):
            n, ub = lo + i, bound[i]
            ub[np.searchsorted(c_ids, q_ids[n], "left"):np.searchsorted(c_ids, q_ids[n], "right")] = -np.inf
            alive = np.flatnonzero(ub > -np.inf)
            if len(alive) > k:
                seed = np.argpartition(ub, len(ub) - k)[-k:]
                seed = seed[ub[seed] > -np.inf]
                floor = min(_exact(q[n], c[seed], large)) - slack if len(seed) == k else -np.inf
                alive = alive[ub[alive] >= floor]
                for level in range(1, len(resolutions)):
                    alive = alive[cs[level][alive] @ qs[level][n] >= floor]
            score = _exact(q[n], c[alive], large)
            best = np.lexsort((c_ids[alive], -score))[:k] if not large else np.array(
                sorted(range(len(alive)), key=lambda j: (-score[j], c_ids[alive[j]]))[:k], int)
            found.append((np.full(len(best), q_rows[n]), c_ids[alive][best], score[best]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def top_k(table: DataFrame, is_query: Column, k: int = 5, rows_per_shard: int = ROWS_PER_SHARD,
          queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each usable row that satisfies ``is_query`` (a condition on
    vec_id) its k best other rows by integer inner product, all if fewer; ties to the smaller vec_id.

    Different vectors under one id are rows of their own, each a query (with that query_id) and a candidate
    of the other ids.  Vectors of different length are never compared.  An empty table, or one without queries, gives
    no rows.  Rows are copied once per query block and queries once per row shard, so the work is
    queries x rows (the contract of an exact search) but every group is of bounded size."""
    spark = table.sparkSession
    rows = stored(vectors(table))
    n = rows.count()
    asked = rows.filter(is_query)
    blocks = max(1, -(-asked.count() // queries_per_block))
    shards = max(2 * shuffle_width(spark), -(-n // rows_per_shard))
    pick = lambda tag, m: F.pmod(F.xxhash64(F.lit(tag), "row"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    q = asked.select("row", "vec_id", "v", pick("block", blocks).alias("block"), every(shards).alias("shard"))
    c = rows.select("row", "vec_id", "v", pick("shard", shards).alias("shard"), every(blocks).alias("block"))

    def pair(qt: pa.Table, ct: pa.Table) -> pa.Table:
        left, right = _matrix(qt), _matrix(ct)
        got = [search(*left[d], *right[d][1:], k) for d in left if d in right]
        cols = [np.concatenate([g[i] for g in got]) if got else np.empty(0, np.int64) for i in range(3)]
        return pa.table([pa.array([int(x) for x in col] if col.dtype == object else col.astype(np.int64), pa.int64())
                         for col in cols], names=["row", "vec_id", "score"])

    local = q.groupBy("block", "shard").cogroup(c.groupBy("block", "shard")).applyInArrow(
        pair, "row long, vec_id long, score long")
    # the k best of a query's shards: sorted lists of at most shards x k short rows
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "vec_id", "score"))), 1, k)
    named = asked.select("row", F.col("vec_id").cast("long").alias("query_id"))
    return (local.groupBy("row").agg(best.alias("best")).join(named, "row")
            .select("query_id", F.posexplode("best").alias("at", "hit"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"),
                    F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")))

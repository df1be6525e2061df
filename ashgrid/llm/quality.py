"""Quality classifier: random Fourier features over document statistics, ridge scores from
partition-summed normal equations, isotonic calibration.

1. ``document_stats``: per document a short vector of character, word and line statistics,
   computed on the bytes of whole Arrow batches.
2. Labelled rows (joined on doc_id) are standardised and mapped to cos(W x + b), which
   approximates a Gaussian kernel; every partition sums Z'Z and Z'y, the driver adds the
   partials (a bounded number of bounded matrices) and solves the ridge system.
3. A disjoint part of the labelled rows is binned by raw score; pooling adjacent violators over
   the bins gives the monotone map from raw score to probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashgrid.llm.common import RollingHash, spans_of, stored, utf8

MAX_TRAIN_ROWS = 200_000
PARTS = 16
CHUNK = 1 << 18  # bytes of text whose statistics a task works out at once; a statistic looks at one text only
CLASSES = ["lower", "upper", "digit", "blank", "newline", "stop", "comma", "bang", "pipe", "symbol", "quote",
           "bracket", "dash", "other", "lead", "tail"]
STATS = [*(c for c in CLASSES), "log_chars", "log_words", "word_len", "long_words", "caps_words", "symbol_words",
         "log_lines", "line_len", "distinct_words", "distinct_lines", "symbol_runs"]


def _class_table() -> np.ndarray:
    t = np.full(256, CLASSES.index("other"), np.uint8)
    t[0x80:0xC0], t[0xC0:] = CLASSES.index("tail"), CLASSES.index("lead")
    t[ord("a"):ord("z") + 1], t[ord("A"):ord("Z") + 1] = CLASSES.index("lower"), CLASSES.index("upper")
    t[ord("0"):ord("9") + 1] = CLASSES.index("digit")
    for name, chars in (("blank", " \t\r\v\f"), ("newline", "\n"), ("stop", ".?"), ("comma", ",;:"), ("bang", "!"),
                        ("pipe", "|"), ("symbol", "$#%&*@^~=+<>\\_`"), ("quote", "\"'"), ("bracket", "()[]{}/"),
                        ("dash", "-")):
        t[[ord(c) for c in chars]] = CLASSES.index(name)
    return t


CLASS_OF = _class_table()
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _distinct_share(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Share of distinct values among the keys of each owner (1 where there are none)."""
    total = np.bincount(owner, minlength=n)
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    kinds = np.bincount(o[first], minlength=n)
    return np.where(total > 0, kinds / np.maximum(total, 1), 1.0)


def _word_keys(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit key per [s, e): enough to tell words or lines apart in a statistic."""
    return RollingHash(data).of(s, e)


def _stats(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """STATS of the rows [starts, ends) of ``data`` (one contiguous run of bytes)."""
    n, base = len(starts), int(starts[0])
    data = data[base:int(ends.max(initial=base))]
    starts, ends = starts - base, ends - base
    size = ends - starts
    owner = np.repeat(np.arange(n), size)
    inside = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends)]) if size.sum() != len(data) else slice(None)
    cls = CLASS_OF[data[inside]]
    d = data[inside]
    c = np.bincount(owner * len(CLASSES) + cls, minlength=n * len(CLASSES)).reshape(n, -1).astype(np.float64)
    chars = c.sum(1) - c[:, CLASSES.index("tail")]
    total = np.maximum(chars, 1)
    space = _SPACE[d]
    edge = np.ones(len(d), bool)
    edge[1:] = owner[1:] != owner[:-1]
    head = np.flatnonzero(~space & (edge | np.r_[True, space[:-1]]))
    last = np.r_[edge[1:], True]
    tail = np.flatnonzero(~space & (last | np.r_[space[1:], True])) + 1
    w_owner = owner[head]
    words = np.bincount(w_owner, minlength=n)
    w = np.maximum(words, 1)
    length = tail - head
    upper = np.r_[0, np.cumsum(cls == CLASSES.index("upper"))]
    odd = np.r_[0, np.cumsum(np.isin(cls, [CLASSES.index(x) for x in ("symbol", "bang", "pipe")]))]
    sums = lambda m: np.bincount(w_owner, weights=m.astype(np.float64), minlength=n)
    is_nl = np.flatnonzero(d == 10)
    doc_head = np.flatnonzero(edge)
    l_start = np.unique(np.r_[doc_head, np.minimum(is_nl + 1, max(len(d) - 1, 0))]) if len(d) else np.empty(0, int)
    l_end = np.r_[l_start[1:], len(d)] if len(d) else l_start
    l_owner = owner[l_start] if len(d) else np.empty(0, int)
    lines = np.maximum(np.bincount(l_owner, minlength=n), 1)
    run = np.isin(cls, [CLASSES.index("symbol"), CLASSES.index("bang")])
    runs = np.bincount(owner[1:][run[1:] & run[:-1] & ~edge[1:]], minlength=n) if len(d) > 1 else np.zeros(n)
    cols = [c[:, i] / total for i in range(len(CLASSES))]
    cols += [np.log1p(chars), np.log1p(words), sums(length) / w, sums(length > 14) / w,
             sums(upper[tail] - upper[head] > np.maximum(1, length // 2)) / w, sums(odd[tail] - odd[head] > 0) / w,
             np.log1p(lines), np.log1p(total / lines),
             _distinct_share(_word_keys(d, head, tail), w_owner, n),
             _distinct_share(_word_keys(d, l_start, l_end), l_owner, n), runs / total]
    return np.nan_to_num(np.stack(cols, 1))


def stats_of(text: pa.Array, chunk: int = CHUNK) -> np.ndarray:
    raw, starts, ends = utf8(text)
    out = [_stats(raw, starts[i:j], ends[i:j]) for i, j in spans_of(starts, ends, chunk)]
    return np.concatenate(out) if out else np.empty((0, len(STATS)))


def _stats_batches(batches):
    for b in batches:
        x = stats_of(b.column(1)).astype(np.float32)
        flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(STATS)).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([b.column(0), flat], ["doc_id", "stats"])


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id, stats (array of ``len(STATS)`` floats) of every whole text; null counts as empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_stats_batches, f"doc_id {kind}, stats array<float>")


@dataclass
class Model:
    """Everything a score needs; a few hundred kilobytes, whatever the corpus."""
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    knots: np.ndarray   # raw scores, ascending
    levels: np.ndarray  # calibrated probabilities, non-decreasing

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0)
        return np.clip(np.interp(self.features(x) @ self.beta, self.knots, self.levels), 0.0, 1.0)


def _vectors(batch) -> np.ndarray:
    col = batch.column("stats")
    return col.flatten().to_numpy().astype(np.float64).reshape(len(col), len(STATS))


def _summed(rows: DataFrame, of) -> list[np.ndarray]:
    """``of(stats, quality)`` -> tuple of arrays, summed over every partition and then over the
    at most PARTS partials that reach the driver (half a megabyte each), however many partitions
    ``rows`` was dealt to."""
    def part(batches):
        acc = None
        for b in batches:
            got = of(_vectors(b), b.column("quality").to_numpy(zero_copy_only=False).astype(np.float64))
            acc = got if acc is None else [x + y for x, y in zip(acc, got)]
        if acc is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.ascontiguousarray(a, np.float64).tobytes()], pa.binary()) for a in acc],
                [f"a{i}" for i in range(len(acc))])
    shapes = [np.shape(a) for a in of(np.zeros((1, len(STATS))), np.zeros(1))]
    schema = ", ".join(f"a{i} binary" for i in range(len(shapes)))
    total = [np.zeros(s) for s in shapes]
    for r in rows.coalesce(PARTS).mapInArrow(part, schema).collect():
        total = [t + np.frombuffer(r[i], np.float64).reshape(t.shape) for i, t in enumerate(total)]
    return total


def pool_adjacent(hits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Isotonic (non-decreasing) fit of hits / sizes by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for h, s in zip(hits, sizes):
        blocks.append([h, s, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            h2, s2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + h2, blocks[-1][1] + s2, blocks[-1][2] + n2]
    return np.repeat([h / s for h, s, _ in blocks], [int(n) for _, _, n in blocks])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, features: int = 256, width: float = 6.0, ridge: float = 1e-3,
        max_train_rows: int = MAX_TRAIN_ROWS, bins: int = 400, seed: int = 11) -> Model:
    """Model from ``stats`` (doc_id, stats) and ``labels`` (doc_id, quality).

    Only rows that are not held out train.  At most about ``max_train_rows`` of them are used
    (chosen by a hash of doc_id); a fifth of those calibrates, the rest fits.  A doc_id labelled
    more than once counts by the mean of its labels; null labels are ignored.  Without labelled
    rows, or with labels of one kind only, every score is their mean (0.5 without any)."""
    lab = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.avg(F.col("quality").cast("double")).alias("quality"))
    lab = lab.filter(~held_out(F.col("doc_id")))
    share = min(1.0, max_train_rows / max(1, lab.count()))
    lab = lab.filter(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = stored(stats.join(lab, "doc_id").select("doc_id", "stats", "quality")
                  .withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(5)))
                  .repartition(PARTS, F.xxhash64(F.lit("spread"), "doc_id")))
    train, calib = rows.filter("part > 0"), rows.filter("part = 0")
    n, pos, s1, s2 = _summed(train, lambda x, y: [np.array(float(len(y))), np.array(y.sum()), x.sum(0), (x * x).sum(0)])
    d = len(STATS)
    rng = np.random.default_rng(seed)
    mean = s1 / max(n, 1)
    scale = np.sqrt(np.maximum(s2 / max(n, 1) - mean * mean, 0))
    scale[scale < 1e-9] = 1.0
    m = Model(mean, scale, rng.normal(size=(d, features)) / width, rng.uniform(0, 2 * np.pi, features),
              np.zeros(features + 1), np.array([0.0]), np.array([float(pos / n) if n else 0.5]))
    if n == 0 or pos <= 0 or pos >= n:
        return m
    weight = np.array([n / (2 * (n - pos)), n / (2 * pos)])  # both classes weigh the same in the fit

    def normal(x, y):
        z = m.features(x)
        zw = z * (weight[0] + (weight[1] - weight[0]) * y)[:, None]
        return [z.T @ zw, zw.T @ y]

    a, r = _summed(train, normal)
    m.beta = np.linalg.solve(a + ridge * n * np.diag(np.r_[np.ones(features), 1e-6]) / features, r)
    edges = np.linspace(-0.5, 1.5, bins + 1)

    def binned(x, y):
        at = np.clip(np.searchsorted(edges, m.features(x) @ m.beta, "right") - 1, 0, bins - 1)
        return [np.bincount(at, minlength=bins).astype(float), np.bincount(at, weights=y, minlength=bins)]

    size, hits = _summed(calib, binned)
    if size.sum() == 0:
        size, hits = _summed(train, binned)
    used = size > 0
    mid = ((edges[:-1] + edges[1:]) / 2)[used]
    m.knots, m.levels = mid, pool_adjacent(hits[used], size[used])
    return m


def scorer(model: Model):
    """Column function text -> score of the model (a null text scores as an empty one)."""
    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(model.score(stats_of(text)), pa.float64())
    return score


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fit_options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Statistics are computed once, stored (a hundred bytes per document) and used for both the
    fit and the scores.  Repeated rows are scored alike; an empty table gives no rows."""
    stats = stored(document_stats(docs))
    model = fit(stats, labels, **fit_options)

    def scored(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_vectors(b)), pa.float64())],
                                             ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = stats.mapInArrow(scored, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fit_options) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns.  Only the
    short statistics are shuffled; the filter itself moves no text."""
    model = fit(document_stats(docs), labels, **fit_options)
    return docs.filter(scorer(model)(F.col("text").cast("string")) >= threshold)

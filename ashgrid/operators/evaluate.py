"""Evaluation of per-pixel fire predictions.

Input: a prediction table with a 0/1 label, a score (probability or logit) and optional
group keys (fold, fire).  Every metric is one aggregation; the rank-based ones (average
precision, Lovasz hinge) use bucketed running totals, never a single-partition window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ashgrid.operators.ranks import cumulative_by_value

__all__ = ["confusion", "binary_metrics", "average_precision", "pr_curve", "bce", "focal",
           "dice", "jaccard", "lovasz_hinge", "metrics_by_group", "focal_alpha", "softplus"]


def _pred(score: str, threshold: float) -> Column:
    return (F.col(score) > threshold).cast("int")


def confusion(df: DataFrame, keys: Sequence[str] = (), label: str = "y", score: str = "score",
              threshold: float = 0.5) -> DataFrame:
    """TP / FP / FN / TN with prediction ``score > threshold``."""
    p, y = _pred(score, threshold), F.col(label)
    return df.groupBy(*keys).agg(
        F.count_if((p == 1) & (y == 1)).alias("tp"), F.count_if((p == 1) & (y == 0)).alias("fp"),
        F.count_if((p == 0) & (y == 1)).alias("fn"), F.count_if((p == 0) & (y == 0)).alias("tn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary_metrics(conf: DataFrame) -> DataFrame:
    """Precision, recall, F1 and IoU from confusion counts (0 when undefined)."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return conf.select("*", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
                       _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(tp, tp + fp + fn).alias("iou"))


def average_precision(df: DataFrame, keys: Sequence[str] = (), label: str = "y", score: str = "score",
                      buckets: int | None = None) -> DataFrame:
    """Step-wise area under the precision-recall curve over distinct scores:
    sum over thresholds (descending) of (R_k - R_{k-1}) * P_k.  Null without positives."""
    keys = list(keys)
    d = df.select(*keys, F.col(score).alias("_s"), F.col(label).cast("long").alias("_pos"),
                  (1 - F.col(label)).cast("long").alias("_neg"))
    c = cumulative_by_value(d, keys, "_s", ["_pos", "_neg"], descending=True, buckets=buckets)
    totals = d.groupBy(*keys).agg(F.sum("_pos").alias("_P"))
    c = c.join(totals, keys) if keys else c.select("*", totals.select("_P").scalar().alias("_P"))
    prec = F.col("_pos_through") / (F.col("_pos_through") + F.col("_neg_through"))
    contrib = F.try_divide(F.col("_pos").cast("double"), F.col("_P").cast("double")) * prec
    return c.groupBy(*keys).agg(F.sum(contrib).alias("average_precision"))


def pr_curve(df: DataFrame, keys: Sequence[str] = (), label: str = "y", score: str = "score",
             n_thresholds: int = 100) -> DataFrame:
    """I4: precision and recall at ``n_thresholds`` evenly spaced thresholds t in [0, 1]
    (prediction ``score >= t``); precision is 1 where nothing is predicted positive.

    Scores are binned to the largest threshold index they reach, so the suffix sums run over
    at most ``n_thresholds`` rows per key (a bounded window)."""
    keys = list(keys)
    k = n_thresholds - 1
    s = F.col(score)
    i0 = F.floor(s * k)
    i1 = F.when((i0 + 1) / k <= s, i0 + 1).when(i0 / k > s, i0 - 1).otherwise(i0)
    idx = F.when(s < 0, F.lit(-1)).otherwise(F.least(i1, F.lit(k))).cast("int")
    binned = df.groupBy(*keys, idx.alias("t_idx")).agg(
        F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    P = binned.groupBy(*keys).agg(F.sum("_p").alias("_P"))
    spark = df.sparkSession
    owners = binned.select(*keys).distinct() if keys else spark.range(1).select()
    grid = owners.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(k))).alias("t_idx"))
    g = grid.join(binned.filter(F.col("t_idx") >= 0), [*keys, "t_idx"], "left")
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(F.desc("t_idx")) \
        .rowsBetween(Window.unboundedPreceding, 0)
    g = g.select(*keys, "t_idx", F.sum(F.coalesce(F.col("_p"), F.lit(0))).over(w).alias("tp"),
                 F.sum(F.coalesce(F.col("_n"), F.lit(0))).over(w).alias("fp"))
    g = g.join(P, keys) if keys else g.select("*", P.select("_P").scalar().alias("_P"))
    tpc, fpc = F.col("tp"), F.col("fp")
    return g.select(*keys, "t_idx", (F.col("t_idx") / float(k)).alias("threshold"),
                    F.coalesce(F.try_divide(tpc.cast("double"), (tpc + fpc).cast("double")), F.lit(1.0)).alias("precision"),
                    F.coalesce(F.try_divide(tpc.cast("double"), F.col("_P").cast("double")), F.lit(0.0)).alias("recall"))


def sigmoid(c) -> Column:
    """Probability of a logit.  The metrics (I1-I4) take probabilities: raw model outputs go through
    this first.  Undefined precision is 1 in ``pr_curve`` (nothing predicted, nothing wrong) and 0 in
    ``binary_metrics``; the curve has its thresholds only, no added end point."""
    z = F.col(c) if isinstance(c, str) else c
    return 1 / (1 + F.exp(-z))


def softplus(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def bce(df: DataFrame, keys: Sequence[str] = (), label: str = "y", logit: str = "score",
        pos_weight: float | Column = 1.0) -> DataFrame:
    """Mean of pos_weight * y * -log(sigmoid(x)) + (1 - y) * -log(1 - sigmoid(x))."""
    x, y = F.col(logit), F.col(label)
    loss = pos_weight * y * softplus(-x) + (1 - y) * softplus(x)
    return df.groupBy(*keys).agg(F.avg(loss).alias("bce"))


def focal_alpha(pos_weight: float) -> float:
    """alpha from a positive-class weight w: 1 - w / (1 + w) when w > 1, else 1 - w."""
    w = pos_weight / (1 + pos_weight) if pos_weight > 1 else pos_weight
    return 1 - w


def focal(df: DataFrame, keys: Sequence[str] = (), label: str = "y", logit: str = "score",
          alpha: float = 0.25, gamma: float = 2.0) -> DataFrame:
    """Sigmoid focal loss, mean over pixels."""
    x, y = F.col(logit), F.col(label)
    p = 1 / (1 + F.exp(-x))
    ce = y * softplus(-x) + (1 - y) * softplus(x)
    p_t = p * y + (1 - p) * (1 - y)
    loss = ce * F.pow(1 - p_t, gamma)
    if alpha >= 0:
        loss = loss * (alpha * y + (1 - alpha) * (1 - y))
    return df.groupBy(*keys).agg(F.avg(loss).alias("focal"))


def _overlap(df, keys, label, logit, eps):
    p = 1 / (1 + F.exp(-F.col(logit)))
    y = F.col(label).cast("double")
    return df.groupBy(*keys).agg(F.sum(p * y).alias("_i"), F.sum(p + y).alias("_c"), F.sum(y).alias("_ys"))


def dice(df: DataFrame, keys: Sequence[str] = (), label: str = "y", logit: str = "score",
         eps: float = 1e-7) -> DataFrame:
    """1 - 2*sum(p*y) / max(sum(p + y), eps); 0 when there is no positive label."""
    a = _overlap(df, keys, label, logit, eps)
    loss = 1 - 2 * F.col("_i") / F.greatest(F.col("_c"), F.lit(eps))
    return a.select(*keys, F.when(F.col("_ys") > 0, loss).otherwise(F.lit(0.0)).alias("dice"))


def jaccard(df: DataFrame, keys: Sequence[str] = (), label: str = "y", logit: str = "score",
            eps: float = 1e-7) -> DataFrame:
    """1 - sum(p*y) / max(sum(p + y) - sum(p*y), eps); 0 when there is no positive label."""
    a = _overlap(df, keys, label, logit, eps)
    loss = 1 - F.col("_i") / F.greatest(F.col("_c") - F.col("_i"), F.lit(eps))
    return a.select(*keys, F.when(F.col("_ys") > 0, loss).otherwise(F.lit(0.0)).alias("jaccard"))


def lovasz_hinge(df: DataFrame, keys: Sequence[str] = (), label: str = "y", logit: str = "score",
                 buckets: int | None = None) -> DataFrame:
    """I8: Lovasz hinge over all pixels of each key.

    Errors e = 1 - x * (2y - 1) sorted descending; the loss is sum(relu(e_i) * g_i) with g the
    discrete gradient of the Jaccard loss along the order.  Within a group of equal errors the
    gradients telescope, so each distinct error contributes relu(e) * (J_after - J_before),
    where J = 1 - (P - pos_through) / (P + neg_through): only running totals are needed.
    """
    keys = list(keys)
    y = F.col(label).cast("long")
    d = df.select(*keys, (1 - F.col(logit) * (2 * y - 1)).alias("_e"), y.alias("_pos"), (1 - y).alias("_neg"))
    c = cumulative_by_value(d, keys, "_e", ["_pos", "_neg"], descending=True, buckets=buckets)
    totals = d.groupBy(*keys).agg(F.sum("_pos").alias("_P"))
    c = c.join(totals, keys) if keys else c.select("*", totals.select("_P").scalar().alias("_P"))

    def jac(pos, neg):
        den = F.col("_P") + F.col(neg)
        return F.when(den == 0, F.lit(0.0)).otherwise(
            1 - F.try_divide((F.col("_P") - F.col(pos)).cast("double"), den.cast("double")))

    contrib = F.greatest(F.col("_e"), F.lit(0.0)) * (jac("_pos_through", "_neg_through") - jac("_pos_before", "_neg_before"))
    return c.groupBy(*keys).agg(F.sum(contrib).alias("lovasz"))


def metrics_by_group(df: DataFrame, keys: Sequence[str], label: str = "y", score: str = "score",
                     threshold: float = 0.5) -> DataFrame:
    """Confusion counts, precision, recall, F1, IoU and average precision per group (fold)."""
    m = binary_metrics(confusion(df, keys, label, score, threshold))
    ap = average_precision(df, keys, label, score)
    return m.join(ap, list(keys), "left")

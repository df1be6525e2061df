"""Registered queries for the evaluation metrics over the scored-pixel view."""

from __future__ import annotations

from ashgrid.operators import evaluate as E
from ashgrid.plans.catalog import register, rounded
from ashgrid.sources.fixtures import pred

_CONF = """select count(*) filter (where score > 0.5 and y = 1) as tp, count(*) filter (where score > 0.5 and y = 0) as fp,
  count(*) filter (where score <= 0.5 and y = 1) as fn, count(*) filter (where score <= 0.5 and y = 0) as tn"""

_RATIOS = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 6) as iou"""


@register("binary_metrics", sql=f"with c as ({_CONF} from pred) select tp, fp, fn, tn, {_RATIOS} from c")
def q_binary_metrics(spark, sf_dir):
    """Confusion counts at 0.5 and precision, recall, f1 score, IoU."""
    return rounded(E.binary_metrics(E.confusion(pred(spark, sf_dir))))


_AP = """g as (select {k} score, sum(y) as pos, sum(1 - y) as neg from pred group by {k} score),
c as (select {k} pos, sum(pos) over ({pk} order by score desc) as tp, sum(neg) over ({pk} order by score desc) as fp from g),
t as (select {k} sum(y) as p_total from pred group by {k2})"""


@register("average_precision", sql="with " + _AP.format(k="", pk="", k2="()") + """
select round(sum(pos / p_total * tp / (tp + fp)), 6) as average_precision from c, t""")
def q_average_precision(spark, sf_dir):
    """Average precision over distinct scores."""
    return rounded(E.average_precision(pred(spark, sf_dir)))


@register("pr_curve", sql="""
with t as (select range as t_idx, range / 99.0 as threshold from range(0, 100)),
c as (select t.t_idx, t.threshold, count(*) filter (where p.score >= t.threshold and p.y = 1) as tp,
             count(*) filter (where p.score >= t.threshold and p.y = 0) as fp from t, pred p group by 1, 2),
pt as (select sum(y) as p_total from pred)
select cast(t_idx as int) as t_idx, round(threshold, 6) as threshold,
       round(coalesce(tp / nullif(tp + fp, 0), 1.0), 6) as precision, round(coalesce(tp / nullif(p_total, 0), 0), 6) as recall
from c, pt""")
def q_pr_curve(spark, sf_dir):
    """I4: precision and recall at 100 evenly spaced thresholds."""
    return rounded(E.pr_curve(pred(spark, sf_dir)))


@register("losses", sql="""
with d as (select cast(y as double) as y, score as x, 1 / (1 + exp(-score)) as p from pred),
l as (select y, x, p,
  greatest(-x, 0) + ln(1 + exp(-abs(x))) as sp_neg, greatest(x, 0) + ln(1 + exp(-abs(x))) as sp_pos from d),
a as (select
  avg(3.0 * y * sp_neg + (1 - y) * sp_pos) as bce,
  avg((y * sp_neg + (1 - y) * sp_pos) * pow(1 - (p * y + (1 - p) * (1 - y)), 2)
      * (0.25 * y + (1 - 0.25) * (1 - y))) as focal,
  sum(p * y) as i, sum(p + y) as c, sum(y) as ys from l)
select round(bce, 6) as bce, round(focal, 6) as focal,
  round(case when ys > 0 then 1 - 2 * i / greatest(c, 1e-7) else 0 end, 6) as dice,
  round(case when ys > 0 then 1 - i / greatest(c - i, 1e-7) else 0 end, 6) as jaccard from a""")
def q_losses(spark, sf_dir):
    """Weighted BCE (pos weight 3), focal (alpha from weight 3), Dice and Jaccard on
    scores read as logits."""
    p = pred(spark, sf_dir)
    alpha = E.focal_alpha(3.0)
    b = E.bce(p, pos_weight=3.0)
    out = b.select("bce", E.focal(p, alpha=alpha).select("focal").scalar().alias("focal"),
                   E.dice(p).select("dice").scalar().alias("dice"),
                   E.jaccard(p).select("jaccard").scalar().alias("jaccard"))
    return rounded(out)


@register("lovasz_hinge", sql="""
with d as (select 1 - score * (2 * y - 1) as e, y from pred),
g as (select e, sum(y) as pos, sum(1 - y) as neg from d group by e),
c as (select e, pos, neg, sum(pos) over (order by e desc) as pt, sum(neg) over (order by e desc) as nt from g),
t as (select sum(y) as p_total from d)
select round(sum(greatest(e, 0) * ((case when p_total + nt = 0 then 0 else 1 - (p_total - pt) / (p_total + nt) end)
  - (case when p_total + nt - neg = 0 then 0 else 1 - (p_total - (pt - pos)) / (p_total + nt - neg) end))), 6) as lovasz
from c, t""")
def q_lovasz_hinge(spark, sf_dir):
    """I8: Lovasz hinge loss over all pixels."""
    return rounded(E.lovasz_hinge(pred(spark, sf_dir)))


@register("metrics_by_fold", sql="with " + _AP.format(k="grp,", pk="partition by grp", k2="grp") + f""",
ap as (select c.grp, sum(pos / p_total * tp / (tp + fp)) as average_precision from c join t on c.grp = t.grp group by 1),
m as (select grp, {_CONF.replace('select ', '')} from pred group by grp)
select m.grp, tp, fp, fn, tn, {_RATIOS}, round(ap.average_precision, 6) as average_precision
from m left join ap on m.grp = ap.grp""")
def q_metrics_by_fold(spark, sf_dir):
    """Metrics per fold (the language column plays the fold)."""
    return rounded(E.metrics_by_group(pred(spark, sf_dir), ["grp"]))

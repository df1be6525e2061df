"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per (source, language, topic) cell; the cell weights are raked until their
sums match the three target marginals; documents are then drawn with the probability of their
cell, by a hash of doc_id, so a rerun draws the same documents.  Cells, marginals and factors are
Spark tables throughout; only sums reach the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashgrid.llm.common import stored
from ashgrid.session import checkpoint_root

AXES = ("source", "lang", "topic")
NONE = "(none)"
BROADCAST_CELLS = 100_000  # cells (some 100 bytes each) up to which their table is broadcast; beyond, Spark shuffles


def content_class(text: Column) -> Column:
    """The default topic: a coarse class of the whole text.  The tables carry no topic column; any
    other column expression may be passed instead."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    share = lambda cut: (n - F.length(F.translate(t, cut, ""))) / n
    return (F.when(F.length(F.trim(t)) == 0, "empty")
            .when(share("|") > 0.02, "table")
            .when(share("0123456789") > 0.05, "records")
            .when(n < 400, "note").when(n < 4000, "article").otherwise("long form"))


def token_count(text: Column) -> Column:
    """Words separated by white space; a null or blank text has none."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(t) == 0, 0).otherwise(F.length(t) - F.length(F.translate(t, " ", "")) + 1).cast("long")


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: unlike a checkpoint it carries neither the constraints nor
    the statistics of the plan before it, which pile up over the rounds of a fit."""
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/mixing-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def axis_targets(cells: DataFrame, axis: str, shares: dict[str, float] | None, power: float) -> DataFrame:
    """(m_<axis>, goal): the target share of every value of an axis that occurs.  ``shares`` gives them per
    value (a value without one gets none, those present are scaled to add up to 1); without ``shares`` they are
    the token shares to ``power``, scaled (below 1 lifts small parts)."""
    name = f"m_{axis}"
    have = cells.groupBy(name).agg(F.sum("tokens").alias("t"))
    if shares is None:
        raw = have.select(name, F.when(F.col("t") > 0, F.pow("t", F.lit(power))).otherwise(0.0).alias("goal"))
    else:
        given = cells.sparkSession.createDataFrame([(k, max(0.0, float(v))) for k, v in shares.items()], f"{name} string, goal double")
        raw = have.join(given, name, "left").select(name, F.coalesce("goal", F.lit(0.0)).alias("goal"))
    raw = _written(raw)
    whole = raw.agg(F.sum("goal")).first()[0] or 0.0
    return raw.withColumn("goal", F.col("goal") / whole) if whole > 0 else raw


def rake(cells: DataFrame, goals: dict[str, DataFrame], tolerance: float = 1e-8, rounds: int = 50) -> DataFrame:
    """``cells`` with m_weight, whose sums along each axis equal the goals (shares of all), and m_gap, the
    largest difference from a goal that the last round met.

    Every step sums the weights of one axis, joins the sum back and is written once, so that all rounds run the
    same three small plans; of a round the driver sees two numbers.  Ends when the goals are met, or when a round
    moves no weight: where they contradict each other on the cells present, the last axis holds exactly, the rest
    are as near as the cells allow, and m_gap says how near.  ``rounds`` only stops a fit that still creeps; m_gap
    shows that too."""
    whole = cells.agg(F.sum("tokens")).first()[0] or 0.0
    now = cells.withColumn("m_weight", F.col("tokens") / whole if whole > 0 else F.lit(0.0))
    if not whole > 0:
        return now.withColumn("m_gap", F.lit(0.0))
    for axis, goal in goals.items():
        now = now.join(goal.withColumnRenamed("goal", f"goal_{axis}"), f"m_{axis}")
    now, gap = _written(now), 0.0
    for _ in range(rounds):
        step = now.withColumn("before", F.col("m_weight")).withColumn("gap", F.lit(0.0))
        for axis in goals:
            have, goal = F.col("have"), F.col(f"goal_{axis}")
            by = F.when(have > 0, goal / have).otherwise(0.0)
            sums = step.groupBy(f"m_{axis}").agg(F.sum("m_weight").alias("have"))
            step = _written(step.join(sums, f"m_{axis}").withColumn("m_weight", F.col("m_weight") * by).withColumn(
                "gap", F.greatest("gap", F.abs(have - goal))).drop("have"))
        gap, moved = step.agg(F.max("gap"), F.max(F.abs(F.col("m_weight") - F.col("before")))).first()
        now = step.drop("before", "gap")
        if gap < tolerance or moved < tolerance:
            break
    return now.drop(*[f"goal_{a}" for a in goals]).withColumn("m_gap", F.lit(float(gap)))


def probabilities(cells: DataFrame, keep: float) -> DataFrame:
    """``cells`` with m_prob, proportional to weight / tokens and at most 1, such that the expected tokens are
    ``keep`` of all.  Cells at 1 are kept whole and the rest scaled anew, so the total holds although some cells
    cannot reach their target; a cell without tokens costs nothing and stays.

    The expected tokens are a concave, piecewise linear function of the scale.  From 0 on, Newton's steps rise
    to the solution and end there; a step is one sum over the cells, of which the driver sees three numbers."""
    ratio = F.col("m_weight") / F.col("tokens")
    full = F.col("scale") * ratio >= 1
    live = cells.filter("tokens > 0 and m_weight > 0")
    whole = cells.agg(F.sum("tokens")).first()[0] or 0.0
    scale, seen = 0.0, -1
    while True:
        kept, free, n = live.withColumn("scale", F.lit(scale)).agg(
            F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(~full, F.col("m_weight"))), F.count(F.when(full, 1))).first()
        if n == seen or not free:
            break
        scale, seen = max(scale, (keep * whole - (kept or 0.0)) / free), n
    # 12 digits: a sum taken in another order draws the same documents
    prob = F.round(F.least(F.lit(scale) * ratio, F.lit(1.0)), 12)
    return cells.withColumn("m_prob", F.when(F.col("tokens") > 0, prob).otherwise(1.0))


def draw(doc_id: Column, seed: int) -> Column:
    """Uniform number in [0, 1) fixed by doc_id and seed."""
    return F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 53)) / F.lit(float(1 << 53))


def cell_table(at: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = 0.7,
               keep: float = 0.8) -> DataFrame:
    """(m_source, m_lang, m_topic, m_weight, m_gap, m_prob) for every cell of ``at`` (see ``cells_of``), a Spark
    table from start to end: source may have any number of values.

    ``targets`` maps an axis to shares per value; a missing axis gets its tempered shares.  Values
    without a share weigh nothing, and shares of values that do not occur are left out."""
    cells = _written(at.groupBy(*[f"m_{a}" for a in AXES]).agg(F.sum("m_tokens").cast("double").alias("tokens")))
    goals = {a: axis_targets(cells, a, (targets or {}).get(a), power) for a in AXES}
    return _written(probabilities(rake(cells, goals), keep).drop("tokens"))


def cells_of(docs: DataFrame, topic=content_class) -> DataFrame:
    """doc_id, the cell (m_source, m_lang, m_topic) and m_tokens of every document."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("m_source"),
                       F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("m_lang"),
                       topic(text).alias("m_topic"), token_count(text).alias("m_tokens"))


def _side(cells: DataFrame, most: int) -> DataFrame:
    return F.broadcast(cells) if cells.count() <= most else cells


def mix_documents(docs: DataFrame, topic=content_class, targets=None, power: float = 0.7, keep: float = 0.8,
                  seed: int = 17, most: int = BROADCAST_CELLS) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight (raked share of the cell), gap (largest difference of a
    marginal from its target), prob, kept per document.

    Null source or language form a value of their own, '(none)'; a null text has no tokens.  Rows
    with equal doc_id are drawn alike within a cell.  An empty table gives no rows; other columns are ignored.
    Up to ``most`` cells are broadcast, more are joined by a shuffle whose hot cells Spark splits."""
    at = stored(cells_of(docs, topic))  # a few short columns; the texts are read once
    cells = cell_table(at, targets, power, keep)
    met = at.join(_side(cells, most), [f"m_{a}" for a in AXES], "left")
    return met.select("doc_id", F.col("m_source").alias("source"), F.col("m_lang").alias("lang"),
                      F.col("m_topic").alias("topic"), F.col("m_tokens").alias("n_tokens"),
                      F.col("m_weight").alias("weight"), F.col("m_gap").alias("gap"), F.col("m_prob").alias("prob"),
                      (draw(F.col("doc_id"), seed) < F.col("m_prob")).alias("kept"))


def sample_documents(docs: DataFrame, topic=content_class, targets=None, power: float = 0.7, keep: float = 0.8,
                     seed: int = 17, most: int = BROADCAST_CELLS) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, whatever their names; null, blank and repeated rows as
    in ``mix_documents``, an empty table gives no rows."""
    cells = cell_table(cells_of(docs, topic), targets, power, keep)
    names = docs.columns
    text = F.col("d.text").cast("string")
    hit = ((F.coalesce(F.col("d.source").cast("string"), F.lit(NONE)) == F.col("c.m_source"))
           & (F.coalesce(F.col("d.lang").cast("string"), F.lit(NONE)) == F.col("c.m_lang"))
           & (topic(text) == F.col("c.m_topic")) & (draw(F.col("d.doc_id"), seed) < F.col("c.m_prob")))
    return docs.alias("d").join(_side(cells, most).alias("c"), hit, "left_semi").select(*[F.col(f"d.`{n}`") for n in names])

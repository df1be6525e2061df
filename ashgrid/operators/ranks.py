"""Running totals, average ranks and rank correlation without a single-partition window.

``rank() over (order by v)`` puts a whole group into one task.  Here the rows are sorted over all
partitions by (key, value), every partition sums its own rows, and what a partition needs from
those before it (the sums of a key, or of equal values, that lie across a boundary) is worked out
from one row per partition.  That is all the driver sees, however many rows, keys or values there are;
the bounds of the ranges stay inside Spark's range partitioning.  Equal values may be spread over
many partitions by further sort columns, so a value that a third of the rows hold is no hot spot.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ashgrid.session import cut_lineage

__all__ = ["running_totals", "average_ranks", "rank_correlation", "rank_correlation_of_groups", "cumulative_by_value"]

GROUP_ROWS = 1 << 18    # rows of a group that one task may rank at once
RANK_ROWS = 1 << 17     # rows of small groups that are ranked together
HELD_ROWS = 1 << 21     # rows of a group that one task may hold when its rows are not stored

FIRST_KEY, FIRST_TIE, LAST_TIE = 1, 2, 4   # which edge of its partition a row belongs to


def _changed(a: pa.Array) -> np.ndarray:
    """Whether each element but the first differs from the one before (null equals null, NaN equals NaN)."""
    x, y = a.slice(1), a.slice(0, len(a) - 1)
    out = np.asarray(pc.fill_null(pc.not_equal(x, y), False)) | (np.asarray(x.is_null()) != np.asarray(y.is_null()))
    if pa.types.is_floating(a.type):
        nan = [np.asarray(pc.fill_null(pc.is_nan(v), False)) for v in (x, y)]
        out &= ~(nan[0] & nan[1])
    return out


def _scan(batches, keys: list[str], value: str, sums: list[str]):
    """Sorted rows of one partition -> the rows with, per sum, the total of smaller values of the same key
    (``_before``) and of equal values (``_tied``) within the partition, the partition and the row's edges.

    A group of equal values is held until it ends, everything else streams."""
    from pyspark import TaskContext
    pid = TaskContext.get().partitionId()
    seen = {c: 0 for c in sums}          # totals of the open key so far
    last = None                          # the last finished row
    state = {"first_tie": True, "first_key": True}

    def flags(t):
        n = t.num_rows
        new_key = np.zeros(n, bool)
        for k in keys:
            new_key[1:] |= _changed(t.column(k).combine_chunks())
        new_tie = new_key.copy()
        new_tie[1:] |= _changed(t.column(value).combine_chunks())
        return new_key, new_tie

    def finish(t, new_key, new_tie, at_end):
        nonlocal last
        new_key, new_tie = new_key.copy(), new_tie.copy()
        new_tie[0] = True
        new_key[0] = last is None or any(_changed(pa.concat_arrays([last.column(k).combine_chunks(), t.column(k).slice(0, 1).combine_chunks()]))[0]
                                         for k in keys)
        starts = np.flatnonzero(new_tie)
        tie = np.cumsum(new_tie) - 1
        key_of = np.cumsum(new_key[starts])          # 0: the key that was open before
        opens = np.r_[0, np.flatnonzero(new_key[starts][1:]) + 1]
        extra = []
        for c in sums:
            w = t.column(c).to_numpy().astype(np.int64)
            total = np.add.reduceat(w, starts)
            before = np.cumsum(total) - total
            base = np.zeros(int(key_of[-1]) + 1, np.int64)
            base[key_of[opens]] = before[opens]
            before = before - base[key_of] + np.where(key_of == 0, seen[c], 0)
            seen[c] = int(before[-1] + total[-1])
            extra += [pa.array(before[tie]), pa.array(total[tie])]
        edge = np.zeros(len(tie), np.int32)
        if state["first_tie"]:
            edge[tie == 0] |= FIRST_TIE
            state["first_tie"] = False
            first_open = key_of == key_of[0]
        else:
            first_open = key_of == 0
        if state["first_key"]:
            edge[first_open[tie]] |= FIRST_KEY
            state["first_key"] = bool(first_open[-1])
        if at_end:
            edge[tie == tie[-1]] |= LAST_TIE
        last = t.slice(t.num_rows - 1, 1)
        named = list(zip(t.schema.names, t.columns)) + list(zip([f"{c}{s}" for c in sums for s in ("_before", "_tied")], extra))
        named += [("_pid", pa.array(np.full(len(tie), pid, np.int32))), ("_edge", pa.array(edge))]
        return pa.table(dict(named)).combine_chunks().to_batches()

    open_rows = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if open_rows is None else pa.concat_tables([open_rows, t])
        new_key, new_tie = flags(t)
        cut = int(np.flatnonzero(new_tie)[-1]) if new_tie.any() else 0
        if cut:
            yield from finish(t.slice(0, cut), new_key[:cut], new_tie[:cut], False)
        open_rows = t.slice(cut)
    if open_rows is not None:
        new_key, new_tie = flags(open_rows)
        yield from finish(open_rows, new_key, new_tie, True)


def _carries(edges: list, sums: list[str]) -> list[tuple]:
    """Per partition: what its first key had before it, and totals of equal values across its two boundaries."""
    out, groups, open_group, key, had = {}, [], None, None, None
    for e in edges:
        single_key, single_tie = bool(e.last_edge & FIRST_KEY), bool(e.last_edge & FIRST_TIE)
        add = had if key is not None and key == e.first.k else [0] * len(sums)
        out[e["_pid"]] = {"add": add, "first_before": None, "first_total": None, "last_total": None}
        if open_group is not None and open_group["tie"] == e.first:
            open_group["total"] = [a + b for a, b in zip(open_group["total"], e.first_tied)]
            open_group["at"].append((e["_pid"], "first"))
        elif single_tie:
            open_group = {"tie": e.first, "before": add, "total": list(e.first_tied), "at": [(e["_pid"], "first")]}
            groups.append(open_group)
        if single_tie:
            open_group["at"].append((e["_pid"], "last"))
        else:
            shift = add if single_key else [0] * len(sums)
            open_group = {"tie": e.last, "before": [b + s for b, s in zip(e.last_before, shift)], "total": list(e.last_tied),
                          "at": [(e["_pid"], "last")]}
            groups.append(open_group)
        key = e.last.k
        had = [b + t + (a if single_key else 0) for b, t, a in zip(e.last_before, e.last_tied, add)]
    for g in groups:
        if len({p for p, _ in g["at"]}) > 1:
            for p, side in g["at"]:
                out[p][f"{side}_total"] = g["total"]
                if side == "first":
                    out[p]["first_before"] = g["before"]
    return [(p, c["add"], c["first_before"], c["first_total"], c["last_total"]) for p, c in out.items()]


def running_totals(df: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str], spread: Sequence[str] = (),
                   buckets: int | None = None) -> DataFrame:
    """``df`` with, for each whole-number column c of ``sums``, ``c_before`` (the total of c over rows of the
    same keys with a smaller ``value``) and ``c_tied`` (over those with an equal one, the row included).

    ``spread`` names further columns that may deal rows of one value to several partitions; ``buckets`` sets
    the number of partitions (default: Spark's, which AQE lowers).  ``df`` should be materialised: it is
    read for the range bounds and then sorted."""
    keys, sums = list(keys), list(sums)
    order = [*keys, value, *spread]
    ranged = df.repartitionByRange(buckets, *order) if buckets else df.repartitionByRange(*order)
    schema = T.StructType([*df.schema.fields, *[T.StructField(f"{c}{s}", T.LongType()) for c in sums for s in ("_before", "_tied")],
                           T.StructField("_pid", T.IntegerType()), T.StructField("_edge", T.IntegerType())])
    local = cut_lineage(ranged.sortWithinPartitions(*order).mapInArrow(lambda b: _scan(b, keys, value, sums), schema))
    at = lambda bit: F.col("_edge").bitwiseAND(bit) > 0
    tie = F.struct(F.struct(F.lit(0).alias("_"), *keys).alias("k"), F.col(value).alias("v"))
    each = lambda s: F.array(*[F.col(f"{c}{s}") for c in sums])
    edges = local.filter(at(FIRST_TIE) | at(LAST_TIE)).groupBy("_pid").agg(
        F.any_value(F.when(at(FIRST_TIE), tie), True).alias("first"), F.any_value(F.when(at(FIRST_TIE), each("_tied")), True).alias("first_tied"),
        F.any_value(F.when(at(LAST_TIE), tie), True).alias("last"), F.any_value(F.when(at(LAST_TIE), each("_tied")), True).alias("last_tied"),
        F.any_value(F.when(at(LAST_TIE), each("_before")), True).alias("last_before"),
        F.max(F.when(at(LAST_TIE), F.col("_edge"))).alias("last_edge"))
    carried = _carries(sorted(edges.collect(), key=lambda e: e["_pid"]), sums)
    if len(carried) < 2:
        return local.drop("_pid", "_edge")
    carry = df.sparkSession.createDataFrame(carried, "_pid int, _add array<long>, _fb array<long>, _ft array<long>, _lt array<long>")
    met = local.join(carry, "_pid")
    first, lasts = at(FIRST_TIE) & F.col("_ft").isNotNull(), at(LAST_TIE) & F.col("_lt").isNotNull()
    done = {}
    for i, c in enumerate(sums):
        done[f"{c}_before"] = F.when(first, F.get("_fb", F.lit(i))).otherwise(
            F.col(f"{c}_before") + F.when(at(FIRST_KEY), F.get("_add", F.lit(i))).otherwise(0))
        done[f"{c}_tied"] = F.when(first, F.get("_ft", F.lit(i))).when(lasts, F.get("_lt", F.lit(i))).otherwise(F.col(f"{c}_tied"))
    return met.withColumns(done).select(*df.columns, *done)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, buckets: int | None = None,
                  weight: str | None = None) -> DataFrame:
    """One row per distinct (keys, value): ``n`` rows with that value, ``avg_rank`` (1-based,
    ties share the mean of their positions), ``centered`` = avg_rank - (total + 1) / 2 where ``total`` is
    the key's row count (the mean rank is exactly (total + 1) / 2), and ``total``.

    Null and NaN values are not ranked.  ``weight`` names a column of row multiplicities when the
    input is already pre-aggregated.
    """
    keys = list(keys)
    w = F.col(weight) if weight else F.lit(1)
    v = F.col(value)
    counts = cut_lineage(df.filter(v.isNotNull() & ~F.isnan(v.cast("double")))
                         .groupBy(*keys, value).agg(F.sum(w).cast("long").alias("n")))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    r = running_totals(counts, keys, value, ["n"], buckets=buckets)
    if keys:
        named = totals.select("total", *[F.col(k).alias(f"_t_{i}") for i, k in enumerate(keys)])
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_t_{i}"))
        r = r.join(named, same)
    else:
        r = r.withColumn("total", totals.scalar())
    rank = F.col("n_before") + (F.col("n") + 1) / 2.0
    return r.select(*keys, value, "n", "total", rank.alias("avg_rank"), (rank - (F.col("total") + 1) / 2.0).alias("centered"))


def rank_correlation(df: DataFrame, keys: Sequence[str], x: str, y: str, buckets: int | None = None,
                     weight: str | None = None) -> DataFrame:
    """Spearman correlation per key over rows where both x and y are present (null and NaN are not).

    Rows are first collapsed to distinct (key, x, y) pairs with a multiplicity (the sum of ``weight`` if
    given), then sorted and ranked in place by x and by y, each spread by the other: four shuffles.
    The mean of the ranks is known, (n + 1) / 2.
    Returns (keys..., spearman); null when either side is constant.
    """
    keys = list(keys)
    vx, vy = F.col(x).cast("double"), F.col(y).cast("double")
    both = df.filter(vx.isNotNull() & vy.isNotNull() & ~F.isnan(vx) & ~F.isnan(vy))
    # the collapsed pairs are read for the bounds and for the sort: materialised once in the
    # shared checkpoint folder, so the source is scanned once and lineage stays short
    count = F.sum(F.col(weight)).cast("long") if weight else F.count(F.lit(1))
    pairs = cut_lineage(both.groupBy(*keys, vx.alias("_x"), vy.alias("_y")).agg(count.alias("_w")))
    rank = F.col("_w_before") + (F.col("_w_tied") + 1) / 2.0
    r = running_totals(pairs, keys, "_x", ["_w"], ["_y"], buckets).withColumn("_rx", rank).drop("_w_before", "_w_tied")
    r = running_totals(r, keys, "_y", ["_w"], ["_x"], buckets).withColumn("_ry", rank)
    n, w = F.sum("_w"), F.col("_w")
    both_means = n * F.pow((n + 1) / 2.0, 2)
    agg = r.groupBy(*keys).agg(
        (F.sum(w * F.col("_rx") * F.col("_ry")) - both_means).alias("_sxy"), (F.sum(w * F.col("_rx") * F.col("_rx")) - both_means).alias("_sxx"),
        (F.sum(w * F.col("_ry") * F.col("_ry")) - both_means).alias("_syy"),
        ((F.min("_x") < F.max("_x")) & (F.min("_y") < F.max("_y"))).alias("_varies"))
    return agg.select(*keys, F.when(F.col("_varies"), F.try_divide(F.col("_sxy"), F.sqrt(F.col("_sxx")) * F.sqrt(F.col("_syy")))).alias("spearman"))


def _whole_groups(batches, keys: list[str], most: int | None = None):
    """Rows whose groups follow one another -> tables of whole groups with the flags of their first rows, many groups
    at a time.  Of a group of more than ``most`` rows only the first row is given, without flags, and no rows are held."""
    def starts(t):
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            new[1:] |= _changed(t.column(k).combine_chunks())
        return new

    held, n, passed = [], 0, None  # passed: a row of the group whose rows are left out
    for b in batches:
        if not b.num_rows:
            continue
        if passed is not None:
            ends = np.flatnonzero(starts(pa.concat_tables([passed, pa.Table.from_batches([b])]))[1:])
            if not len(ends):
                continue
            b, passed = b.slice(int(ends[0])), None
        held.append(b)
        n += b.num_rows
        if n >= RANK_ROWS:
            t = pa.Table.from_batches(held).combine_chunks()
            new = starts(t)
            cut = int(np.flatnonzero(new)[-1])  # the last group may go on
            if cut:
                yield t.slice(0, cut), new[:cut]
            held, n = t.slice(cut).to_batches(), n - cut
            if most is not None and n > most:
                passed = t.slice(cut, 1)
                held, n = [], 0
                yield passed, None
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, starts(t)


def _codes(v):
    """Whole numbers in the order of the values, equal ones for equal values."""
    by = np.argsort(v)
    sv = v[by]
    code = np.empty(len(v), np.int64)
    code[by] = np.cumsum(np.r_[False, sv[1:] != sv[:-1]])
    return code


def _centered_ranks(code, group, first, n):
    """Average ranks of whole numbers within groups that lie one after another, less the groups' mean rank."""
    r = int(len(code) - 1).bit_length()
    c = r + int(code.max()).bit_length()
    if c + int(group[-1]).bit_length() < 63:  # (group, code, row) are sorted as one number
        key = np.sort((group << c) | (code << r) | np.arange(len(code)))
        by, key = key & ((1 << r) - 1), key >> r
        lo = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    else:
        by = np.lexsort((code, group))
        sv, sg = code[by], group[by]
        lo = np.flatnonzero(np.r_[True, (sv[1:] != sv[:-1]) | (sg[1:] != sg[:-1])])
    hi = np.r_[lo[1:], len(code)]
    rank = np.empty(len(code))
    rank[by] = np.repeat((lo + hi - 1) / 2.0, hi - lo)  # equal values share their middle position
    return rank - np.repeat(first + (n - 1) / 2.0, n)


def _group_correlation(x, y, first):
    """Per group the sums of products of centred values (xx, yy, xy), their correlation and whether both sides vary."""
    sxy, sxx, syy = (np.add.reduceat(p, first) for p in (x * y, x * x, y * y))
    varies = (sxx > 0) & (syy > 0)
    return sxx, syy, sxy, sxy / np.where(varies, np.sqrt(sxx) * np.sqrt(syy), 1.0), varies


def _group_ranks(batches, keys: list[str]):
    """Rows (keys, _x, _y) sorted by key -> keys and Spearman correlation of every group, many groups at a time."""
    for t, new in _whole_groups(batches, keys):
        first = np.flatnonzero(new)
        group, n = np.cumsum(new) - 1, np.diff(np.r_[first, len(new)])
        x, y = (_centered_ranks(_codes(t.column(c).to_numpy()), group, first, n) for c in ("_x", "_y"))
        *_, rho, varies = _group_correlation(x, y, first)
        out = t.select(keys).take(pa.array(first)).append_column("spearman", pa.array(rho, mask=~varies))
        yield from out.combine_chunks().to_batches()


def _group_metrics(batches, keys: list[str], truth: str, est: str, places: list[str], most: int):
    """Rows whose groups follow one another -> keys and the D3 metrics of every group; of a group of more than ``most``
    rows the keys only.  The columns ``_code_...`` order truth and estimate as whole numbers."""
    for t, new in _whole_groups(batches, keys, most):
        if new is None:
            out = t.select(keys)
            for c in ("pearson", "log_pearson", "spearman", "rmse", "bias", "slope"):
                out = out.append_column(c, pa.nulls(1, pa.float64()))
            for c in ("n", "stations"):
                out = out.append_column(c, pa.nulls(1, pa.int64()))
            yield from out.combine_chunks().to_batches()
            continue
        first = np.flatnonzero(new)
        group, n = np.cumsum(new) - 1, np.diff(np.r_[first, len(new)])
        x, y = (np.asarray(t.column(c).cast(pa.float64())) for c in (truth, est))

        def centred(v, group, first, n):
            v = v - np.repeat(v[first], n)  # a constant group becomes all zeros
            return v - np.repeat(np.add.reduceat(v, first) / n, n)

        _, syy, sxy, pearson, varies = _group_correlation(centred(x, group, first, n), centred(y, group, first, n), first)
        log_pearson, log_varies = np.zeros(len(first)), np.zeros(len(first), bool)
        positive = (x > 0) & (y > 0)
        if positive.any():
            g = group[positive]
            f = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            of, m = g[f], np.diff(np.r_[f, len(g)])
            g = np.repeat(np.arange(len(f)), m)
            *_, log_pearson[of], log_varies[of] = _group_correlation(*(centred(np.log(v[positive]), g, f, m) for v in (x, y)), f)
        *_, rho, ranked = _group_correlation(*(_centered_ranks(np.asarray(t.column(f"_code_{c}")), group, first, n) for c in (truth, est)), first)
        for k in keys:  # as for groups ranked by themselves: none without a key
            ranked &= ~np.asarray(t.column(k).take(pa.array(first)).is_null())
        off = x - y
        out = t.select(keys).take(pa.array(first))
        varies_y = syy > 0
        for c, v, known in (("pearson", pearson, varies), ("log_pearson", log_pearson, log_varies), ("spearman", rho, ranked),
                            ("rmse", np.sqrt(np.add.reduceat(off * off, first) / n), True), ("bias", np.add.reduceat(off, first) / n, True),
                            ("slope", sxy / np.where(varies_y, syy, 1.0), varies_y)):
            out = out.append_column(c, pa.array(v, mask=np.broadcast_to(~np.asarray(known), len(first))))
        # places: runs of rows of one place are told apart first, so rows that come place by place leave few
        at = [np.where(np.isnan(p), np.nan, p + 0.0).view(np.int64) for p in (np.asarray(t.column(c).cast(pa.float64())) for c in places)]
        run = np.flatnonzero(new | np.r_[True, np.any([p[1:] != p[:-1] for p in at], axis=0)])
        runs = [group[run], *(p[run] for p in at)]
        by = np.lexsort(runs[::-1])
        fresh = np.r_[True, np.any([r[by][1:] != r[by][:-1] for r in runs], axis=0)]
        stations = np.bincount(runs[0][by][fresh], minlength=len(first))
        out = out.append_column("n", pa.array(n, pa.int64())).append_column("stations", pa.array(stations, pa.int64()))
        yield from out.combine_chunks().to_batches()


def rank_correlation_of_groups(df: DataFrame, keys: Sequence[str], x: str, y: str, sizes: DataFrame, size: str = "n",
                               buckets: int | None = None, most: int = GROUP_ROWS) -> DataFrame:
    """D5 for many groups (fires, stations): as ``rank_correlation``, with one shuffle for all groups of at most ``most`` rows.

    ``sizes`` holds every key's row count (``size``), or more.  Larger groups are ranked by ``rank_correlation``,
    spread over all tasks; there are at most the rows over ``most`` of them.  Groups with a null in their key
    are left out."""
    keys = list(keys)
    vx, vy = F.col(x).cast("double"), F.col(y).cast("double")
    both = df.select(*keys, vx.alias("_x"), vy.alias("_y")).dropna(subset=keys)
    both = both.filter(F.col("_x").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_x") & ~F.isnan("_y"))
    large = cut_lineage(sizes.filter(F.col(size) > most).select(*keys).dropna())
    none = large.isEmpty()
    small = both if none else both.join(F.broadcast(large), keys, "left_anti")
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("spearman", T.DoubleType())])
    done = small.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda b: _group_ranks(b, keys), schema)
    if none:
        return done
    return done.unionByName(rank_correlation(both.join(F.broadcast(large), keys, "left_semi"), keys, "_x", "_y", buckets))


def cumulative_by_value(df: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str],
                        descending: bool = False, buckets: int | None = None) -> DataFrame:
    """Running totals over the distinct values of ``value`` within each key.

    Returns one row per distinct (keys, value) with, for each whole-number column ``c`` in ``sums``,
    ``c`` (the group's own total), ``c_before`` (total over values strictly earlier in the
    order) and ``c_through`` (including this value).  See ``running_totals``: no window ever
    spans a whole key.
    """
    keys, sums = list(keys), list(sums)
    v = F.col(value)
    grouped = cut_lineage(df.filter(v.isNotNull()).groupBy(*keys, value)
                          .agg(*[F.sum(c).alias(c) for c in sums]).withColumn("_o", -v if descending else v))
    out = running_totals(grouped, keys, "_o", sums, buckets=buckets)
    return out.select(*keys, value, *sums, *[f"{c}_before" for c in sums],
                      *[(F.col(f"{c}_before") + F.col(c)).alias(f"{c}_through") for c in sums])

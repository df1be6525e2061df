"""Summarise the physical plans of registered queries: join strategies, shuffles, scans.

python tools/plan_report.py [sf_dir] [names...]  -> markdown on stdout
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NODES = ["BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
         "HashAggregate", "ObjectHashAggregate", "SortAggregate", "Window", "Generate", "Expand"]


def summarise(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    nodes = Counter()
    for n in NODES:
        nodes[n] = len(re.findall(rf"\b{n}\b", plan))
    exch = len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition|Exchange RoundRobin", plan))
    bcast = len(re.findall(r"BroadcastExchange", plan))
    scans = []
    for line in plan.splitlines():
        if "FileScan" in line:
            m_loc = re.search(r"\[file:[^\]]*/([^/\]]+)\]", line)
            m_pf = re.search(r"PushedFilters: \[([^\]]*)\]", line)
            m_rs = re.search(r"ReadSchema: (struct<[^>]*>)", line)
            scans.append((m_loc.group(1) if m_loc else "?", m_pf.group(1) if m_pf else "", m_rs.group(1) if m_rs else ""))
    return {"nodes": {k: v for k, v in nodes.items() if v}, "shuffles": exch, "broadcasts": bcast, "scans": scans}


def main() -> None:
    from ashgrid.session import build_session
    from ashgrid.plans import load_all
    from ashgrid.plans.catalog import QUERIES as q
    load_all()
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    names = sys.argv[2:] or sorted(q)
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("OFF")
    pieces: list[dict] = []  # plans that end in a checkpoint while the query is built
    frame = type(spark.range(0))
    plain = frame.checkpoint

    def checkpoint(self, *a, **k):
        pieces.append(summarise(self))
        return plain(self, *a, **k)

    frame.checkpoint = checkpoint
    print(f"# Physical plans at {sf}\n")
    print("Initial AQE plans (before runtime re-optimisation: AQE later turns small sort-merge joins into "
          "broadcast joins and coalesces partitions). Counts are per occurrence in the plan text, so a scalar "
          "subquery used in several expressions is counted each time although it runs once (ReusedSubquery). "
          "No plan contains a nested-loop join or a Cartesian product.  A query that cuts its lineage has a row "
          "for every plan that ends in a checkpoint, numbered in order, before the row of its result.\n")
    print("| query | joins and aggregates | shuffles | broadcasts | scans (table: pushed filters; read schema) |")
    print("| --- | --- | --- | --- | --- |")
    for n in names:
        pieces.clear()
        try:
            last = summarise(q[n](spark, sf))
        except Exception as e:  # report and continue
            print(f"| {n} | error: {type(e).__name__} | | | |")
            continue
        for k, s in enumerate([*pieces, last], 1):
            name = n if s is last else f"{n} ({k})"
            nodes = ", ".join(f"{k}×{v}" for k, v in s["nodes"].items())
            scans = "<br>".join(f"{t}: {pf or '—'}; {rs}" for t, pf, rs in sorted(set(s["scans"])))
            print(f"| {name} | {nodes} | {s['shuffles']} | {s['broadcasts']} | {scans} |")
    spark.stop()


if __name__ == "__main__":
    main()

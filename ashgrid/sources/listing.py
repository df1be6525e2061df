"""Large directory listings in XML, read by several tasks.

Spark splits the files at "<", so a record is one tag and a split may begin anywhere in the tree.  What a
split does to the path of open directories is (whether a new tree begins, how many directories it
closes, which ones it leaves open); such steps combine, so the path at the start of each split follows
from one small row per split, and a second pass reads the files under their directories.
"""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["tree_files", "listing_files_to_fire_dates"]

TAG = re.compile(r"(/?)(tree|directory|file)(?=[\s/>])([^>]*?)(/?)>")
NAME = re.compile(r"""\bname\s*=\s*(?:"([^"]*)"|'([^']*)')""")


def _walk(batches, start):
    """Yields (split, new tree, closed, open, file) events: a row with ``file`` per file found, and at each
    end of a split one with its step.  ``start`` maps a split to the directories open where it begins."""
    split, fresh, closed, stack = None, False, 0, []
    for b in batches:
        for value, *at in zip(*(c.to_pylist() for c in b.columns)):
            if tuple(at) != split:
                if split is not None:
                    yield split, fresh, closed, stack, None
                split, fresh, closed, stack = tuple(at), False, 0, list(start.get(tuple(at), ()))
            m = TAG.match(value or "")
            if not m:
                continue
            end, tag, rest, single = m.groups()
            if tag == "tree":
                fresh, closed, stack = True, 0, []
            elif tag == "directory" and end:
                if stack:
                    stack.pop()
                else:
                    closed += 1
            elif not end:
                n = NAME.search(rest)
                name = html.unescape((n.group(1) if n.group(1) is not None else n.group(2)) if n else "")
                if tag == "file":
                    yield split, fresh, closed, stack, name
                elif not single:
                    stack.append(name)
    if split is not None:
        yield split, fresh, closed, stack, None


def _steps(batches):
    for (path, at), fresh, closed, stack, file in _walk(batches, {}):
        if file is None:
            yield pa.RecordBatch.from_pylist([{"path": path, "at": at, "fresh": fresh, "closed": closed, "open": stack}],
                                             pa.schema([("path", pa.string()), ("at", pa.int64()), ("fresh", pa.bool_()),
                                                        ("closed", pa.int64()), ("open", pa.list_(pa.string()))]))


def _files(batches, start, rows: int = 10000):
    schema = pa.schema([("dirs", pa.list_(pa.string())), ("file", pa.string())])
    held = []
    for _, _, _, stack, file in _walk(batches, start):
        if file is not None:
            held.append({"dirs": list(stack), "file": file})
        if len(held) == rows:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def tree_files(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """(dirs, file): every file of ``<tree>`` listings with the names of the directories around it, outermost
    first.  A listing may have any size and need not have line breaks; the driver holds a row per split."""
    # the session's list of files must not change between the passes: splits are named by path and offset
    tags = spark.read.option("lineSep", "<").text(paths).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
    steps = tags.mapInArrow(_steps, "path string, at long, fresh boolean, closed long, open array<string>")
    start: dict[tuple[str, int], list[str]] = {}
    path, stack = None, []
    for r in sorted(steps.collect(), key=lambda r: (r.path, r.at)):
        if r.path != path:
            path, stack = r.path, []
        start[r.path, r["at"]] = stack
        stack = [*([] if r.fresh else stack[:max(0, len(stack) - r.closed)]), *r["open"]]
    return tags.mapInArrow(lambda b: _files(b, start), "dirs array<string>, file string")


def listing_files_to_fire_dates(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Over files, as ``nested_listing_to_fire_dates``, for listings too large for one value."""
    t = tree_files(spark, paths)
    d = F.col("dirs")
    day = F.try_to_date(F.regexp_extract("file", r"^(\d{4}-\d{2}-\d{2})\.tif$", 1), "yyyy-MM-dd")
    fires = t.filter((F.size(d) == 3) & (F.get(d, F.lit(0)) == ".") & F.get(d, F.lit(2)).startswith("fire_"))
    dated = fires.select(F.regexp_replace(F.get(d, F.lit(2)), "^fire_", "").alias("fire_id"), day.alias("d"))
    return dated.filter(F.col("d").isNotNull()).groupBy("fire_id").agg(
        F.min("d").alias("start_date"), F.max("d").alias("end_date"), F.array_sort(F.collect_set("d")).alias("dates"))

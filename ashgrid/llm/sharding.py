"""Consistent-hash ring with virtual nodes and bounded loads (DataFrame and SQL functions only).

The ring has a fixed number of positions.  Every shard owns several virtual nodes on it; a row
hashes by doc_id to a position and belongs to the first virtual node clockwise.  Shards have
capacities; rows that overflow a full shard continue clockwise to the next shard with room.

Rows are never walked one by one.  They are counted per ring position, and only those counts
(as many as the ring has positions, whatever the input) go through the rounds of overflow; a
position that straddles a capacity is split by row rank.  The rows meet the outcome in one
equi-join on the ring position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ashgrid.llm.common import stored

RING = 4096
VNODES = 64


def ring_preferences(spark, shards: int, vnodes: int = VNODES, ring: int = RING) -> DataFrame:
    """pos, pref: for every ring position the shards in clockwise order of their virtual nodes."""
    node = spark.range(shards * vnodes).select(
        F.pmod(F.xxhash64(F.lit("node"), "id"), F.lit(ring)).alias("at"),
        F.xxhash64(F.lit("tie"), "id").alias("tie"), F.expr(f"cast(id div {vnodes} as int)").alias("shard"))
    around = F.expr("array_sort(collect_list(struct(at, tie, shard)))")
    nodes = node.agg(around.alias("nodes")).select("nodes").scalar()
    return spark.range(ring).select(F.col("id").alias("pos"), nodes.alias("nodes")).select(
        "pos", F.expr("""array_distinct(transform(
            concat(filter(nodes, v -> v.at >= pos), filter(nodes, v -> v.at < pos)), v -> v.shard))""").alias("pref"))


def place(counts: DataFrame, shards: int, vnodes: int = VNODES, ring: int = RING) -> DataFrame:
    """Bounded-load placement of ring positions.

    ``counts``: pos, cnt (rows of the position; at most ``ring`` rows).  Returns pieces
    (pos, first, take, shard, base): rows ranked [first, first + take) within the position go to
    ``shard`` and get the slots from ``base`` on.  Capacities add up to the number of rows, so
    after the last round every shard is exactly full and shard sizes differ by at most one row.
    Each round fills at least one shard, hence at most ``shards`` rounds; a round moves ``ring``
    short rows, and the driver sees ``shards`` sums."""
    spark = counts.sparkSession
    total = counts.agg(F.sum("cnt")).first()[0] or 0
    room = [total // shards + (s < total % shards) for s in range(shards)]
    load = [0] * shards
    state = ring_preferences(spark, shards, vnodes, ring).join(counts, "pos").select(
        "pos", "pref", F.col("cnt").cast("long").alias("left"), F.lit(0).cast("long").alias("first"),
        F.expr("cast(array() as array<struct<first: bigint, take: bigint, shard: int, base: bigint>>)").alias("pieces"))
    state = state.coalesce(1)  # ``ring`` rows at most: one task, and no shuffle in any round
    while sum(load) < total:
        full = F.array(*[F.lit(s) for s in range(shards) if room[s] == load[s]]).cast("array<int>")
        rooms = F.array(*[F.lit(r - x).cast("long") for r, x in zip(room, load)])
        loads = F.array(*[F.lit(x).cast("long") for x in load])
        there = state.withColumn("to", F.element_at(F.array_except("pref", full), 1))
        run = Window.partitionBy("to").orderBy(F.xxhash64(F.lit("order"), "pos"), "pos")
        before = F.sum("left").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("left")
        there = there.withColumn("before", before)
        take = F.greatest(F.lit(0).cast("long"),
                          F.least("left", F.element_at(rooms, F.col("to") + 1) - F.col("before")))
        there = there.withColumn("take", take)
        piece = F.struct("first", "take", F.col("to").alias("shard"),
                         (F.element_at(loads, F.col("to") + 1) + F.col("before")).alias("base"))
        state = stored(there.select(
            "pos", "pref", (F.col("left") - F.col("take")).alias("left"), (F.col("first") + F.col("take")).alias("first"),
            F.when(F.col("take") > 0, F.concat("pieces", F.array(piece))).otherwise(F.col("pieces")).alias("pieces")))
        filled = state.select(F.explode("pieces").alias("p")).groupBy("p.shard").agg(F.sum("p.take").alias("n"))
        for r in filled.collect():  # one row per shard
            load[r["shard"]] = r["n"]
    return state.select("pos", F.explode("pieces").alias("p")).select("pos", "p.*")


def shard_documents(docs: DataFrame, shards: int = 24, vnodes: int = VNODES, ring: int = RING) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null under this law).

    size is the UTF-8 length plus 8 (a null text counts 8 and has the checksum of no bytes, 0).
    A null doc_id hashes like any other value.  Repeated rows are counted first and get distinct
    slots, so a doc_id that fills the table is no hot key.  An empty table gives no rows.  Other
    columns are ignored."""
    raw = F.col("text").cast("binary")
    rows = stored(docs.select(
        F.col("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
        .withColumn("pos", F.pmod(F.xxhash64("doc_id"), F.lit(ring))))
    pieces = place(rows.groupBy("pos").agg(F.sum("copies").alias("cnt")), shards, vnodes, ring)
    run = Window.partitionBy("pos").orderBy(F.xxhash64(F.lit("rank"), "doc_id"), "doc_id", "size", "text_crc32")
    ranked = rows.withColumn(
        "rank", F.sum("copies").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies"))
    last = F.col("rank") + F.col("copies")
    met = ranked.join(pieces, "pos").filter((F.col("rank") < F.col("first") + F.col("take")) & (last > F.col("first")))
    lo, hi = F.greatest("rank", "first"), F.least(last, F.col("first") + F.col("take"))
    return met.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "base", "first",
        F.explode(F.sequence(lo, hi - 1)).alias("r")).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("base") + F.col("r") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))

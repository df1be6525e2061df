"""Prefix trie of rebuilt conversations, on fingerprints that compose.

A conversation is rebuilt from the first turns of its base conversation and its own later turns.
No rebuilt text is ever made:

1. A turn is an element (1, t) of a monoid, a stretch of n turns an element (n, sum of t_i B^i), and
   (m, a) (n, b) = (m + n, a + B^m b).  One pass over the turns in order gives the product of the
   first k turns of every conversation; a conversation whose turns lie in several partitions is
   put together from the partitions' products.
2. The fingerprint of a rebuilt prefix is the product of the base's head and the own suffix, the
   suffix being the left quotient of two stored products.
3. Prefixes of one depth and fingerprint form a node.  Every prefix refers to its stored last turn
   (the base's or its own) and to its parent; a node is proved when all its members have one
   parent and refer to turns of one content (SHA-256), by induction over the depth.  If any node
   fails, all is fingerprinted again with other bases.
4. Every node is named by its smallest member.  A conversation names the nodes of its path from some
   depth on, so the sums over subtrees are sums over members: no walk over levels.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashgrid.llm.common import stored

EVERY, HEADS = 20, 4               # base of c: c - c % EVERY; head length: crc32(c) % HEADS
BLOCK = 1 << 16                    # ids joined into one piece of a node's list


@dataclass(frozen=True)
class Monoid:
    """Products of turns modulo two primes below 2**31 (so that a product of two numbers fits a long)."""

    seed: int = 0
    primes: tuple[int, int] = ((1 << 31) - 1, (1 << 31) - 19)

    def bases(self) -> list[int]:
        got = [int.from_bytes(hashlib.sha256(f"turn base {self.seed} {p}".encode()).digest()[:8], "big") % p for p in self.primes]
        return [b if b > 1 else 2 for b in got]

    def turn(self, digest: str) -> list[Column]:
        """The element of a turn, from the digest of its content."""
        return [F.pmod(F.xxhash64(F.lit(f"{self.seed} {k}"), digest), F.lit(p)) for k, p in enumerate(self.primes)]

    def powers(self, k: int, n: int) -> np.ndarray:
        """base ** 0 .. base ** (n - 1) of the k-th prime."""
        p, b = self.primes[k], self.bases()[k]
        out = np.ones(max(n, 1), np.int64)
        done = 1
        while done < n:
            more = min(done, n - done)
            out[done:done + more] = out[:more] * pow(b, done, p) % p
            done += more
        return out

    def joined(self, k: int, left: Column, length: Column, right: Column) -> Column:
        """Product of ``left`` (of ``length`` < HEADS turns) and ``right``."""
        p, b = self.primes[k], self.bases()[k]
        power = F.get(F.array(*[F.lit(pow(b, e, p)).cast("long") for e in range(HEADS)]), length)
        return (left + power * right) % p

    def quotient(self, k: int, whole: Column, head: Column, length: Column) -> Column:
        """What remains of ``whole`` after its first ``length`` < HEADS turns, whose product is ``head``."""
        p, b = self.primes[k], self.bases()[k]
        inverse = F.get(F.array(*[F.lit(pow(b, -e, p)).cast("long") for e in range(HEADS)]), length)
        return F.pmod(whole - head, F.lit(p)) * inverse % p


def head_length(conv_id: Column) -> Column:
    """How many turns a conversation takes from its base."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def stored_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest, words of every turn; the texts are read here and nowhere else."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.sha2(content, 256)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")).filter("conv_id is not null")


_LOCAL = "conv_id long, pid int, k long, p0 long, p1 long, w long, b0 long, b1 long, words long, digest binary, last boolean"


def _scan(batches, monoid: Monoid):
    """Sorted turns of one partition -> their products and word sums within the partition (after the
    turn: p0, p1, w; before it: b0, b1), then one row with the state at the partition's end."""
    from pyspark import TaskContext
    pid = TaskContext.get().partitionId()
    conv, count, total, words_sum = None, 0, [0, 0], 0
    bases = monoid.bases()
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        c, words = (b.column(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("conv_id", "words"))
        first = np.ones(n, bool)
        first[1:] = c[1:] != c[:-1]
        start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        at = np.arange(n) - start
        more = (start == 0) & (conv is not None) & (c[0] == conv)  # rows of the conversation left open before
        k = at + 1 + np.where(more, count, 0)
        run = np.cumsum(words)
        w = run - np.where(start > 0, run[start - 1], 0) + np.where(more, words_sum, 0)
        after, before = [], []
        for x, p in enumerate(monoid.primes):
            t = b.column(f"t{x}").to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.cumsum(t * monoid.powers(x, n)[at] % p)
            prod = (sums - np.where(start > 0, sums[start - 1], 0)) % p
            shift = pow(bases[x], count, p)
            prod = np.where(more, (total[x] + shift * prod) % p, prod)
            prev = np.r_[0, prod[:-1]]
            prev[first] = 0
            if more[0]:
                prev[0] = total[x]
            after.append(prod)
            before.append(prev)
        conv, count, words_sum, total = int(c[-1]), int(k[-1]), int(w[-1]), [int(a[-1]) for a in after]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c), pa.array(np.full(n, pid, np.int32)), pa.array(k), pa.array(after[0]), pa.array(after[1]), pa.array(w),
             pa.array(before[0]), pa.array(before[1]), pa.array(words), b.column("digest"), pa.array(np.zeros(n, bool))],
            ["conv_id", "pid", "k", "p0", "p1", "w", "b0", "b1", "words", "digest", "last"])
    if conv is not None:
        one = lambda v: pa.array([v], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [one(conv), pa.array([pid], pa.int32()), one(count), one(total[0]), one(total[1]), one(words_sum), one(0), one(0), one(0),
             pa.nulls(1, pa.binary()), pa.array([True])],
            ["conv_id", "pid", "k", "p0", "p1", "w", "b0", "b1", "words", "digest", "last"])


def turn_products(turns: DataFrame, monoid: Monoid) -> DataFrame:
    """conv_id, k, p0, p1, w, b0, b1, words, digest: position of every turn in its conversation, product
    and word sum of the first k turns and product of the first k - 1.

    Turns are sorted over all partitions (null turns first, equal turns by their content), so one long
    conversation is spread like any other rows.  The driver sees one row per partition."""
    spark = turns.sparkSession
    t0, t1 = monoid.turn("digest")
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("digest").asc()]
    parts = turns.select("conv_id", "turn", "digest", "words", t0.alias("t0"), t1.alias("t1")).repartitionByRange(
        *order).sortWithinPartitions(*order)
    local = stored(parts.mapInArrow(lambda batches: _scan(batches, monoid), _LOCAL))
    carried, state = [], None
    for e in sorted(local.filter("last").select("pid", "conv_id", "k", "p0", "p1", "w").collect(), key=lambda r: r.pid):
        if state is not None:
            carried.append((e.pid, *state, *[pow(b, state[1], p) for b, p in zip(monoid.bases(), monoid.primes)]))
        if state is not None and state[0] == e.conv_id:
            prods = [(s + pow(b, state[1], p) * x) % p
                     for s, b, p, x in zip(state[2:4], monoid.bases(), monoid.primes, (e.p0, e.p1))]
            state = (e.conv_id, state[1] + e.k, *prods, state[4] + e.w)
        else:
            state = (e.conv_id, e.k, e.p0, e.p1, e.w)
    carry = spark.createDataFrame(carried, "c_pid int, c_conv long, c_k long, c0 long, c1 long, c_w long, s0 long, s1 long")
    met = local.filter("not last").join(carry, (F.col("pid") == F.col("c_pid")) & (F.col("conv_id") == F.col("c_conv")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    joined = lambda x, name: F.when(F.col("c_k").isNull(), F.col(name)).otherwise(
        (F.col(f"c{x}") + F.col(f"s{x}") * F.col(name)) % monoid.primes[x])
    return met.select("conv_id", (F.col("k") + zero(F.col("c_k"))).alias("k"), joined(0, "p0").alias("p0"), joined(1, "p1").alias("p1"),
                      (F.col("w") + zero(F.col("c_w"))).alias("w"), joined(0, "b0").alias("b0"), joined(1, "b1").alias("b1"),
                      "words", "digest")


def _rebuilt(products: DataFrame) -> DataFrame:
    """Per conversation: conv_id, h, heads (the base's first turns that it takes), n_head, len and total_w of
    the rebuilt conversation, own_* (product and words of its own first turns, which it gives up) and
    base_* (those of the heads)."""
    lead = F.when(F.col("k") < HEADS, F.struct("k", "p0", "p1", "w", "words", "digest"))
    convs = stored(products.groupBy("conv_id").agg(F.max("k").alias("n"), F.max("w").alias("all_w"),
                                                   F.sort_array(F.collect_list(lead)).alias("firsts")))
    base = convs.select(F.col("conv_id").alias("base_id"), F.col("firsts").alias("base_firsts"))
    h = head_length(F.col("conv_id"))
    met = convs.withColumn("h", h).join(base, F.col("conv_id") - F.col("conv_id") % EVERY == F.col("base_id"), "left")
    heads = F.when(F.col("base_id").isNull() | (F.col("h") == 0), F.slice("firsts", 1, 0)).otherwise(
        F.slice("base_firsts", F.lit(1), F.greatest("h", F.lit(1))))
    met = met.withColumn("heads", heads).withColumn("n_head", F.size("heads")).withColumn("given", F.least("h", "n").cast("int"))
    zero = F.lit(0).cast("long")
    part = lambda arr, i, f: F.coalesce(F.get(arr, F.col(i) - 1)[f], zero)
    out = met.select("conv_id", "n", "h", "heads", "n_head", (F.col("n_head") + F.col("n") - F.col("given")).alias("len"), "all_w",
                     *[part("firsts", "given", f).alias(f"own_{f}") for f in ("p0", "p1", "w")],
                     *[part("heads", "n_head", f).alias(f"base_{f}") for f in ("p0", "p1", "w")])
    return out.withColumn("total_w", F.col("base_w") + F.col("all_w") - F.col("own_w"))


def _prefixes(products: DataFrame, convs: DataFrame, monoid: Monoid) -> DataFrame:
    """One row per rebuilt conversation and depth: conv_id, len, depth, fp, parent (the parent's fp), digest
    (of the last turn), w_before (words of the turns before the last)."""
    name = lambda a, b: a * (1 << 31) + b
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", "len", zero.alias("depth"), zero.alias("fp"), F.lit(None).cast("long").alias("parent"),
                        F.lit(None).cast("binary").alias("digest"), zero.alias("w_before"))
    one = convs.select("conv_id", "len", "heads", F.posexplode("heads").alias("at", "x"))
    up = F.get("heads", F.col("at") - 1)
    heads = one.select("conv_id", "len", (F.col("at") + 1).cast("long").alias("depth"), name(F.col("x.p0"), F.col("x.p1")).alias("fp"),
                       F.coalesce(name(up["p0"], up["p1"]), zero).alias("parent"), F.col("x.digest").alias("digest"),
                       (F.col("x.w") - F.col("x.words")).alias("w_before"))
    own = products.filter(F.col("k") > head_length(F.col("conv_id"))).join(convs.drop("heads", "n"), "conv_id")
    made = lambda x, c: monoid.joined(x, F.col(f"base_p{x}"), F.col("n_head"),
                                      monoid.quotient(x, F.col(c), F.col(f"own_p{x}"), F.col("h")))
    tails = own.select("conv_id", "len", (F.col("n_head") + F.col("k") - F.col("h")).alias("depth"),
                       name(made(0, "p0"), made(1, "p1")).alias("fp"), name(made(0, "b0"), made(1, "b1")).alias("parent"), "digest",
                       (F.col("base_w") + F.col("w") - F.col("own_w") - F.col("words")).alias("w_before"))
    return root.unionByName(heads).unionByName(tails)


def _packed(rows, names: list[str], text: str, size: int = 1 << 20):
    """Rows (depth, fp, ...) as Arrow batches of about ``size`` characters of ``text``."""
    schema = pa.schema([(n, pa.string() if n == text else pa.int64()) for n in names])
    held, n = [], 0
    for r in rows:
        held.append(dict(zip(names, r)))
        n += 64 + len(held[-1][text])
        if n >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _blocks(batches):
    """Sorted (depth, fp, conv_id) -> depth, fp, first, body: the ids of a node, comma-joined in pieces."""
    def rows():
        key, ids = None, []
        for b in batches:
            for d, f, c in zip(*(b.column(x).to_pylist() for x in range(3))):
                if (d, f) != key or len(ids) == BLOCK:
                    if ids:
                        yield *key, ids[0], ",".join(map(str, ids))
                    key, ids = (d, f), []
                ids.append(c)
        if ids:
            yield *key, ids[0], ",".join(map(str, ids))
    return _packed(rows(), ["depth", "fp", "first", "body"], "body")


def _digests(batches):
    """Sorted pieces -> depth, fp, ends_sha256; a list is hashed piece by piece, never held whole."""
    def rows():
        key, h = None, None
        for b in batches:
            for d, f, body in zip(*(b.column(x).to_pylist() for x in ("depth", "fp", "body"))):
                if (d, f) == key:
                    h.update(b"," + body.encode())
                    continue
                if h is not None:
                    yield *key, h.hexdigest()
                key, h = (d, f), hashlib.sha256(body.encode())
        if h is not None:
            yield *key, h.hexdigest()
    return _packed(rows(), ["depth", "fp", "ends_sha256"], "ends_sha256")


def _ends(prefixes: DataFrame) -> DataFrame:
    """depth, fp, ends_sha256: digest of the ids of the conversations that end at a node.  The ids of one
    node are sorted and joined in many tasks; only their pieces meet."""
    keys = ["depth", "fp", "conv_id"]
    ids = prefixes.filter("depth = len").select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    blocks = ids.mapInArrow(_blocks, "depth long, fp long, first long, body string")
    return blocks.repartition("depth", "fp").sortWithinPartitions("depth", "fp", "first").mapInArrow(
        _digests, "depth long, fp long, ends_sha256 string")


def conversation_trie(conversations: DataFrame, monoid: Monoid = Monoid()) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by ``turn`` (null first, equal ones by a digest of their content); repeated rows are
    turns of their own; null roles and texts are empty.  Rows without conv_id belong to no
    conversation and take no part.  A conversation whose base is missing takes no head; one with no turns
    left ends at the root.  An empty table has no node, not even a root.  Other columns are ignored."""
    turns = stored(stored_turns(conversations))
    while True:
        products = stored(turn_products(turns, monoid))
        convs = stored(_rebuilt(products))
        prefixes = stored(_prefixes(products, convs, monoid))
        nodes = stored(prefixes.groupBy("depth", "fp").agg(
            F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.max("len").alias("max_len"), F.min("w_before").alias("w_before"),
            F.min("parent").alias("parent"), F.max("parent").alias("parent_b"), F.min("digest").alias("d_a"), F.max("digest").alias("d_b")))
        if nodes.filter("parent <> parent_b or d_a <> d_b").isEmpty():
            break
        monoid = Monoid(monoid.seed + 1)
    # the depth from which a conversation names its nodes, the words before it, and whether it names a leaf
    names = nodes.groupBy("rep").agg(F.min("depth").alias("since"), F.min_by("w_before", "depth").alias("cut"),
                                     F.max(F.struct("depth", "max_len")).alias("tip"))
    members = convs.select("conv_id", "len", "total_w").join(names, F.col("conv_id") == F.col("rep"), "left").select(
        "conv_id", F.coalesce("since", F.col("len") + 1).alias("since"), F.coalesce("cut", "total_w").alias("cut"),
        F.coalesce(F.col("tip.depth") == F.col("tip.max_len"), F.lit(False)).alias("leaf"))
    sums = prefixes.select("conv_id", "len", "depth", "fp").join(members, "conv_id").groupBy("depth", "fp").agg(
        F.sum(F.when(F.col("since") > F.col("depth"), F.col("cut")).otherwise(0)).alias("cuts"),
        F.sum(((F.col("len") > F.col("depth")) & (F.col("since") <= F.col("depth") + 1)).cast("long")).alias("n_children"),
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("parent"), F.col("rep").alias("parent_conv_id"))
    full = nodes.join(sums, ["depth", "fp"]).join(_ends(prefixes), ["depth", "fp"], "left")
    return full.join(above, ["depth", "parent"], "left").select(
        F.col("rep").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("cuts") - (F.col("n_convs") - 1) * F.col("w_before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))

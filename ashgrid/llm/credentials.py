"""Secret scan with multipart credential linking (DataFrame and SQL functions only).

Base patterns (assignments, access identifiers, hexadecimal runs) are reported wherever they occur.
Weak candidates (user names and client ids, bare mixed strings, endpoints) are reported only when a
complementary part lies within their scope: an identifier or an endpoint needs a secret nearby, a
bare string needs an identifier or an endpoint.  A weak candidate inside a base match is part of that
match and not reported again.  Parts meet in an interval join: every part is
registered in the fixed-width cells it covers, weak parts look into the cells their scope covers,
and the exact distance is the join condition, so no part meets the whole document.

Positions come from the lengths of the matches and of the text between them, summed along the
document; only the short list of matches is moved, never the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the patterns of the contract
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"   # runs of AKIA[A-Z0-9]+ with 18 characters or more
HEX = r"[0-9a-f]{16,}"          # runs of [0-9a-f]+ with 16 characters or more

IDENT = (r"""(?i)(?:user(?:_?name)?|client_?id|account(?:_?id)?|login|access_?key_?id)["']?\x20*[:=]\x20*["']?"""
         r"""[A-Za-z0-9._@+-]{3,}""")
BARE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{20})[A-Za-z0-9+/_-]++={0,2}"
ENDPOINT = (r"""(?i)(?:(?:https?|ftps?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>|]{4,}"""
            r"""|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,})""")

# kind: (order in the output, role); the first three are the base kinds
KINDS = {"assign": (0, "secret"), "access": (1, "ident"), "hex": (2, "secret"),
         "ident": (3, "ident"), "bare": (4, "secret"), "endpoint": (5, "endpoint")}
BASE = ("assign", "access", "hex")
SCOPE, CELL = 200, 256


def _matches(text: Column, kind: str, pattern: str, ok, guard: Column | None = None) -> Column:
    """Array of (kind, i, gap, len, ok): the i-th match of the pattern, the code points between it and
    the match before, its own code points, and whether it counts."""
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    item = F.transform(every, lambda m, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(between, i)).alias("gap"), F.length(m).alias("len"),
        ok(m, i).alias("ok")))
    empty = F.array().cast("array<struct<kind:string,i:int,gap:int,len:int,ok:boolean>>")
    there = text.rlike(pattern) if guard is None else guard & text.rlike(pattern)
    return F.when(there, item).otherwise(empty)


def all_matches(text: Column) -> Column:
    second = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    always = lambda m, i: F.lit(True)
    mixed = lambda m, i: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")
    return F.concat(
        _matches(text, "assign", ASSIGN, lambda m, i: F.length(F.get(second, i)) >= 12),
        _matches(text, "access", ACCESS, always, text.contains("AKIA")),
        _matches(text, "hex", HEX, always),
        _matches(text, "ident", IDENT, always),
        _matches(text, "bare", BARE, mixed),
        _matches(text, "endpoint", ENDPOINT, always))


def parts_of(docs: DataFrame) -> DataFrame:
    """d_id, d_key, kind, role, i, start, end for every counting match; d_key is a hash of the text, so
    rows with equal doc_id and text are scanned once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = (docs.select(F.col("doc_id").alias("d_id"), F.xxhash64(text).alias("d_key"), all_matches(text).alias("m"))
             .filter(F.size("m") > 0).dropDuplicates(["d_id", "d_key"])
             .select("d_id", "d_key", F.explode("m").alias("m")).select("d_id", "d_key", "m.*"))
    run = Window.partitionBy("d_id", "d_key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(run)
    role = F.create_map(*[F.lit(x) for k, (_, r) in KINDS.items() for x in (k, r)])
    return (found.withColumn("end", end).filter("ok")
            .select("d_id", "d_key", "kind", F.element_at(role, F.col("kind")).alias("role"), "i",
                    (F.col("end") - F.col("len")).alias("start"), "end"))


def linked(parts: DataFrame, scope: int = SCOPE, cell: int = CELL) -> DataFrame:
    """The weak parts that have a complementary part at most ``scope`` code points away and lie in no
    base match as a whole (one that contains or crosses a base match stays)."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))
    other = parts.select("d_id", "d_key", F.col("kind").alias("o_kind"), F.col("role").alias("o_role"),
                         F.col("start").alias("o_start"), F.col("end").alias("o_end"),
                         cells(F.col("start"), F.col("end") - 1).alias("cell"))
    weak = parts.filter(~F.col("kind").isin(*BASE)).withColumn(
        "cell", cells(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope))
    near = (F.col("o_start") <= F.col("end") + scope) & (F.col("o_end") >= F.col("start") - scope)
    same = F.col("w.d_id").eqNullSafe(F.col("o.d_id")) & (F.col("w.d_key") == F.col("o.d_key")) & (
        F.col("w.cell") == F.col("o.cell"))
    covers = F.col("o_kind").isin(*BASE) & (F.col("o_start") <= F.col("start")) & (F.col("o_end") >= F.col("end"))
    fits = (F.col("role") != F.col("o_role")) & ((F.col("role") == "secret") | (F.col("o_role") == "secret"))
    met = weak.alias("w").join(other.alias("o"), same & near & (covers | fits))
    keys = [F.col(f"w.{c}").alias(c) for c in ("d_id", "d_key", "kind", "role", "i", "start", "end")]
    return (met.groupBy(*keys).agg(F.max(fits).alias("fits"), F.max(covers).alias("covered"))
            .filter("fits and not covered").drop("fits", "covered"))


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """d_id, d_key, kind, start, end: base spans and linked weak spans (code points, end exclusive)."""
    parts = parts_of(docs)
    cols = ["d_id", "d_key", "kind", "start", "end"]
    return parts.filter(F.col("kind").isin(*BASE)).select(*cols).unionByName(linked(parts, scope).select(*cols))


def scan_documents(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked for every row of ``docs``.

    A null text is empty; rows without spans have the digest of the empty string and empty spans.
    Repeated rows get equal results, an empty table gives none, other columns are ignored."""
    spans = secret_spans(docs, scope)
    order = F.create_map(*[F.lit(x) for k, (n, _) in KINDS.items() for x in (k, n)])
    said = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    item = F.struct("start", F.element_at(order, F.col("kind")).alias("nth"), said.alias("said"))
    count = lambda k: F.sum((F.col("kind") == k).cast("long"))
    per = spans.groupBy("d_id", "d_key").agg(
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sum((~F.col("kind").isin(*BASE)).cast("long")).alias("n_linked"),
        F.array_sort(F.collect_list(item)).alias("all"))
    base = F.filter("all", lambda x: x["nth"] < len(BASE))
    text_of = lambda a: F.array_join(F.transform(a, lambda x: x["said"]), ",")
    per = per.select(F.col("d_id").alias("h_id"), F.col("d_key").alias("h_key"), *[f"n_{k}" for k in BASE], "n_linked",
                     text_of(base).alias("base"), text_of(F.col("all")).alias("spans"))
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    same = F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("d_key") == F.col("h_key"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return docs.select("doc_id", key.alias("d_key")).join(per, same, "left").select(
        "doc_id", *[zero(f"n_{k}") for k in BASE], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"), zero("n_linked"))

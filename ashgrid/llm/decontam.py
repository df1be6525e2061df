"""Benchmark decontamination by winnowing (DataFrame and SQL functions only).

A window is ``span`` consecutive words of a benchmark item (a shorter item is one window).  Of all
k-word grams of a text, winnowing keeps the minimum hash of every ``span - k + 1`` consecutive
grams.  Any shared run of ``span`` words contains such a run of grams on both sides, the same one,
so both sides keep the same gram: joining the kept hashes finds every shared window.

1. Kept hashes of all documents meet the kept hashes of the benchmark in a semi join.
2. Around each hit the document windows that contain the gram are cut out and joined with the
   benchmark windows by their words, which extends hits and removes hash collisions.
3. Per document the matched windows are merged into the set of covered words.

Items shorter than ``span`` words form one class per length, with the whole item as the gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashgrid.llm.common import stored

SPAN, GRAM = 10, 5
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what separates words
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOW = (1 << 31) - 1  # the low 31 bits of a fingerprint hold the gram's position


def words_of(text: Column) -> Column:
    """Words of the whole text, A-Z lower-cased; a null text has none.

    Cutting at what lies between words takes a tenth of the time of extracting each word; the
    empty pieces are those before a first and after a last separator."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), ""),
                      F.array().cast("array<string>"))


def fingerprints(words: str, gram: int, window: int) -> Column:
    """Array of the fingerprints of column ``words``: for every ``window`` consecutive grams the one
    with the smallest hash (the first of equals).  A fingerprint is a long with the hash in the
    upper bits and the position in the lower ones, so that the minimum keeps both."""
    grams = f"size({words}) - {gram - 1}"
    hashed = (f"transform(sequence(1, {grams}), i -> "
              f"(xxhash64(slice({words}, i, {gram})) & {~LOW}) | cast(i - 1 as bigint))")
    if window > 1:
        hashed = (f"transform(array({hashed}), h -> array_distinct(transform("
                  f"sequence(1, {grams} - {window - 1}), j -> array_min(slice(h, j, {window})))))[0]")
    return F.expr(f"if({grams} >= {window}, {hashed}, cast(array() as array<bigint>))")


def joined(words: str, start: str, n: str) -> str:
    return f"array_join(slice({words}, {start} + 1, {n}), ' ')"


def benchmark_windows(items: DataFrame, span: int = SPAN) -> DataFrame:
    """phrase, items: every window of the benchmark with the (distinct, non-null) ids that hold it."""
    w = items.select("item_id", words_of(F.col("text").cast("string")).alias("words")).filter(F.size("words") > 0)
    cut = F.expr(f"""transform(sequence(0, greatest(size(words) - {span}, 0)),
                     s -> {joined('words', 's', str(span))})""")
    return (w.select("item_id", F.explode(F.array_distinct(cut)).alias("phrase"))
            .groupBy("phrase").agg(F.collect_set("item_id").alias("items")))


def contaminated_windows(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """d_id, d_key, start, len, items: every occurrence of a benchmark window in a document.

    d_key is a hash of the text: rows with equal doc_id and text are one document."""
    key = F.xxhash64(F.col("text").cast("string"))
    base = docs.select(F.col("doc_id").alias("d_id"), key.alias("d_key"), words_of(F.col("text").cast("string")).alias("words"))
    bench = items.select(words_of(F.col("text").cast("string")).alias("words")).filter(F.size("words") > 0)
    short = [r["n"] for r in bench.select(F.size("words").alias("n")).filter(F.col("n") < span).distinct().collect()]
    hits = None
    for n in sorted(short) + [span]:  # at most ``span`` classes of lengths
        g, w = (gram, span - gram + 1) if n == span else (n, 1)
        side = bench.filter(F.size("words") >= span if n == span else F.size("words") == n)
        keys = side.select(F.explode(fingerprints("words", g, w)).alias("f")).select(
            F.col("f").bitwiseAND(F.lit(~LOW)).alias("k")).distinct()
        found = (base.select("d_id", "d_key", F.explode(fingerprints("words", g, w)).alias("f"))
                 .withColumn("k", F.col("f").bitwiseAND(F.lit(~LOW))).join(keys, "k", "left_semi")
                 .select("d_id", "d_key", F.struct(F.col("f").bitwiseAND(F.lit(LOW)).cast("int").alias("pos"),
                                                   F.lit(n).alias("len")).alias("hit")))
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.groupBy("d_id", "d_key").agg(F.collect_set("hit").alias("hits")).select(
        F.col("d_id").alias("h_id"), F.col("d_key").alias("h_key"), "hits")
    reach = span - gram
    around = F.expr(f"""array_distinct(flatten(transform(hits, x ->
        if(x.len < {span},
           array(struct(x.pos as start, x.len as len)),
           transform(sequence(greatest(x.pos - {reach}, 0), greatest(least(x.pos, size(words) - {span}), 0)),
                     s -> struct(s as start, {span} as len))))))""")
    whole = docs.select(F.col("doc_id").alias("d_id"), key.alias("d_key"), "text")
    cand = (whole.join(hits, F.col("d_id").eqNullSafe(F.col("h_id")) & (F.col("d_key") == F.col("h_key")))
            .select("d_id", "d_key", "hits", words_of(F.col("text").cast("string")).alias("words"))
            .select("d_id", "d_key", "words", around.alias("at"))
            .select("d_id", "d_key", F.explode(F.expr(
                f"transform(at, a -> struct(a.start as start, a.len as len, {joined('words', 'a.start', 'a.len')} as phrase))"
            )).alias("a")).select("d_id", "d_key", "a.*"))
    return cand.join(benchmark_windows(items, span), "phrase").select("d_id", "d_key", "start", "len", "items")


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``.

    Null or empty texts have no words; benchmark rows without words take no part, a null item_id
    marks words but is not listed.  Repeated rows get equal results; empty tables on either side
    give no hits.  Other columns are ignored.  Exact copies share their fingerprints' fate: the
    hits of a (doc_id, text) are collected once."""
    matched = contaminated_windows(docs, items, span, gram)
    union = F.expr("""aggregate(array_sort(collect_set(struct(start, len))),
        struct(0 as upto, cast(0 as bigint) as total),
        (a, x) -> struct(greatest(a.upto, x.start + x.len) as upto,
                         a.total + greatest(x.start + x.len - greatest(x.start, a.upto), 0) as total),
        a -> a.total)""")
    per = matched.groupBy(F.col("d_id").alias("h_id"), F.col("d_key").alias("h_key")).agg(
        union.alias("hit"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("ids"))
    all_docs = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("d_key"),
                           F.size(words_of(F.col("text").cast("string"))).cast("long").alias("n_words"))
    listed = F.coalesce(F.array_join(F.array_sort(F.transform("ids", lambda x: x.cast("string"))), ","), F.lit(""))
    n_hit = F.coalesce(F.col("hit"), F.lit(0)).cast("long")
    return all_docs.join(per, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("d_key") == F.col("h_key")), "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with all their columns."""
    bad = stored(contaminated_windows(docs, items, span, gram).select("d_id", "d_key").distinct())
    same = F.col("t.doc_id").eqNullSafe(F.col("b.d_id")) & (F.xxhash64(F.col("t.text").cast("string")) == F.col("b.d_key"))
    return docs.alias("t").join(bad.alias("b"), same, "left_anti")

"""URL filter: rules on hosts and paths, and for the rest the ratio of two character language models.

1. A rule (host, path, verdict) fits its host and all subdomains when the path starts with the rule's.  The
   longest fitting rule decides.
2. The URLs that rules accept and those that they reject train two variable-order Markov models of the
   characters of host and path.  A character's probability after the last ORDER characters is the
   Witten-Bell mixture over all shorter contexts; a context never seen hands over to the next shorter one.
3. A URL's score is the difference of the two log-likelihoods, divided by its characters.  The threshold is
   calibrated on the URLs with rules: their hosts are dealt to two folds, each scored by the models of
   the other; the least error (share of accepted URLs below plus of rejected ones above) wins.

Counts are Spark tables of n-grams, so they grow with the URLs; they are joined, never collected.  A URL
is named by a 64-bit hash while its characters are summed.  Only
histogram counts of the calibration (a fixed number of classes) reach the driver.  Logarithms are
rounded to millionths of a nat and summed as whole numbers, so sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashgrid.llm.common import stored

ORDER = 4                          # longest context
ALPHABET = 256                     # the order below zero: every character has probability 1 / ALPHABET
SCALE = 1_000_000                  # parts of a nat in which log-ratios are summed
STEP, CLASSES = 10_000, 1200       # width (in parts of a nat) and number of threshold classes, around zero
PAD = "\u0002"                     # before the first character
#: Fixed values of the contract: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
MODELS = ("0", "1", "all")         # trained without fold 0, without fold 1, and on everything
Rules = Sequence[tuple[str, str, str]]


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host is what follows the first :// up to /, ?, # or the end, with A-Z in lower case; path
    is what follows the host up to ?, # or the end.  Both are empty for null and without ://."""
    rest = F.coalesce(_after(url), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, lower)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Rules = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does.  Rules of one length: the one with the
    longer host."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _grams(urls: DataFrame) -> DataFrame:
    """One row per character of every URL: key, n, verdict, fold and gram (the character after its ORDER
    predecessors)."""
    padded = F.concat(F.lit(PAD * ORDER), F.col("u"))
    gram = F.explode(F.when(F.length("u") > 0, F.transform(
        F.sequence(F.lit(1), F.length("u")), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))))
    return urls.select("key", "n", "verdict", "fold", gram.alias("gram"))


def _counts(urls: DataFrame) -> DataFrame:
    """gram and its counts under each model: a_0, a_1, a_all (accepted URLs), r_0, r_1, r_all (rejected ones).
    Grams of URLs without a rule are there with zeros, since they are to be scored."""
    def total(verdict, model):
        inside = F.col("verdict") == verdict
        if model != "all":
            inside &= F.col("fold") != int(model)
        return F.sum(F.when(inside, F.col("n")).otherwise(0))
    return _grams(urls).groupBy("gram").agg(*[total(v, m).alias(f"{c}_{m}") for c, v in (("a", "allow"), ("r", "block")) for m in MODELS])


def gram_ratios(counts: DataFrame) -> DataFrame:
    """gram, x_0, x_1, x_all: log-ratio of the character's probability under the accepted and the rejected
    model, in parts of a nat.

    From the shortest context to the longest: the table of one order is met by the next one's on the gram
    without its first character.  At most as many rows share such a key as there are characters."""
    cols = [f"{c}_{m}" for c in "ar" for m in MODELS]
    levels = {ORDER: counts}
    for k in range(ORDER - 1, -1, -1):
        levels[k] = levels[k + 1].groupBy(F.substring("gram", 2, k + 1).alias("gram")).agg(*[F.sum(c).alias(c) for c in cols])
    below = None
    for k in range(ORDER + 1):
        context = F.substring("gram", 1, k)
        sums = levels[k].groupBy(context.alias("context")).agg(
            *[F.sum(c).alias(f"n_{c}") for c in cols], *[F.sum((F.col(c) > 0).cast("long")).alias(f"t_{c}") for c in cols])
        met = levels[k].withColumn("context", context).join(sums, "context")
        if below is None:
            met = met.select("*", *[F.lit(1.0 / ALPHABET).alias(f"p_{c}") for c in cols])
        else:
            met = met.withColumn("shorter", F.substring("gram", 2, k)).join(
                below.select(F.col("gram").alias("shorter"), *[f"p_{c}" for c in cols]), "shorter")
        mixed = lambda c: F.when(F.col(f"n_{c}") == 0, F.col(f"p_{c}")).otherwise(
            (F.col(c) + F.col(f"t_{c}") * F.col(f"p_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}")))
        below = met.select("gram", *[mixed(c).alias(f"p_{c}") for c in cols])
    part = lambda m: F.round((F.log(f"p_a_{m}") - F.log(f"p_r_{m}")) * SCALE).cast("long")
    return below.select("gram", *[part(m).alias(f"x_{m}") for m in MODELS])


def _scores(urls: DataFrame) -> DataFrame:
    """key, score (whole parts of a nat per character) of every URL that has characters; those with a rule are
    scored by the models trained without their fold."""
    ratios = stored(gram_ratios(stored(_counts(urls))))
    # fold + 1 of a URL with a rule, 0 without: all that its characters need
    model = F.when(F.col("verdict").isNull(), 0).otherwise(F.col("fold") + 1).cast("byte")
    value = F.when(F.col("model") == 0, F.col("x_all")).when(F.col("model") == 1, F.col("x_0")).otherwise(F.col("x_1"))
    met = _grams(urls).select("key", model.alias("model"), "gram").join(ratios, "gram")
    return met.groupBy("key").agg(F.sum(value).alias("x"), F.count("*").alias("chars")).select(
        "key", F.floor(F.col("x") / F.col("chars")).alias("score"))


def threshold_of(scores: DataFrame) -> int:
    """The calibrated threshold, a multiple of STEP: URLs of this score or more are accepted.

    Of the multiples within CLASSES / 2 of zero, the one with the least sum of the share of accepted URLs below
    it and of rejected ones not below it; ties go to the one nearest to zero, then the smaller.
    Without accepted or without rejected URLs it is 0."""
    half = CLASSES // 2
    place = F.greatest(F.least(F.floor(F.col("score") / STEP), F.lit(half)), F.lit(-half - 1))
    rows = scores.filter("verdict is not null").groupBy(place.alias("c")).agg(
        F.sum(F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(0)).alias("r")).collect()  # CLASSES + 2 rows at most
    good, bad = {r.c: r.a for r in rows}, {r.c: r.r for r in rows}
    n_good, n_bad = sum(good.values()), sum(bad.values())
    if not n_good or not n_bad:
        return 0
    best, below_good, below_bad = None, good.get(-half - 1, 0), bad.get(-half - 1, 0)
    for c in range(-half, half + 1):
        error = below_good * n_bad + (n_bad - below_bad) * n_good   # both shares over one denominator
        rank = (error, abs(c), c)
        best = rank if best is None or rank < best else best
        below_good, below_bad = below_good + good.get(c, 0), below_bad + bad.get(c, 0)
    return best[2] * STEP


def filter_urls(pages: DataFrame, rules: Rules = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), score (nats per character, null if a rule decides) for
    every row of ``pages``.

    A null URL, or one without ://, has empty host and path; without characters the score is 0, which is
    judged like any other.  If no URL is accepted or none rejected by a rule, the threshold is 0.  Repeated rows
    each give a row and count as often in the models; null page_ids stay; an empty table gives no rows;
    other columns are ignored."""
    host, path = split_url(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    urls = stored(rows.groupBy("host", "path").agg(F.count("*").alias("n")).select(
        "host", "path", "n", rule.alias("rule"), verdict.alias("verdict"), F.concat("host", "path").alias("u"),
        F.xxhash64("host", "path").alias("key"), (F.ascii(F.md5(F.col("host").cast("binary"))) % 2).alias("fold")))
    scored = stored(urls.select("host", "path", "n", "rule", "verdict", "key").join(_scores(urls), "key", "left"))
    least = threshold_of(scored.filter("score is not null"))
    judged = scored.select(
        "host", "path", "rule", F.coalesce("verdict", F.when(F.coalesce("score", F.lit(0)) >= least, "allow").otherwise("block")).alias("verdict"),
        F.when(F.col("rule").isNull(), F.coalesce("score", F.lit(0)) / SCALE).alias("score"))
    return rows.join(judged, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "score")

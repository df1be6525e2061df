"""Prefix trie, periodic runs and URL filter against brute force, with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ashgrid.llm import runs, urls
from ashgrid.llm.conversations import Monoid, conversation_trie, turn_products, stored_turns
from ashgrid.llm.runs import lyndon_array, periodic_runs, run_digest, with_planted_period, word_runs
from ashgrid.llm.urls import filter_urls, rule_for, split_url

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, depth int, fp string, k int"


@pytest.mark.parametrize("n", (11, 12, 13))
def test_one_query_per_operator(n):
    assert len([q for q in entry.queries() if q.startswith(f"op{n}_")]) == 1


# ------------------------------------------------------------------ prefix trie

def trie_by_hand(rows):
    """Nodes of the trie, from the rebuilt texts themselves."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            content = f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()
            own[c].append((turn is not None, turn or 0, hashlib.sha256(content).digest(), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(v, key=lambda t: t[:3])] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        whole[c] = own.get(base, [])[:h] + own[c][h:]
    members = collections.defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.defaultdict(set)
    for path in members:
        if path:
            children[path[:-1]].add(path)

    def below(path):
        return [path] + [x for k in children[path] for x in below(k)]

    out = set()
    for path, convs in members.items():
        sub = below(path)
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in sub if x)
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(path))
        out.add((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(children[path]),
                 sum(not children[x] for x in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_of(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 9, "x", 1) for r in rows], TURNS)
    got = [tuple(r) for r in conversation_trie(df, **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


def some_turns(seed, convs=90, words=3):
    rng = random.Random(seed)
    rows = []
    for c in range(-20, convs):
        for k in range(rng.randint(1, 6)):
            rows.append((c, k, rng.choice(["user", "assistant"]) if rng.random() < 0.1 else ("user", "assistant")[k % 2],
                         " ".join(rng.choice("ab") for _ in range(rng.randint(0, words)))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", (1, 2))
def test_trie_matches_brute_force(spark, seed):
    rows = some_turns(seed)
    assert trie_of(spark, rows) == trie_by_hand(rows)


def test_trie_of_odd_rows(spark):
    rows = [(None, 1, "user", "no conversation"), (3, None, None, None), (3, 2, "user", ""), (3, 1, "user", "x  y\tz"), (3, 1, "user", "x  y\tz"),
            (4, 5, "a", "long " * 20_000), (40, 1, "user", "same"), (41, 1, "user", "same"), (45, 1, "user", "same"), (-7, 0, "b", "c"),
            (7, 0, "ab", "c"), (8, 0, "a", "bc")]
    rows += [(500, k, "user", f"turn {k % 3}") for k in range(300)]
    assert trie_of(spark, rows) == trie_by_hand(rows)
    assert trie_of(spark, []) == set()


def test_colliding_fingerprints_are_found_and_drawn_again(spark):
    rows = some_turns(5, convs=40, words=4)
    weak = Monoid(primes=(3, 5))       # 15 fingerprints: most nodes collide, until the default primes come
    assert trie_of(spark, rows, monoid=weak) == trie_by_hand(rows)


def test_products_of_a_conversation_over_many_partitions(spark):
    rows = [(1, k, "user", f"t{k % 7}") for k in range(2000)] + [(c, 0, "user", "x") for c in range(2, 40)]
    df = spark.createDataFrame([(*r, 9, "x", 1) for r in rows], TURNS)
    m = Monoid()
    got = turn_products(stored_turns(df), m).orderBy("conv_id", "k").collect()
    assert [r.k for r in got if r.conv_id == 1] == list(range(1, 2001)) and [r.w for r in got if r.conv_id == 1][-1] == 2000
    elements = {}
    for r in stored_turns(df).select("digest", *[c.alias(f"t{i}") for i, c in enumerate(m.turn("digest"))]).distinct().collect():
        elements[bytes(r.digest)] = (r.t0, r.t1)
    for x in (0, 1):
        p, b, total, power = m.primes[x], m.bases()[x], 0, 1
        for r in [r for r in got if r.conv_id == 1]:
            assert r[f"b{x}"] == total
            total = (total + power * elements[bytes(r.digest)][x]) % p
            power = power * b % p
            assert r[f"p{x}"] == total


# ------------------------------------------------------------------ periodic runs

def runs_by_hand(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def digest_by_hand(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs_by_hand(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def periodic_words(rng):
    c = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 2)):
        u = [rng.randrange(6) for _ in range(rng.randint(1, 6))]
        at = rng.randint(0, len(c))
        c[at:at] = (u * 8)[:rng.randint(1, 6 * len(u))]
    return c


def test_grouping_gives_lyndon_arrays():
    rng = random.Random(4)
    for _ in range(600):
        c = periodic_words(rng)
        brute = [next((j for j in range(i + 1, len(c)) if c[j:] < c[i:]), len(c)) - i for i in range(len(c))]
        assert lyndon_array(c) == brute


def test_runs_match_brute_force(monkeypatch):
    rng = random.Random(7)
    many = [[f"w{x}".encode() for x in periodic_words(rng)] for _ in range(800)]
    expected = [runs_by_hand(w) for w in many]
    assert sum(map(len, expected)) > 400
    assert [word_runs(w) for w in many] == expected
    # hashes that tell nothing apart: the words themselves decide
    monkeypatch.setattr(runs._Sums, "of", lambda self, a, b: np.zeros(len(a), np.uint64))
    assert [word_runs(w) for w in many] == expected


def test_run_digest_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.substring("text", 1, 3000).alias("text"))
    planted = docs.select("doc_id", with_planted_period(F.col("text"), F.col("doc_id")).alias("text"))
    got = {tuple(r) for r in run_digest(planted).collect()}
    assert got == {digest_by_hand(r.doc_id, r.text) for r in docs.collect()}
    assert sum(r[1] for r in got) > 5


def test_runs_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b a b a b a b"), (5, "x " * 200_000), (6, "u u u u u u"), (6, "u u u u u u"), (7, "u u u u u"),
            (8, "é\u00a0é é\u00a0é é\u00a0é é\u00a0é é\u00a0é é\u00a0é"), (9, "ab cd ab cd ab cd ab cd")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, runs string")
    got = collections.Counter((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic_runs(df).collect())
    assert got == collections.Counter([
        (1, (), ""), (2, (), ""), (3, (), ""), (None, ((0, 8, 2),), "a b"), (5, ((0, 200_000, 1),), "x"), (6, ((0, 6, 1),), "u"),
        (6, ((0, 6, 1),), "u"), (7, (), "u u u u u"), (8, ((0, 6, 1),), "é\u00a0é"), (9, ((0, 8, 2),), "ab cd")])
    assert periodic_runs(df.limit(0)).collect() == []
    planted = df.select("doc_id", with_planted_period(F.col("text"), F.col("doc_id")).alias("text"))
    assert planted.filter("doc_id is null and text = 'a b a b a b a b'").count() == 1


# ------------------------------------------------------------------ url filter

def parts_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return re.sub("[A-Z]", lambda c: c.group().lower(), m.group(1)), m.group(2)


def verdicts_by_hand(url_list):
    """(host, path, rule, verdict) of every url, from Counters of every context."""
    parts = [parts_by_hand(u) for u in url_list]

    def rule(host, path):
        fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits, key=lambda r: len(r[0])) if fits else (None, None)

    fold = {h: ord(hashlib.md5(h.encode()).hexdigest()[0]) % 2 for h, _ in parts}
    models = {}
    for side in ("allow", "block"):
        for out in (0, 1, None):
            seen = collections.defaultdict(collections.Counter)
            for h, p in parts:
                if rule(h, p)[1] == side and fold[h] != out:
                    u = urls.PAD * urls.ORDER + h + p
                    for i in range(urls.ORDER, len(u)):
                        for k in range(urls.ORDER + 1):
                            seen[u[i - k:i]][u[i]] += 1
            models[side, out] = seen

    def chance(seen, context, c):
        p = 1 / urls.ALPHABET
        for k in range(len(context) + 1):
            counts = seen.get(context[len(context) - k:])
            if counts:
                n, t = sum(counts.values()), len(counts)
                p = (counts[c] + t * p) / (n + t)
        return p

    def score(h, p, out):
        u = urls.PAD * urls.ORDER + h + p
        at = range(urls.ORDER, len(u))
        x = [round((math.log(chance(models["allow", out], u[i - urls.ORDER:i], u[i]))
                    - math.log(chance(models["block", out], u[i - urls.ORDER:i], u[i]))) * 10 ** 6) for i in at]
        return sum(x) // len(x) if x else 0

    ruled = [(score(h, p, fold[h]), rule(h, p)[1]) for h, p in parts if rule(h, p)[1]]
    good, bad = [s for s, v in ruled if v == "allow"], [s for s, v in ruled if v == "block"]
    least = 0
    if good and bad:
        cuts = [(sum(s // urls.STEP < c for s in good) * len(bad) + sum(s // urls.STEP >= c for s in bad) * len(good), abs(c), c)
                for c in range(-urls.CLASSES // 2, urls.CLASSES // 2 + 1)]
        least = min(cuts)[2] * urls.STEP
    out = []
    for h, p in parts:
        name, v = rule(h, p)
        out.append((h, p, name, v or ("allow" if score(h, p, None) >= least else "block")))
    return out


def pages_of(spark, url_list):
    return spark.createDataFrame([(i, u, "gram", 1.5) for i, u in enumerate(url_list)], "page_id long, url string, host string, score double")


def test_verdicts_match_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()
    got = filter_urls(spark.read.parquet(f"{SF}/pages.parquet")).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == verdicts_by_hand([r.url for r in pages])


def test_urls_of_odd_rows(spark):
    odd = [None, "", "no scheme", "http://", "http://A.Example.COM/En/x?q#f", "https://example.com", "https://example.com/", "http://xn.net/es/1",
           "http://xn.net/fr/1", "http://xn.net/fr/1", "http://notexample.com/en/1", "http://www.example.com/en/1", "http://sub.www.example.com/en/2",
           "http://example.com:80/en/3", "a://b://c/d", "http://é.org/ü?x", "http://h.org/" + "a" * 50_000, "x://com/", "x://net/es/"]
    got = filter_urls(pages_of(spark, odd)).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == verdicts_by_hand(odd)
    assert [r.rule for r in got[4:9]] == ["com/", None, "com/", "net/es/", "net/fr/"]
    assert [r.rule for r in got[10:14]] == ["com/", "www.example.com/en/", "www.example.com/en/", None]
    only_good = filter_urls(pages_of(spark, ["http://a.com/x", "http://b.org/y"])).collect()
    assert {r.verdict for r in only_good} <= {"allow", "block"} and len(only_good) == 2
    assert filter_urls(pages_of(spark, [])).collect() == []


def test_a_model_learns_what_its_urls_look_like(spark):
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(12))
    seen = [f"http://{word('aeiou')}.com/{word('aeiou')}" for _ in range(80)] + [f"http://{word('xyzqw')}.net/es/{word('xyzqw')}" for _ in range(80)]
    new = [f"http://{word('aeiou')}.org/{word('aeiou')}" for _ in range(20)] + [f"http://{word('xyzqw')}.org/{word('xyzqw')}" for _ in range(20)]
    got = filter_urls(pages_of(spark, seen + new)).orderBy("page_id").collect()[160:]
    assert [r.verdict for r in got] == ["allow"] * 20 + ["block"] * 20


def test_split_and_rules_as_columns(spark):
    df = spark.createDataFrame([("http://Www.Example.com/en/1",)], "url string")
    h, p = split_url(F.col("url"))
    got = df.select(h.alias("h"), p.alias("p")).select("*", *[c.alias(n) for c, n in zip(rule_for(F.col("h"), F.col("p")), ("rule", "verdict"))]).first()
    assert tuple(got) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")

"""Decontamination, n-gram Jaccard join, repeat removal and the pipeline against brute force."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ashgrid.llm import jaccard
from ashgrid.llm.components import components, near_labels
from ashgrid.llm.decontam import decontaminate, drop_contaminated, words_of
from ashgrid.llm.jaccard import PrefixTree, drop_near_duplicates, near_duplicates
from ashgrid.llm.mixing import mix_documents
from ashgrid.llm.quality import score_documents
from ashgrid.llm.repeats import RunLengthIndex, remove_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sid long, d long"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 9) for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, "  \t "), (None, "a text without an id and some more words in it"), (5, "long " * 60_000),
       (6, "same text of a few words"), (6, "same text of a few words"), (7, "same text of a few words")]


def prose(rng, n, vocabulary=200):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


# ------------------------------------------------------------------ decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def overlap(docs, items):
    win = collections.defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        for s in range(max(1, len(w) - 9) if w else 0):
            win[tuple(w[s:s + 10])].add(i)
    out = []
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        hit, ids = set(), set()
        for n in {len(k) for k in win}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in win:
                    hit.update(range(s, s + n))
                    ids |= win[tuple(w[s:s + n])]
        ids.discard(None)
        listed = ",".join(sorted(map(str, ids)))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, rng.choice([1, 3, 9, 10, 11, 30]), 60)) for i in range(40)] + [(90, None), (91, ""), (92, "!?"), (None, prose(rng, 12)), (3, prose(rng, 20))]
    rows = []
    for i in range(150):
        t = prose(rng, rng.randint(0, 80), 60)
        if i % 3 == 0:
            t += ", " + rng.choice(items)[1].upper() + " É. " + prose(rng, 5) if rng.choice(items)[1] else ""
        rows.append((i, t))
    rows += ODD
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate(docs_of(spark, rows), bench).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(overlap(rows, items), key=key)
    clean = drop_contaminated(docs_of(spark, rows), bench)
    assert sorted((r.doc_id or -1) for r in clean.collect()) == sorted((o[0] or -1) for o in overlap(rows, items) if not o[5])
    assert clean.columns == docs_of(spark, rows).columns
    assert not any(r.contaminated for r in decontaminate(docs_of(spark, rows), bench.limit(0)).collect())
    assert decontaminate(docs_of(spark, []), bench).collect() == []


def test_words_are_cut_out_without_a_match_per_word(spark, capsys):
    texts = [None, "", " ", "!?", "Word", " Lead and trail, ", "a--b__c\x00d\x7fe", "ÉCOLE Été\u00a0\U0001F600x K9", "Z\n\tÀ", "0:9", "[x]{y}`z@"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", words_of(F.col("text")).alias("w"))
    assert [r.w for r in df.orderBy("i").collect()] == [WORD.findall((t or "").translate(LOWER)) for t in texts]
    capsys.readouterr()
    df.explain()  # a match per word took half of the operator's time
    assert "regexp_extract" not in capsys.readouterr().out


# ------------------------------------------------------------------ Jaccard join

def shingles(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def classes(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = d if low.get(r) is None else min(x for x in (low[r], d) if x is not None) if d is not None else low[r]
    return sorted(((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def near_copy_rows(seed):
    """Families of near copies around the threshold, a common passage, copies, short texts."""
    rng = random.Random(seed)
    passage, rows = prose(rng, 60), []
    for fam in range(12):
        base = prose(rng, rng.choice([6, 12, 40, 90, 150])).split()
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 18))):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 10 ** 6)}"
            text = " ".join(w)
            if fam % 3 == 0:
                text += "\n" + passage
            rows.append((len(rows), text.upper() if rng.random() < 0.2 else text))
    rows += [(len(rows) + k, prose(rng, rng.randint(0, 7), 3)) for k in range(25)]
    return rows + [(500 + k, rows[0][1]) for k in range(5)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_matches_brute_force(spark, seed):
    rows = near_copy_rows(seed) + ODD
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs_of(spark, rows)).collect()), key=str)
    assert got == classes(rows)


@pytest.mark.parametrize("block, pairs", [(2, 4), (7, 1 << 17)])
def test_passages_in_many_sets_are_compared_block_by_block(spark, monkeypatch, block, pairs):
    """Documents made of few shared passages: every prefix shingle has many holders that are not similar."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "PAIRS", pairs)
    rng = random.Random(block)
    passages = [prose(rng, 30, 5000) for _ in range(6)]
    rows = []
    for i in range(160):
        parts = rng.sample(passages, rng.randint(1, 3)) + [prose(rng, rng.randint(0, 9), 5000)]
        if rng.random() < 0.3:
            parts[0] = " ".join(w for w in parts[0].split() if rng.random() < 0.97)
        rows.append((i, " ".join(parts)))
    got = {r.doc_id: r.component_id for r in near_duplicates(docs_of(spark, rows)).collect()}
    want = {d: c for d, _, c in classes(rows)}
    assert got == want and 5 < len(set(want.values())) < 160


def test_holders_of_a_shingle_give_up_no_more_pairs_than_join_them(spark):
    """A hundred alike sets: the first round gives a forest, not all pairs."""
    from ashgrid.llm.common import stored
    hist = bytes([1] * 128)
    rows = spark.range(100).selectExpr("5L as token", "id + 1 as sid", "130 as n", "3 as pos")
    items = spark.range(100).selectExpr("id + 1 as sid", "130L as n").withColumn("hist", F.lit(bytearray(hist)))
    none = spark.createDataFrame([], "node long, comp long")
    assert jaccard.pairs_apart(rows, none, items, True).count() == 99
    assert jaccard.pairs_apart(rows, none, items, False).count() == 4950
    # two sets already lie in one component, one is too large, one has another histogram
    comp = spark.createDataFrame([(1, 1), (2, 1)], "node long, comp long")
    few = stored(rows.filter("sid <= 5").withColumn("n", F.when(F.col("sid") == 4, 180).otherwise(F.col("n"))))
    other = items.withColumn("hist", F.when(F.col("sid") == 5, F.lit(bytearray([2] * 65 + [0] * 63))).otherwise(F.col("hist")))
    assert {tuple(r) for r in jaccard.pairs_apart(few, comp, other, False).collect()} == {(1, 3), (2, 3)}


def test_histograms_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for _ in range(300):
        n = int(rng.integers(1, 1500))
        x = np.unique(rng.choice(pool, n))
        y = np.unique(np.concatenate([x[rng.uniform(size=len(x)) < rng.uniform(0.7, 1)], rng.choice(pool, int(n * rng.uniform(0, 0.3)))]))
        differ = len(np.setxor1d(x, y))
        hx, hy = jaccard._histogram(x), jaccard._histogram(y)
        assert 2 * len(hx) >= max(32, len(x)) and jaccard._distances([hx], [hy])[0] <= differ
    assert jaccard._distances([], []).tolist() == []


def test_one_document_of_each_class_stays(spark):
    rows = near_copy_rows(3) + ODD
    kept = drop_near_duplicates(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    named = [(d, c) for d, n, c in classes(rows) if n]
    got = collections.Counter(r.doc_id for r in kept.collect() if shingles(r.text))
    assert got == collections.Counter({c for _, c in named})
    assert sum(not shingles(r.text) for r in kept.collect()) == sum(not shingles(t) for _, t in rows)
    assert drop_near_duplicates(docs_of(spark, [])).collect() == []
    assert near_duplicates(docs_of(spark, [])).collect() == []


def test_prefix_tree_finds_exactly_the_similar_sets():
    rng = np.random.default_rng(8)
    base = np.sort(rng.choice(400, 60, replace=False))
    sets = []
    for _ in range(300):
        s = base[rng.random(60) > rng.choice([0.0, 0.05, 0.2])]
        s = np.union1d(s, rng.choice(400, rng.integers(0, 20)))
        sets.append(s.astype(">u4"))
    want = [k for k, s in enumerate(sets) if 100 * len(np.intersect1d(s, base)) >= 75 * len(np.union1d(s, base))]
    assert sorted(PrefixTree(sets).similar(base.astype(">u4"))) == want and 0 < len(want) < 300


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(300, 360)] + [(1, 1)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{k: 7 for k in range(300, 360)}}


def test_near_labels_only_join_connected_nodes(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(500, k) for k in range(100, 140)] + [(k, k + 1) for k in range(200, 230)]
    df = spark.createDataFrame(edges, "a long, b long")
    exact, got = dict(components(df.filter("a <> b")).collect()), dict(near_labels(df).collect())
    assert all(exact.get(n, n) == exact.get(c, c) for n, c in got.items()) and {n for e in edges for n in e} == set(got)
    assert {got[k] for k in [500, *range(100, 140)]} == {100}  # a hub and its partners
    assert near_labels(df.limit(0)).collect() == []


def test_labels_of_many_steps_need_no_long_plan(spark, capsys):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 130)]
    loops = [(200, 200), (201, 202), (202, 203), (203, 201)]
    edges = path + star + loops
    near = {n: {n} for e in edges for n in e}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    least = {n: n for n in near}
    for _ in range(10):
        least = {n: min(least[m] for m in near[n]) for n in near}
    df = spark.createDataFrame(edges, "a long, b long")
    for some, want in ((df, least), (df.filter("a >= 100"), {n: m for n, m in least.items() if n >= 100})):
        got = near_labels(some, 10)
        assert dict(got.collect()) == want
        capsys.readouterr()
        got.explain()  # a plan of nine joins, planned anew after each of its stages, filled the driver
        assert capsys.readouterr().out.split("Initial Plan")[0].count("Join") <= 3


def test_links_found_last_join_converged_labels(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for g in range(12):
        base = prose(rng, 120, 4000).split()
        for k in range(6):
            t = list(base)
            for _ in range(k):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10 ** 6)}"
            rows.append((g * 10 + k, " ".join(t)))
    want = near_duplicates(docs_of(spark, rows)).select("doc_id", "component_id")
    want = sorted(map(tuple, want.collect()))
    # labels of one step leave the rest to the links between them
    monkeypatch.setattr(jaccard, "near_labels", lambda links, rounds: near_labels(links, 1))
    got = near_duplicates(docs_of(spark, rows)).select("doc_id", "component_id")
    assert sorted(map(tuple, got.collect())) == want


# ------------------------------------------------------------------ repeats

def repeats(rows, span=100):
    seen, out = set(), {}
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for d, t in order:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - span + 1):
            k = b[i:i + span]
            if k in seen:
                mark[i:i + span] = b"\1" * span
            else:
                seen.add(k)
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out[(d, t)] = (d, len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest())
    return sorted((out[(d, t)] for d, t in rows), key=str)


def repeat_rows(seed):
    rng = random.Random(seed)
    line, passage = prose(rng, 14) + "\n", prose(rng, 90)
    rows = []
    for i in range(60):
        t = prose(rng, rng.randint(0, 120), 10 ** 6)
        if i % 2:
            t += "\n" + line + prose(rng, 10, 10 ** 6)
        if i % 3 == 0:
            t = passage[rng.randint(0, 200):] + t
        if i % 7 == 0:
            t += passage[:150] + "é€😀" * 20 + passage[100:260]
        rows.append((i, t))
    rows += [(100 + k, rows[k][1]) for k in range(10)] + [(200, "ab" * 400), (201, "z" * 99), (202, "z" * 100), (203, "z" * 101)]
    return rows


def test_repeat_removal_matches_brute_force(spark, monkeypatch):
    from ashgrid.llm import repeats as module
    rows = repeat_rows(1) + [r for r in ODD if r[0] != 5]
    for size in (module.BUCKET_BYTES, 300):  # also with most regions going through window hashes
        monkeypatch.setattr(module, "BUCKET_BYTES", size)
        out = remove_repeats(docs_of(spark, rows), with_text=True).collect()
        got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=str)
        assert got == repeats(rows)
        assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed for r in out)
    assert remove_repeats(docs_of(spark, [])).collect() == []


@pytest.mark.parametrize("span", [40, 128, 200, 300])
def test_repeat_removal_of_any_span(spark, span):
    rows = repeat_rows(span) + [(1000 + i, prose(random.Random(i % 3), 200, 10 ** 6)) for i in range(9)]
    got = sorted((tuple(r) for r in remove_repeats(docs_of(spark, rows), span=span).collect()), key=str)
    assert got == repeats(rows, span) and sum(r[2] for r in got) > 5 * span


def test_repeats_under_ids_of_text(spark):
    rows = [(f"doc-{i:03}" if i is not None else None, t) for i, t in repeat_rows(4)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((tuple(r) for r in remove_repeats(df).collect()), key=str)
    assert got == repeats([(d, t) for d, t in rows]) and any(r[2] for r in got)


def test_periodic_text_and_repeated_ids(spark):
    rows = [(1, "long " * 3000), (1, "long " * 3000), (2, "long " * 50), (3, "q" * 1000)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs_of(spark, rows)).collect()), key=str)
    assert got == repeats(rows)
    twice = [(4, "first " + prose(random.Random(1), 40)), (4, "second " + prose(random.Random(1), 40))]
    out = remove_repeats(docs_of(spark, twice)).collect()
    assert sorted(r.n_removed > 0 for r in out) == [False, True]


def test_many_texts_under_one_null_id_stay_apart(spark):
    rng = random.Random(12)
    own = [f"{rng.getrandbits(900):x}" for _ in range(6000)]
    texts = own + [t[:120] + f"z{rng.getrandbits(400):x}" for t in own[:1500]]
    out = remove_repeats(docs_of(spark, [(None, t) for t in texts]), with_text=True).collect()
    assert sorted(r.n_bytes for r in out) == sorted(map(len, texts))
    # of the two texts that share 120 bytes one loses exactly those, no other text loses any
    cut = sorted(r.kept.decode() for r in out if r.n_removed)
    assert [r.n_removed for r in out if r.n_removed] == [120] * 1500
    pairs = {t[120:]: k for k, t in enumerate(own[:1500])} | {t[120:]: k for k, t in enumerate(texts[6000:])}
    assert sorted(pairs[c] for c in cut) == list(range(1500))
    assert not {r.kept.decode() for r in out if not r.n_removed} - set(texts)


def test_run_length_index_streams_the_matching_statistics():
    rng = random.Random(3)
    part = bytes(rng.randrange(97, 101) for _ in range(60))
    strings = [bytes(rng.randrange(97, 99) for _ in range(rng.randint(1, 90))) + part[:rng.randint(0, 60)] for _ in range(30)] + [b"\0\0a", b"\0\0", b"\0"]
    idx = RunLengthIndex([np.frombuffer(s, np.uint8) for s in strings])
    where = [(k, i) for k, s in enumerate(strings) for i in range(len(s))]
    tail = lambda p: strings[where[p][0]][where[p][1]:]
    order = sorted(range(len(where)), key=lambda p: (tail(p), where[p]))
    assert [tail(p) for p in idx.order] == [tail(p) for p in order]
    want = {}
    for a, b in zip([None, *idx.order], idx.order):
        n = 0 if a is None else len(os.path.commonprefix([tail(a), tail(b)]))
        want[b] = n
    assert idx.matching().tolist() == [want[p] for p in range(len(where))]
    assert len(idx.runs) < len(where)
    seen, again = set(), []
    for p in range(len(where)):
        s = tail(p)[:12]
        if len(s) == 12:
            again += [p] if s in seen else []
            seen.add(s)
    assert idx.repeats(12).tolist() == again


# ------------------------------------------------------------------ pipeline

def test_pipeline_stages_take_effect(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "sharding" or docs.columns == columns
        kept.append({r.doc_id for r in docs.collect()})
    # the same decisions by brute force, each stage on what the one before kept
    score = {r.doc_id: r.predicted for r in score_documents(spark.read.parquet(f"{sf}/documents.parquet"),
                                                            spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    want = {d for d in rows if score[d]}
    assert kept[0] == want
    want = {c for _, n, c in classes([(d, rows[d]) for d in sorted(want)])}
    assert kept[1] == want
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {o[0] for o in overlap([(d, rows[d]) for d in want], items) if not o[5]}
    assert kept[2] == want
    drawn = {r.doc_id for r in mix_documents(spark.read.parquet(f"{tmp_path}/decontamination")).collect() if r.kept}
    assert kept[3] == drawn == kept[4]
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == kept[4]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.collect() == []


def test_every_holder_of_a_shared_shingle_is_listed(spark):
    from ashgrid.llm.jaccard import BUCKETS, shared_prefixes, shingle_sets
    rng = random.Random(6)
    common = prose(rng, 5)
    texts = [common + " " + prose(rng, rng.randint(3, 9), 10 ** 6) for _ in range(40)] + [prose(rng, 8, 10 ** 6) for _ in range(20)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    raw = common.encode()
    token = int(shingle_sets(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0].view(np.int64)[0])
    counters = np.zeros(BUCKETS, np.uint32)
    held = [s for s in (set(x.view(np.int64).tolist()) for t in texts for x in shingle_sets(
        np.frombuffer(t.encode(), np.uint8), np.array([0]), np.array([len(t.encode())]))) if token in s]
    in_prefix = sum(sorted(np.uint64(v % 2 ** 64) for v in s).index(np.uint64(token % 2 ** 64)) <= len(s) - -(-len(s) * 3 // 4) for s in held)
    for flush in (1 << 17, 30):  # one run per task, or several
        rows = shared_prefixes(df, counters, flush=flush).filter(F.col("token") == token).collect()
        assert len(rows) == len({r.sid for r in rows}) == in_prefix > 3

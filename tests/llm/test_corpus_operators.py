"""Decontamination, near duplicates, top-k, URL filters and the pipeline against brute force on small tables."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import components, decontamination, near_duplicates, queries, top_k, url_filters
from factloom.llm._runtime import settle
from factloom.llm.fm_index import FMIndex, WaveletTree, suffix_array

FOLDER = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def test_index():
    r = np.random.default_rng(0)
    for _ in range(30):
        symbols = r.integers(1, 5, r.integers(1, 80))
        symbols[r.random(len(symbols)) < 0.1] = 0
        symbols = np.append(symbols, 0)
        patterns = np.zeros((40, 4), np.int64)
        lengths = r.integers(1, 5, 40)
        for row, n in zip(patterns, lengths, strict=True):
            row[:n] = r.integers(1, 6, n)
        index = FMIndex(symbols)
        which, low, high = index.search(patterns.ravel(), 4 * np.arange(40), lengths)
        found = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high, strict=True)}
        for i, (row, n) in enumerate(zip(patterns, lengths, strict=True)):
            want = [k for k in range(len(symbols) - n + 1) if (symbols[k : k + n] == row[:n]).all()]
            assert found.get(i, []) == want
        tree = WaveletTree(symbols)
        at = r.integers(0, len(symbols) + 1, 20)
        symbol, rank = tree.symbol_and_rank(at[at < len(symbols)])
        assert symbol.tolist() == symbols[at[at < len(symbols)]].tolist() and rank.tolist() == [int((symbols[:k] == symbols[k]).sum()) for k in at if k < len(symbols)]
        assert all(tree.rank(np.full(20, c), at).tolist() == [int((symbols[:k] == c).sum()) for k in at] for c in range(6))
    assert sorted(suffix_array(np.array([1, 1, 0, 1, 1, 0]))) == list(range(6))


def brute_hits(items, text):
    own = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    hit, names = set(), set()
    for name, item in items:
        ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(item))
        for k in range(max(1, len(ws) - 12)) if ws else ():
            w = ws[k : k + 13]
            for i in range(len(own) - len(w) + 1):
                if own[i : i + len(w)] == w:
                    hit |= set(range(i, i + len(w)))
                    names.add(name)
    return len(own), len(hit), ",".join(sorted(names))


@pytest.mark.parametrize("block_words", [500_000, 20, 2])
def test_decontamination(spark, block_words):
    import hashlib

    r = random.Random(7)
    vocabulary = ["a", "B", "cé", "d", "9"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 25)))) for i in range(12)] + [(12, None), (12, "..."), (None, "a B")]
    texts = [" ".join(r.choice([*vocabulary, "zz"]) for _ in range(r.randint(0, 80))) + " " + (items[r.randrange(12)][1] or "") for _ in range(40)]
    texts += [None, "", "zz", texts[0], "a " * 20_000]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = [(str(i), t) for i, t in items if i is not None and t]
    for got in decontamination.contamination_digest(docs, bench, block_words=block_words).collect():
        if got.doc_id == len(texts) - 1:
            continue
        n, hit, names = brute_hits(named, texts[got.doc_id])
        assert (got.n_words, got.n_hit, got.items_sha256) == (n, hit, hashlib.sha256(names.encode()).hexdigest())
        assert got.contaminated == (hit > 0 and 20 * hit >= n)
    assert decontamination.contamination_digest(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontamination.contamination_digest(docs.limit(0), bench).count() == 0


def test_cutting(spark):
    phrase = " ".join(f"w{i}" for i in range(13))
    long = " ".join(f"x{i}" for i in range(400))
    rows = [(1, f"{long} {phrase.upper()}! {long}"), (2, phrase), (3, long), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, ["x"], 7, 8) for i, t in rows], "doc_id long, text string, _items array<string>, _hits int, row int")
    items = spark.createDataFrame([(1, phrase)], "item_id long, text string")
    kept = decontamination.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == sorted([(1, f"{long} ! {long}", ["x"], 7, 8), (3, long, ["x"], 7, 8), (4, None, ["x"], 7, 8), (5, "", ["x"], 7, 8)], key=lambda r: r[0])
    assert decontamination.decontaminate(docs.limit(0), items).collect() == []
    assert len(decontamination.decontaminate(docs, items.limit(0)).collect()) == 5


def test_cutting_many_spans(spark):
    phrase = " ".join(f"w{i}" for i in range(13))
    filler = " ".join(f"é{i}" for i in range(300))
    text = f"{filler} {phrase}. " * 1500
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = decontamination.decontaminate(docs, spark.createDataFrame([(1, phrase)], "item_id long, text string")).collect()
    assert found[0].text == f"{filler} . " * 1500


def brute_groups(rows, width, percent=80):
    sets = {}
    for i, text in rows:
        ws = [w for w in re.split("[\x20\x09-\x0d]+", lower(text)) if w]
        sets[i] = {tuple(ws[k : k + width]) for k in range(len(ws) - width + 1)} if len(ws) >= width else {tuple(ws)} - {()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    r = random.Random(width)
    vocabulary = [f"v{i}" for i in range(3000)]
    rows = []
    for _ in range(6):  # a text and copies of it with more and more edits; edits build on edits, so links are chains, too
        base = [r.choice(vocabulary) for _ in range(120)]
        for k in range(18):
            own = list(base) if k % 3 else list(rows[-1][1].split()) if rows else list(base)
            for _ in range(r.randint(0, 9)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            if k % 5 == 0:
                own = own[: -r.randint(1, 25)]
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", " \n", None, "one", "ONE", rows[0][1], rows[0][1].upper(), "\x1c a"])]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n int, key string")
    found = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates.near_duplicates(docs, width=width).collect()}
    assert found == brute_groups(rows, width)
    kept = near_duplicates.one_of_each(docs, width=width)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, (_, c) in found.items() if i == c)


def test_near_duplicates_of_one_text(spark):
    """Two thousand copies of a text, edited from little to beyond what links them: some hang on others, some on nothing."""
    r = random.Random(9)
    vocabulary = [f"v{i}" for i in range(4000)]
    base = [r.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(2000):
        own = list(base)
        for _ in range(r.randint(0, 8)):
            own[r.randrange(60)] = r.choice(vocabulary)
        rows.append((i, " ".join(own)))
    found = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    wanted = brute_groups(rows, 2)
    assert found == wanted and 50 < len({c for _, c in wanted.values()}) < 1950


@pytest.mark.parametrize("n_words", range(5))
def test_few_words_in_a_partition(spark, n_words):
    rows = [(1, " ".join("abcd"[:n_words])), (2, None), (3, " ".join("abcd"[:n_words]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    kept = near_duplicates.one_of_each(docs)
    assert sorted(map(tuple, kept.collect())) == [r for r in rows if r[0] < 3 or not n_words]


def test_columns_of_any_name(spark):
    rows = [(i, "one two three four five six" if i < 3 else None, i, i, i, i) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int, _twice int, id int, row int")
    kept = near_duplicates.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[3]]


def test_near_duplicates_odd(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "A  b\nc"), (None, "a b c"), (None, None), (3, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((x.doc_id, x.component_id, x.kept) for x in near_duplicates.near_duplicates(docs, width=2).collect()), key=str)
    assert found == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (None, None, True), (3, 3, True)], key=str)
    assert sorted((x.doc_id for x in near_duplicates.one_of_each(docs, width=2).collect()), key=str) == [1, 3, None, None]
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0


def test_sketch_fills_and_estimates():
    r = np.random.default_rng(0)
    both = r.integers(0, 2**63, 1200).astype(np.uint64)
    a, b = near_duplicates.sketch(both[:1000]), near_duplicates.sketch(both[200:])
    assert abs((a == b).mean() - 800 / 1200) < 0.15
    for n in (1, 2, 7):
        s = near_duplicates.sketch(both[:n])
        assert len(s) == near_duplicates.COORDINATES and (s != np.uint64(2**64 - 1)).all()


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    found = {x.node: x.root for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {2: 1, 3: 1, 8: 7, 9: 7} | {101 + i: 100 for i in range(40)}


def test_top_k(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((40, 16)) * r.exponential(1, (40, 1))
    rows = base[r.integers(0, 40, 700)] + 0.05 * r.standard_normal((700, 16))
    rows[650:] = rows[0]
    data = [(i, v.tolist(), "x", 0) for i, v in enumerate(rows)] + [(700, None, "x", 0), (800, [1.0, None], "x", 0), (900, [float("inf")] * 16, "x", 0), (1000, [], "x", 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, score string, rank int")
    ints = np.floor(1024 * rows).astype(np.int64)
    want = set()
    for q in range(0, 700, 10):
        s = ints @ ints[q]
        order = [j for j in np.lexsort((np.arange(700), -s)) if j != q][:10]
        want |= {(q, k + 1, int(j), int(s[j])) for k, j in enumerate(order)}
    for block, bucket, together in ((4096, 2048, 16), (16, 32, 16), (16, 32, 2)):
        top_k.BLOCK, before, top_k.BUCKET, size = block, top_k.BLOCK, bucket, top_k.BUCKET
        top_k.ROUND = together
        try:
            found = {(x.query_id, x["rank"], x.vec_id, x.score) for x in top_k.top_k(df, F.col("vec_id") % 10 == 0).collect()}
        finally:
            top_k.BLOCK, top_k.BUCKET, top_k.ROUND = before, size, 16
        assert found == want
    few = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (2, [2.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(x["rank"], x.vec_id) for x in top_k.top_k(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert top_k.top_k(few.limit(0), F.col("vec_id") == 0).count() == 0
    large = np.array([[2**62, 2**62], [-(2**62), 3]])
    assert top_k._products(large, large).tolist() == [[2**63 - 1, -(2**63)], [-(2**63), 2**63 - 1]]


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = lower(host)
    fits = [(len(r.text), r) for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda x: x[0])[1] if fits else None
    return host, path, best and best.text, best and best.verdict


def test_url_filters(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url").collect()
    odd = [None, "", "abc", "x://", "http://net/", "http://NET", "http://a.net/en/", "http://example.net/en/x?y#z", "http://xexample.net/en/", "https://u@b.example.com/de/", "a://b://c.org/fr/", "http://org/fr/\nx"]
    rows = [(p.page_id, p.url) for p in pages] + [(1000 + i, u) for i, u in enumerate(odd)] + [(1000, None)]
    spam = [(2000 + i, f"http://spam-{i % 4}.cheap.net/x/{i}?pill=1") for i in range(40)] + [(3000, "http://other.example.com/x/1?pill=2")]
    df = spark.createDataFrame([(i, u, "x", 0) for i, u in rows + spam], "page_id long, url string, host string, rule int")
    found = url_filters.judge_urls(df, queries.URL_RULES).collect()
    assert len(found) == len(rows + spam)
    urls = dict(rows + spam)
    for r in found:
        host, path, rule, verdict = brute_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert next(r for r in found if r.page_id == 3000).verdict == "block"  # learnt: a query for pills goes with blocked hosts
    assert url_filters.judge_urls(df.limit(0), queries.URL_RULES).count() == 0


def test_url_filters_know_whole_paths_and_tokens(spark):
    long = "w" * 120
    bad = [f"https://a{i}.test/x/y/z/u/spam/{i}" for i in range(30)] + [f"https://b{i}.test/{long}bad" for i in range(30)]
    good = [f"https://c{i}.test/x/y/z/u/news/{i}" for i in range(30)] + [f"https://d{i}.test/{long}good" for i in range(30)]
    labels = spark.createDataFrame([(u, True) for u in bad] + [(u, False) for u in good], "url string, blocked boolean")
    asked = ["https://new.test/x/y/z/u/spam/7", "https://new.test/x/y/z/u/news/7", f"https://new.test/{long}bad", f"https://new.test/{long}good"]
    pages = spark.createDataFrame(list(enumerate(asked)), "page_id long, url string")
    found = {r.page_id: r.verdict for r in url_filters.judge_urls(pages, [], labels=labels).collect()}
    assert found == {0: "block", 1: "allow", 2: "block", 3: "allow"}


@pytest.mark.parametrize("wide", [12, 0])
def test_mined_rules_by_enumeration(spark, monkeypatch, wide):
    """By FP-growth and level by level. Every combination of tokens counted by hand: the rules that hold, less those that a shorter one covers, block what they fit."""
    from itertools import combinations

    monkeypatch.setattr(url_filters, "WIDE", wide)
    r = random.Random(6)
    names = ["red", "green", "blue", "gold"]
    urls = [f"https://{r.choice(names)}.test/{r.choice(names)}/{r.choice(names)}" for _ in range(200)]
    labelled = [(u, u.count("red") >= 2 or ("gold.test/blue" in u and r.random() < 0.95)) for u in urls]
    pages = sorted(set(urls)) + [f"https://{a}.test/{b}/{c}" for a in names for b in names for c in names]

    def tokens(u):
        host, *path = u.split("://")[1].split("/")
        return frozenset([*(f"host:{x}" for x in host.split(".")), *(f"path{i}:{x}" for i, x in enumerate(path))])

    sets = [(tokens(u), b) for u, b in labelled]
    rules = []
    for size in range(1, 5):
        for combo in {frozenset(c) for t, _ in sets for c in combinations(sorted(t), size)}:
            hit = [b for t, b in sets if combo <= t]
            if sum(hit) >= 0.02 * len(sets) and sum(hit) >= 0.9 * len(hit) and not any(x < combo for x in rules):
                rules.append(combo)
    labels = spark.createDataFrame(labelled, "url string, blocked boolean")
    found = url_filters.judge_urls(spark.createDataFrame(list(enumerate(pages)), "page_id long, url string"), [], labels=labels, min_support=0.02).collect()
    assert rules and {r.page_id: r.verdict for r in found} == {i: "block" if any(x <= tokens(u) for x in rules) else "allow" for i, u in enumerate(pages)}


@pytest.mark.parametrize("depths", [[40], range(1, 41)])
def test_deep_paths_do_not_explode(spark, depths):
    """10,000 URLs of which a third share a path of forty pieces, or parts of it of any depth: rules are found in seconds, and are those of the tokens that tell."""
    import time

    r = random.Random(2)
    deep = [f"p{k}" for k in range(40)]
    depths = list(depths)
    labelled = []
    for i in range(10_000):
        blocked = r.random() < 0.5
        path = "/".join(deep[: depths[i % len(depths)]]) if i % 3 == 0 else f"x{i % 50}"
        labelled.append((f"https://h{i % 7}.test/{path}?{'spam' if blocked and i % 2 else 'id'}={i}", blocked))
    labels = spark.createDataFrame(labelled, "url string, blocked boolean")
    asked = ["https://new.test/p0/p1/p2?spam=1", "https://new.test/p0/p1/p2?id=1", "https://h1.test/" + "/".join(deep)]
    began = time.perf_counter()
    found = url_filters.judge_urls(spark.createDataFrame(list(enumerate(asked)), "page_id long, url string"), [], labels=labels)
    assert [r.verdict for r in sorted(found.collect())] == ["block", "allow", "allow"]
    assert time.perf_counter() - began < 150  # 2^40 combinations would never end


def test_repeated_labels_and_pages(spark):
    """Rows that repeat count each, as labels and as pages; labels that are null are left out."""
    labels = spark.createDataFrame([("https://a.test/bad", True)] * 20 + [("https://a.test/good", False)] * 20 + [(None, True), ("https://a.test/good", None)], "url string, blocked boolean")
    pages = spark.createDataFrame([(1, "https://b.test/bad"), (1, "https://b.test/bad"), (2, "https://b.test/good"), (None, None)], "page_id long, url string")
    found = url_filters.judge_urls(pages, [], labels=labels).collect()
    assert sorted((r.page_id or 0, r.verdict, r.confidence) for r in found) == [(0, "allow", None), (1, "block", 1.0), (1, "block", 1.0), (2, "allow", None)]


def test_pipeline_on_odd_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    source = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).withColumns({"row": F.lit(1), "_gone": F.lit("x"), "id": F.lit(2)})
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "one"), (9003, "one"), (None, "two words"), (9004, "long " * 40_000)], "doc_id long, text string")
    for c in source.columns[2:]:
        odd = odd.withColumn(c, F.lit(None).cast(source.schema[c].dataType))
    source.unionByName(odd).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() > 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        ids = {r.doc_id for r in stage(spark, docs, folder).collect()}
        assert {9001, 9002, 9003, None} <= ids, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).collect() == [], name


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = settle(stage(spark, docs, FOLDER))
        assert out.columns == corpus_pipeline.COLUMNS, name
        sizes.append(out.count())
        docs = out
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert decontamination.contamination_digest(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).where("contaminated").count() == 0
    final = docs.select("doc_id").distinct()
    packed = corpus_pipeline.run(spark, FOLDER)
    assert packed.select("doc_id").distinct().exceptAll(final).count() == 0 == final.exceptAll(packed.select("doc_id").distinct()).count()

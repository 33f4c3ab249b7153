"""Nearest neighbours, the filter audit and phrase mining against brute force on small tables."""

import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import filter_audit, one_bit_codes, phrases, queries

FOLDER = "/root/testdata/sf0.001"


# nearest neighbours


def test_codes_estimate_and_bound():
    r = np.random.default_rng(0)
    vectors = r.standard_normal((4000, 96)) * r.uniform(0.1, 3, (4000, 1)) + 0.5
    mean, query = vectors.mean(0), r.standard_normal(96)
    codes, length, fit = one_bit_codes.encode(vectors, mean)
    assert codes.shape == (4000, 12) and codes.dtype == np.uint8
    turn = one_bit_codes.rotation(96)
    assert np.allclose(turn @ turn.T, np.eye(96))
    estimate = one_bit_codes.signs(codes, 96) @ (turn @ query) * length / fit + query @ mean
    error = length * np.sqrt(1 - fit * fit) / fit * np.linalg.norm(query) / np.sqrt(95)
    off = np.abs(estimate - vectors @ query) / error
    assert abs(np.mean(estimate - vectors @ query)) < 0.1 and (off < 2).mean() > 0.94 and (off < 4).mean() > 0.999
    codes, length, fit = one_bit_codes.encode(np.array([mean, mean + 1]), mean)
    assert length[0] == 0 and np.isfinite(fit).all()


def vectors_of(n, d, seed=1):
    r = np.random.default_rng(seed)
    return r.standard_normal((n, d)) + 2 * r.standard_normal((10, d))[r.integers(0, 10, n)]


def brute_nearest(rows, every, k):
    """rows: (id, vector). (query, rank, id) and products."""
    out = {}
    for q, v in rows:
        if q % every == 0:
            own = sorted(((float(np.dot(v, w)), i) for i, w in rows if i != q and len(w) == len(v)), key=lambda x: (-x[0], x[1]))[:k]
            out[q] = own
    return out


def nearest_rows(df, **options):
    found = {}
    for r in sorted(one_bit_codes.nearest(df, F.col("vec_id") % 20 == 0, **options).collect()):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(found[r.query_id])
    return found


@pytest.mark.parametrize("block", [None, 4096])
def test_nearest(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(one_bit_codes, "BLOCK_BYTES", block)
    monkeypatch.setattr(one_bit_codes, "HEAD", 64)
    own = vectors_of(1500, 24)
    own[300] = own[301] = own[7]  # ties
    rows = [(i, v) for i, v in enumerate(own)] + [(5000 + i, v) for i, v in enumerate(vectors_of(15, 9))]
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    want = brute_nearest(rows, 20, 20)
    exact = nearest_rows(df, sigmas=float("inf"))
    assert {q: [i for _, i in x] for q, x in exact.items()} == {q: [i for _, i in x] for q, x in want.items()}
    assert all(np.allclose([s for s, _ in exact[q]], [s for s, _ in want[q]]) for q in want)
    about = nearest_rows(df)
    assert all(len(about[q]) == len(want[q]) for q in want)
    products = {q: {i: s for s, i in brute_nearest(rows, 20, 10**9)[q]} for q in want}
    assert all(s == pytest.approx(products[q][i]) for q in about for s, i in about[q])
    shared = sum(len({i for _, i in about[q]} & {i for _, i in want[q]}) for q in want)
    assert shared >= 0.97 * sum(map(len, want.values()))


def test_nearest_odd(spark):
    v = [0.25, -1.0]
    rows = [(0, v), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (None, v), (7, v), (7, v), (8, [1.0]), (20, [2.0, 2.0]), (20, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest_rows(df)
    assert [i for _, i in found[0]] == [7, 7, 20, 20] and found[0][0][0] == 1.0625 and [i for _, i in found[20]] == [0, 7, 7]
    assert nearest_rows(df.limit(0)) == {}
    assert nearest_rows(df.where("vec_id = 0")) == {}


def test_recall_of_the_query(spark):
    found = {}
    for r in queries.op11_nearest_neighbours(spark, "/root/testdata/sf0.01").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    want = brute_nearest(rows, 20, 20)
    assert found.keys() == want.keys() and all(len(found[q]) == 20 for q in found)
    assert np.mean([len(found[q] & {i for _, i in want[q]}) / 20 for q in want]) >= 0.95


# filter audit


def brute_audit(counts, letters):
    want, shapley = {}, Counter()
    for order in itertools.permutations(letters):
        left = dict(counts)
        for step, c in enumerate(order, 1):
            bit = letters.index(c)
            gone = {m: x for m, x in left.items() if m >> bit & 1}
            left = {m: x for m, x in left.items() if not m >> bit & 1}
            removed = sum(x[0] for x in gone.values())
            shapley[c] += removed
            fails = sum(x[0] for m, x in counts.items() if m >> bit & 1)
            want["".join(order), step] = [c, sum(x[0] for x in left.values()), removed, fails - removed, counts.get(1 << bit, (0,))[0], sum(x[1] for x in gone.values()), sum(x[2] for x in gone.values())]
    return {k: (*v[1:], shapley[v[0]]) for k, v in want.items()}


def test_diagrams_by_enumeration():
    r = random.Random(1)
    for n in (1, 2, 3, 5):
        letters = "ABCDE"[:n]
        for share in (0, 0.1, 0.5, 1):
            counts = {m: (r.randint(1, 9), r.randint(0, 3), r.randint(0, 3)) for m in range(2**n) if r.random() < share}
            found = {x[:2]: x[2:] for x in filter_audit.audit_of(counts, letters)}
            assert found == brute_audit(counts, letters)


def test_diagram_stays_reduced():
    """After any swaps the diagram is the one that is built in that order, node for node, and no node has nothing failed below."""
    r = random.Random(2)
    for _ in range(30):
        counts = {m: (r.choice([1, 1, 2]), 0, 0) for m in range(16) if r.random() < 0.7}
        diagram = filter_audit.Diagram(counts, 4)
        for level in filter_audit.adjacent_swaps(4):
            diagram.swap(level)
            moved = {sum((m >> f & 1) << i for i, f in enumerate(diagram.order)): c for m, c in counts.items()}
            assert len(diagram.nodes() - {0}) == len(filter_audit.Diagram(moved, 4).nodes() - {0})
            assert all(diagram.failed[x] != diagram.EMPTY for x in diagram.nodes() if diagram.variable[x] >= 0)


def brute_masks(rows, labels):
    """rows: doc_id, text, source. Counts by part and mask."""
    first, out = {}, {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, source in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        mask = (len(w) < 50) + 2 * (100 * len(set(w)) < 65 * len(w)) + 4 * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) + 8 * bool(re.search("[#$%&*|]", t)) + 16 * (i is not None and i > first.get(t, i))
        good, toxic = labels.get(i, (0, 0))
        own = out.setdefault(source or "", {})
        n = own.get(mask, (0, 0, 0))
        own[mask] = (n[0] + 1, n[1] + good, n[2] + toxic)
    return out


def audit_rows(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.part, {})[r.filter_order, r.step] = tuple(r[c] for c in filter_audit.COLUMNS)
    return out


def test_filter_audit(spark):
    r = random.Random(5)
    words = ["alpha", "Beta", "GAMMA", "delta", "e#", "f", "ü", " ", "x\x0by", "9|", *(f"w{i}" for i in range(80))]
    texts = [" ".join(r.choice(words[: r.choice([3, 12, 90])]) for _ in range(r.choice([0, 1, 49, 50, 51, 80]))) for _ in range(60)] + [None, "", " \t\n", "word " * 20_000, "A" * 10_000]
    rows = [(i, r.choice(texts), r.choice(["a", "b", "b", "b", None, ""])) for i in range(400)]
    rows += [(400, texts[0], "a"), (400, texts[0], "a"), (None, texts[0], "c"), (None, None, None)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 400, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    marks = {}
    for i, q, t in labels:
        if i is not None:
            old = marks.get(i, (0, 0))
            marks[i] = (max(old[0], q or 0), max(old[1], t or 0))
    docs = spark.createDataFrame([(*x, 1, "m", "p") for x in rows], "doc_id long, text string, source string, id int, mask string, part string").repartition(3)
    found = audit_rows(filter_audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert found == {part: brute_audit(counts, "ABCDE") for part, counts in brute_masks(rows, marks).items()}
    none = filter_audit.filter_audit(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert none.collect() == []
    unlabelled = filter_audit.filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert audit_rows(unlabelled) == {part: brute_audit(counts, "ABCDE") for part, counts in brute_masks(rows, {}).items()}


def test_filter_audit_with_other_filters(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2] * (i % 5), None) for i in range(20)], "doc_id long, text string, source string")
    short = {"S": lambda text, words: F.length(text) < 2}
    found = audit_rows(filter_audit.filter_audit(docs, spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int"), short, copies="C"))
    masks, seen = {}, set()
    for i in range(20):
        text = "ab"[i % 2] * (i % 5)
        mask = (len(text) < 2) + 2 * (text in seen)
        seen.add(text)
        n = masks.get(mask, (0, 0, 0))
        masks[mask] = (n[0] + 1, n[1] + (i == 3), 0)
    assert found == {"": brute_audit(masks, "SC")} and len(found[""]) == 4


# phrases


def brute_phrases(rows, support, longest, first):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            w = tuple(re.findall("[^ \t]+", piece))
            totals[lang] += len(w)
            for n in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(w[i : i + n] for i in range(len(w) - n + 1))
    out = []
    for lang, own in counts.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= support}
        inside = Counter()
        for p, a in candidates.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    inside[p[i : i + n]] = max(inside[p[i : i + n]], a)
        scored = []
        for p, a in candidates.items():
            if 100 * inside[p] < 100 * a:
                score, k = min((1000 * a * totals[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, totals[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:first], 1)]
    return sorted(out)


PIECES = ["the", "The", "of", "a", "b", "in the", "in the end", "é", "\xa0", "\t", ",", ".", "\n", "\x0b", " ", "?!", "one two three four five six", "漢", "x" * 300]


def some_texts(n=250, seed=4):
    r = random.Random(seed)
    rows = [(r.choice(["en", "en", "en", "de", None, "und"]), " ".join(r.choice(PIECES) for _ in range(r.randint(0, 40)))) for _ in range(n)]
    return [*rows, ("en", None), ("fr", ""), ("fr", "."), (None, None), ("en", "in the end " * 4000), ("en", "the, " * 3000), *rows[:20]]


@pytest.mark.parametrize("small", [False, True])
def test_phrases(spark, monkeypatch, small):
    """With small bounds both semi-joins are shuffles, and workers hand their counts on early."""
    if small:
        for name, value in (("BROADCAST_WORDS", 3), ("BROADCAST_GROUPS", 3), ("TALLY", 5), ("NUMBER_BINS", 3)):
            monkeypatch.setattr(phrases, name, value)
    rows = some_texts()
    docs = spark.createDataFrame([(*x, "p", 1) for x in rows], "lang string, text string, phrase string, n int").repartition(3)
    found = sorted(tuple(r) for r in phrases.collocations(docs, support=10, longest=5, first=12).collect())
    assert found == brute_phrases(rows, 10, 5, 12) and len(found) > 30


def test_phrases_beyond_64_bits(spark):
    """Scores whose products pass 64 bits, and cuts that only tie after flooring."""
    row = lambda a, n, heads, tails: (["w"] * len(heads), a, n, heads, tails)
    rows = [row(10**9, 10**12, [3 * 10**10, 2 * 10**10, 10**9], [4 * 10**10, 5 * 10**10, 10**9]), row(100, 10**12, [101, 100, 100], [100, 101, 100])]
    got = spark.createDataFrame(rows, "phrase array<string>, a long, n long, heads array<long>, tails array<long>").selectExpr(f"{phrases._CUTS} AS cut").collect()
    for (words, a, n, heads, tails), r in zip(rows, got, strict=True):
        want = min((1000 * a * n // (heads[k - 1] * tails[len(words) - k - 1]), k) for k in range(1, len(words)))
        assert (r.cut.score, r.cut.k) == want


def test_phrases_of_odd_tables(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert phrases.collocations(empty).collect() == [] and phrases.collocations(empty).columns == columns
    rare = spark.createDataFrame([("en", "a b"), (None, None)], "lang string, text string")
    assert phrases.collocations(rare).collect() == [] and phrases.collocations(rare).columns == columns


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_phrase_mining"])
def test_queries_equal_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    found = queries.QUERIES[name](spark, FOLDER)
    wanted = c.execute(queries.ORACLE_SQL[name])
    order = [d[0] for d in wanted.description]
    assert sorted(order) == sorted(found.columns)
    assert sorted(tuple(r[x] for x in order) for r in found.collect()) == sorted(wanted.fetchall())

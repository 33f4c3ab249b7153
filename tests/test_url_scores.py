"""URL scores by automaton against brute force, over one and several blocks of queries."""

import random
import re

import pytest

from factloom.operators import discovery, url_scores


def brute(urls, queries):
    out = {}
    for q, text in queries:
        tokens = set(re.findall("[a-z0-9]+", text.lower())) if text else set()
        for u in {u for u in urls if u}:
            n = sum(t in u.lower() for t in tokens)
            if n:
                out[q, u] = n
    return out


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(3)
    parts = ["a", "ab", "abc", "Example", "exam", "past-papers", "2024", "org", "é", "x", "PAST", "papers", "/", ".", "?q=", "zz", "nothing"]
    urls = ["https://" + "".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(300)] + [None, "", "ab" * 5_000]
    urls += urls[:50]
    queries = [(i, " ".join(r.choice(parts) for _ in range(r.randint(0, 6)))) for i in range(60)] + [(900, None), (901, ""), (902, "!!"), (-5, "a ab abc " * 400)]
    frames = spark.createDataFrame([(u, 1) for u in urls], "url string, score int").repartition(3), spark.createDataFrame([(*q, "x") for q in queries], "query_id long, query string, url string").repartition(2)
    return *frames, brute(urls, queries)


@pytest.mark.parametrize("block", [2**20, 200])
def test_scores(data, monkeypatch, block):
    monkeypatch.setattr(url_scores, "BLOCK_BYTES", block)
    urls, queries, wanted = data
    rows = discovery.scored_urls(urls, queries).collect()
    assert {(r.query_id, r.url): r.score for r in rows} == wanted and len(rows) == len(wanted)


@pytest.mark.parametrize("block", [2**20, 200])
def test_candidates(data, monkeypatch, block):
    monkeypatch.setattr(url_scores, "BLOCK_BYTES", block)
    urls, queries, wanted = data
    best = {}
    for (q, u), n in wanted.items():
        best.setdefault(q, []).append((-n, u.encode(), u))
    expected = sorted((q, i, u, -n) for q, x in best.items() for i, (n, _, u) in enumerate(sorted(x)[:7]))
    assert sorted(map(tuple, discovery.discover_candidates(urls, queries, k=7).collect())) == expected


def test_a_task_hands_on_few(data):
    """No more than k rows a query leave a task."""
    urls, queries, _ = data
    n = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    assert max(r["count"] for r in url_scores.url_scores(urls, queries, k=5).groupBy("query_id").count().collect()) <= 5 * n


def test_nothing_to_score(spark, data):
    urls, queries, _ = data
    assert discovery.discover_candidates(urls.limit(0), queries).collect() == []
    assert discovery.discover_candidates(urls, queries.limit(0)).collect() == []
    assert discovery.scored_urls(urls, queries.where("query_id > 899")).collect() == []


@pytest.mark.parametrize("pairs", [1, 3_000, 10**6])
def test_scores_are_in_order(data, monkeypatch, pairs):
    """Over slices of one query, of some, and as many as there are partitions; a URL goes to a slice once."""
    monkeypatch.setattr(url_scores, "SLICE_PAIRS", pairs)
    urls, queries, wanted = data
    rows = [(r.query_id, -r.score, r.url.encode()) for r in discovery.scored_urls(urls, queries).collect()]
    assert rows == sorted(rows) and len(rows) == len(wanted)


def test_a_url_goes_to_a_slice_once(data):
    urls, queries, _ = data
    own = url_scores._folded(urls)
    (block,) = url_scores.query_blocks(queries)
    cuts = url_scores.np.array([i for i, _ in block][30::30])
    rows = url_scores._listed(own, block, cuts).collect()
    assert len(rows) == len({(r.slice, r.url) for r in rows}) <= own.count() * (len(cuts) + 1)
    assert sum(len(r.queries) for r in rows) == url_scores.url_scores(urls, queries).count()


def test_pairs_come_in_bounded_parts(monkeypatch):
    """URLs that each meet all queries, as many in a batch as there may be."""
    monkeypatch.setattr(url_scores, "PAIRS", 5_000)
    matcher = url_scores.Matcher([(i, ["a"]) for i in range(700)])
    batch = url_scores.pa.RecordBatch.from_pydict({"url": [f"a{i}" for i in range(1_000)], "folded": ["a"] * 1_000})
    sizes = [len(at) for _, at, _, _ in url_scores._pairs([batch], matcher)]
    assert sum(sizes) == 700_000 and max(sizes) < 5_700


def test_slices_stay_wide_over_many_urls(spark):
    """What is shuffled of a URL is a row a slice: 770,000 URLs and 7,700 queries made 1,540 slices of 5 queries."""
    assert 7_700 / url_scores.slice_width(770_000, 7_700, 12) < 200
    urls = spark.createDataFrame([(f"https://a/{i}", f"https://a/{i}") for i in range(400)], "url string, folded string").coalesce(1)
    block = [(i, ["a", str(i)]) for i in range(90)]
    rows = url_scores._rated(urls, block, url_scores.np.arange(90), 30, url_scores.np.dtype("uint8")).collect()
    assert len(rows) == 3 * 400 and {len(r.scores) for r in rows} == {30}
    assert sum(x for r in rows for x in r.scores) == 400 * 90 + sum(str(i) in f"https://a/{k}" for i in range(90) for k in range(400))


@pytest.mark.parametrize("held", [2**27, 0])
@pytest.mark.parametrize("block", [2**20, 200])
def test_order_of_held_and_sorted_pairs(spark, monkeypatch, held, block):
    """Where a worker holds a slice and where Spark sorts pairs; scores above 255, ids that stand twice, one URL for each of several blocks."""
    monkeypatch.setattr(url_scores, "URL_BYTES", held)
    monkeypatch.setattr(url_scores, "BLOCK_BYTES", block)
    tokens = [f"t{i}x" for i in range(300)]
    urls = ["/".join(tokens), "t1x", "é t1x", "T1X t2x", None, "none", *(f"t{i}x/t{i % 7}x" for i in range(200))]
    queries = [(7, " ".join(tokens)), (3, "t1x t2x"), (3, "t4x"), (-2, "t5x"), *((50 + i, f"t{i}x") for i in range(30))]
    frames = spark.createDataFrame([(u,) for u in urls], "url string").repartition(3), spark.createDataFrame(queries, "query_id long, query string")
    rows = [(r.query_id, r.url, r.score) for r in discovery.scored_urls(*frames).collect()]
    wanted = [(q, u, n) for i, (q, text) in enumerate(queries) for (_, u), n in brute(urls, [(i, text)]).items()]
    assert sorted(rows) == sorted(wanted) and max(n for _, _, n in rows) == 300
    assert [q for q, _, _ in rows] == sorted(q for q, _, _ in rows)
    once = [(q, -n, u.encode()) for q, u, n in rows if q != 3]
    assert once == sorted(once)


@pytest.mark.parametrize("queries_a_slice", [0, 16])
def test_what_is_moved_grows_with_urls(spark, monkeypatch, queries_a_slice):
    """Twice the URLs and queries: twice as much goes to the slices, where a number a query and URL made it four times as much."""
    monkeypatch.setattr(url_scores, "SLICE_QUERIES", queries_a_slice, raising=False)
    for step in ("_unpacked", "_counted"):
        monkeypatch.setattr(url_scores, step, lambda rows, *_: rows, raising=False)

    def moved(n):
        urls = spark.createDataFrame([(f"https://a.example/en/{i}x?page=2",) for i in range(n)], "url string")
        queries = spark.createDataFrame([(i, f"en {i}x page 2") for i in range(n // 2)], "query_id long, query string")
        return sum(len(r[2]) * (4 if isinstance(r[2], list) else 1) for r in discovery.scored_urls(urls, queries).collect())

    small, large = moved(400), moved(800)
    assert 0 < large < 2.5 * small


@pytest.mark.parametrize("held", [2**27, 3_000, 0])
@pytest.mark.parametrize("block", [2**20, 200])
def test_order_of_counted_tokens(spark, monkeypatch, held, block):
    """As above where URLs take tokens along, up to the bytes of URLs and tokens that a worker holds: slices of several queries, of one block or more."""
    monkeypatch.setattr(url_scores, "SLICE_QUERIES", 0)
    monkeypatch.setattr(url_scores, "URL_BYTES", held)
    monkeypatch.setattr(url_scores, "BLOCK_BYTES", block)
    tokens = [f"t{i}x" for i in range(300)]
    urls = ["/".join(tokens), "t1x", "é t1x", "T1X t2x", None, "", "none", *(f"t{i}x/t{i % 7}x" for i in range(200))]
    queries = [(7, " ".join(tokens)), (3, "t1x t2x"), (3, "t4x"), (-2, "t5x"), (8, "nowhere"), (9, None), *((50 + i, f"t{i}x t{i + 1}x") for i in range(30))]
    frames = spark.createDataFrame([(u,) for u in urls], "url string").repartition(3), spark.createDataFrame(queries, "query_id long, query string")
    rows = [(r.query_id, r.url, r.score) for r in discovery.scored_urls(*frames).collect()]
    wanted = [(q, u, n) for i, (q, text) in enumerate(queries) for (_, u), n in brute(urls, [(i, text)]).items()]
    assert sorted(rows) == sorted(wanted) and max(n for _, _, n in rows) == 300
    assert [q for q, _, _ in rows] == sorted(q for q, _, _ in rows)
    once = [(q, -n, u.encode()) for q, u, n in rows if q != 3]
    assert once == sorted(once)


def test_a_slice_gets_the_tokens_that_it_asks_for(spark):
    block = [(i, ["a", f"b{i}"]) for i in range(90)]
    urls = spark.createDataFrame([(f"a{i}", f"a b{i}c") for i in range(90)] + [("none", "none")], "url string, folded string").coalesce(1)
    firsts, asked = url_scores.token_places([block, block])
    assert firsts == [0, 91] and asked[0].tolist() == [0, 1] and asked[90].tolist() == [91, 92]
    rows = url_scores._asked_tokens(url_scores._held_tokens(urls, block, 91), asked[90:], 30).collect()
    assert len(rows) == 3 * 90 and len({(r.slice, r.url) for r in rows}) == 3 * 90
    for r in rows:
        own = {91 + 1 + q for q in range(30 * r.slice, 30 * r.slice + 30)} | {91}
        assert r.tokens == sorted(k for k in own if k == 91 or f"b{k - 92}" in f"b{r.url[1:]}c")

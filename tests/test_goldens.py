"""Literal expected results."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import exprs as E
from factloom.operators import audit, contracts, curation, discovery, grounding, lifecycle, priority, quality
from factloom.operators import relational as rel
from factloom.operators import text as tx


@pytest.mark.parametrize(
    "papers, questions, covered, want",
    [
        ([], [], True, (0, 0, 0, [], "MEDIUM", ["DIRECT_SYLLABUS_COVERAGE", "NO_PREVIOUS_PAPER_DATA"])),
        ([(1, 7, 2024)], [], True, (1, 0, 0, [], "MEDIUM", ["DIRECT_SYLLABUS_COVERAGE", "NO_RECORDED_PREVIOUS_OCCURRENCE"])),
        ([(1, 7, 2023)], [(1, 5, 0), (1, 5, 1)], True, (1, 2, 1, [2023], "MEDIUM", ["DIRECT_SYLLABUS_COVERAGE", "APPEARED_IN_PREVIOUS_PAPER"])),
        ([(1, 7, 2024), (2, 7, 2022), (3, 7, 2022), (4, 8, 2025)], [(1, 5, 0), (2, 5, 0), (3, 5, 0), (4, 5, 0)], True, (3, 3, 3, [2022, 2024], "HIGH", ["DIRECT_SYLLABUS_COVERAGE", "REPEATED_IN_PREVIOUS_PAPERS"])),
        ([(1, 7, 2023), (2, 7, 2024)], [(1, 5, 0), (2, 5, 0)], False, (2, 2, 2, [2023, 2024], "LOW", ["NOT_IN_SELECTED_SYLLABUS_VERSION", "REPEATED_IN_PREVIOUS_PAPERS"])),
    ],
)
def test_priority(spark, papers, questions, covered, want):
    p = spark.createDataFrame(papers, "paper_id long, exam_id long, year long")
    q = spark.createDataFrame(questions, "paper_id long, topic_id long, position long")
    pairs = spark.createDataFrame([(7, 5, covered)], "exam_id long, topic_id long, covered boolean")
    r = priority.topic_priority(pairs, priority.topic_occurrence_stats(p, q), priority.paper_totals(p)).first()
    assert (r.exam_paper_count, r.matched_question_count, r.matched_paper_count, r.matched_years, r.band, r.reasons) == want


SNAPSHOTS = [
    (1, "text/plain", "\ufeffzu\u0308rich\r\rtwo\u00a0words \t\n\n\n\nlast".encode(), "zürich\n\ntwo words\n\nlast\n", None),
    (2, "text/html", b"<!doctype html><head><title>no</title></head><body><style>p{}</style><ul><li>one<li>two &lt; three</ul>tail<br/>end<noscript>x</noscript></body>", "one\ntwo < three\ntail\nend\n", None),
    (3, "application/json", '{"k":["ä",{"z":1.5,"y":[]}],"n":null,"b":false}'.encode(), "ä\n1.5\nnull\nfalse\n", None),
    (4, "application/xml", b"<a x='1'>p<b/>q<c>r<d>s</d></c>t</a>", "pqrst\n", None),
    (5, "text/xml", "<?xml version='1.0'?><m>\n  <n>&#252;ber</n>\n</m>".encode(), "über\n", None),
    (6, "text/plain", b"\t \r\n", None, "EXTRACTION_EMPTY_TEXT"),
    (7, "text/html", b"ab\xc3", None, "EXTRACTION_INVALID_ENCODING"),
    (8, "text/html", b"<svg><text>drawn</text></svg><template>later</template>", None, "EXTRACTION_EMPTY_TEXT"),
    (9, "application/json", b"[1,]", None, "EXTRACTION_INVALID_DOCUMENT"),
    (10, "application/json", b"[Infinity]", None, "EXTRACTION_INVALID_DOCUMENT"),
    (11, "application/xml", b"<p>&nbsp;</p>", None, "EXTRACTION_INVALID_DOCUMENT"),
    (12, "text/xml", b"<!DOCTYPE z><z>fine otherwise</z>", None, "EXTRACTION_INVALID_DOCUMENT"),
    (13, "image/png", b"\x89PNG", None, "EXTRACTION_UNSUPPORTED_CONTENT_TYPE"),
    (14, None, b"no kind", None, "EXTRACTION_UNSUPPORTED_CONTENT_TYPE"),
]


def test_extraction(spark):
    snapshots = spark.createDataFrame([s[:3] for s in SNAPSHOTS], "snapshot_id long, content_type string, content binary")
    runs, chunks = tx.extract_snapshots(snapshots)
    assert {(r.snapshot_id, r.text, r.error_code) for r in runs.collect()} == {(s[0], s[3], s[4]) for s in SNAPSHOTS}
    assert {r.snapshot_id for r in chunks.collect()} == {s[0] for s in SNAPSHOTS if s[3]}


@pytest.mark.parametrize("limits, code", [({"max_bytes": 2}, "EXTRACTION_INPUT_TOO_LARGE"), ({"max_chars": 2}, "EXTRACTION_TEXT_TOO_LARGE"), ({"max_chunks": 1}, "EXTRACTION_CHUNK_LIMIT")])
def test_extraction_limits(spark, limits, code):
    snapshots = spark.createDataFrame([(1, "text/plain", b"word " * 300)], "snapshot_id long, content_type string, content binary")
    assert tx.extract_snapshots(snapshots, **limits)[0].first().error_code == code


def test_chunks(spark):
    paragraphs = "k" * 550 + "\n\n" + "m" * 300 + "\n" + "o" * 600
    rows = [(1, paragraphs), (2, ""), (3, None), (4, "z" * 2100), (5, "\U0001f680" * 1200), (6, " " * 700 + "ink " * 200), (7, "ab " * 400)]
    docs = spark.createDataFrame(rows, "id long, text string")
    found = [(r.id, r.position, r.char_start, r.char_end) for r in tx.chunk_text(docs).orderBy("id", "position").collect()]
    assert found == [
        (1, 0, 0, 552), (1, 1, 452, 1452), (1, 2, 1352, 1453), (4, 0, 0, 1000), (4, 1, 900, 1900), (4, 2, 1800, 2100), (5, 0, 0, 1000), (5, 1, 900, 1200), (6, 0, 0, 1000), (6, 1, 900, 1500), (7, 0, 0, 999), (7, 1, 899, 1200),
    ]
    for r in tx.chunk_text(docs).collect():
        assert r.text == dict(rows)[r.id][r.char_start : r.char_end]


def test_stored_extraction(spark, tmp_path):
    snapshots = spark.createDataFrame([s[:3] for s in SNAPSHOTS], "snapshot_id long, content_type string, content binary")
    for _ in range(2):  # a repeated call replaces what is there
        runs, chunks = tx.store_extraction(snapshots, f"file://{tmp_path}/sink")
    assert {(r.snapshot_id, r.error_code) for r in runs.collect()} == {(s[0], s[4]) for s in SNAPSHOTS}
    assert sorted((r.snapshot_id, r.text) for r in chunks.collect()) == [(s[0], s[3]) for s in SNAPSHOTS if s[3]]


SEQUENCES = [
    ([], ("DRAFT", "UNRELEASED"), 0),
    (["APPROVED", "DRAFT"], ("DRAFT", "UNRELEASED"), 0),
    (["RELEASE"], ("DRAFT", "UNRELEASED"), 1),
    (["APPROVED", "RELEASE", "REJECTED"], ("APPROVED", "RELEASED"), 1),
    (["APPROVED", "RELEASE", "WITHDRAW", "RELEASE"], ("APPROVED", "WITHDRAWN"), 1),
    (["APPROVED", "WITHDRAW"], ("APPROVED", "UNRELEASED"), 1),
    (["APPROVED", "RELEASE", "WITHDRAW", "DRAFT"], ("DRAFT", "WITHDRAWN"), 0),
]


@pytest.mark.parametrize("decisions, state, refused", [s for s in SEQUENCES if s[0]])
def test_lifecycle(spark, decisions, state, refused):
    rows = [("a", "note", i, i, d, f"n{i}", True) for i, d in enumerate(decisions)]
    log = spark.createDataFrame(rows, "asset string, asset_kind string, ts long, seq long, decision string, note string, guard_ok boolean")
    found, no = lifecycle.release_state(log)
    r = found.first()
    assert ((r.approval_status, r.release_status), r.n_refused) == (state, refused)
    assert no.count() == refused
    if r.approval_status == "DRAFT":
        assert r.reviewer_note is None and r.decided_at is None


def test_decisions_in_buckets(spark):
    """However many decisions a row folds, the state and what is refused are the same."""
    import random

    r = random.Random(4)
    rows = [(f"a{r.randrange(4)}", r.choice(["note", "item"]), i // 3, i, r.choice(["DRAFT", "APPROVED", "APPROVED", "REJECTED", "RELEASE", "WITHDRAW"]), f"n{i}", r.random() < 0.9) for i in range(300)]
    log = spark.createDataFrame(rows, "asset string, asset_kind string, ts long, seq long, decision string, note string, guard_ok boolean")
    whole, pieces = lifecycle.release_state(log), lifecycle.release_state(log, bucket=5)
    for a, b in zip(whole, pieces, strict=True):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert whole[1].count() > 50
    first, later = lifecycle.release_state(log.where("seq < 120"), bucket=5), log.where("seq >= 120")
    state, refused = lifecycle.release_state(later, bucket=7, before=first[0])
    assert sorted(map(str, state.collect())) == sorted(map(str, whole[0].collect()))
    assert first[1].count() + refused.count() == whole[1].count()


def test_package_without_members(spark):
    log = spark.createDataFrame([("p", "package", 0, 0, "APPROVED", "", False), ("p", "package", 1, 1, "RELEASE", "", False)], "asset string, asset_kind string, ts long, seq long, decision string, note string, guard_ok boolean")
    assert lifecycle.release_state(log)[1].first().reason == "GUARD_FAILED"


ROBOTS = "User-agent: Other\nDisallow: /\n\nUser-agent: *\nDisallow: /hidden\nDisallow: /maps/closed\nSitemap: https://museum.example.net/maps/all.xml"
SITE = "https://museum.example.net"


def _leaf(*paths):
    return "<urlset>" + "".join(f"<url><loc>{SITE}{p}</loc></url>" for p in paths) + "</urlset>"


def _index(*urls):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"


def test_discovery(spark):
    robots = spark.createDataFrame([("museum.example.net", ROBOTS)], "host string, body string")
    rules, sitemaps, states = discovery.parse_robots(robots)
    assert sitemaps.first().location == f"{SITE}/maps/all.xml" and states.first().valid
    leaf = _leaf("/coins/roman?page=2&amp;lang=de", "/coins/greek#top", "/hidden/coins-vault", "/COINS/celtic", "/garden")
    crawl = spark.createDataFrame([(f"{SITE}/maps/all.xml", _index(f"{SITE}/maps/1.xml", "https://MUSEUM.example.net:443/maps/2.xml")), (f"{SITE}/maps/1.xml", leaf), (f"{SITE}/maps/2.xml", _leaf("/coins/greek"))], "url string, body string")
    roots = spark.createDataFrame([(1, f"{SITE}/maps/all.xml")], "run_id long, url string")
    hosts = spark.createDataFrame([("museum.example.net",)], "host string")
    urls = discovery.expand_sitemaps(crawl, roots, hosts=hosts, rules=rules)
    assert {(r.url, r.error_code) for r in urls.collect()} == {(f"{SITE}{p}", None) for p in ("/coins/roman?lang=de&page=2", "/coins/greek", "/COINS/celtic", "/garden")}
    frontier = discovery.frontier_filter(urls, hosts, rules, agent="FactBot/1.0")
    queries = spark.createDataFrame([(1, "Roman coins"), (2, "telescopes"), (3, "a")], "query_id long, query string")
    found = [(r.query_id, r.position, r.location, r.score) for r in discovery.discover_candidates(frontier, queries, k=3).orderBy("query_id", "position").collect()]
    assert [f for f in found if f[0] < 3] == [(1, 0, f"{SITE}/coins/roman?lang=de&page=2", 2), (1, 1, f"{SITE}/COINS/celtic", 1), (1, 2, f"{SITE}/coins/greek", 1)]
    assert [f[3] for f in found if f[0] == 3] == [1, 1, 1]


def test_sitemap_walks_that_fail(spark):
    crawl = spark.createDataFrame(
        [(f"{SITE}/loop.xml", _index(f"{SITE}/loop.xml")), (f"{SITE}/dtd.xml", "<!DOCTYPE q><urlset/>"), (f"{SITE}/abroad.xml", _index("https://elsewhere.example.net/x.xml")), (f"{SITE}/plain.xml", _index("http://museum.example.net/x.xml")), (f"{SITE}/gap.xml", _index(f"{SITE}/gone.xml")),
         (f"{SITE}/leafy.xml", "<urlset><url><loc>https://elsewhere.example.net/p</loc></url></urlset>"), (f"{SITE}/many.xml", _leaf(*[f"/p{i}" for i in range(6)])), (f"{SITE}/maps/closed.xml", _leaf("/q")), (f"{SITE}/wide.xml", _index(*[f"{SITE}/w{i}.xml" for i in range(5)]))],
        "url string, body string",
    )
    names = ["loop", "dtd", "abroad", "plain", "gap", "leafy", "many", "maps/closed", "wide", "nowhere"]
    roots = spark.createDataFrame([(i, f"{SITE}/{n}.xml") for i, n in enumerate(names)] + [(99, "https://unlisted.example.net/s.xml")], "run_id long, url string")
    rules = discovery.parse_robots(spark.createDataFrame([("museum.example.net", ROBOTS)], "host string, body string"))[0]
    hosts = spark.createDataFrame([("museum.example.net",)], "host string")
    found = {r.run_id: r.error_code for r in discovery.expand_sitemaps(crawl, roots, hosts=hosts, rules=rules, max_docs=4, max_urls=5).collect()}
    codes = ["DISCOVERY_LIMIT_EXCEEDED", "SITEMAP_INVALID", "REDIRECT_POLICY_REJECTED", "REDIRECT_POLICY_REJECTED", "SITEMAP_UNAVAILABLE", "REDIRECT_POLICY_REJECTED", "DISCOVERY_LIMIT_EXCEEDED", "ROBOTS_DENIED", "DISCOVERY_LIMIT_EXCEEDED", "SITEMAP_UNAVAILABLE"]
    assert found == dict(enumerate(codes)) | {99: "REDIRECT_POLICY_REJECTED"}


CHUNK = "Rivers: Elbe \U0001f30a and Öder.\n"


def test_grounding(spark):
    chunks = spark.createDataFrame([(1, 10, 0, CHUNK), (2, 20, 0, "ñandú \U0001f426 seen"), (3, 30, 0, "  \n ")], "run_id long, chunk_id long, position long, chunk_text string")
    proposals = spark.createDataFrame([(1, 0, "two rivers"), (1, 1, "one of them"), (2, 0, "a bird"), (3, 0, "nothing")], "run_id long, claim_position long, statement string")
    citations = spark.createDataFrame([(1, 0, 0, 10, 19, 23), (1, 0, 1, 10, 8, 12), (1, 1, 0, 10, 8, 12), (2, 0, 0, 20, 0, 7), (3, 0, 0, 30, 0, 3)], "run_id long, claim_position long, citation_position long, chunk_id long, char_start long, char_end long")
    valid = grounding.validate_grounding(proposals, citations, chunks)
    assert {r.run_id: r.status for r in valid.collect()} == {1: "SUCCEEDED", 2: "SUCCEEDED", 3: "FAILED"}
    evidence, claims, links = grounding.ground_claims(proposals, citations, chunks, valid)
    assert [r.content for r in evidence.where("run_id = 1").orderBy("position").collect()] == [CHUNK[19:23], "Elbe"]
    assert evidence.where("run_id = 2").first().content == "ñandú \U0001f426"
    assert sorted((r.claim_position, r.evidence_position) for r in links.where("run_id = 1").collect()) == [(0, 0), (0, 1), (1, 1)]
    assert claims.count() == 3


@pytest.mark.parametrize("place", [(77, 8, 12), (10, 8, 4000), (10, 8, 8), (10, -2, 4), (10, len(CHUNK) - 1, len(CHUNK)), (20, 0, 4)])
def test_ungrounded(spark, place):
    """Another run's chunk, an end beyond the chunk, an empty or negative range, only white space, no such chunk."""
    chunks = spark.createDataFrame([(1, 10, 0, CHUNK), (2, 77, 0, "of another run")], "run_id long, chunk_id long, position long, chunk_text string")
    proposals = spark.createDataFrame([(1, 0, "a claim")], "run_id long, claim_position long, statement string")
    citations = spark.createDataFrame([(1, 0, 0, *place)], "run_id long, claim_position long, citation_position long, chunk_id long, char_start long, char_end long")
    assert grounding.validate_grounding(proposals, citations, chunks).first().error_code == grounding.INVALID


def test_claim_outputs(spark):
    import json

    cite = {"source_chunk_id": 4, "char_start": 0, "char_end": 9}
    claim = {"statement": "Elbe flows north", "citations": [cite]}
    good = [{"claims": [claim]}, {"claims": [claim | {"subject": None, "predicate": "flows", "object_value": "north"}] * 50}, {"claims": [claim | {"citations": [cite] * 10, "statement": "s" * 2000}]}]
    bad = [
        {}, [], {"claims": []}, {"claims": {}}, {"claims": [claim] * 51}, {"claims": [claim], "more": 1}, {"claims": [claim | {"more": 1}]}, {"claims": [claim | {"citations": []}]}, {"claims": [claim | {"citations": [cite] * 11}]},
        {"claims": [claim | {"statement": "s" * 2001}]}, {"claims": [claim | {"statement": " \n"}]}, {"claims": [claim | {"statement": 5}]}, {"claims": [claim | {"subject": ""}]}, {"claims": [claim | {"subject": "s" * 501}]}, {"claims": [claim | {"object_value": 7}]},
        {"claims": [{"statement": "x"}]}, {"claims": [{"citations": [cite]}]}, {"claims": [claim, 3]}, {"claims": [claim | {"citations": [cite | {"char_start": -1}]}]}, {"claims": [claim | {"citations": [cite | {"char_end": 0}]}]}, {"claims": [claim | {"citations": [cite | {"char_end": 9.0}]}]},
        {"claims": [claim | {"citations": [cite | {"char_end": "9"}]}]}, {"claims": [claim | {"citations": [cite | {"char_end": True}]}]}, {"claims": [claim | {"citations": [cite | {"source_chunk_id": 2**31}]}]}, {"claims": [claim | {"citations": [cite | {"x": 1}]}]}, {"claims": [claim | {"citations": [{"char_start": 0, "char_end": 1}]}]},
    ]
    texts = [(json.dumps(x), True) for x in good] + [(json.dumps(x), False) for x in bad] + [("{", False), ("", False), (None, False)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string")
    found = {r.i: r.ok for r in df.select("i", contracts.claims_output_valid(F.col("t")).alias("ok")).collect()}
    assert {i: texts[i] for i in found if found[i] != texts[i][1]} == {}


def test_requests(spark):
    items = spark.createDataFrame(
        [(1, "q", "e", [3, 4], ["a", "b"], 1), (1, " ", "e", [3], ["a", "b"], 0), (1, "q", "e", [3, 3], ["a", "b"], 0), (1, "q", "e", [3], ["a"], 0), (1, "q", "e", [3], ["a", "\t"], 0), (1, "q", "e", [3], ["a", "b"], 2), (0, "q", "e", [3], ["a", "b"], 0), (1, "q", None, [3], ["a", "b"], 0)],
        "content_version_id long, question_text string, explanation string, claim_ids array<long>, options array<string>, correct_option_position int",
    )
    assert [r.error_code for r in contracts.validated(items.coalesce(1), "question_item").collect()] == [None, "QUESTION", "CLAIMS", "OPTIONS", "BLANK_OPTION", "CORRECT_OPTION", "VERSION", "EXPLANATION"]
    runs = spark.createDataFrame([("q", "sitemap", "SUCCEEDED", None, ["x"]), ("q", "sitemap", "SUCCEEDED", "late", []), ("q", "sitemap", "FAILED", None, []), ("q", "sitemap", "FAILED", "why", ["x"]), ("q", "sitemap", "SUCCEEDED", None, ["x", " x"])], "query string, adapter_key string, status string, error_message string, locations array<string>")
    assert [r.error_code for r in contracts.validated(runs.coalesce(1), "discovery_run").collect()] == [None, "MESSAGE", "MESSAGE", "FAILED_WITH_CANDIDATES", "REPEATED_LOCATION"]
    fetched = spark.createDataFrame([("SUCCEEDED", "https://a.example/x", 200, "eA==", None), ("SUCCEEDED", "ftp://a.example/", 200, "eA==", None), ("SUCCEEDED", "https://a.example/", 404, "eA==", None), ("FAILED", "https://a.example/", None, None, "TIME_OUT"), ("FAILED", "https://a.example/", None, None, "time out"), ("LOST", "https://a.example/", None, None, None)], "status string, requested_url string, http_status int, content_base64 string, error_code string")
    found = contracts.validated(fetched.withColumnRenamed("error_code", "given").withColumn("error_code", F.col("given")).coalesce(1), "fetch_result")
    assert [r.error_code for r in found.collect()] == [None, "URL", "HTTP_STATUS", None, "ERROR_CODE", "STATUS"]


def test_deletes_go_along_references(spark):
    """a <- b CASCADE, b <- c RESTRICT, b <- d SET NULL: what a restricted row stops stays whole."""
    a, b = spark.createDataFrame([(1,), (2,), (3,)], "id long"), spark.createDataFrame([(11, 1), (12, 2), (13, 2)], "id long, a long")
    c, d = spark.createDataFrame([(21, 11)], "id long, b long"), spark.createDataFrame([(31, 12), (32, 11), (33, None)], "id long, b long")
    tables = {"a": (a, "id"), "b": (b, "id"), "c": (c, "id"), "d": (d, "id")}
    found = quality.propagate_deletes(tables, [("b", "a", "a", "id", "CASCADE"), ("c", "b", "b", "id", "RESTRICT"), ("d", "b", "b", "id", "SET_NULL")], "a", spark.createDataFrame([(1,), (2,)], "id long"))
    assert {tuple(r) for r in found.collect()} == {("a", "1", "BLOCKED"), ("a", "2", "DELETE"), ("b", "12", "DELETE"), ("b", "13", "DELETE"), ("d", "31", "SET_NULL")}


def test_document(spark):
    packages = spark.createDataFrame([(1,), (2,), (3,)], "package_id long")
    notes = spark.createDataFrame([(5, "# T\n\n- s\n\n")], "note_id long, markdown string")
    items = spark.createDataFrame([(7, "Q?", "Since.", 71), (8, "R?", "No.", 99)], "item_id long, question_text string, explanation string, correct_option_id long")
    options = spark.createDataFrame([(70, 7, 0, "a"), (71, 7, 1, "b"), (80, 8, 0, "c")], "option_id long, item_id long, position long, option_text string")
    pn = spark.createDataFrame([(1, 5, 0), (3, 5, 0)], "package_id long, note_id long, position long")
    pi = spark.createDataFrame([(1, 7, 0), (2, 8, 0)], "package_id long, item_id long, position long")
    found = {r.package_id: r for r in curation.document_markdown(packages, pn, notes, pi, items, options).collect()}
    assert found[1].markdown == "# Content Package 1\n\n## Notes\n\n# T\n\n- s\n\n## Practice Questions\n\n### Question 1\n\nQ?\n\nA. a\nB. b\n\n**Answer:** B. b\n\n**Explanation:** Since.\n"
    assert found[2].error == "NO_ANSWER" and found[2].markdown is None
    assert found[3].markdown == "# Content Package 3\n\n## Notes\n\n# T\n\n- s\n"


def test_render(spark):
    rows = [(1, "a {x} {{y}} {x}", {"x": "{z}"}), (2, "{q}", {"x": "1"}), (3, "{x.y}", {"x": "1"}), (4, "{", {"x": "1"})]
    df = spark.createDataFrame(rows, "i int, t string, v map<string,string>")
    text, error = audit.rendered(F.col("t"), F.col("v"))
    assert [tuple(r) for r in df.select(text, error).orderBy("i").collect()] == [("a {z} {y} {z}", None), (None, "MISSING_PLACEHOLDER"), (None, "UNSUPPORTED_PLACEHOLDER"), (None, "UNSUPPORTED_PLACEHOLDER")]


def test_scalars(spark):
    df = spark.createDataFrame([("https://EXAMPLE.org.:443/?b=2&a=%41#f",)], "u string")
    assert df.select(E.canonical_url(F.col("u"))).first()[0] == "https://example.org/?a=A&b=2"
    costs = spark.createDataFrame([("0",), ("01",), ("999999999999.999999",), ("1.1234567",), ("-1",)], "c string")
    assert [r[0] is not None for r in costs.select(E.cost(F.col("c"))).collect()] == [True, False, True, False, False]
    codes = spark.createDataFrame([(401, None), (429, None), (504, None), (503, None), (404, None), (None, "UNAVAILABLE"), (None, "?")], "c int, s string")
    assert [r[0].removeprefix("AI_PROVIDER_") for r in codes.select(audit.provider_status_code(F.col("c"), F.col("s"))).collect()] == ["AUTHENTICATION", "RATE_LIMITED", "TIMEOUT", "UNAVAILABLE", "TRANSPORT", "UNAVAILABLE", "TRANSPORT"]


def test_order_of_rows_does_not_matter(spark):
    links = spark.createDataFrame([(1, 9, 2), (1, 8, 1), (2, 7, 0)], "p long, c long, position long")
    parents = spark.createDataFrame([(1,), (2,), (3,)], "p long")
    for rows in (links, links.orderBy(F.desc("c")), links.repartition(3)):
        nested = rel.nest_children(parents, rows, key="p", order_by=["position"], fields=["c"], as_="cs")
        assert {r.p: [x.c for x in r.cs] for r in nested.collect()} == {1: [8, 9], 2: [7], 3: []}


def test_functions_in_sql(spark):
    """The SQL functions give what the column expressions give."""
    from factloom.functions.registry import SQL_FUNCTIONS, register_functions

    assert set(SQL_FUNCTIONS) < set(register_functions(spark))
    urls = ["https://EXAMPLE.org.:443/?b=2&a=%41&&c=x=y#f", "https://u@a.org/", "https://a.org/p q", "http://a.org", "https://10.0.0.1/", "https://b.example.net", "https://b.example.net/", "nothing", "", None]
    df = spark.createDataFrame([(u, f" {u}; x", "a1 B-c") for u in urls], "u string, m string, q string")
    pairs = {
        "fl_host(u)": E.host(F.col("u")), "fl_valid_hostname(fl_host(u))": E.valid_hostname(E.host(F.col("u"))), "fl_canonical_url(u)": E.canonical_url(F.col("u")), "fl_canonical_origin(u)": E.canonical_origin(F.col("u")), "fl_media_type(m)": E.media_type(F.col("m")),
        "fl_relevance(q, u)": E.relevance_score(E.search_tokens(F.col("q")), F.col("u")), "fl_bounded(m, 9)": E.bounded(F.col("m"), 9), "fl_request_id_valid(m)": E.request_id_valid(F.col("m")), "fl_non_blank(m)": E.non_blank(F.col("m"), "unicode"), "fl_base64(q)": E.decoded_base64(F.col("q")),
        "fl_cost(q)": E.cost(F.col("q")), "fl_slice(m, 1, 4)": E.codepoint_slice(F.col("m"), F.lit(1), F.lit(4)), "fl_token_total(1, 2, 3)": E.token_usage_valid(F.lit(1), F.lit(2), F.lit(3)), "fl_error_code(upper(q))": E.key_pattern(F.upper("q"), "error_code"),
    }
    for sql, column in pairs.items():
        assert df.select(F.expr(sql).alias("a"), column.alias("b")).where("not (a <=> b)").collect() == [], sql

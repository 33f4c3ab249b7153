"""Queries on stored crawls: policy, robots rules, sitemaps, candidates, fetch results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import exprs as E
from factloom.operators import discovery as dc
from factloom.operators import relational as rel

from .registry import query
from .text import _CANONICAL, _H, _ODD, _odd_urls

C = F.col
AGENT = "FactBot/1.0"

_LINES = """(SELECT host, n, CASE WHEN line LIKE '%:%' THEN lower(trim(split_part(line, ':', 1))) END AS name, trim(regexp_replace(line, '^[^:]*:', '')) AS value, line <> '' AND (line NOT LIKE '%:%' OR NOT regexp_full_match(lower(trim(split_part(line, ':', 1))), '[a-z][a-z0-9-]*')) AS bad
 FROM (SELECT host, n, trim(regexp_replace(raw, '#.*$', '')) AS line FROM (SELECT host, unnest(string_split(body, chr(10))) AS raw, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS n FROM {robots}) a) b)"""
_STATES = f"(SELECT host, NOT bool_or(bad) AND coalesce(bool_or(name = 'user-agent'), FALSE) AS valid FROM {_LINES} l GROUP BY host)"
_GROUPED = f"""(SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY n) AS group_id FROM (SELECT l.*, name = 'user-agent' AND coalesce(lag(name) OVER (PARTITION BY l.host ORDER BY n), '') <> 'user-agent' AS opens FROM {_LINES} l JOIN {_STATES} s ON s.host = l.host WHERE s.valid AND name IS NOT NULL) x)"""
_RULES = f"""(SELECT a.host, a.group_id, lower(a.value) AS agent, r.n AS rule_order, r.name = 'allow' OR r.value = '' AS allow, r.value AS prefix FROM {_GROUPED} a JOIN {_GROUPED} r ON r.host = a.host AND r.group_id = a.group_id WHERE a.name = 'user-agent' AND r.name IN ('allow', 'disallow'))"""
_USED = f"""(SELECT DISTINCT r.host, r.rule_order, r.allow, r.prefix FROM {_RULES} r JOIN (SELECT host, arg_min(group_id, row(agent = '*', group_id)) AS group_id FROM {_RULES} q WHERE agent = '*' OR contains('factbot', agent) GROUP BY host) c ON c.host = r.host AND c.group_id = r.group_id)"""


def _allowed(source: str) -> str:
    """SQL: url, allowed over distinct url of source."""
    path = "coalesce(nullif(regexp_extract(url, '^[^:]+://[^/?#]*([^#]*)', 1), ''), '/')"
    return f"(SELECT t.url, coalesce(arg_min(u.allow, u.rule_order), TRUE) AS allowed FROM (SELECT DISTINCT url, {_H} AS host, {path} AS path FROM {source} s) t LEFT JOIN {_USED} u ON u.host = t.host AND (u.prefix = '*' OR starts_with(t.path, u.prefix)) GROUP BY t.url)"


@query(f"SELECT host, CAST(group_id AS BIGINT) AS group_id, agent, rule_order, allow, prefix FROM {_RULES} x")
def parse_robots(t) -> DataFrame:
    return dc.parse_robots(t("robots"))[0]


@query(f"SELECT url, allowed FROM {_allowed('{urls}')} x")
def robots_rule_join(t) -> DataFrame:
    return dc.robots_filter(t("urls"), dc.parse_robots(t("robots"))[0], agent=AGENT)


_POLICY = "(regexp_matches(url, '^(?i)https://') AND url NOT LIKE '% %' AND url NOT LIKE '%@%' AND url NOT LIKE '%#_%' AND {h} LIKE '%.%' AND NOT regexp_full_match({h}, '[0-9]+(\\.[0-9]+){{3}}'))"


@query(f"SELECT page_id, variant, {_POLICY.format(h='host')} AND host IN (SELECT host FROM {{allowed_hosts}}) AS allowed FROM (SELECT page_id, variant, url, {_H} AS host FROM {_ODD} x) y")
def url_policy_filter(t) -> DataFrame:
    urls = _odd_urls(t).withColumn("host", E.host(C("url")))
    listed = urls.join(t("allowed_hosts").select("host", F.lit(True).alias("listed")).hint("merge"), "host", "left")
    return listed.select("page_id", "variant", (E.url_policy(C("url")) & C("listed").isNotNull()).alias("allowed"))


@query(f"SELECT DISTINCT {_CANONICAL} AS url FROM (SELECT url, {_H} AS host FROM {{urls}} u) y WHERE {_CANONICAL} IS NOT NULL")
def url_set(t) -> DataFrame:
    return t("urls").select(E.canonical_url(C("url")).alias("url")).where("url is not null").distinct()


@query(f"SELECT page_id, url FROM {{urls}} u WHERE {_H} IN (SELECT host FROM {{allowed_hosts}})")
def allowlist_membership(t) -> DataFrame:
    return dc.allowlist_membership(t("urls"), t("allowed_hosts")).select("page_id", "url")


_FRONTIER = f"(SELECT DISTINCT {_CANONICAL} AS url FROM (SELECT url, {_H} AS host FROM {{urls}} u) y WHERE {_CANONICAL} IS NOT NULL AND host IN (SELECT host FROM {{allowed_hosts}}))"


@query(f"SELECT url FROM {_allowed(_FRONTIER)} x WHERE allowed")
def frontier_filter(t) -> DataFrame:
    return dc.frontier_filter(t("urls"), t("allowed_hosts"), dc.parse_robots(t("robots"))[0], agent=AGENT)


_SCORED = "(SELECT q.query_id, u.url, CAST(len(list_filter(list_distinct(regexp_extract_all(lower(q.query), '[a-z0-9]+')), lambda x: contains(lower(u.url), x))) AS BIGINT) AS score FROM (SELECT DISTINCT url FROM {urls}) u CROSS JOIN {queries} q)"


@query(f"SELECT query_id, position, url AS location, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) - 1 AS position FROM {_SCORED} s WHERE score > 0) x WHERE position < 50")
def discover_candidates(t) -> DataFrame:
    return dc.discover_candidates(t("urls"), t("queries"), k=50)


@query("SELECT run_id, location, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY length(location) DESC, location, candidate_id) AS r FROM {candidates}) x WHERE r <= 5")
def topk_candidates(t) -> DataFrame:
    return rel.top_of(t("candidates"), "run_id", [F.desc(F.length("location")), "location", "candidate_id"], 5).select("run_id", "location", "candidate_id")


@query(f"SELECT query_id, url, score FROM {_SCORED} s WHERE score > 0")
def score_order(t) -> DataFrame:
    return dc.scored_urls(t("urls"), t("queries"))


@query("SELECT run_id, candidates, urls, CASE WHEN candidates > 30 THEN 'CANDIDATES_LIMIT' WHEN urls > 20 THEN 'URLS_LIMIT' END AS error_code FROM (SELECT run_id, count(*) AS candidates, count(DISTINCT location) AS urls FROM {candidates} GROUP BY run_id) x")
def limit_gate(t) -> DataFrame:
    counts = t("candidates").groupBy("run_id").agg(F.count("*").alias("candidates"), F.count_distinct("location").alias("urls"))
    return dc.limit_gate(counts, {"candidates": 30, "urls": 20})


@query(
    f"""SELECT response_id, code AS error_code, CASE WHEN code IS NULL THEN 'SUCCEEDED' ELSE 'FAILED' END AS status FROM (SELECT r.response_id, CASE WHEN NOT {_POLICY.format(h='r.h').replace('url ', 'r.url ').replace('(url,', '(r.url,')} OR r.h NOT IN (SELECT host FROM {{allowed_hosts}}) THEN 'FETCH_URL_POLICY'
 WHEN s.valid IS NULL THEN 'FETCH_ROBOTS_UNAVAILABLE' WHEN NOT s.valid THEN 'FETCH_ROBOTS_INVALID' WHEN NOT a.allowed THEN 'FETCH_ROBOTS_DENIED' WHEN r.http_status NOT BETWEEN 200 AND 299 THEN 'FETCH_HTTP_STATUS'
 WHEN lower(trim(split_part(r.content_type, ';', 1))) NOT IN ('application/json', 'application/pdf', 'application/xml', 'text/html', 'text/plain', 'text/xml') THEN 'FETCH_UNSUPPORTED_CONTENT_TYPE' WHEN r.body = '' THEN 'FETCH_EMPTY_CONTENT' END AS code
 FROM (SELECT *, {_H} AS h FROM (SELECT *, requested_url AS url FROM {{responses}}) z) r LEFT JOIN {_STATES} s ON s.host = r.h LEFT JOIN {_allowed('{urls}')} a ON a.url = r.url) y"""
)
def classify_fetch(t) -> DataFrame:
    rules, _, states = dc.parse_robots(t("robots"))
    return dc.classify_fetch(t("responses").drop("host"), t("allowed_hosts"), rules, states, agent=AGENT)


@query(
    """SELECT result_id, reason, CASE WHEN reason IS NULL AND status = 'SUCCEEDED' THEN CAST(strlen(text) AS BIGINT) END AS byte_size, CASE WHEN reason IS NULL AND status = 'SUCCEEDED' THEN sha256(text) END AS sha256 FROM (
 SELECT r.*, d.text, CASE WHEN s.source_id IS NULL THEN 'SOURCE_NOT_FOUND' WHEN r.requested_url <> s.location THEN 'URL_MISMATCH' WHEN r.status = 'SUCCEEDED' AND r.content_base64 = 'not base64!' THEN 'INVALID_BASE64' WHEN r.status = 'SUCCEEDED' AND coalesce(d.text, '') = '' THEN 'EMPTY_CONTENT' WHEN r.status = 'SUCCEEDED' AND strlen(d.text) > 5242880 THEN 'CONTENT_TOO_LARGE' END AS reason FROM {fetch_results} r JOIN {documents} d ON d.doc_id = r.result_id LEFT JOIN {sources} s ON s.source_id = r.source_id) x"""
)
def ingest_fetch_results(t) -> DataFrame:
    runs, snapshots, rejects = dc.ingest_fetch_results(t("fetch_results"), t("sources"))
    ok = runs.select("result_id", F.lit(None).cast("string").alias("reason")).join(snapshots.select("result_id", "byte_size", "sha256"), "result_id", "left")
    return ok.unionByName(rejects.select("result_id", "reason", F.lit(None).cast("long").alias("byte_size"), F.lit(None).cast("string").alias("sha256")))


_SECURE = "regexp_replace(url, '^http://', 'https://')"
_PLACED = f"(SELECT page_id, host, page_id // 1000 AS part, url, '<url><loc> ' || replace(url, '&', '&amp;') || '</loc></url>' AS loc FROM (SELECT page_id, url, {_H} AS host FROM (SELECT page_id, {_SECURE} AS url FROM {{urls}}) a) b WHERE {_CANONICAL} IS NOT NULL)"


def _placed(t) -> DataFrame:
    """Pages with a URL that a site may list, each in a part of its host's sitemap: a part holds the pages of a thousand ids."""
    urls = t("urls").select("page_id", F.regexp_replace("url", "^http://", "https://").alias("url"))
    loc = F.concat(F.lit("<url><loc> "), F.replace(C("url"), F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    fine = urls.where(E.canonical_url(C("url")).isNotNull())
    return fine.select("page_id", E.host(C("url")).alias("host"), F.floor(C("page_id") / 1000).alias("part"), "url", loc.alias("loc"))


def _sitemaps(t) -> DataFrame:
    """A sitemap a host and part, an index a host, and broken ones for hosts of some lengths."""
    parts = _placed(t).groupBy("host", "part").agg(F.array_join(F.array_sort(F.collect_list("loc")), "").alias("locs"))
    own = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "locs", F.lit("</urlset>"))
    body = F.when(F.length("host") % 6 == 0, F.lit("<urlset>")).otherwise(own)
    leaves = parts.select("host", "part", F.concat(F.lit("https://"), "host", F.lit("/s/"), C("part").cast("string"), F.lit(".xml")).alias("url"), body.alias("body"))
    entry = F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>"))
    index = leaves.groupBy("host").agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.array_sort(F.collect_list(entry)), ""), F.lit("</sitemapindex>")).alias("body"))
    return leaves.select("url", "body").unionByName(index.select(F.concat(F.lit("https://"), "host", F.lit("/s.xml")).alias("url"), "body"))


@query(
    f"""SELECT 'https://' || host || '/s/' || part || '.xml' AS url, length(host) % 6 <> 0 AS valid, CASE WHEN length(host) % 6 <> 0 THEN FALSE END AS is_index, CASE WHEN length(host) % 6 <> 0 THEN string_agg(url, ' ' ORDER BY loc) END AS locations FROM {_PLACED} p GROUP BY host, part
 UNION ALL SELECT 'https://' || host || '/s.xml', TRUE, TRUE, string_agg(DISTINCT 'https://' || host || '/s/' || part || '.xml', ' ' ORDER BY 'https://' || host || '/s/' || part || '.xml') FROM {_PLACED} q GROUP BY host"""
)
def parse_sitemap(t) -> DataFrame:
    return dc.parse_sitemap(_sitemaps(t)).withColumn("locations", F.array_join("locations", " "))


_RUNS = f"(SELECT host, min(page_id) AS run_id, count(DISTINCT part) AS parts, count(*) AS n FROM {_PLACED} p GROUP BY host)"
_LISTED = f"(SELECT DISTINCT host, {_CANONICAL} AS url FROM {_PLACED} p)"
_ROOTS = f"(SELECT 'https://' || host || '/s.xml' AS url FROM {_RUNS} r UNION ALL SELECT DISTINCT 'https://' || host || '/s/' || part || '.xml' FROM {_PLACED} p)"
_JUDGED = f"""(SELECT r.run_id, r.host, CASE WHEN r.host NOT IN (SELECT host FROM {{allowed_hosts}}) THEN 'REDIRECT_POLICY_REJECTED' WHEN NOT coalesce(a.allowed, TRUE) THEN 'ROBOTS_DENIED' WHEN r.parts > 19 THEN 'DISCOVERY_LIMIT_EXCEEDED' WHEN d.denied THEN 'ROBOTS_DENIED' WHEN length(r.host) % 6 = 0 THEN 'SITEMAP_INVALID' WHEN r.n > 1000 THEN 'DISCOVERY_LIMIT_EXCEEDED' END AS code FROM {_RUNS} r
 LEFT JOIN {_allowed(_ROOTS)} a ON a.url = 'https://' || r.host || '/s.xml' LEFT JOIN (SELECT regexp_extract(url, '://([^/]*)', 1) AS host, bool_or(NOT allowed) AS denied FROM {_allowed(_ROOTS)} b WHERE url LIKE '%/s/%' GROUP BY 1) d ON d.host = r.host)"""


@query(f"SELECT j.run_id, l.url, CAST(NULL AS VARCHAR) AS error_code FROM {_JUDGED} j JOIN {_LISTED} l ON l.host = j.host JOIN {_allowed(_LISTED)} a ON a.url = l.url AND a.allowed WHERE j.code IS NULL UNION ALL SELECT run_id, NULL, code FROM {_JUDGED} j WHERE code IS NOT NULL")
def expand_sitemaps(t) -> DataFrame:
    """A run a host, from its index on, with the allow-list and robots rules in force."""
    roots = _placed(t).groupBy("host").agg(F.min("page_id").alias("run_id")).select("run_id", F.concat(F.lit("https://"), "host", F.lit("/s.xml")).alias("url"))
    return dc.expand_sitemaps(_sitemaps(t), roots, hosts=t("allowed_hosts"), rules=dc.parse_robots(t("robots"))[0], agent=AGENT)

"""Site discovery and fetch classification over stored crawl tables."""

from __future__ import annotations

from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import exprs as E
from factloom.sources.storage import bounded_batches, settled

from . import relational as rel
from .url_scores import ordered_scores, url_scores

#: Kinds of content that are stored.
SUPPORTED = ["application/json", "application/pdf", "application/xml", "text/html", "text/plain", "text/xml"]


def _directives(robots: DataFrame) -> DataFrame:
    """A row a line: host, n, name and value of the directive, whether it is malformed."""
    lines = robots.select("host", F.posexplode(F.split("body", "\r\n?|\n")).alias("n", "raw"))
    line = lines.select("host", "n", E.strip(F.regexp_replace("raw", "#.*$", "")).alias("line"))
    name = F.lower(E.strip(F.split_part("line", F.lit(":"), F.lit(1))))
    value = E.strip(F.regexp_replace("line", "^[^:]*:", ""))
    bad = (F.col("line") != "") & (~F.contains("line", F.lit(":")) | ~name.rlike("^[a-z][a-z0-9-]*$"))
    return line.select("host", "n", F.when(F.contains("line", F.lit(":")), name).alias("name"), value.alias("value"), bad.alias("bad"))


def parse_robots(robots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """robots: host, body. Rules (host, agent, rule_order, allow, prefix), sitemaps (host, location) and states (host, valid).

    An agent line after a line that is none opens a group; each of its rules counts for all agents of the group. A file
    with a malformed directive, or that names no agent, is invalid and has no rules.
    """
    lines = _directives(robots)
    states = lines.groupBy("host").agg((F.max("bad").eqNullSafe(False) & F.coalesce(F.max(F.col("name") == "user-agent"), F.lit(False))).alias("valid"))
    good = lines.where("name is not null").join(states.where("valid").select("host").hint("merge"), "host")
    w = Window.partitionBy("host").orderBy("n")
    agent = F.col("name") == "user-agent"
    opened = good.withColumn("opens", agent & ~F.coalesce(F.lag("name").over(w) == "user-agent", F.lit(False)))
    grouped = opened.withColumn("group_id", F.sum(F.col("opens").cast("int")).over(w))
    agents = grouped.where(agent).select("host", "group_id", F.lower("value").alias("agent"))
    rules = grouped.where("name in ('allow', 'disallow') and group_id > 0").select("host", "group_id", F.col("n").alias("rule_order"), ((F.col("name") == "allow") | (F.col("value") == "")).alias("allow"), F.col("value").alias("prefix"))
    sitemaps = good.where("name = 'sitemap' and value <> ''").select("host", F.col("value").alias("location"))
    return agents.join(rules.hint("merge"), ["host", "group_id"]).select("host", "group_id", "agent", "rule_order", "allow", "prefix"), sitemaps, states


def robots_filter(urls: DataFrame, rules: DataFrame, *, agent: str) -> DataFrame:
    """url, allowed: the first rule in file order whose prefix the path and query begin with; without one, allowed.

    The agent's rules are those of the first group that names part of it, else of the group for all.
    """
    own = F.lit(agent.split("/")[0].lower())
    mine = rules.where((F.col("agent") == "*") | F.contains(own, F.col("agent")))
    best = F.struct((F.col("agent") == "*").alias("any"), F.col("group_id").alias("group_id"))
    chosen = mine.groupBy("host").agg(F.min(best).alias("best")).select("host", F.col("best.group_id").alias("group_id"))
    used = mine.join(chosen.hint("merge"), ["host", "group_id"]).select("host", F.struct("rule_order", "allow", "prefix").alias("rule")).distinct()
    listed = settled(used.groupBy("host").agg(F.array_sort(F.collect_list("rule")).alias("rules")))  # a host's rules are lines of one bounded file
    path = F.regexp_extract("url", r"^[^:]+://[^/?#]*([^#]*)", 1)
    target = urls.select("url").distinct().select("url", E.host(F.col("url")).alias("host"), F.when(path == "", "/").otherwise(path).alias("path"))
    first = F.get(F.filter("rules", lambda r: (r["prefix"] == "*") | F.startswith(F.col("path"), r["prefix"])), F.lit(0))
    return target.join(listed.hint("merge"), "host", "left").select("url", F.coalesce(first["allow"], F.lit(True)).alias("allowed"))


def allowlist_membership(urls: DataFrame, hosts: DataFrame) -> DataFrame:
    return urls.withColumn("host", E.host(F.col("url"))).join(hosts.select("host").distinct(), "host", "left_semi")


def frontier_filter(urls: DataFrame, hosts: DataFrame, rules: DataFrame, *, agent: str) -> DataFrame:
    """Canonical URLs, each once, that policy, allow-list and robots rules let through."""
    canonical = urls.select(E.canonical_url(F.col("url")).alias("url")).where("url is not null").distinct()
    return allowlist_membership(canonical, hosts).select("url").join(robots_filter(canonical, rules, agent=agent).where("allowed").hint("merge"), "url").select("url")


def scored_urls(urls: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, url and score (how many of the query's tokens the URL holds) wherever there is one, in order of query, best score and URL."""
    return ordered_scores(urls, queries)


def discover_candidates(urls: DataFrame, queries: DataFrame, *, k: int = 50) -> DataFrame:
    """query_id, position, location, score: the k best URLs of each query by score and then URL. A task hands on k a query at most."""
    best = rel.top_of(url_scores(urls, queries, k=k), "query_id", [F.desc("score"), "url"], k)
    return rel.numbered(best, "query_id", [F.desc("score"), "url"]).select("query_id", "position", F.col("url").alias("location"), "score")


def limit_gate(counts: DataFrame, limits: dict[str, int]) -> DataFrame:
    """counts: a row a run with a column a limit. The first limit, in order, that a run exceeds; none is cut short."""
    code = F.lit(None).cast("string")
    for name, limit in reversed(limits.items()):
        code = F.when(F.col(name) > limit, F.lit(name.upper() + "_LIMIT")).otherwise(code)
    return counts.withColumn("error_code", code)


def classify_fetch(responses: DataFrame, hosts: DataFrame, rules: DataFrame, states: DataFrame, *, agent: str) -> DataFrame:
    """response_id, status and error_code of stored responses, by the first rule that fails."""
    allowed = hosts.select("host").distinct().withColumn("listed", F.lit(True))
    own = responses.withColumn("host", E.host(F.col("requested_url"))).join(allowed.hint("merge"), "host", "left").join(states.hint("merge"), "host", "left")
    verdicts = robots_filter(responses.select(F.col("requested_url").alias("url")), rules, agent=agent)
    own = own.join(verdicts.hint("merge"), F.col("requested_url") == F.col("url"), "left")
    code = (
        F.when(~E.url_policy(F.col("requested_url")) | F.col("listed").isNull(), "FETCH_URL_POLICY")
        .when(F.col("valid").isNull(), "FETCH_ROBOTS_UNAVAILABLE")
        .when(~F.col("valid"), "FETCH_ROBOTS_INVALID")
        .when(~F.col("allowed"), "FETCH_ROBOTS_DENIED")
        .when(~F.col("http_status").between(200, 299), "FETCH_HTTP_STATUS")
        .when(~E.media_type(F.col("content_type")).isin(SUPPORTED), "FETCH_UNSUPPORTED_CONTENT_TYPE")
        .when(F.length("body") == 0, "FETCH_EMPTY_CONTENT")
    )
    return own.select("response_id", code.alias("error_code")).withColumn("status", F.when(F.col("error_code").isNull(), "SUCCEEDED").otherwise("FAILED"))


def ingest_fetch_results(results: DataFrame, sources: DataFrame, *, max_bytes: int = 5_242_880) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs, snapshots and rejects (with a reason) of recorded fetch results."""
    own = results.join(sources.select("source_id", "location"), "source_id", "left").withColumn("content", E.decoded_base64(F.col("content_base64")))
    succeeded = F.col("status") == "SUCCEEDED"
    reason = (
        F.when(F.col("location").isNull(), "SOURCE_NOT_FOUND")
        .when(F.col("requested_url") != F.col("location"), "URL_MISMATCH")
        .when(succeeded & F.col("content").isNull(), "INVALID_BASE64")
        .when(succeeded & (F.octet_length("content") == 0), "EMPTY_CONTENT")
        .when(succeeded & (F.octet_length("content") > max_bytes), "CONTENT_TOO_LARGE")
    )
    judged = own.withColumn("reason", reason)
    runs = judged.where("reason is null").select("result_id", "source_id", "requested_url", "status")
    snapshots = judged.where("reason is null and status = 'SUCCEEDED'").select("result_id", "source_id", F.octet_length("content").cast("long").alias("byte_size"), F.sha2("content", 256).alias("sha256"))
    return runs, snapshots, judged.where("reason is not null").select("result_id", "source_id", "reason")


_SITEMAP = T.StructType([T.StructField("is_index", T.BooleanType()), T.StructField("locations", T.ArrayType(T.StringType()))])


def _read_sitemap(body: str | None):
    if body is None or "<!DOCTYPE" in body.upper() or "<!ENTITY" in body.upper():
        return None
    try:
        root = ElementTree.fromstring(body)
    except (ElementTree.ParseError, ValueError):
        return None
    name = root.tag.rpartition("}")[2]
    if name not in ("urlset", "sitemapindex"):
        return None
    found = [(e.text or "").strip() for e in root.iter() if e.tag.rpartition("}")[2] == "loc"]
    return {"is_index": name == "sitemapindex", "locations": [x for x in found if x]}


@F.pandas_udf(_SITEMAP)
def _sitemap(bodies: pd.Series) -> pd.DataFrame:
    read = [_read_sitemap(x) or {"is_index": None, "locations": None} for x in bodies]
    return pd.DataFrame({"is_index": [x["is_index"] for x in read], "locations": [x["locations"] for x in read]})


def parse_sitemap(crawl: DataFrame) -> DataFrame:
    """url, valid, is_index and locations of stored sitemaps (url, body)."""
    bounded_batches(crawl.sparkSession)
    return crawl.select("url", _sitemap("body").alias("s")).select("url", F.col("s.is_index").isNotNull().alias("valid"), F.col("s.is_index").alias("is_index"), F.col("s.locations").alias("locations"))


def expand_sitemaps(crawl: DataFrame, roots: DataFrame, *, hosts: DataFrame | None = None, rules: DataFrame | None = None, agent: str = "FactBot/1.0", max_docs: int = 20, max_urls: int = 1_000) -> DataFrame:
    """roots: run_id, url. Locations (run_id, url) of each run's sitemaps, breadth first, and runs that failed (url null, error_code).

    All that a run meets must be of its root's host (and of hosts, if given) in canonical form, and its documents open by
    robots rules, if given; locations that these close are left out. A run fails on a document that is missing or
    invalid, one that it meets twice, more than max_docs of them, or more than max_urls locations. Of failures in
    several rounds the first counts, of those in one round the first by name. There are at most max_docs rounds, each
    stored.
    """
    docs = settled(parse_sitemap(crawl))
    canonical = E.canonical_url(F.col("url"))
    sites = roots.select("run_id", E.host(F.col("url")).alias("site"))
    if hosts is not None:
        sites = sites.join(hosts.select(F.col("host").alias("site")).distinct().hint("merge"), "site", "left_semi")
    sites = settled(sites)
    reached = lambda df: df.join(sites.hint("merge"), "run_id", "left").withColumn("url", F.when(E.host(F.col("url")) == F.col("site"), canonical)).drop("site")
    none = "run_id long, error_code string, round int"
    frontier, leaves, failed = reached(roots.select("run_id", "url")), [], crawl.sparkSession.createDataFrame([], none)
    seen = frontier.where("url is not null")
    for k in range(max_docs):
        opened = frontier.join(docs.hint("merge"), "url", "left")
        if rules is not None:
            opened = opened.join(robots_filter(frontier.where("url is not null"), rules, agent=agent).hint("merge"), "url", "left")
        else:
            opened = opened.withColumn("allowed", F.lit(True))
        code = F.when(F.col("url").isNull(), "REDIRECT_POLICY_REJECTED").when(~F.col("allowed"), "ROBOTS_DENIED").when(F.col("valid").isNull(), "SITEMAP_UNAVAILABLE").when(~F.col("valid"), "SITEMAP_INVALID")
        opened = settled(opened.withColumn("error_code", code))
        inside = opened.where("error_code is null").select("run_id", "is_index", F.explode("locations").alias("url"))
        listed = settled(reached(inside.withColumnRenamed("url", "given").withColumn("url", F.col("given"))))
        outside = listed.where("url is null").select("run_id", F.lit("REDIRECT_POLICY_REJECTED").alias("error_code"))
        following = listed.where("is_index and url is not null").select("run_id", "url")
        seen = settled(seen.select("run_id", "url").unionByName(following))
        over = seen.groupBy("run_id").agg(F.count("*").alias("n"), F.count_distinct("url").alias("d")).where((F.col("n") > max_docs) | (F.col("n") > F.col("d"))).select("run_id", F.lit("DISCOVERY_LIMIT_EXCEEDED").alias("error_code"))
        now = opened.where("error_code is not null").select("run_id", "error_code").unionByName(outside).unionByName(over)
        failed = settled(failed.unionByName(now.withColumn("round", F.lit(k))))
        leaves.append(listed.where("not is_index and url is not null").select("run_id", "url"))
        frontier = settled(following.join(failed.select("run_id").distinct().hint("merge"), "run_id", "left_anti"))
        if frontier.isEmpty():
            break
    found = reduce(DataFrame.unionByName, leaves)
    many = found.groupBy("run_id").count().where(F.col("count") > max_urls).select("run_id", F.lit("DISCOVERY_LIMIT_EXCEEDED").alias("error_code"), F.lit(max_docs).alias("round"))
    first = settled(failed.unionByName(many).groupBy("run_id").agg(F.min(F.struct("round", "error_code"))["error_code"].alias("error_code")))
    kept = found.distinct().join(first.select("run_id").hint("merge"), "run_id", "left_anti")
    if rules is not None:
        kept = kept.join(robots_filter(kept, rules, agent=agent).where("allowed").select("url").hint("merge"), "url", "left_semi")
    none_failed = F.lit(None).cast("string")
    return kept.select("run_id", "url", none_failed.alias("error_code")).unionByName(first.select("run_id", none_failed.alias("url"), "error_code"))

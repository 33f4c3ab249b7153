"""Queries on scalar functions, extraction and chunks."""

from __future__ import annotations

import html
from html.entities import html5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import exprs as E
from factloom.functions.registry import register_functions as register
from factloom.operators import text as tx
from factloom.sources.chunk_sql import chunk_sql as _chunks
from factloom.sources.storage import shared_folder

from .registry import query

C = F.col


@query("SELECT id, sha256(text) AS sha FROM {texts}")
def fn_sha256(t) -> DataFrame:
    return t("texts").select("id", E.sha256_hex(C("text")).alias("sha"))


_BASE64 = "regexp_full_match(content_base64, '([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?')"


@query("SELECT result_id, CASE WHEN ok THEN 'decoded:' || decode(from_base64(CASE WHEN ok THEN content_base64 ELSE '' END)) ELSE 'refused' END AS payload, base64(encode(requested_url)) AS encoded FROM (SELECT *, " + _BASE64 + " AS ok FROM {fetch_results}) x")
def fn_base64(t) -> DataFrame:
    decoded = E.decoded_base64(C("content_base64")).cast("string")
    return t("fetch_results").select("result_id", F.coalesce(F.concat(F.lit("decoded:"), decoded), F.lit("refused")).alias("payload"), E.encoded_base64(C("requested_url").cast("binary")).alias("encoded"))


@query("SELECT response_id, lower(trim(split_part(content_type, ';', 1))) AS media FROM {responses}")
def fn_media_type(t) -> DataFrame:
    return t("responses").select("response_id", E.media_type(C("content_type")).alias("media"))


_HOST = "rtrim(lower(regexp_replace(regexp_replace(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '.')"
_VALID = "(length({h}) <= 253 AND {h} LIKE '%.%' AND regexp_full_match({h}, '([\\p{{L}}\\p{{N}}]([\\p{{L}}\\p{{N}}-]{{0,61}}[\\p{{L}}\\p{{N}}])?)(\\.[\\p{{L}}\\p{{N}}]([\\p{{L}}\\p{{N}}-]{{0,61}}[\\p{{L}}\\p{{N}}])?)*') AND NOT regexp_full_match({h}, '[0-9]+(\\.[0-9]+){{3}}'))"
_H = _HOST.format(u="url")


def _odd_urls(t) -> DataFrame:
    """The pages' URLs and variants of them that exercise the rules."""
    u = C("url")
    variants = F.array(u, F.upper(u), F.regexp_replace(u, "^http://", "https://"), F.regexp_replace(u, "://([^/]+)", "://$1.:443"), F.regexp_replace(u, "://", "://u:p@"), F.regexp_replace(u, "://[^/]+", "://10.0.0.1"), F.regexp_replace(u, "^(https?://[^/]+).*$", "$1"), F.concat(u, F.lit(" x")), F.regexp_replace(u, "://", "://-"))
    return t("urls").select("page_id", F.posexplode(variants).alias("variant", "url"))


_ODD = """(SELECT page_id, v.variant, v.url FROM {urls} u, LATERAL (VALUES (0, u.url), (1, upper(u.url)), (2, regexp_replace(u.url, '^http://', 'https://')), (3, regexp_replace(u.url, '://([^/]+)', '://\\1.:443')), (4, replace(u.url, '://', '://u:p@')), (5, regexp_replace(u.url, '://[^/]+', '://10.0.0.1')), (6, regexp_replace(u.url, '^(https?://[^/]+).*$', '\\1')), (7, u.url || ' x'), (8, replace(u.url, '://', '://-'))) v(variant, url))"""


@query(f"SELECT page_id, variant, {_H} AS host FROM {_ODD} x")
def fn_host(t) -> DataFrame:
    return _odd_urls(t).select("page_id", "variant", E.host(C("url")).alias("host"))


@query(f"SELECT page_id, variant, {_VALID.format(h='host')} AS valid FROM (SELECT page_id, variant, {_H} AS host FROM {_ODD} x) y")
def fn_valid_hostname(t) -> DataFrame:
    return _odd_urls(t).select("page_id", "variant", E.valid_hostname(E.host(C("url"))).alias("valid"))


@query(f"SELECT page_id, variant, CASE WHEN regexp_full_match(url, '(?i)https://[^/?#@]+/?') AND url NOT LIKE '% %' AND {_VALID.format(h='host')} THEN 'https://' || host END AS origin FROM (SELECT page_id, variant, url, {_H} AS host FROM {_ODD} x) y")
def fn_canonical_origin(t) -> DataFrame:
    return _odd_urls(t).select("page_id", "variant", E.canonical_origin(C("url")).alias("origin"))


_CANONICAL = f"""CASE WHEN regexp_matches(url, '^(?i)https://') AND url NOT LIKE '% %' AND url NOT LIKE '%@%' AND {_VALID.format(h='host')} THEN 'https://' || host
 || CASE WHEN regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) END
 || CASE WHEN regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&')), '&') END END"""


@query(f"SELECT page_id, variant, {_CANONICAL} AS canonical FROM (SELECT page_id, variant, url, {_H} AS host FROM {_ODD} x) y")
def fn_canonical_url(t) -> DataFrame:
    return _odd_urls(t).select("page_id", "variant", E.canonical_url(C("url")).alias("canonical"))


@query("SELECT query_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+'))), ',') AS tokens FROM {queries}")
def fn_tokens(t) -> DataFrame:
    return t("queries").select("query_id", F.array_join(F.array_sort(E.search_tokens(C("query"))), ",").alias("tokens"))


@query("SELECT u.page_id, q.query_id, CAST(len(list_filter(list_distinct(regexp_extract_all(lower(q.query), '[a-z0-9]+')), lambda x: contains(lower(u.url), x))) AS BIGINT) AS score FROM {urls} u JOIN {asked} a ON a.page_id = u.page_id JOIN {queries} q ON q.query_id = a.query_id")
def fn_relevance_score(t) -> DataFrame:
    pairs = t("urls").join(t("asked"), "page_id").join(t("queries"), "query_id")
    return pairs.select("page_id", "query_id", E.relevance_score(E.search_tokens(C("query")), C("url")).cast("long").alias("score"))


_MESSY = "replace(replace(text, '. ', chr(9) || chr(13) || chr(10)), ', ', chr(160) || chr(8203) || chr(10) || chr(10) || chr(10) || chr(10)) || '  ' || chr(10)"
_CLEAN = "replace(replace(replace(replace(nfc_normalize({x}), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' '), chr(9), ' ')"
_NORMAL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + _CLEAN + ", '[\\x00-\\x09\\x0B-\\x1F\\x7F-\\x9F]|\\p{{Cf}}', '', 'g'), '(?m) +$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def _messy() -> F.Column:
    x = F.replace(F.replace(C("text"), F.lit(". "), F.lit("\t\r\n")), F.lit(", "), F.lit(" ​\n\n\n\n"))
    return F.concat(x, F.lit("  \n"))


@query(f"SELECT id, CASE WHEN n = '' THEN '' ELSE n || chr(10) END AS normalized FROM (SELECT id, {_NORMAL.format(x=_MESSY)} AS n FROM {{texts}}) x")
def fn_normalize_text(t) -> DataFrame:
    return t("texts").select("id", E.normalized_text(_messy()).alias("normalized"))


@query("SELECT id, substr(text, 6, 37) AS slice FROM {texts}")
def fn_codepoint_slice(t) -> DataFrame:
    return t("texts").select("id", E.codepoint_slice(C("text"), F.lit(5), F.lit(42)).alias("slice"))


@query("SELECT execution_id, regexp_matches(output_text, '[^\\s]') AS any_blank, trim(output_text, ' ') <> '' AS spaces, regexp_matches(output_text, '\\S') AS ascii_blank FROM {executions}")
def fn_non_blank(t) -> DataFrame:
    x = C("output_text")
    return t("executions").select("execution_id", E.non_blank(x, "unicode").alias("any_blank"), E.non_blank(x, "spaces").alias("spaces"), E.non_blank(x, "ascii").alias("ascii_blank"))


@query("SELECT id, regexp_full_match(CASE WHEN id % 3 = 0 THEN sha256(text) WHEN id % 3 = 1 THEN upper(sha256(text)) ELSE md5(text) END, '[0-9a-f]{64}') AS ok FROM {texts}")
def fn_hex64(t) -> DataFrame:
    x = F.when(C("id") % 3 == 0, F.sha2("text", 256)).when(C("id") % 3 == 1, F.upper(F.sha2("text", 256))).otherwise(F.md5("text"))
    return t("texts").select("id", E.is_hex64(x).alias("ok"))


@query("SELECT execution_id, regexp_full_match(model_id, '[a-z][a-z0-9_.-]*') AS key_ok, regexp_full_match(provider_error, '[A-Z][A-Z0-9_]*') AS code_ok, regexp_full_match(cost_currency, '[A-Z]{3}') AS currency_ok FROM {executions}")
def fn_key_patterns(t) -> DataFrame:
    return t("executions").select("execution_id", E.key_pattern(C("model_id"), "provider_key").alias("key_ok"), E.key_pattern(C("provider_error"), "error_code").alias("code_ok"), E.key_pattern(C("cost_currency"), "currency").alias("currency_ok"))


@query("SELECT execution_id, CASE WHEN regexp_full_match(provider_cost, '(0|[1-9][0-9]{0,11})([.][0-9]{1,6})?') THEN CAST(provider_cost AS DECIMAL(18,6)) END AS cost FROM {executions}")
def fn_cost(t) -> DataFrame:
    return t("executions").select("execution_id", E.cost(C("provider_cost")).alias("cost"))


@query("SELECT id, nullif(substr(trim(regexp_replace(text, '[^ -~]', '', 'g'), ' '), 1, 100), '') AS bounded FROM {texts}")
def fn_bounded(t) -> DataFrame:
    return t("texts").select("id", E.bounded(C("text"), 100).alias("bounded"))


@query("SELECT chunk_id, 'source-snapshot:' || run_id || '#chunk=' || chunk_id || '&chars=' || position || '-' || (position + 7) AS reference FROM {chunks}")
def fn_location_reference(t) -> DataFrame:
    return t("chunks").select("chunk_id", E.location_reference(C("run_id"), C("chunk_id"), C("position"), C("position") + 7).alias("reference"))


@query("SELECT option_id, chr(CAST(65 + position % 26 AS INTEGER)) AS label FROM {options}")
def fn_option_label(t) -> DataFrame:
    return t("options").select("option_id", E.option_label(C("position") % 26).alias("label"))


@query("SELECT execution_id, CASE WHEN input_tokens < 0 THEN 0 ELSE input_tokens * 1000 + 3 END AS ms FROM {executions}")
def fn_duration_ms(t) -> DataFrame:
    begin = C("started_at").cast("timestamp")
    end = F.timestamp_micros(F.unix_micros(begin) + C("input_tokens") * 1_000_000 + 3_400)
    return t("executions").select("execution_id", E.duration_ms(begin, end).alias("ms"))


@query("SELECT execution_id, input_tokens BETWEEN 0 AND 2147483647 AND output_tokens BETWEEN 0 AND 2147483647 AND total_tokens BETWEEN 0 AND 2147483647 AND total_tokens = input_tokens + output_tokens AS ok FROM {executions}")
def fn_token_total(t) -> DataFrame:
    return t("executions").select("execution_id", E.token_usage_valid(C("input_tokens"), C("output_tokens"), C("total_tokens")).alias("ok"))


@query("SELECT id, length(r) BETWEEN 1 AND 100 AND trim(r) = r AND NOT regexp_matches(r, '[\\x00-\\x1f\\x7f]') AS ok FROM (SELECT id, CASE id % 4 WHEN 0 THEN 'request ' || id WHEN 1 THEN ' request' WHEN 2 THEN substr(text, 1, 120) ELSE 'a' || chr(9) || 'b' END AS r FROM {texts}) x")
def fn_request_id_valid(t) -> DataFrame:
    r = F.when(C("id") % 4 == 0, F.concat(F.lit("request "), C("id").cast("string"))).when(C("id") % 4 == 1, " request").when(C("id") % 4 == 2, F.substring("text", 1, 120)).otherwise("a\tb")
    return t("texts").select("id", E.request_id_valid(r).alias("ok"))


@query("SELECT document_id, 'content-document-' || document_id || '.pdf' AS filename, title FROM {stored_documents}")
def fn_artifact_name(t) -> DataFrame:
    return t("stored_documents").select("document_id", E.artifact_name(C("document_id")).alias("filename"), F.concat(F.lit("Content Package "), C("package_id").cast("string")).alias("title"))


@query(f"SELECT * FROM {_chunks('{texts}')} x")
def chunk_text(t) -> DataFrame:
    return tx.chunk_text(t("texts"))


@query(f"SELECT id, CASE WHEN strpos(text, '%') > 0 THEN 'RANGE' WHEN strpos(text, '@') > 0 THEN 'TEXT' ELSE 'HASH' END AS reason, CAST(position AS BIGINT) AS position FROM {_chunks('{texts}')} x WHERE strpos(text, '%') > 0 OR strpos(text, '@') > 0 OR strpos(text, '|') > 0")
def chunk_integrity(t) -> DataFrame:
    """Chunks against texts whose at-signs were changed since: with hashes that missed a change of bars, and places lost where a percent sign stands."""
    chunks = tx.chunk_text(t("texts"))
    broken = chunks.withColumns({"char_end": F.when(F.contains("text", F.lit("%")), C("char_start")).otherwise(C("char_end")), "sha256": F.sha2(F.translate("text", "|", "/"), 256)})
    return tx.chunk_integrity(broken, t("texts").withColumn("text", F.translate("text", "@", "#"))).select("id", "reason", C("position").cast("long").alias("position"))


_LOST = f"(SELECT *, lead(char_start) OVER (PARTITION BY id ORDER BY position) AS following, row_number() OVER (PARTITION BY id ORDER BY position) - 1 AS place FROM {_chunks('{texts}')} x WHERE strpos(text, '@') = 0)"


@query(f"SELECT id, n_chunks, breaks, breaks = 0 AND first = 0 AND last = length(text) AS continuous FROM (SELECT id, count(*) AS n_chunks, count(*) FILTER (WHERE position <> place OR (following IS NOT NULL AND following <> char_end AND following <> char_end - 100)) AS breaks, min(char_start) AS first, max(char_end) AS last FROM {_LOST} l GROUP BY id) p JOIN {{texts}} t USING (id)")
def chunk_continuity(t) -> DataFrame:
    """Chunks of a store that lost those with an at-sign."""
    kept = tx.chunk_text(t("texts")).where(~F.contains("text", F.lit("@")))
    return tx.chunk_continuity(kept, t("texts").select("id", F.length("text").alias("n")))


def _plain(t) -> DataFrame:
    content = F.concat(F.when(C("doc_id") % 9 == 0, F.unhex(F.lit("EFBBBF"))).otherwise(F.lit("").cast("binary")), F.when(C("doc_id") % 8 == 0, F.unhex(F.lit("FF"))).otherwise(F.lit("").cast("binary")), F.when(C("doc_id") % 7 == 0, F.lit(" ")).otherwise(C("text")).cast("binary"))
    kind = F.when(C("doc_id") % 6 == 5, "application/pdf").otherwise("text/plain")
    return t("documents").where("text is not null").select(C("doc_id").alias("snapshot_id"), kind.alias("content_type"), content.alias("content"))


_RUNS = f"""(SELECT snapshot_id, content_type, CASE WHEN code IS NULL THEN 'SUCCEEDED' ELSE 'FAILED' END AS status, code AS error_code, CASE WHEN code IS NULL THEN n END AS text FROM (SELECT snapshot_id, content_type, n,
 CASE WHEN content_type <> 'text/plain' THEN 'EXTRACTION_UNSUPPORTED_CONTENT_TYPE' WHEN snapshot_id % 8 = 0 THEN 'EXTRACTION_INVALID_ENCODING' WHEN snapshot_id % 7 = 0 OR n = chr(10) THEN 'EXTRACTION_EMPTY_TEXT' END AS code FROM (
 SELECT doc_id AS snapshot_id, CASE WHEN doc_id % 6 = 5 THEN 'application/pdf' ELSE 'text/plain' END AS content_type, {_NORMAL.format(x='text')} || chr(10) AS n FROM {{documents}} WHERE text IS NOT NULL) a) b)"""


_LINES = "address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"
_BARE = f"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head>.*?</head>|<!--.*?-->', chr(1), 'g'), '(?i)</?({_LINES})(\\s[^>]*)?/?>', chr(10), 'g'), '<[^>]*>', chr(1), 'g')"


def _map(pairs: dict) -> str:
    quoted = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in pairs.items()) + "}"


#: HTML's rule of character references: numbers that do not stand for themselves, names that end with a semicolon, and those that count without one.
_ODD_NUMBERS = {n: text for n in (*range(0xA0), *range(0xFDD0, 0xFDF0), *(p * 0x10000 + x for p in range(17) for x in (0xFFFE, 0xFFFF))) if (text := html.unescape(f"&#{n};")) != chr(n)}
_NAMES = {name: text for name, text in html5.items() if name.endswith(";")}
_BARE_NAMES = {name: html5[name] for name in sorted(html5, key=lambda x: (-len(x), x)) if not name.endswith(";")}


def _numbered(n: str, form: str) -> str:
    return f"coalesce({_map(_ODD_NUMBERS)}[{n}], CASE WHEN {n} NOT BETWEEN 55296 AND 57343 AND {n} <= 1114111 THEN chr(CAST({n} AS INTEGER)) END, chr(65533)) || regexp_replace(p, '^#{form};?', '')"


_DECIMAL = _numbered("TRY_CAST(regexp_extract(p, '^#([0-9]+)', 1) AS BIGINT)", "[0-9]+")
_HEX = _numbered("TRY_CAST('0x' || regexp_extract(p, '^#[xX]([0-9a-fA-F]+)', 1) AS BIGINT)", "[xX][0-9a-fA-F]+")
_NAME, _BARE_NAME = "regexp_extract(p, '^[^\\t\\n\\f <&#;]{1,31};')", f"regexp_extract(p, '^({'|'.join(_BARE_NAMES)})')"
_REFERENCE = f"""CASE WHEN regexp_matches(p, '^#[0-9]') THEN {_DECIMAL} WHEN regexp_matches(p, '^#[xX][0-9a-fA-F]') THEN {_HEX} WHEN {_NAME} <> '' AND {_map(_NAMES)}[{_NAME}] IS NOT NULL THEN {_map(_NAMES)}[{_NAME}] || substr(p, length({_NAME}) + 1)
 WHEN {_BARE_NAME} <> '' THEN {_map(_BARE_NAMES)}[{_BARE_NAME}] || substr(p, length({_BARE_NAME}) + 1) ELSE '&' || p END"""
_UNESCAPED = f"replace(array_to_string(list_transform(string_split({_BARE}, '&'), lambda p, i: CASE WHEN i = 1 THEN p ELSE {_REFERENCE} END), ''), chr(1), '')"
_HTML_RUNS = f"(SELECT page_id AS snapshot_id, 'text/html' AS content_type, CASE WHEN n = '' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, CASE WHEN n = '' THEN 'EXTRACTION_EMPTY_TEXT' END AS error_code, CASE WHEN n <> '' THEN n || chr(10) END AS text FROM (SELECT page_id, {_NORMAL.format(x=_UNESCAPED)} AS n FROM {{pages}} WHERE html IS NOT NULL) h)"
_JSON_RUNS = "(SELECT event_id AS snapshot_id, 'application/json' AS content_type, 'SUCCEEDED' AS status, CAST(NULL AS VARCHAR) AS error_code, json_extract_string(props, '$.k') || chr(10) AS text FROM {events} WHERE props IS NOT NULL)"
#: What is no document: every third by its making, and those with characters, or the sign of an end, that XML does not have in a text.
_XML_BROKEN = "(option_id % 3 = 0 OR regexp_matches(option_text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFE}\\x{FFFF}]|\\]\\]>'))"
_XML_RUNS = f"(SELECT option_id AS snapshot_id, 'text/xml' AS content_type, CASE WHEN broken THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, CASE WHEN broken THEN 'EXTRACTION_INVALID_DOCUMENT' END AS error_code, CASE WHEN NOT broken THEN n || chr(10) END AS text FROM (SELECT option_id, {_XML_BROKEN} AS broken, {_NORMAL.format(x=chr(39) + 'x' + chr(39) + ' || option_text')} AS n FROM {{options}} WHERE option_text IS NOT NULL) o)"
_ALL_RUNS = "(" + " UNION ALL ".join(f"SELECT snapshot_id + {k} * 1000000000000 AS snapshot_id, content_type, status, error_code, text FROM {runs} r{k}" for k, runs in enumerate((_RUNS, _HTML_RUNS, _JSON_RUNS, _XML_RUNS))) + ")"


def _html(t) -> DataFrame:
    return t("pages").where("html is not null").select(C("page_id").alias("snapshot_id"), F.lit("text/html").alias("content_type"), C("html").cast("binary").alias("content"))


def _json(t) -> DataFrame:
    return t("events").where("props is not null").select(C("event_id").alias("snapshot_id"), F.lit("application/json").alias("content_type"), C("props").cast("binary").alias("content"))


def _xml(t) -> DataFrame:
    safe = F.replace(F.replace(C("option_text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.when(C("option_id") % 6 == 0, F.concat(F.lit("<!DOCTYPE r><r>"), safe, F.lit("</r>"))).when(C("option_id") % 3 == 0, F.lit("<broken>")).otherwise(F.concat(F.lit("<r>x<s>"), safe, F.lit("</s></r>")))
    return t("options").where("option_text is not null").select(C("option_id").alias("snapshot_id"), F.lit("text/xml").alias("content_type"), body.cast("binary").alias("content"))


def _snapshots(t) -> DataFrame:
    """Documents, pages, event properties and options as snapshots of their kinds, with ids of their own."""
    every = [df.withColumn("snapshot_id", C("snapshot_id") + F.lit(k * 1_000_000_000_000)) for k, df in enumerate((_plain(t), _html(t), _json(t), _xml(t)))]
    return every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])


@query(f"SELECT snapshot_id, content_type, status, error_code, text, CAST(length(text) AS BIGINT) AS text_char_count, sha256(text) AS text_sha256 FROM {_ALL_RUNS} r")
def extract_snapshots(t) -> DataFrame:
    runs, _ = tx.extract_snapshots(_snapshots(t))
    return runs.withColumn("text_char_count", C("text_char_count").cast("long"))


@query(f"SELECT id AS snapshot_id, position, char_start, char_end, sha256 FROM {_chunks(f'(SELECT snapshot_id AS id, text FROM {_ALL_RUNS} r WHERE text IS NOT NULL) s')} x")
def extraction_sink(t) -> DataFrame:
    _, chunks = tx.store_extraction(_snapshots(t), shared_folder(t.spark))
    return chunks.select("snapshot_id", "position", "char_start", "char_end", "sha256")


def _extracted(snapshots: DataFrame) -> DataFrame:
    return tx.extract_snapshots(snapshots)[0].select("snapshot_id", "status", "error_code", "text")


@query(f"SELECT snapshot_id, status, error_code, text FROM {_RUNS} r WHERE content_type = 'text/plain'")
def extract_plain(t) -> DataFrame:
    return _extracted(_plain(t).where("content_type = 'text/plain'"))


@query(f"SELECT snapshot_id, status, error_code, text FROM {_HTML_RUNS} r")
def extract_html(t) -> DataFrame:
    return _extracted(_html(t))


@query(f"SELECT snapshot_id, status, error_code, text FROM {_JSON_RUNS} r")
def extract_json(t) -> DataFrame:
    return _extracted(_json(t))


@query(f"SELECT snapshot_id, status, error_code, text FROM {_XML_RUNS} r")
def extract_xml(t) -> DataFrame:
    return _extracted(_xml(t))


@query("SELECT doc_id AS id, sha256(text) AS sha, 'content-document-' || doc_id || '.pdf' AS filename FROM {documents} WHERE text IS NOT NULL")
def register_functions(t) -> DataFrame:
    register(t.spark)
    return t.spark.sql("SELECT doc_id AS id, fl_sha256(fl_slice(text, 0, length(text))) AS sha, fl_artifact_name(doc_id) AS filename FROM {d} WHERE text IS NOT NULL", d=t("documents"))

"""Engine tables over the test tables, each as one SELECT that Spark and the SQL oracle both run.

References to other tables stand in braces: base tables are Parquet files, the rest are entries of TABLES.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunk_sql import chunk_sql
from .storage import bounded_batches

#: Base tables, one Parquet each.
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations", "embeddings")

_TOPIC = "CASE {0} WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 WHEN 'es' THEN 4 ELSE 5 END"

TABLES: dict[str, str] = {
    # curriculum
    "exams": "SELECT CAST(n_nationkey AS BIGINT) AS exam_id, n_name AS name FROM {nation} UNION ALL SELECT CAST(25 AS BIGINT), 'WITHOUT PAPERS'",
    "papers": "SELECT o_orderkey AS paper_id, CAST(c_nationkey AS BIGINT) AS exam_id, CAST(year(o_orderdate) AS BIGINT) AS year FROM {orders} JOIN {customer} ON o_custkey = c_custkey",
    "questions": "SELECT l_orderkey AS paper_id, l_partkey AS topic_id, CAST(l_linenumber - 1 AS BIGINT) AS position FROM {lineitem}",
    "syllabus_pairs": "SELECT exam_id, topic_id, (topic_id + exam_id) % 3 = 0 AS covered FROM (SELECT p_partkey % 26 AS exam_id, p_partkey AS topic_id FROM {part} UNION SELECT p.exam_id, q.topic_id FROM {papers} p JOIN {questions} q ON q.paper_id = p.paper_id) x",
    "syllabus_topics": "SELECT x.exam_id AS syllabus_id, x.topic_id, p.p_name AS topic_name FROM {syllabus_pairs} x JOIN {part} p ON p.p_partkey = x.topic_id WHERE x.covered",
    # sources and knowledge
    "topics": "SELECT CAST(1 AS BIGINT) AS topic_id, 'English' AS name UNION ALL SELECT CAST(2 AS BIGINT), 'French' UNION ALL SELECT CAST(3 AS BIGINT), 'German' UNION ALL SELECT CAST(4 AS BIGINT), 'Spanish' UNION ALL SELECT CAST(5 AS BIGINT), 'Other' UNION ALL SELECT CAST(6 AS BIGINT), 'Unused'",
    "sources": "SELECT CAST(substr(source, 4) AS BIGINT) AS source_id, source AS name, 'https://' || source || '.example.org/data' AS location, CAST(substr(source, 4) AS BIGINT) % 4 + 1 AS tier FROM (SELECT DISTINCT source FROM {documents} WHERE source IS NOT NULL) s",
    "first_labels": "SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM {labels} GROUP BY doc_id",
    "claims": "SELECT d.doc_id AS claim_id, CAST("
    + _TOPIC.format("d.lang")
    + " AS BIGINT) AS topic_id, CASE WHEN instr(d.text, '.') > 0 THEN substr(d.text, 1, instr(d.text, '.')) ELSE d.text END AS statement, CASE WHEN l.toxic = 1 THEN 'REJECTED' WHEN l.quality = 1 THEN 'APPROVED' ELSE 'DRAFT' END AS approval_status FROM {documents} d LEFT JOIN {first_labels} l ON d.doc_id = l.doc_id",
    "evidence": "SELECT doc_id AS evidence_id, CAST(substr(source, 4) AS BIGINT) AS source_id, text AS content, 'document:' || CAST(doc_id AS VARCHAR(20)) AS location_reference FROM {documents}",
    "claim_evidence": "SELECT c.claim_id, e.evidence_id FROM {claims} c JOIN {evidence} e ON e.evidence_id = c.claim_id WHERE c.claim_id % 5 <> 0 UNION ALL SELECT c.claim_id, e.evidence_id FROM {claims} c JOIN {evidence} e ON e.evidence_id = c.claim_id + 3 WHERE c.claim_id % 2 = 0",
    "verifications": "SELECT e.event_id AS verification_id, c.claim_id, CASE WHEN e.event_type IN ('error', 'signup') THEN 'CONTRADICTED' WHEN e.event_type = 'view' THEN 'INSUFFICIENT' ELSE 'SUPPORTED' END AS verdict, CASE WHEN e.value > 100 THEN 1.0 ELSE e.value / 100 END AS confidence, e.ts AS created_at FROM (SELECT v.*, v.event_id % z.n AS target FROM {events} v CROSS JOIN (SELECT max(doc_id) + 1 AS n FROM {documents}) z) e JOIN {claims} c ON c.claim_id = e.target",
    "verification_evidence": "SELECT v.verification_id, ce.evidence_id, CASE WHEN v.verdict = 'CONTRADICTED' THEN 'CONTRADICTS' WHEN v.verdict = 'SUPPORTED' THEN 'SUPPORTS' ELSE 'CONTEXT' END AS evidence_role, CASE WHEN ce.evidence_id = v.claim_id THEN 0 ELSE 1 END AS position FROM {verifications} v JOIN {claim_evidence} ce ON ce.claim_id = v.claim_id",
    # content
    "content_versions": "SELECT CAST(row_number() OVER (ORDER BY source, lang) AS BIGINT) AS content_version_id, CAST(substr(source, 4) AS BIGINT) AS syllabus_id, CAST("
    + _TOPIC.format("lang")
    + " AS BIGINT) AS topic_id, CAST(1 AS BIGINT) AS version FROM (SELECT DISTINCT source, lang FROM {documents} WHERE source IS NOT NULL AND lang IS NOT NULL) s",
    "version_log": "SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS syllabus_id, CAST("
    + _TOPIC.format("lang")
    + " AS BIGINT) AS topic_id, CAST(n_chars % 7 AS BIGINT) AS version FROM {documents} WHERE source IS NOT NULL AND lang IS NOT NULL",
    "notes": "SELECT c.claim_id AS note_id, v.content_version_id, c.topic_id, c.approval_status, CASE WHEN c.approval_status = 'APPROVED' AND c.claim_id % 2 = 0 THEN 'RELEASED' ELSE 'UNRELEASED' END AS release_status, '# ' || t.name || chr(10) || chr(10) || '- ' || c.statement || chr(10) AS markdown FROM {claims} c JOIN {topics} t ON t.topic_id = c.topic_id LEFT JOIN {documents} d ON d.doc_id = c.claim_id LEFT JOIN {content_versions} v ON v.syllabus_id = CAST(substr(d.source, 4) AS BIGINT) AND v.topic_id = c.topic_id",
    "note_claims": "SELECT n.note_id, n.note_id + 7 * k.k AS claim_id, CAST(k.k AS BIGINT) AS position FROM {notes} n CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) k WHERE k.k <= n.note_id % 3",
    "options": "SELECT conv_id * 100000 + turn AS option_id, conv_id AS item_id, CAST(turn AS BIGINT) AS position, text AS option_text FROM {conversations}",
    "items": "SELECT conv_id AS item_id, max(CASE WHEN turn = 0 THEN text END) AS question_text, 'Because of turn ' || CAST(max(turn) AS VARCHAR(20)) AS explanation, conv_id * 100000 + conv_id % 5 AS correct_option_id, conv_id % 40 + 1 AS content_version_id, CASE WHEN conv_id % 4 = 0 THEN 'DRAFT' ELSE 'APPROVED' END AS approval_status, CASE WHEN conv_id % 4 <> 0 AND conv_id % 3 = 0 THEN 'RELEASED' ELSE 'UNRELEASED' END AS release_status FROM {conversations} GROUP BY conv_id",
    "item_claims": "SELECT i.item_id, c.claim_id, c.claim_id % 7 AS position FROM {items} i JOIN (SELECT l.claim_id, l.claim_id % z.n AS item_id FROM {claims} l CROSS JOIN (SELECT max(conv_id) + 1 AS n FROM {conversations}) z) c ON c.item_id = i.item_id",
    "packages": "SELECT content_version_id AS package_id, content_version_id, CASE WHEN content_version_id % 3 = 0 THEN 'UNRELEASED' ELSE 'RELEASED' END AS release_status FROM {content_versions}",
    "package_notes": "SELECT content_version_id AS package_id, note_id, CAST(row_number() OVER (PARTITION BY content_version_id ORDER BY note_id) - 1 AS BIGINT) AS position FROM {notes} WHERE release_status = 'RELEASED' AND content_version_id IS NOT NULL",
    "package_items": "SELECT i.content_version_id AS package_id, i.item_id, CAST(row_number() OVER (PARTITION BY i.content_version_id ORDER BY i.item_id) - 1 AS BIGINT) AS position FROM {items} i JOIN {content_versions} v ON v.content_version_id = i.content_version_id WHERE i.release_status = 'RELEASED'",
    "stored_documents": "SELECT package_id AS document_id, package_id, 'Content Package ' || CAST(package_id AS VARCHAR(20)) AS title, CASE WHEN package_id % 2 = 0 THEN 'RELEASED' ELSE 'UNRELEASED' END AS release_status FROM {packages} WHERE release_status = 'RELEASED' AND package_id % 5 <> 0",
    "artifacts": "SELECT document_id AS artifact_id, document_id, 'content-document-' || CAST(document_id AS VARCHAR(20)) || '.pdf' AS filename, 'application/pdf' AS media_type, length(title) AS byte_size, title AS payload, CASE WHEN document_id % 4 = 0 THEN 'RELEASED' ELSE 'UNRELEASED' END AS release_status FROM {stored_documents}",
    # review log
    "decisions": "SELECT CAST(user_id AS VARCHAR(20)) || ':' || substr(CAST(ts AS VARCHAR(30)), 1, 10) AS asset, CASE user_id % 4 WHEN 0 THEN 'note' WHEN 1 THEN 'item' WHEN 2 THEN 'package' ELSE 'document' END AS asset_kind, event_id AS seq, ts, CASE event_type WHEN 'click' THEN 'APPROVED' WHEN 'error' THEN 'REJECTED' WHEN 'view' THEN 'DRAFT' WHEN 'purchase' THEN 'RELEASE' ELSE 'WITHDRAW' END AS decision, 'note ' || CAST(event_id AS VARCHAR(20)) AS note, user_id AS asset_id FROM {events}",
    "guards": "SELECT asset_kind, asset_id, bool_and(guard_ok) AS guard_ok FROM (SELECT 'note' AS asset_kind, note_id AS asset_id, content_version_id IS NOT NULL AS guard_ok FROM {notes} UNION ALL SELECT 'item', i.item_id, coalesce(n, 0) >= 2 AND coalesce(has, FALSE) FROM {items} i LEFT JOIN (SELECT o.item_id, count(*) AS n, bool_or(o.option_id = i.correct_option_id) AS has FROM {options} o JOIN {items} i ON i.item_id = o.item_id GROUP BY o.item_id) o ON o.item_id = i.item_id UNION ALL SELECT 'package', package_id, package_id IN (SELECT package_id FROM {package_notes} UNION SELECT package_id FROM {package_items}) FROM {packages}) g GROUP BY asset_kind, asset_id",
    "guarded_decisions": "SELECT d.*, coalesce(g.guard_ok, d.asset_kind = 'document') AS guard_ok FROM {decisions} d LEFT JOIN {guards} g ON g.asset_kind = d.asset_kind AND g.asset_id = d.asset_id",
    # crawl
    "urls": "SELECT page_id, url FROM {pages} WHERE url IS NOT NULL",
    "hosts": "SELECT DISTINCT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM {pages} WHERE url IS NOT NULL",
    "robots": "SELECT host, CASE length(host) % 7 WHEN 0 THEN 'User-agent: *' || chr(10) || 'Disallow: /fr/' || chr(10) || 'Allow: /' || chr(10) || 'Sitemap: https://' || host || '/s.xml' WHEN 1 THEN '# none' || chr(10) || 'User-agent: other' || chr(10) || 'Disallow: /' || chr(10) || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /en/1' || chr(10) || 'Disallow:' WHEN 2 THEN 'Disallow /' WHEN 3 THEN 'Disallow: /x' WHEN 4 THEN 'User-agent: FactBot' || chr(10) || 'Disallow: /es' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /' ELSE 'User-agent: *' || chr(10) || 'Disallow: /de' END AS body FROM {hosts} WHERE length(host) % 7 <> 5",
    "allowed_hosts": "SELECT DISTINCT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM {pages} WHERE page_id % 3 = 0 AND url IS NOT NULL",
    "queries": "SELECT page_id AS query_id, lower(regexp_extract(url, '://[^/?#]*([^#]*)', 1)) AS query FROM {pages} WHERE url IS NOT NULL AND page_id % 100 = 0 UNION ALL SELECT -1 - min(page_id), 'nothing-matches-this zzz' FROM {pages}",
    "asked": "SELECT page_id, page_id - page_id % 100 AS query_id FROM {pages} WHERE url IS NOT NULL",
    "candidates": "SELECT page_id AS candidate_id, page_id % 7 AS run_id, url AS location, CASE page_id % 3 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'DRAFT' ELSE 'REJECTED' END AS approval_status, 'reviewed ' || CAST(page_id AS VARCHAR(20)) AS note FROM {pages} WHERE url IS NOT NULL",
    "promotions": "SELECT candidate_id, location FROM {candidates} WHERE approval_status = 'APPROVED' AND candidate_id % 2 = 0",
    "responses": "SELECT page_id AS response_id, url AS requested_url, regexp_extract(url, '://([^/?#]*)', 1) AS host, CASE page_id % 11 WHEN 0 THEN 404 WHEN 1 THEN 503 ELSE 200 END AS http_status, CASE page_id % 7 WHEN 0 THEN 'image/png' WHEN 1 THEN 'Text/HTML; charset=utf-8' ELSE ' text/html ' END AS content_type, CASE WHEN page_id % 13 = 0 THEN '' ELSE html END AS body FROM {pages} WHERE url IS NOT NULL",
    "fetch_results": "SELECT d.doc_id AS result_id, CAST(substr(d.source, 4) AS BIGINT) AS source_id, CASE WHEN d.doc_id % 17 = 0 THEN 'https://elsewhere.example.org/' ELSE 'https://' || d.source || '.example.org/data' END AS requested_url, CASE WHEN d.doc_id % 19 = 0 THEN 'not base64!' ELSE replace(replace(base64(unhex(hex(coalesce(d.text, '')))), chr(13), ''), chr(10), '') END AS content_base64, CASE WHEN d.doc_id % 29 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status FROM {documents} d WHERE d.source IS NOT NULL",
    # text
    "texts": "SELECT doc_id AS id, text FROM {documents} WHERE text IS NOT NULL",
    # grounding
    "chunks": "SELECT id * 1000000 + position AS chunk_id, id AS run_id, CAST(position AS BIGINT) AS position, CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end, text AS chunk_text FROM " + chunk_sql("{texts}") + " x",
    "proposals": "SELECT c.run_id, c.position AS claim_position, CASE WHEN c.run_id % 31 = 0 THEN 'same statement' ELSE c.chunk_text || CAST(c.position AS VARCHAR(5)) END AS statement FROM {chunks} c",
    "citations": "SELECT p.run_id, p.claim_position, CAST(k.k AS BIGINT) AS citation_position, CASE WHEN p.run_id % 13 = 0 AND k.k = 1 THEN CAST(-1 AS BIGINT) ELSE p.run_id * 1000000 + CASE WHEN p.run_id % 3 = 0 THEN p.claim_position ELSE 0 END END AS chunk_id, CASE WHEN p.run_id % 11 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(20 * k.k AS BIGINT) END AS char_start, CASE WHEN p.run_id % 7 = 0 AND k.k = 0 THEN CAST(99999 AS BIGINT) WHEN p.run_id % 11 = 0 THEN CAST(9 AS BIGINT) ELSE CAST(20 * k.k + 9 AS BIGINT) END AS char_end FROM {proposals} p CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) k WHERE k.k <= p.run_id % 2 OR p.run_id % 11 = 0",
    "model_outputs": "SELECT doc_id AS output_id, '{' || q.q || 'claims' || q.q || ':[{' || q.q || 'statement' || q.q || ':' || q.q || replace(replace(replace(coalesce(text, ''), chr(92), chr(92) || chr(92)), q.q, chr(92) || q.q), chr(10), chr(92) || 'n') || q.q || ',' || q.q || 'subject' || q.q || ':' || coalesce(q.q || lang || q.q, 'null') || CASE WHEN doc_id % 19 = 0 THEN ',' || q.q || 'more' || q.q || ':1' ELSE '' END || ',' || q.q || 'citations' || q.q || ':[' || coalesce(substr(repeat(',{' || q.q || 'source_chunk_id' || q.q || ':' || CAST(doc_id AS VARCHAR(20)) || ',' || q.q || 'char_start' || q.q || ':0,' || q.q || 'char_end' || q.q || ':' || CASE doc_id % 17 WHEN 0 THEN q.q || '9' || q.q WHEN 1 THEN '1.5' ELSE CAST(n_chars AS VARCHAR(20)) END || '}', CAST(doc_id % 12 AS INT)), 2), '') || ']}]' || CASE WHEN doc_id % 23 = 0 THEN '' ELSE '}' END AS body FROM {documents} CROSS JOIN (SELECT chr(34) AS q) q",
    # prompts and executions
    "prompts": "SELECT s_suppkey AS prompt_id, CASE s_suppkey % 3 WHEN 0 THEN 'summary' ELSE 'extract' END AS prompt_key, s_suppkey AS version, CASE s_suppkey % 3 WHEN 1 THEN 'You are {{role}} for ' || s_name || '.' ELSE 'Plain ' || s_name END AS system_template, CASE s_suppkey % 3 WHEN 1 THEN 'Type {type} value {value} {{braces}}' WHEN 2 THEN 'Props {props} of {type}' ELSE 'Missing {nothing}' END AS user_template, CASE s_suppkey % 3 WHEN 0 THEN 'other.input' ELSE 'grounded-claim-extraction.input' END AS input_schema_key, CAST(1 AS BIGINT) AS input_schema_version, CASE s_suppkey % 3 WHEN 1 THEN 'grounded-claim-extraction.output' ELSE 'other.output' END AS output_schema_key, CAST(1 AS BIGINT) AS output_schema_version FROM {supplier}",
    "executions": "SELECT event_id AS execution_id, event_id % z.n + 1 AS prompt_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'model-x' ELSE 'model-a' END AS model_id, CASE event_id % 9 WHEN 0 THEN '{bad json' WHEN 1 THEN ' ' WHEN 2 THEN '[1]' ELSE props END AS output_text, CASE event_id % 14 WHEN 3 THEN 'AI_PROVIDER_TIMEOUT' WHEN 4 THEN 'SOMETHING_ELSE' END AS provider_error, CASE WHEN event_id % 10 = 7 THEN CAST(-1 AS BIGINT) ELSE user_id END AS input_tokens, CAST(10 AS BIGINT) AS output_tokens, CASE WHEN event_id % 15 = 8 THEN user_id ELSE user_id + 10 END AS total_tokens, CASE event_id % 4 WHEN 0 THEN '0.25' WHEN 1 THEN '1e5' WHEN 2 THEN '012' END AS provider_cost, CASE event_id % 8 WHEN 0 THEN 'USD' WHEN 1 THEN 'usd' WHEN 4 THEN 'EUR' END AS cost_currency, ts AS started_at FROM {events} CROSS JOIN (SELECT max(s_suppkey) AS n FROM {supplier}) z",
    "claim_executions": "SELECT e.execution_id, CASE WHEN e.output_text IN ('{bad json', ' ', '[1]') OR e.execution_id % 9 = 3 THEN e.output_text ELSE m.body END AS output_text, e.provider_error, e.input_tokens, e.output_tokens, e.total_tokens, e.provider_cost, e.cost_currency FROM (SELECT x.*, x.execution_id % z.n AS output_id FROM {executions} x CROSS JOIN (SELECT max(doc_id) + 1 AS n FROM {documents}) z) e LEFT JOIN {model_outputs} m ON m.output_id = e.output_id",
}

_REF = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def _names(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(_REF.findall(sql)) if n in TABLES or n in BASE]


def needed(names: list[str]) -> list[str]:
    """The engine tables that names need, in an order in which each comes after those that it needs."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in out or name in BASE:
            return
        for n in _names(TABLES[name]):
            visit(n)
        out.append(name)

    for n in names:
        visit(n)
    return out


def _filled(sql: str, with_names: dict[str, str]) -> str:
    return _REF.sub(lambda m: with_names.get(m[1], m[0]), sql)


def oracle(sql: str) -> str:
    """Oracle SQL whose references in braces are the engine tables, as common table expressions."""
    tables = needed(_names(sql))
    own = {n: n if n in BASE else f"t_{n}" for n in (*BASE, *TABLES)}
    ctes = ", ".join(f"t_{n} AS ({_filled(TABLES[n], own)})" for n in tables)
    body = f"SELECT * FROM ({_filled(sql, own)}) result"
    return f"WITH {ctes} {body}" if ctes else body


class Tables:
    """Engine tables of a folder of test tables, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.known = spark, sf_dir, {}
        bounded_batches(spark)

    def __call__(self, name: str) -> DataFrame:
        if name not in self.known:
            if name in BASE:
                self.known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name == "chunks":
                self.known[name] = _chunks(self("texts"))
            else:
                refs = _names(TABLES[name])
                sql = _filled(TABLES[name], {n: f"{{t_{n}}}" for n in refs})
                self.known[name] = _run(self.spark, sql, {f"t_{n}": self(n) for n in refs})
        return self.known[name]


def _chunks(texts: DataFrame) -> DataFrame:
    """The engine's own chunks of whole texts; what the oracles walk over in SQL. Stored once a session of tables."""
    from factloom.operators.text import chunk_text

    from .storage import settled

    cut = chunk_text(texts).withColumn("chunk_id", F.col("id") * 1_000_000 + F.col("position"))
    places = [F.col(c).cast("long").alias(c) for c in ("position", "char_start", "char_end")]
    return settled(cut.select("chunk_id", F.col("id").alias("run_id"), *places, F.col("text").alias("chunk_text")))


def _run(spark: SparkSession, sql: str, frames: dict[str, DataFrame]) -> DataFrame:
    """sql with {name} of frames; all other braces are text."""
    if not frames:
        return spark.sql(sql)
    escaped = sql.replace("{", "{{").replace("}", "}}")
    for name in frames:
        escaped = escaped.replace("{{" + name + "}}", "{" + name + "}")
    return spark.sql(escaped, **frames)

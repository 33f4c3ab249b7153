"""Queries on grounding, model executions, review and release, audits."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import audit, contracts, curation, grounding, identity, lifecycle, quality
from factloom.operators import relational as rel
from factloom.operators import text as tx
from factloom.sources import rules, schemas
from factloom.sources.storage import settled

from .registry import query

C = F.col

# grounding


@query(
    "SELECT run_id, n_chunks, n_chars, n_bytes, contiguous, contiguous AND n_chunks <= 50 AND n_chars <= 50000 AND n_bytes <= 200000 AS eligible FROM (SELECT run_id, count(*) AS n_chunks, CAST(sum(length(chunk_text)) AS BIGINT) AS n_chars, CAST(sum(strlen(chunk_text)) AS BIGINT) AS n_bytes, max(position) = count(*) - 1 AND count(DISTINCT position) = count(*) AS contiguous FROM {chunks} GROUP BY run_id) x"
)
def extraction_limits(t) -> DataFrame:
    return grounding.extraction_limits(t("chunks"))


@query("SELECT run_id, count(*) AS n_evidence, count(*) <= 3 AS allowed FROM (SELECT DISTINCT run_id, chunk_id, char_start, char_end FROM {citations}) x GROUP BY run_id")
def distinct_evidence(t) -> DataFrame:
    return grounding.distinct_evidence(t("citations"), max_evidence=3)


_JOINED = "(SELECT c.*, k.chunk_text, coalesce(c.char_start >= 0 AND c.char_start < c.char_end AND c.char_end <= length(k.chunk_text), FALSE) AS in_range FROM {citations} c LEFT JOIN {chunks} k ON k.run_id = c.run_id AND k.chunk_id = c.chunk_id)"


@query(f"SELECT run_id, claim_position, citation_position, chunk_id, in_range FROM {_JOINED} x")
def citation_chunk_join(t) -> DataFrame:
    return grounding.citation_chunk_join(t("citations"), t("chunks")).select("run_id", "claim_position", "citation_position", "chunk_id", "in_range")


_VALID = f"""(SELECT p.run_id, p.bad OR coalesce(c.bad, FALSE) OR coalesce(e.bad, FALSE) AS bad FROM (SELECT run_id, count(*) > 25 OR count(*) > count(DISTINCT statement) AS bad FROM {{proposals}} GROUP BY run_id) p
 LEFT JOIN (SELECT run_id, bool_or(n > 5 OR n > d OR bad) AS bad FROM (SELECT run_id, claim_position, count(*) AS n, count(DISTINCT row(chunk_id, char_start, char_end)) AS d, bool_or(NOT in_range OR NOT regexp_matches(substr(chunk_text, char_start + 1, char_end - char_start), '\\S')) AS bad FROM {_JOINED} j GROUP BY run_id, claim_position) k GROUP BY run_id) c ON c.run_id = p.run_id
 LEFT JOIN (SELECT run_id, count(DISTINCT row(chunk_id, char_start, char_end)) > 125 AS bad FROM {{citations}} GROUP BY run_id) e ON e.run_id = p.run_id)"""


@query(f"SELECT run_id, CASE WHEN bad THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, CASE WHEN bad THEN 'CLAIM_EXTRACTION_GROUNDING_INVALID' END AS error_code FROM {_VALID} v")
def validate_grounding(t) -> DataFrame:
    return grounding.validate_grounding(t("proposals"), t("citations"), t("chunks"))


_PLACES = "(SELECT run_id, chunk_id, char_start, char_end, row_number() OVER (PARTITION BY run_id ORDER BY f) - 1 AS position FROM (SELECT run_id, chunk_id, char_start, char_end, min(row(claim_position, citation_position)) AS f FROM {citations} GROUP BY run_id, chunk_id, char_start, char_end) x)"


@query(f"SELECT * FROM {_PLACES} x")
def first_appearance_order(t) -> DataFrame:
    return grounding.first_appearance_order(t("citations"))


def _grounded(t):
    valid = grounding.validate_grounding(t("proposals"), t("citations"), t("chunks"))
    return grounding.ground_claims(t("proposals"), t("citations"), t("chunks"), valid)


_EVIDENCE = f"(SELECT p.run_id, p.chunk_id, p.char_start, p.char_end, p.position, substr(k.chunk_text, p.char_start + 1, p.char_end - p.char_start) AS content FROM {_PLACES} p JOIN {_VALID} v ON v.run_id = p.run_id AND NOT v.bad JOIN {{chunks}} k ON k.run_id = p.run_id AND k.chunk_id = p.chunk_id)"


@query(f"SELECT *, sha256(content) AS sha256, 'source-snapshot:' || run_id || '#chunk=' || chunk_id || '&chars=' || char_start || '-' || char_end AS location_reference FROM {_EVIDENCE} e")
def ground_claims(t) -> DataFrame:
    return _grounded(t)[0]


@query(
    f"""SELECT c.run_id, e.evidence, c.claims FROM (SELECT run_id, string_agg(claim_position || ':' || coalesce(refs, ''), ';' ORDER BY claim_position) AS claims FROM (SELECT p.run_id, p.claim_position, l.refs FROM {{proposals}} p JOIN {_VALID} v ON v.run_id = p.run_id AND NOT v.bad
 LEFT JOIN (SELECT c.run_id, c.claim_position, string_agg(CAST(x.position AS VARCHAR), ',' ORDER BY c.citation_position) AS refs FROM {{citations}} c JOIN {_PLACES} x ON x.run_id = c.run_id AND x.chunk_id = c.chunk_id AND x.char_start = c.char_start AND x.char_end = c.char_end GROUP BY c.run_id, c.claim_position) l ON l.run_id = p.run_id AND l.claim_position = p.claim_position) y GROUP BY run_id) c
 LEFT JOIN (SELECT run_id, string_agg(content, '|' ORDER BY position) AS evidence FROM {_EVIDENCE} z GROUP BY run_id) e ON e.run_id = c.run_id"""
)
def grounding_report(t) -> DataFrame:
    return grounding.grounding_report(*_grounded(t))


@query("SELECT run_id, CASE WHEN c IS NULL THEN 'SUCCEEDED' ELSE 'FAILED' END AS status, substr(c, 8) AS error_code, n AS n_failures FROM (SELECT run_id, min(CASE WHEN code IS NOT NULL THEN lpad(CAST(position AS VARCHAR), 6, '0') || ':' || code END) AS c, count(code) AS n FROM (SELECT run_id, position, CASE WHEN length(chunk_text) < 100 THEN 'SHORT' WHEN chunk_id % 11 = 0 THEN 'ELEVEN' END AS code FROM {chunks}) x GROUP BY run_id) y")
def run_status_rollup(t) -> DataFrame:
    code = F.when(F.length("chunk_text") < 100, "SHORT").when(C("chunk_id") % 11 == 0, "ELEVEN")
    return grounding.run_status_rollup(t("chunks").select("run_id", C("position").alias("ordinal"), code.alias("code")), t("chunks"))


@query("SELECT run_id, input_json, CAST(strlen(input_json) AS BIGINT) AS json_bytes, strlen(input_json) <= 250000 AS allowed FROM (SELECT run_id, '{\"chunks\":[' || string_agg('{\"position\":' || position || ',\"source_chunk_id\":' || chunk_id || ',\"text\":' || CAST(to_json(chunk_text) AS VARCHAR) || '}', ',' ORDER BY position) || '],\"source_extraction_run_id\":' || run_id || '}' AS input_json FROM {chunks} GROUP BY run_id) x")
def grounding_input(t) -> DataFrame:
    return grounding.grounding_input(t("chunks"))


_RUN_STATES = "(SELECT run_id, CASE WHEN sum(length(chunk_text)) <= 2000000 AND count(*) <= 5000 AND bool_or(regexp_matches(chunk_text, '\\S')) THEN 'SUCCEEDED' ELSE 'FAILED' END AS status FROM {chunks} GROUP BY run_id)"


def _runs(t) -> DataFrame:
    """Extraction runs with their status: failed if the text was too long, of too many chunks, or blank."""
    sizes = t("chunks").groupBy("run_id").agg(F.sum(F.length("chunk_text")).alias("chars"), F.count("*").alias("n"), F.max(C("chunk_text").rlike(r"\S")).alias("ink"))
    return sizes.select("run_id", F.when((C("chars") <= 2_000_000) & (C("n") <= 5_000) & C("ink"), "SUCCEEDED").otherwise("FAILED").alias("status"))


@query(f"SELECT c.run_id, p.prompt_id FROM {_RUN_STATES} c JOIN {{prompts}} p ON p.prompt_id = c.run_id % (SELECT max(prompt_id) FROM {{prompts}}) + 1 WHERE c.status = 'SUCCEEDED' AND p.input_schema_key = 'grounded-claim-extraction.input' AND p.input_schema_version = 1 AND p.output_schema_key = 'grounded-claim-extraction.output' AND p.output_schema_version = 1")
def grounding_eligibility(t) -> DataFrame:
    """Each run asks for one prompt; it may go on if it succeeded and the prompt is made for grounded claims."""
    runs = _runs(t)
    last = t("prompts").agg(F.max("prompt_id").alias("last"))
    asked = runs.join(F.broadcast(last)).select("run_id", "status", (C("run_id") % C("last") + 1).alias("prompt_id"))  # last is one row
    return grounding.grounding_eligibility(asked, t("prompts")).select("run_id", "prompt_id")


_EDITED = "strpos(text, '@') > 0"
_CHANGED_PROMPT = "(SELECT prompt_id FROM {prompts} WHERE user_template = 'Missing {nothing}')"
_STATE_OF = "CASE WHEN gone THEN 'MISSING' WHEN changed <> '' THEN 'CHANGED' ELSE 'OK' END AS state, CASE WHEN gone THEN '' ELSE changed END AS changed"


@query(
    f"""SELECT 'snapshot' AS kind, doc_id AS id, {_STATE_OF} FROM (SELECT doc_id, source IS NULL AS gone, CASE WHEN {_EDITED} THEN 'sha256' ELSE '' END AS changed FROM {{documents}} WHERE text IS NOT NULL) a
 UNION ALL SELECT 'extraction', id, {_STATE_OF} FROM (SELECT id, FALSE AS gone, CASE WHEN {_EDITED} THEN 'snapshot_sha256,chunks' ELSE '' END AS changed FROM {{texts}} WHERE length(text) > 0) b
 UNION ALL SELECT 'prompt', prompt_id, {_STATE_OF} FROM (SELECT prompt_id, FALSE AS gone, CASE WHEN prompt_id IN {_CHANGED_PROMPT} THEN 'checksum' ELSE '' END AS changed FROM {{prompts}}) c
 UNION ALL SELECT 'execution', execution_id, {_STATE_OF} FROM (SELECT execution_id, cost_currency = 'EUR' AS gone, CASE WHEN prompt_id IN {_CHANGED_PROMPT} THEN CASE WHEN model_id = '' THEN 'prompt_checksum,model_id' ELSE 'prompt_checksum' END WHEN model_id = '' THEN 'model_id' ELSE '' END AS changed
  FROM {{executions}} WHERE prompt_id IN (SELECT prompt_id FROM {{prompts}})) d"""
)
def identity_revalidate(t) -> DataFrame:
    """Identities of snapshots, extractions with their chunks, prompts and executions, after at-signs in texts were masked, a template and blank models were mended, and some rows went."""

    def recorded(texts: DataFrame, prompts: DataFrame, executions: DataFrame) -> dict[str, DataFrame]:
        digest = F.sha2("text", 256)
        snapshots = texts.select(C("doc_id").alias("snapshot_id"), C("source").alias("source_id"), F.lit("text/plain").alias("content_type"), F.octet_length("text").alias("byte_size"), digest.alias("sha256"))
        cut = tx.chunk_text(texts.select(C("doc_id").alias("run_id"), "text"), id_col="run_id").withColumn("chunk_id", C("run_id") * 1_000_000 + C("position"))
        runs = texts.select(C("doc_id").alias("run_id"), C("doc_id").alias("snapshot_id"), F.lit(1).alias("source_id"), digest.alias("snapshot_sha256"), F.lit("SUCCEEDED").alias("status"))
        summed = audit.prompt_checksums(prompts).select("prompt_id", "prompt_key", "version", "checksum")
        used = executions.select("execution_id", "prompt_id", F.lit("provider").alias("provider_key"), "model_id", F.when(C("provider_error").isNull(), "SUCCEEDED").otherwise("FAILED").alias("status"))
        ran = used.join(summed.select("prompt_id", "prompt_key", C("version").alias("prompt_version"), C("checksum").alias("prompt_checksum")), "prompt_id")
        return {"snapshot": snapshots, "extraction": runs.join(identity.chunks_digest(cut).hint("merge"), "run_id"), "prompt": summed, "execution": ran}

    texts, prompts, executions = t("documents").where("text is not null").withColumn("source", F.coalesce("source", F.lit(""))), t("prompts"), t("executions")
    now = recorded(
        t("documents").where("text is not null").withColumn("text", F.translate("text", "@", "#")),
        prompts.withColumn("user_template", F.when(C("user_template") == "Missing {nothing}", "Missing {}").otherwise(C("user_template"))),
        executions.where("coalesce(cost_currency <> 'EUR', true)").withColumn("model_id", F.when(C("model_id") == "", "model-a").otherwise(C("model_id"))),
    )
    now["snapshot"] = now["snapshot"].where("source_id is not null")
    then = recorded(texts, prompts, executions)
    found = identity.revalidate_all({kind: (then[kind], now[kind]) for kind in then})
    return found.select("kind", "id", "state", F.array_join("changed", ",").alias("changed"))


@query(
    """SELECT p.run_id, p.claim_position, c.citation_position, c.chunk_id, d.doc_id AS snapshot_id, r.status AS extraction_status, f.result_id AS fetch_run_id, f.status AS fetch_status, s.name AS source_name, s.tier FROM {proposals} p JOIN {citations} c ON c.run_id = p.run_id AND c.claim_position = p.claim_position
 JOIN {chunks} k ON k.run_id = c.run_id AND k.chunk_id = c.chunk_id JOIN """
    + _RUN_STATES
    + """ r ON r.run_id = k.run_id JOIN {documents} d ON d.doc_id = k.run_id JOIN {fetch_results} f ON f.result_id = d.doc_id JOIN {sources} s ON s.source_id = f.source_id"""
)
def provenance_chain(t) -> DataFrame:
    """Claim, citation, chunk, extraction run, snapshot, fetch run and source in one row."""
    cited = t("proposals").select("run_id", "claim_position").join(t("citations"), ["run_id", "claim_position"]).join(t("chunks").select("run_id", "chunk_id"), ["run_id", "chunk_id"])
    extracted = cited.join(_runs(t).select("run_id", C("status").alias("extraction_status")), "run_id")
    snapshots = extracted.join(t("documents").select(C("doc_id").alias("run_id"), C("doc_id").alias("snapshot_id")), "run_id")
    fetched = snapshots.join(t("fetch_results").select(C("result_id").alias("snapshot_id"), C("result_id").alias("fetch_run_id"), "source_id", C("status").alias("fetch_status")), "snapshot_id")
    whole = fetched.join(t("sources").select("source_id", C("name").alias("source_name"), "tier"), "source_id")
    return whole.select("run_id", "claim_position", "citation_position", "chunk_id", "snapshot_id", "extraction_status", "fetch_run_id", "fetch_status", "source_name", "tier")


_REQUESTS = """SELECT 'verification' AS kind, v.verification_id AS id, CASE WHEN NOT coalesce(claim_id BETWEEN 1 AND 2147483647, FALSE) THEN 'CLAIM' WHEN verdict NOT IN ('SUPPORTED', 'CONTRADICTED', 'INSUFFICIENT') THEN 'VERDICT' WHEN NOT coalesce(confidence BETWEEN 0 AND 1, FALSE) THEN 'CONFIDENCE'
 WHEN coalesce(n, 0) = 0 OR least_id <= 0 OR n <> ids THEN 'EVIDENCE' WHEN least_position < 0 OR n <> places THEN 'POSITIONS' END AS error_code FROM {verifications} v
 LEFT JOIN (SELECT verification_id, count(*) AS n, min(evidence_id) AS least_id, count(DISTINCT evidence_id) AS ids, min(position) AS least_position, count(DISTINCT position) AS places FROM {verification_evidence} GROUP BY verification_id) e ON e.verification_id = v.verification_id
 UNION ALL SELECT 'question_item', i.item_id, CASE WHEN NOT coalesce(i.content_version_id BETWEEN 1 AND 2147483647, FALSE) THEN 'VERSION' WHEN NOT coalesce(regexp_matches(i.question_text, '\\S'), FALSE) THEN 'QUESTION' WHEN NOT coalesce(regexp_matches(i.explanation, '\\S'), FALSE) THEN 'EXPLANATION' WHEN coalesce(c.n, 0) = 0 OR c.least_id <= 0 OR c.n <> c.ids THEN 'CLAIMS'
 WHEN coalesce(o.n, 0) < 2 THEN 'OPTIONS' WHEN o.blank THEN 'BLANK_OPTION' WHEN NOT coalesce(o.correct BETWEEN 0 AND o.n - 1, FALSE) THEN 'CORRECT_OPTION' END FROM {items} i
 LEFT JOIN (SELECT item_id, count(*) AS n, min(claim_id) AS least_id, count(DISTINCT claim_id) AS ids FROM {item_claims} GROUP BY item_id) c ON c.item_id = i.item_id
 LEFT JOIN (SELECT o.item_id, count(*) AS n, bool_or(NOT coalesce(regexp_matches(option_text, '\\S'), FALSE)) AS blank, min(CASE WHEN o.option_id = i.correct_option_id THEN position END) AS correct FROM {options} o JOIN {items} i ON i.item_id = o.item_id GROUP BY o.item_id) o ON o.item_id = i.item_id
 UNION ALL SELECT 'source', source_id, CASE WHEN NOT coalesce(regexp_matches(name, '\\S') AND length(name) <= 500, FALSE) THEN 'TITLE' WHEN NOT coalesce(tier BETWEEN 1 AND 4, FALSE) THEN 'TIER' WHEN NOT coalesce(regexp_matches(location, '\\S'), FALSE) THEN 'LOCATION' END FROM {sources}
 UNION ALL SELECT 'fetch_result', result_id, CASE WHEN status = 'SUCCEEDED' AND NOT coalesce(length(content_base64) > 0, FALSE) THEN 'CONTENT' END FROM {fetch_results}"""


@query(_REQUESTS)
def request_validation(t) -> DataFrame:
    """Verifications, question items, sources and fetch results as requests, each by the rules of its kind."""
    evidence = rel.nest_children(t("verifications"), t("verification_evidence"), key="verification_id", order_by=["position", "evidence_id"], fields=[], as_="e")
    verifications = evidence.withColumns({"evidence_ids": C("e.evidence_id"), "positions": C("e.position")})
    items = rel.nest_children(t("items"), t("options"), key="item_id", order_by=["position", "option_id"], fields=["option_text"], as_="o")
    items = rel.nest_children(items, t("item_claims"), key="item_id", order_by=["position", "claim_id"], fields=[], as_="c")
    right = F.array_min(F.transform(F.filter("o", lambda o: o["option_id"] == C("correct_option_id")), lambda o: o["position"]))
    items = items.withColumns({"options": C("o.option_text"), "claim_ids": C("c.claim_id"), "correct_option_position": right})
    none = F.lit(None).cast("string")
    sources = t("sources").select("source_id", C("name").alias("title"), none.alias("publisher"), F.lit("site").alias("source_type"), C("tier").alias("authority_tier"), "location", F.lit("open").alias("license_status"), none.alias("content_hash"))
    succeeded = C("status") == "SUCCEEDED"
    fetched = t("fetch_results").withColumns({"http_status": F.when(succeeded, 200), "error_code": F.when(~succeeded, "FETCH_FAILED")})
    kinds = ((verifications, "verification", "verification_id"), (items, "question_item", "item_id"), (sources, "source", "source_id"), (fetched, "fetch_result", "result_id"))
    return reduce(DataFrame.unionByName, [contracts.validated(df, kind).select(F.lit(kind).alias("kind"), C(key).alias("id"), "error_code") for df, kind, key in kinds])


_TEXT_OK = "(NOT list_contains(json_keys(c), '{f}') OR json_type(c, '$.{f}') = 'NULL' OR (json_type(c, '$.{f}') = 'VARCHAR' AND length(c->>'{f}') <= {n} AND regexp_matches(c->>'{f}', '\\S')))"
_OUTPUT_OK = f"""json_type(j) = 'OBJECT' AND json_keys(j) = ['claims'] AND json_type(j, '$.claims') = 'ARRAY' AND json_array_length(j, '$.claims') BETWEEN 1 AND 50 AND len(list_filter(json_extract(j, '$.claims[*]'), lambda c: NOT coalesce(json_type(c) = 'OBJECT'
 AND list_has_all(['statement', 'subject', 'predicate', 'object_value', 'citations'], json_keys(c)) AND json_type(c, '$.statement') = 'VARCHAR' AND length(c->>'statement') BETWEEN 1 AND 2000 AND regexp_matches(c->>'statement', '\\S') AND {_TEXT_OK.format(f="subject", n=500)} AND {_TEXT_OK.format(f="predicate", n=500)} AND {_TEXT_OK.format(f="object_value", n=1000)}
 AND json_type(c, '$.citations') = 'ARRAY' AND json_array_length(c, '$.citations') BETWEEN 1 AND 10 AND len(list_filter(json_extract(c, '$.citations[*]'), lambda x: NOT coalesce(json_type(x) = 'OBJECT' AND list_sort(json_keys(x)) = ['char_end', 'char_start', 'source_chunk_id']
 AND json_type(x, '$.char_end') IN ('UBIGINT', 'BIGINT') AND json_type(x, '$.char_start') IN ('UBIGINT', 'BIGINT') AND json_type(x, '$.source_chunk_id') IN ('UBIGINT', 'BIGINT') AND CAST(x->>'char_start' AS BIGINT) >= 0 AND TRY_CAST(x->>'char_end' AS BIGINT) > 0 AND TRY_CAST(x->>'source_chunk_id' AS BIGINT) BETWEEN 1 AND 2147483647, FALSE))) = 0, FALSE))) = 0"""


@query(f"SELECT output_id, coalesce({_OUTPUT_OK}, FALSE) AS valid FROM (SELECT output_id, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM {{model_outputs}}) x")
def output_schema_check(t) -> DataFrame:
    """Model outputs over whole texts against the contract of grounded claims."""
    return t("model_outputs").select("output_id", contracts.claims_output_valid(C("body")).alias("valid"))


# prompts and executions


@query("SELECT prompt_id, prompt_key, version, sha256('{\"input_schema_key\":\"' || input_schema_key || '\",\"input_schema_version\":' || input_schema_version || ',\"output_schema_key\":\"' || output_schema_key || '\",\"output_schema_version\":' || output_schema_version || ',\"prompt_key\":\"' || prompt_key || '\",\"system_template\":\"' || system_template || '\",\"user_template\":\"' || user_template || '\",\"version\":' || version || '}') AS checksum, TRUE AS unique_version FROM {prompts}")
def prompt_checksums(t) -> DataFrame:
    return audit.prompt_checksums(t("prompts"))


@query(
    """SELECT execution_id, prompt_id, CASE prompt_id % 3 WHEN 1 THEN 'You are {role} for ' || s_name || '.' WHEN 2 THEN 'Plain ' || s_name END AS system, CASE prompt_id % 3 WHEN 1 THEN 'Type ' || event_type || ' value ' || value || ' {braces}' WHEN 2 THEN 'Props ' || props || ' of ' || event_type END AS user, CASE prompt_id % 3 WHEN 0 THEN 'MISSING_PLACEHOLDER' END AS error
 FROM (SELECT event_id AS execution_id, event_id % (SELECT max(s_suppkey) FROM {supplier}) + 1 AS prompt_id, event_type, CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) AS value, props FROM {events} WHERE props IS NOT NULL) x JOIN {supplier} s ON s.s_suppkey = x.prompt_id"""
)
def render_prompts(t) -> DataFrame:
    values = F.create_map(F.lit("type"), "event_type", F.lit("value"), C("value").cast("decimal(18,2)").cast("string"), F.lit("props"), "props")
    asked = t("executions").select("execution_id", "prompt_id")
    inputs = t("events").where("props is not null").select(C("event_id").alias("execution_id"), values.alias("values")).join(asked, "execution_id")
    out = audit.render_prompts(t("prompts"), inputs)
    return out.select("execution_id", "prompt_id", F.when(C("error").isNull(), C("system")).alias("system"), "user", "error")


_CODES = "('AI_PROVIDER_AUTHENTICATION', 'AI_PROVIDER_DISABLED', 'AI_PROVIDER_ERROR', 'AI_PROVIDER_INVALID_RESPONSE', 'AI_PROVIDER_RATE_LIMITED', 'AI_PROVIDER_RESPONSE_INVALID', 'AI_PROVIDER_SAFETY_BLOCKED', 'AI_PROVIDER_TIMEOUT', 'AI_PROVIDER_TRANSPORT', 'AI_PROVIDER_UNAVAILABLE')"
_CLAIM = "json_extract(j, '$.claims[0]')"
_CITED = f"array_to_string(list_transform(json_extract({_CLAIM}, '$.citations[*]'), lambda x: '{{\"char_end\":' || (x->>'char_end') || ',\"char_start\":' || (x->>'char_start') || ',\"source_chunk_id\":' || (x->>'source_chunk_id') || '}}'), ',')"
_CANONICAL_OUTPUT = f"'{{\"claims\":[{{\"citations\":[' || {_CITED} || '],\"statement\":' || CAST(json_extract({_CLAIM}, '$.statement') AS VARCHAR) || ',\"subject\":' || CAST(json_extract({_CLAIM}, '$.subject') AS VARCHAR) || '}}]}}'"
_CLASSIFIED = f"""(SELECT *, CASE WHEN provider_error IS NOT NULL THEN CASE WHEN provider_error IN {_CODES} THEN provider_error ELSE 'AI_PROVIDER_ERROR' END
 WHEN output_text IS NULL OR trim(output_text) = '' OR input_tokens NOT BETWEEN 0 AND 2147483647 OR total_tokens NOT BETWEEN 0 AND 2147483647 OR total_tokens <> input_tokens + output_tokens OR (cost_currency IS NOT NULL AND NOT regexp_full_match(cost_currency, '[A-Z]{{3}}')) OR (provider_cost IS NULL) <> (cost_currency IS NULL) OR (provider_cost IS NOT NULL AND NOT regexp_full_match(provider_cost, '(0|[1-9][0-9]{{0,11}})([.][0-9]{{1,6}})?')) THEN 'AI_PROVIDER_INVALID_RESPONSE'
 WHEN j IS NULL THEN 'AI_OUTPUT_INVALID_JSON' WHEN NOT coalesce({_OUTPUT_OK}, FALSE) THEN 'AI_OUTPUT_SCHEMA_INVALID' END AS error_code FROM (SELECT *, CASE WHEN json_valid(output_text) THEN CAST(output_text AS JSON) END AS j FROM {{claim_executions}}) o)"""


@query(f"SELECT execution_id, CASE WHEN error_code IS NULL THEN 'SUCCEEDED' ELSE 'FAILED' END AS status, error_code, CASE WHEN error_code IS NULL THEN {_CANONICAL_OUTPUT} END AS output_json, CASE WHEN error_code IS NULL THEN sha256({_CANONICAL_OUTPUT}) END AS output_sha256 FROM {_CLASSIFIED} x")
def execution_audit(t) -> DataFrame:
    """Recorded executions whose outputs are claims over whole texts, by the contract of grounded claims."""
    return audit.execution_audit(t("claim_executions"))


@query(
    """SELECT event_id, CASE WHEN code IS NOT NULL THEN CASE WHEN code IN (401, 403) THEN 'AI_PROVIDER_AUTHENTICATION' WHEN code = 429 THEN 'AI_PROVIDER_RATE_LIMITED' WHEN code IN (408, 504) THEN 'AI_PROVIDER_TIMEOUT' WHEN code BETWEEN 500 AND 599 THEN 'AI_PROVIDER_UNAVAILABLE' ELSE 'AI_PROVIDER_TRANSPORT' END
 ELSE CASE event_type WHEN 'error' THEN 'AI_PROVIDER_UNAVAILABLE' WHEN 'click' THEN 'AI_PROVIDER_RATE_LIMITED' ELSE 'AI_PROVIDER_TRANSPORT' END END AS code FROM (SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN 400 + event_id % 120 END AS code FROM {events}) x"""
)
def map_provider_status(t) -> DataFrame:
    status = F.when(C("event_type") == "error", "UNAVAILABLE").when(C("event_type") == "click", "RESOURCE_EXHAUSTED").otherwise("WHATEVER")
    code = F.when(C("event_id") % 2 == 0, 400 + C("event_id") % 120)
    return t("events").select("event_id", audit.provider_status_code(code, status).alias("code"))


@query("SELECT execution_id, model_id, 'AI_MODEL_NOT_ALLOWED' AS error_code FROM {executions} WHERE model_id NOT IN ('model-a', 'model-b')")
def model_allowlist(t) -> DataFrame:
    return audit.model_allowlist(t("executions"), ["model-a", "model-b"])


# review and release

_FOLD = """(WITH RECURSIVE ev AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts, seq) AS n FROM {guarded_decisions}),
 st(asset, n, ap, rn, da, re, ra, wa, nt, seq, decision, reason, oap, ore) AS (
 SELECT DISTINCT asset, CAST(0 AS BIGINT), 'DRAFT', CAST(NULL AS VARCHAR), CAST(NULL AS TIMESTAMP), 'UNRELEASED', CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM ev
 UNION ALL SELECT asset, n, CASE WHEN reason IS NULL AND decision IN ('DRAFT', 'APPROVED', 'REJECTED') THEN decision ELSE ap END, CASE WHEN reason IS NULL AND decision = 'DRAFT' THEN NULL WHEN reason IS NULL AND decision IN ('APPROVED', 'REJECTED') THEN note ELSE rn END,
 CASE WHEN reason IS NULL AND decision = 'DRAFT' THEN NULL WHEN reason IS NULL AND decision IN ('APPROVED', 'REJECTED') THEN ts ELSE da END, CASE WHEN reason IS NULL AND decision = 'RELEASE' THEN 'RELEASED' WHEN reason IS NULL AND decision = 'WITHDRAW' THEN 'WITHDRAWN' ELSE re END,
 CASE WHEN reason IS NULL AND decision = 'RELEASE' THEN ts ELSE ra END, CASE WHEN reason IS NULL AND decision = 'WITHDRAW' THEN ts ELSE wa END, CASE WHEN reason IS NULL AND decision IN ('RELEASE', 'WITHDRAW') THEN note ELSE nt END, seq, decision, reason, ap, re
 FROM (SELECT s.asset, e.n, e.seq, e.ts, e.decision, e.note, s.ap, s.rn, s.da, s.re, s.ra, s.wa, s.nt,
  CASE WHEN e.decision IN ('DRAFT', 'REJECTED') AND s.re = 'RELEASED' THEN 'MUST_BE_WITHDRAWN' WHEN e.decision = 'APPROVED' AND e.asset_kind = 'item' AND NOT e.guard_ok THEN 'INCOMPLETE' WHEN e.decision = 'RELEASE' AND s.re <> 'UNRELEASED' THEN 'BAD_TRANSITION' WHEN e.decision = 'RELEASE' AND s.ap <> 'APPROVED' THEN 'NOT_APPROVED'
  WHEN e.decision = 'RELEASE' AND e.asset_kind IN ('note', 'item', 'package') AND NOT e.guard_ok THEN 'GUARD_FAILED' WHEN e.decision = 'WITHDRAW' AND s.re <> 'RELEASED' THEN 'BAD_TRANSITION' END AS reason
  FROM st s JOIN ev e ON e.asset = s.asset AND e.n = s.n + 1) z) SELECT * FROM st)"""


STATE_SQL = f"SELECT s.asset, k.asset_kind, arg_max(ap, n) AS approval_status, (max_by(row(rn), n))[1] AS reviewer_note, (max_by(row(da), n))[1] AS decided_at, arg_max(re, n) AS release_status, (max_by(row(ra), n))[1] AS released_at, (max_by(row(wa), n))[1] AS withdrawn_at, (max_by(row(nt), n))[1] AS release_note, count(reason) AS n_refused FROM {_FOLD} s JOIN (SELECT DISTINCT asset, asset_kind FROM {{decisions}}) k ON k.asset = s.asset GROUP BY s.asset, k.asset_kind"


def guards(t) -> DataFrame:
    """What the tables say of every asset that has a guard. Stored: a fold reads it more than once."""
    return settled(curation.release_guards(t("notes"), t("items"), t("options"), t("packages"), t("package_notes"), t("package_items")))


def _decided(t) -> DataFrame:
    return lifecycle.with_guards(t("decisions"), guards(t))


@query(STATE_SQL)
def release_state(t) -> DataFrame:
    return lifecycle.release_state(_decided(t))[0]


@query(f"SELECT s.asset, k.asset_kind, s.seq, s.decision, s.reason, s.oap AS approval, s.ore AS release FROM {_FOLD} s JOIN (SELECT DISTINCT asset, asset_kind FROM {{decisions}}) k ON k.asset = s.asset WHERE reason IS NOT NULL")
def rejected_decisions(t) -> DataFrame:
    return lifecycle.release_state(_decided(t))[1]


@query(
    """SELECT 'note' AS asset_kind, note_id AS asset_id, content_version_id IS NOT NULL AS guard_ok FROM {notes}
 UNION ALL SELECT 'item', i.item_id, coalesce(n, 0) >= 2 AND coalesce(has, FALSE) FROM {items} i LEFT JOIN (SELECT o.item_id, count(*) AS n, bool_or(o.option_id = i.correct_option_id) AS has FROM {options} o JOIN {items} i ON i.item_id = o.item_id GROUP BY o.item_id) o ON o.item_id = i.item_id
 UNION ALL SELECT 'package', package_id, package_id IN (SELECT package_id FROM {package_notes} UNION SELECT package_id FROM {package_items}) FROM {packages}"""
)
def release_guards(t) -> DataFrame:
    """What the fold of decisions asks of each asset, from the tables."""
    return curation.release_guards(t("notes"), t("items"), t("options"), t("packages"), t("package_notes"), t("package_items"))


@query("SELECT asset, d AS approval_status, CASE WHEN d <> 'DRAFT' THEN note END AS reviewer_note, CASE WHEN d <> 'DRAFT' THEN ts END AS decided_at FROM (SELECT asset, decision AS d, note, ts, row_number() OVER (PARTITION BY asset ORDER BY ts DESC, seq DESC) AS r FROM {decisions} WHERE decision IN ('DRAFT', 'APPROVED', 'REJECTED')) x WHERE r = 1")
def approval_state(t) -> DataFrame:
    return lifecycle.approval_state(t("decisions"))


@query(f"SELECT asset, 'RELEASED_INCONSISTENT' AS rule FROM (SELECT asset, arg_max(re, n) AS re FROM {_FOLD} s GROUP BY asset) x WHERE re = 'RELEASED' AND strpos(asset, '1') > 0")
def lifecycle_checks(t) -> DataFrame:
    state = lifecycle.release_state(_decided(t))[0]
    broken = F.when((C("release_status") == "RELEASED") & C("asset").contains("1"), "REJECTED").otherwise(C("approval_status"))
    return lifecycle.lifecycle_checks(state.withColumn("approval_status", broken))


_MEMBERS = "(SELECT v.content_version_id, kind, member_id, row_number() OVER (PARTITION BY v.content_version_id, kind ORDER BY member_id) - 1 AS position FROM {content_versions} v JOIN (SELECT content_version_id, 'note' AS kind, note_id AS member_id FROM {notes} WHERE release_status = 'RELEASED' UNION ALL SELECT content_version_id, 'item', item_id FROM {items} WHERE release_status = 'RELEASED') m ON m.content_version_id = v.content_version_id)"


@query(f"SELECT content_version_id, kind, member_id, position FROM {_MEMBERS} x UNION ALL SELECT content_version_id, 'conflict', NULL, NULL FROM {{content_versions}} WHERE content_version_id NOT IN (SELECT content_version_id FROM {_MEMBERS} y)")
def build_packages(t) -> DataFrame:
    _, members, conflicts = lifecycle.build_packages(t("content_versions"), t("notes"), t("items"))
    none = F.lit(None).cast("long")
    return members.select("content_version_id", "kind", "member_id", "position").unionByName(conflicts.select("content_version_id", F.lit("conflict").alias("kind"), none.alias("member_id"), none.alias("position")))


@query(
    """SELECT p.package_id, coalesce(n.body, '') AS notes, coalesce(i.body, '') AS items FROM {packages} p LEFT JOIN (SELECT l.package_id, string_agg(n.markdown, '|' ORDER BY l.position) AS body FROM {package_notes} l JOIN {notes} n ON n.note_id = l.note_id GROUP BY l.package_id) n ON n.package_id = p.package_id
 LEFT JOIN (SELECT l.package_id, string_agg(i.question_text, '|' ORDER BY l.position) AS body FROM {package_items} l JOIN {items} i ON i.item_id = l.item_id GROUP BY l.package_id) i ON i.package_id = p.package_id"""
)
def package_content(t) -> DataFrame:
    notes = t("package_notes").join(t("notes").select("note_id", "markdown"), "note_id")
    items = t("package_items").join(t("items").select("item_id", "question_text"), "item_id")
    found = rel.nest_children(t("packages").select("package_id"), notes, key="package_id", order_by=["position"], fields=["markdown"], as_="n")
    found = rel.nest_children(found, items, key="package_id", order_by=["position"], fields=["question_text"], as_="i")
    return found.select("package_id", F.array_join("n.markdown", "|").alias("notes"), F.array_join("i.question_text", "|").alias("items"))


# audits


_CHECKED = {d: {rule: c for rule, c in schemas.CHECKS[d].items() if set(re.findall("[a-z_0-9]+", c)) & set(schemas.columns(d)) <= set(rules.engine_columns(d))} for d in rules.ENGINE}


def _stored(frames: list[DataFrame]) -> DataFrame:
    """Small results over many tables, each stored on its own, so that no plan holds them all."""
    return reduce(DataFrame.unionByName, [settled(df) for df in frames])


def _declared(t, name: str) -> DataFrame:
    """An engine table's columns under their declared names."""
    return t(rules.ENGINE[name][0]).select(*[C(own).alias(c) for c, own in rules.engine_columns(name).items()])


def _as_sql(name: str) -> str:
    return "(SELECT " + ", ".join(f"{own} AS {c}" for c, own in rules.engine_columns(name).items()) + " FROM {" + rules.ENGINE[name][0] + "})"


@query(" UNION ALL ".join(f"SELECT '{rule}' AS rule, count(*) FILTER (WHERE NOT ({c})) AS violations FROM {_as_sql(d)} x" for d, checks in _CHECKED.items() for rule, c in checks.items()))
def audit_checks(t) -> DataFrame:
    """All declared checks of all stored tables that the test tables give, one pass a table."""
    each = [quality.audit_checks(_declared(t, d), checks) for d, checks in _CHECKED.items() if checks]
    return _stored([reduce(DataFrame.unionByName, each[i : i + 7]) for i in range(0, len(each), 7)])


@query(" UNION ALL ".join(f"SELECT '{rule}' AS rule, count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM {_as_sql(d)} x WHERE {' AND '.join(f'{c} IS NOT NULL' for c in key)} GROUP BY {', '.join(key)} HAVING count(*) > 1) y" for rule, d, key in rules.audited_keys()))
def audit_unique(t) -> DataFrame:
    """All declared keys of all stored tables that the test tables give."""
    keys: dict[str, dict[str, list[str]]] = {}
    for rule, d, key in rules.audited_keys():
        keys.setdefault(d, {})[rule] = key
    each = [(_declared(t, d), own) for d, own in keys.items()]
    return _stored([quality.audit_unique(each[i : i + 7]) for i in range(0, len(each), 7)])


@query(" UNION ALL ".join(f"SELECT '{rule}' AS rule, count(*) AS orphans FROM {_as_sql(child)} c WHERE {' AND '.join(f'c.{x} IS NOT NULL' for x in columns)} AND NOT EXISTS (SELECT 1 FROM {_as_sql(parent)} p WHERE {' AND '.join(f'p.{k} = c.{x}' for x, k in zip(columns, keys, strict=True))})" for rule, child, columns, parent, keys in rules.audited_references()))
def audit_foreign_keys(t) -> DataFrame:
    """All declared references between stored tables that the test tables give: how many rows refer to nothing."""
    tables, references = {d: _declared(t, d) for d in rules.ENGINE}, sorted(rules.audited_references(), key=lambda r: r[3])  # those to one parent stand together
    return _stored([quality.audit_foreign_keys(tables, references[i : i + 8]) for i in range(0, len(references), 8)])


def _gone(seed: str, key: str, used: str, taken: dict[str, str]) -> str:
    """SQL of a deletion of all rows of a table: those that `used` (a query of keys) lists stay; taken: what goes with the others, as queries of key and id."""
    source = "{" + rules.ENGINE[seed][0] + "}"
    parts = [f"""SELECT '{seed}' AS seed_table, '{seed}' AS "table", CAST({key} AS VARCHAR) AS id, CASE WHEN {key} IN ({used}) THEN 'BLOCKED' ELSE 'DELETE' END AS action FROM (SELECT DISTINCT {key} FROM {source}) s"""]
    parts += [f"SELECT DISTINCT '{seed}', '{child}', id, 'DELETE' FROM ({rows}) r WHERE k IN (SELECT {key} FROM {source}) AND k NOT IN ({used})" for child, rows in taken.items()]
    return " UNION ALL ".join(parts)


_DELETIONS = [
    ("question_bank_items", "item_id", "SELECT item_id FROM {package_items}", {"question_bank_options": "SELECT item_id AS k, CAST(option_id AS VARCHAR) AS id FROM {options}", "question_bank_item_claims": "SELECT item_id AS k, item_id || ':' || claim_id AS id FROM {item_claims}"}),
    ("evidence", "evidence_id", "SELECT evidence_id FROM {verification_evidence}", {"claim_evidence": "SELECT evidence_id AS k, claim_id || ':' || evidence_id AS id FROM {claim_evidence}"}),
    ("content_packages", "package_id", "SELECT package_id FROM {stored_documents}", {"content_package_note_drafts": "SELECT package_id AS k, package_id || ':' || note_id AS id FROM {package_notes}", "content_package_question_bank_items": "SELECT package_id AS k, package_id || ':' || item_id AS id FROM {package_items}"}),
    ("topics", "topic_id", "SELECT topic_id FROM {syllabus_topics} UNION ALL SELECT topic_id FROM {questions} UNION ALL SELECT topic_id FROM {notes}", {}),
]


@query(" UNION ALL ".join(_gone(*d) for d in _DELETIONS) + """ UNION ALL SELECT 'topics', 'claims', CAST(claim_id AS VARCHAR), 'SET_NULL' FROM {claims} WHERE topic_id NOT IN (SELECT topic_id FROM {syllabus_topics} UNION ALL SELECT topic_id FROM {questions} UNION ALL SELECT topic_id FROM {notes})""")
def propagate_deletes(t) -> DataFrame:
    """What the deletion of all items, evidence, packages and topics would do along all declared references that the test tables give."""
    tables = {d: (_declared(t, d), rules.UNIQUE[d][0]) for d in rules.ENGINE}
    tables["previous_questions"] = (tables["previous_questions"][0], ["paper_id", "position"])  # the test tables give these no id
    found = [quality.propagate_deletes(tables, rules.held_references(), seed, tables[seed][0].select(key)).withColumn("seed_table", F.lit(seed)) for seed, key, _, _ in _DELETIONS]
    return reduce(DataFrame.unionByName, found)


def _conforming_sql(d: str) -> str:
    held = [c for c in rules.engine_columns(d) if c in schemas.required(d) and c not in schemas.DEFAULTS]
    any_null = " OR ".join(f"{c} IS NULL" for c in held) or "FALSE"
    parts = [f"""SELECT '{d}' AS "table", CAST(NULL AS VARCHAR) AS "column", 'TYPED' AS reason, count(*) AS n FROM {_as_sql(d)} x WHERE NOT ({any_null}) HAVING count(*) > 0"""]
    return " UNION ALL ".join(parts + [f"SELECT '{d}', '{c}', 'NULL', count(*) FROM {_as_sql(d)} x WHERE {c} IS NULL HAVING count(*) > 0" for c in held])


@query(" UNION ALL ".join(_conforming_sql(d) for d in rules.ENGINE))
def typed_scan(t) -> DataFrame:
    """All declared tables that the test tables give, stored as text and read under their declared schemas: rows that conform, and faults."""
    stored = {d: (df := _declared(t, d)).select(*[C(c).cast("string").alias(c) for c in df.columns]) for d in rules.ENGINE}
    names = list(stored)
    return _stored([schemas.conformity({d: stored[d] for d in names[i : i + 7]}) for i in range(0, len(names), 7)])

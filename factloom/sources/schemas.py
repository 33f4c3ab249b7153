"""Declared schemas, defaults and checks of the engine's stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN = "status string, error_code string, created_at timestamp"
_REVIEW = "approval_status string, approval_decided_at timestamp, reviewer_note string"
_RELEASE = "release_status string, released_at timestamp, withdrawn_at timestamp, release_note string"

#: Columns of each stored table, as DDL.
SCHEMAS = {
    "exams": "exam_id long, name string, description string",
    "topics": "topic_id long, name string, parent_id long",
    "syllabus_versions": "syllabus_version_id long, exam_id long, source_id long, label string",
    "syllabus_version_topics": "syllabus_version_id long, topic_id long, position long",
    "previous_papers": "paper_id long, exam_id long, source_id long, year int, label string",
    "previous_questions": "question_id long, paper_id long, topic_id long, position long, question_text string",
    "content_versions": "content_version_id long, syllabus_version_id long, topic_id long, version int",
    "source_discovery_runs": f"run_id long, query string, site_root string, {_RUN}",
    "source_candidates": f"candidate_id long, run_id long, position long, location string, {_REVIEW}",
    "source_candidate_promotions": "candidate_id long, source_id long, location string, approval_status string, approval_decided_at timestamp, reviewer_note string",
    "sources": "source_id long, name string, location string, tier int, created_at timestamp",
    "source_fetch_runs": f"run_id long, source_id long, requested_url string, final_url string, http_status int, {_RUN}",
    "source_snapshots": "snapshot_id long, fetch_run_id long, source_id long, content_type string, content binary, byte_size long, sha256 string",
    "source_extraction_runs": f"run_id long, snapshot_id long, source_id long, snapshot_sha256 string, extractor_key string, text_char_count long, text_sha256 string, {_RUN}",
    "source_chunks": "chunk_id long, run_id long, position long, char_start long, char_end long, text string, sha256 string",
    "evidence": "evidence_id long, source_id long, content string, location_reference string",
    "claims": "claim_id long, topic_id long, statement string, subject string, predicate string, object_value string, confidence double, verification_status string, approval_status string",
    "claim_evidence": "claim_id long, evidence_id long",
    "verifications": "verification_id long, claim_id long, verdict string, confidence double, reasoning string, created_at timestamp",
    "verification_evidence": "verification_id long, evidence_id long, evidence_role string, position long",
    "ai_prompt_versions": "prompt_id long, prompt_key string, version int, system_template string, user_template string, input_schema_key string, input_schema_version int, output_schema_key string, output_schema_version int, checksum string",
    "ai_execution_runs": f"execution_id long, prompt_id long, model_id string, request_id string, input_sha256 string, output_sha256 string, duration_ms long, input_tokens long, output_tokens long, total_tokens long, provider_cost decimal(18,6), cost_currency string, {_RUN}",
    "claim_extraction_runs": f"run_id long, extraction_run_id long, execution_id long, {_RUN}",
    "claim_extraction_evidence": "run_id long, evidence_id long, chunk_id long, char_start long, char_end long, cited_text_sha256 string, position long",
    "claim_extraction_claims": "run_id long, claim_id long, position long",
    "claim_extraction_citations": "run_id long, claim_id long, evidence_id long, position long",
    "note_drafts": f"note_id long, content_version_id long, topic_id long, markdown string, {_REVIEW}, {_RELEASE}",
    "note_draft_claims": "note_id long, claim_id long, position long",
    "question_bank_items": f"item_id long, content_version_id long, question_text string, explanation string, difficulty string, correct_option_id long, {_REVIEW}, {_RELEASE}",
    "question_bank_options": "option_id long, item_id long, position long, option_text string",
    "question_bank_item_claims": "item_id long, claim_id long, position long",
    "content_packages": f"package_id long, content_version_id long, {_REVIEW}, {_RELEASE}",
    "content_package_note_drafts": "package_id long, note_id long, position long",
    "content_package_question_bank_items": "package_id long, item_id long, position long",
    "content_documents": f"document_id long, package_id long, title string, markdown string, sha256 string, {_REVIEW}, {_RELEASE}",
    "pdf_artifacts": f"artifact_id long, document_id long, filename string, media_type string, byte_size long, sha256 string, {_REVIEW}, {_RELEASE}",
}

#: What a new row has where nothing is given.
DEFAULTS = {"approval_status": "DRAFT", "release_status": "UNRELEASED", "verification_status": "UNVERIFIED"}

_STATES = {
    "approval_status": "approval_status in ('DRAFT', 'APPROVED', 'REJECTED')",
    "release_status": "release_status in ('UNRELEASED', 'RELEASED', 'WITHDRAWN')",
    "verification_status": "verification_status in ('UNVERIFIED', 'VERIFIED', 'DISPUTED')",
    "status": "status in ('SUCCEEDED', 'FAILED') and (status = 'FAILED') = (error_code is not null)",
    "position": "position >= 0",
    "tier": "tier between 1 and 4",
    "confidence": "confidence between 0 and 1",
    "http_status": "http_status between 100 and 599",
    "byte_size": "byte_size >= 0",
    "duration_ms": "duration_ms >= 0",
    "total_tokens": "total_tokens between 0 and 2147483647",
    "sha256": "sha256 rlike '^[0-9a-f]{64}$'",
    "char_end": "char_start >= 0 and char_end > char_start",
    "released_at": "(release_status = 'UNRELEASED') = (released_at is null)",
    "withdrawn_at": "(release_status = 'WITHDRAWN') = (withdrawn_at is not null)",
    "verdict": "verdict in ('SUPPORTED', 'CONTRADICTED', 'INSUFFICIENT')",
    "evidence_role": "evidence_role in ('SUPPORTS', 'CONTRADICTS', 'CONTEXT')",
    "version": "version > 0",
    "input_tokens": "input_tokens >= 0",
    "output_tokens": "output_tokens >= 0",
    "cost_currency": "length(cost_currency) = 3",
    "model_id": "length(model_id) between 1 and 128",
    "prompt_key": "length(prompt_key) between 1 and 100",
    "system_template": "trim(system_template) <> '' and length(system_template) <= 20000",
    "user_template": "trim(user_template) <> '' and length(user_template) <= 20000",
    "input_schema_version": "input_schema_version > 0",
    "output_schema_version": "output_schema_version > 0",
    "statement": "trim(statement) <> ''",
    "question_text": "trim(question_text) <> ''",
    "explanation": "trim(explanation) <> ''",
    "option_text": "trim(option_text) <> ''",
    "markdown": "trim(markdown) <> ''",
    "title": "trim(title) <> '' and length(title) <= 500",
    "location": "trim(location) <> ''",
    "name": "trim(name) <> '' and length(name) <= 255",
    "media_type": "media_type = 'application/pdf'",
    "approval_decided_at": "(approval_status = 'DRAFT') = (approval_decided_at is null)",
    "reviewer_note": "approval_status <> 'DRAFT' or reviewer_note is null",
    "release_note": "release_status <> 'UNRELEASED' or release_note is null",
    "year": "year > 0",
    "difficulty": "difficulty in ('EASY', 'MEDIUM', 'HARD')",
    "query": "trim(query) <> ''",
    "requested_url": "trim(requested_url) <> ''",
    "final_url": "trim(final_url) <> ''",
    "content_type": "trim(content_type) <> ''",
    "error_code": "error_code rlike '^[A-Z][A-Z0-9_]*$' and length(error_code) <= 100",
    "input_schema_key": "input_schema_key rlike '^[a-z][a-z0-9_.-]*$' and length(input_schema_key) <= 100",
    "output_schema_key": "output_schema_key rlike '^[a-z][a-z0-9_.-]*$' and length(output_schema_key) <= 100",
    "request_id": "length(request_id) between 1 and 100 and request_id = trim(request_id)",
    "provider_cost": "(provider_cost is null) = (cost_currency is null) and coalesce(provider_cost, 0) >= 0",
    "checksum": "checksum rlike '^[0-9a-f]{64}$'",
    "input_sha256": "input_sha256 rlike '^[0-9a-f]{64}$'",
    "output_sha256": "output_sha256 rlike '^[0-9a-f]{64}$'",
    "snapshot_sha256": "snapshot_sha256 rlike '^[0-9a-f]{64}$'",
    "text_sha256": "text_sha256 rlike '^[0-9a-f]{64}$'",
    "cited_text_sha256": "cited_text_sha256 rlike '^[0-9a-f]{64}$'",
}

#: Checks over several columns of one table.
_TOGETHER = {
    "source_fetch_runs": {"succeeded": "status <> 'SUCCEEDED' or (final_url is not null and http_status between 200 and 299 and error_code is null)"},
    "source_snapshots": {"byte_size_matches": "byte_size = octet_length(content)", "byte_size_positive": "byte_size > 0"},
    "ai_execution_runs": {"tokens_add_up": "total_tokens = input_tokens + output_tokens", "output_of_succeeded": "(status = 'SUCCEEDED') = (output_sha256 is not null)"},
    "ai_prompt_versions": {"schema_versions": "input_schema_version > 0 and output_schema_version > 0"},
    "source_candidate_promotions": {"approved": "approval_status = 'APPROVED' and approval_decided_at is not null"},
    "claim_extraction_evidence": {"place": "position >= 0 and char_start >= 0 and char_end > char_start"},
    "note_drafts": {"release_times": "released_at is null or withdrawn_at is null or withdrawn_at >= released_at"},
    "question_bank_items": {"release_times": "released_at is null or withdrawn_at is null or withdrawn_at >= released_at"},
    "content_packages": {"release_times": "released_at is null or withdrawn_at is null or withdrawn_at >= released_at"},
    "content_documents": {"release_times": "released_at is null or withdrawn_at is null or withdrawn_at >= released_at"},
    "pdf_artifacts": {"release_times": "released_at is null or withdrawn_at is null or withdrawn_at >= released_at"},
}


def columns(name: str) -> list[str]:
    return [part.split()[0] for part in SCHEMAS[name].replace("(18,6)", "").split(", ")]


#: Checks of each table: rule to condition, for the audit of a table.
CHECKS = {name: {f"{name}.{c}": _STATES[c] for c in columns(name) if c in _STATES} | {f"{name}.{c}": rule for c, rule in _TOGETHER.get(name, {}).items()} for name in SCHEMAS}


#: Columns that may be null, in every table or in the named one only.
OPTIONAL = set("description parent_id reviewer_note approval_decided_at released_at withdrawn_at release_note error_code final_url http_status text_char_count text_sha256 subject predicate object_value input_tokens output_tokens total_tokens provider_cost cost_currency output_sha256 claims.topic_id".split())


def kinds(name: str) -> dict[str, str]:
    """Declared column to type."""
    return dict(zip(columns(name), [p.split(" ", 1)[1] for p in SCHEMAS[name].replace(", ", "\n").splitlines()], strict=True))


def required(name: str) -> list[str]:
    return [c for c in columns(name) if c not in OPTIONAL and f"{name}.{c}" not in OPTIONAL]


def judged_table(stored: DataFrame, name: str) -> DataFrame:
    """Each stored row as `typed` (the declared columns, cast, defaults filled in) with `faults`: (column, reason), FAILED_CAST or NULL."""
    have, must = set(stored.columns), set(required(name))
    typed, faults = [], []
    for c, kind in kinds(name).items():
        if c not in have:  # a table's fault, not a row's
            typed.append(F.lit(DEFAULTS.get(c)).cast(kind).alias(c))
            continue
        value = F.col(f"`{c}`").try_cast(kind)
        filled = F.coalesce(value, F.when(F.col(f"`{c}`").isNull(), F.lit(DEFAULTS[c]))) if c in DEFAULTS else value
        typed.append(filled.alias(c))
        null = F.when(filled.isNull(), "NULL") if c in must else F.lit(None).cast("string")
        faults.append(F.struct(F.lit(c).alias("column"), F.when(F.col(f"`{c}`").isNotNull() & value.isNull(), "FAILED_CAST").otherwise(null).alias("reason")))
    found = F.filter(F.array(*faults), lambda f: f["reason"].isNotNull()) if faults else F.array().cast("array<struct<column:string,reason:string>>")
    return stored.select(F.struct(*typed).alias("typed"), found.alias("faults"), F.struct(*[F.col(f"`{c}`") for c in stored.columns]).alias("stored"))


def conforming(stored: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Typed rows that conform to a declared table, and the others as they are stored, with their faults."""
    judged = judged_table(stored, name)
    return judged.where(F.size("faults") == 0).select("typed.*"), judged.where(F.size("faults") > 0).select("stored", "faults")


def table_faults(stored: DataFrame, name: str) -> list[tuple[str, str]]:
    """(column, reason) of a stored table as such: columns that are unknown, and required ones without a default that lack."""
    unknown = [(c, "UNKNOWN_COLUMN") for c in stored.columns if c not in columns(name)]
    return unknown + [(c, "MISSING_COLUMN") for c in required(name) if c not in stored.columns and c not in DEFAULTS]


def conformity(tables: dict[str, DataFrame]) -> DataFrame:
    """table, column, reason and n: of each stored table its rows that conform (TYPED, no column) and how many have which fault; a pass a table."""
    out = []
    for name, stored in tables.items():
        each = judged_table(stored, name).select(F.explode(F.when(F.size("faults") > 0, F.col("faults")).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("column"), F.lit("TYPED").alias("reason"))))).alias("f"))
        out.append(each.groupBy("f.column", "f.reason").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "column", "reason", "n"))
    return reduce(DataFrame.unionByName, out)


def read_table(stored: DataFrame, name: str) -> DataFrame:
    """A stored table under its declared schema: columns that lack are null, values are cast, defaults filled in."""
    types = kinds(name)
    have = set(stored.columns)
    typed = [(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in types.items()]
    return stored.select(*typed).na.fill({c: v for c, v in DEFAULTS.items() if c in types})


def scan_table(spark: SparkSession, name: str, folder: str) -> DataFrame:
    return read_table(spark.read.parquet(f"{folder}/{name}.parquet"), name)

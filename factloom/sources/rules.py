"""Declared checks, keys and references of the stored tables as data, and how the engine tables name them."""

from __future__ import annotations

#: Columns that are unique together, a list a table.
UNIQUE = {
    "exams": [["exam_id"], ["name"]],
    "topics": [["topic_id"]],
    "syllabus_versions": [["syllabus_version_id"], ["exam_id", "label"]],
    "source_discovery_runs": [["run_id"], ["run_id", "status"]],
    "syllabus_version_topics": [["syllabus_version_id", "topic_id"], ["syllabus_version_id", "position"]],
    "previous_papers": [["paper_id"], ["exam_id", "year", "label"]],
    "previous_questions": [["question_id"], ["paper_id", "position"]],
    "content_versions": [["content_version_id"], ["syllabus_version_id", "topic_id", "version"], ["content_version_id", "topic_id"]],
    "source_candidates": [["candidate_id"], ["run_id", "location"], ["run_id", "position"]],
    "source_candidate_promotions": [["candidate_id"], ["source_id"]],
    "sources": [["source_id"]],
    "source_fetch_runs": [["run_id"], ["run_id", "source_id"]],
    "source_snapshots": [["snapshot_id"], ["fetch_run_id"], ["snapshot_id", "source_id", "sha256"]],
    "source_extraction_runs": [["run_id"], ["snapshot_id", "extractor_key"], ["run_id", "snapshot_id"]],
    "source_chunks": [["chunk_id"], ["run_id", "position"], ["run_id", "char_start", "char_end"]],
    "evidence": [["evidence_id"], ["evidence_id", "source_id"]],
    "claims": [["claim_id"]],
    "claim_evidence": [["claim_id", "evidence_id"]],
    "verifications": [["verification_id"]],
    "verification_evidence": [["verification_id", "evidence_id"], ["verification_id", "position"]],
    "ai_prompt_versions": [["prompt_id"], ["prompt_key", "version"], ["prompt_id", "prompt_key", "version", "checksum"]],
    "ai_execution_runs": [["execution_id"], ["request_id"]],
    "claim_extraction_runs": [["run_id"], ["execution_id"], ["run_id", "status"]],
    "claim_extraction_evidence": [["run_id", "evidence_id"], ["run_id", "position"], ["run_id", "chunk_id", "char_start", "char_end"]],
    "claim_extraction_claims": [["run_id", "claim_id"], ["run_id", "position"]],
    "claim_extraction_citations": [["run_id", "claim_id", "evidence_id"], ["run_id", "claim_id", "position"]],
    "note_drafts": [["note_id"], ["note_id", "content_version_id"]],
    "note_draft_claims": [["note_id", "claim_id"], ["note_id", "position"]],
    "question_bank_items": [["item_id"], ["item_id", "content_version_id"]],
    "question_bank_options": [["option_id"], ["item_id", "position"], ["item_id", "option_id"]],
    "question_bank_item_claims": [["item_id", "claim_id"], ["item_id", "position"]],
    "content_packages": [["package_id"], ["package_id", "content_version_id"]],
    "content_package_note_drafts": [["package_id", "note_id"], ["package_id", "position"]],
    "content_package_question_bank_items": [["package_id", "item_id"], ["package_id", "position"]],
    "content_documents": [["document_id"], ["package_id"]],
    "pdf_artifacts": [["artifact_id"], ["document_id"]],
}

#: References as (child, its columns, parent, its columns, what a deletion of the parent does).
REFERENCES = [
    ("topics", ["parent_id"], "topics", ["topic_id"], "RESTRICT"),
    ("syllabus_versions", ["exam_id"], "exams", ["exam_id"], "RESTRICT"),
    ("syllabus_versions", ["source_id"], "sources", ["source_id"], "RESTRICT"),
    ("syllabus_version_topics", ["syllabus_version_id"], "syllabus_versions", ["syllabus_version_id"], "RESTRICT"),
    ("syllabus_version_topics", ["topic_id"], "topics", ["topic_id"], "RESTRICT"),
    ("previous_papers", ["exam_id"], "exams", ["exam_id"], "RESTRICT"),
    ("previous_papers", ["source_id"], "sources", ["source_id"], "RESTRICT"),
    ("previous_questions", ["paper_id"], "previous_papers", ["paper_id"], "RESTRICT"),
    ("previous_questions", ["topic_id"], "topics", ["topic_id"], "RESTRICT"),
    ("content_versions", ["syllabus_version_id", "topic_id"], "syllabus_version_topics", ["syllabus_version_id", "topic_id"], "RESTRICT"),
    ("source_candidates", ["run_id"], "source_discovery_runs", ["run_id"], "RESTRICT"),
    ("source_candidate_promotions", ["candidate_id"], "source_candidates", ["candidate_id"], "RESTRICT"),
    ("source_candidate_promotions", ["source_id"], "sources", ["source_id"], "RESTRICT"),
    ("source_fetch_runs", ["source_id"], "sources", ["source_id"], "RESTRICT"),
    ("source_snapshots", ["fetch_run_id", "source_id"], "source_fetch_runs", ["run_id", "source_id"], "RESTRICT"),
    ("source_extraction_runs", ["snapshot_id"], "source_snapshots", ["snapshot_id"], "RESTRICT"),
    ("source_chunks", ["run_id"], "source_extraction_runs", ["run_id"], "CASCADE"),
    ("evidence", ["source_id"], "sources", ["source_id"], "CASCADE"),
    ("claims", ["topic_id"], "topics", ["topic_id"], "SET_NULL"),
    ("claim_evidence", ["claim_id"], "claims", ["claim_id"], "CASCADE"),
    ("claim_evidence", ["evidence_id"], "evidence", ["evidence_id"], "CASCADE"),
    ("verifications", ["claim_id"], "claims", ["claim_id"], "RESTRICT"),
    ("verification_evidence", ["verification_id"], "verifications", ["verification_id"], "CASCADE"),
    ("verification_evidence", ["evidence_id"], "evidence", ["evidence_id"], "RESTRICT"),
    ("ai_execution_runs", ["prompt_id"], "ai_prompt_versions", ["prompt_id"], "RESTRICT"),
    ("claim_extraction_runs", ["extraction_run_id"], "source_extraction_runs", ["run_id"], "RESTRICT"),
    ("claim_extraction_runs", ["execution_id"], "ai_execution_runs", ["execution_id"], "RESTRICT"),
    ("claim_extraction_evidence", ["run_id"], "claim_extraction_runs", ["run_id"], "CASCADE"),
    ("claim_extraction_evidence", ["chunk_id"], "source_chunks", ["chunk_id"], "RESTRICT"),
    ("claim_extraction_evidence", ["evidence_id"], "evidence", ["evidence_id"], "RESTRICT"),
    ("claim_extraction_claims", ["run_id"], "claim_extraction_runs", ["run_id"], "CASCADE"),
    ("claim_extraction_claims", ["claim_id"], "claims", ["claim_id"], "RESTRICT"),
    ("claim_extraction_citations", ["run_id", "claim_id"], "claim_extraction_claims", ["run_id", "claim_id"], "CASCADE"),
    ("claim_extraction_citations", ["run_id", "evidence_id"], "claim_extraction_evidence", ["run_id", "evidence_id"], "CASCADE"),
    ("claim_extraction_citations", ["claim_id", "evidence_id"], "claim_evidence", ["claim_id", "evidence_id"], "RESTRICT"),
    ("note_drafts", ["topic_id"], "topics", ["topic_id"], "RESTRICT"),
    ("note_drafts", ["content_version_id", "topic_id"], "content_versions", ["content_version_id", "topic_id"], "RESTRICT"),
    ("note_draft_claims", ["note_id"], "note_drafts", ["note_id"], "CASCADE"),
    ("note_draft_claims", ["claim_id"], "claims", ["claim_id"], "RESTRICT"),
    ("question_bank_items", ["content_version_id"], "content_versions", ["content_version_id"], "RESTRICT"),
    ("question_bank_items", ["item_id", "correct_option_id"], "question_bank_options", ["item_id", "option_id"], "RESTRICT"),
    ("question_bank_options", ["item_id"], "question_bank_items", ["item_id"], "CASCADE"),
    ("question_bank_item_claims", ["item_id"], "question_bank_items", ["item_id"], "CASCADE"),
    ("question_bank_item_claims", ["claim_id"], "claims", ["claim_id"], "RESTRICT"),
    ("content_packages", ["content_version_id"], "content_versions", ["content_version_id"], "RESTRICT"),
    ("content_package_note_drafts", ["package_id"], "content_packages", ["package_id"], "CASCADE"),
    ("content_package_note_drafts", ["note_id"], "note_drafts", ["note_id"], "RESTRICT"),
    ("content_package_question_bank_items", ["package_id"], "content_packages", ["package_id"], "CASCADE"),
    ("content_package_question_bank_items", ["item_id"], "question_bank_items", ["item_id"], "RESTRICT"),
    ("content_documents", ["package_id"], "content_packages", ["package_id"], "RESTRICT"),
    ("pdf_artifacts", ["document_id"], "content_documents", ["document_id"], "RESTRICT"),
]

#: Engine table of each declared table that the test tables give, and its columns by their declared names (declared=engine where they differ).
ENGINE = {
    "exams": ("exams", "exam_id name"),
    "topics": ("topics", "topic_id name"),
    "syllabus_version_topics": ("syllabus_topics", "syllabus_version_id=syllabus_id topic_id"),
    "previous_papers": ("papers", "paper_id exam_id year"),
    "previous_questions": ("questions", "paper_id topic_id position"),
    "content_versions": ("content_versions", "content_version_id syllabus_version_id=syllabus_id topic_id version"),
    "source_candidates": ("candidates", "candidate_id run_id location approval_status"),
    "source_candidate_promotions": ("promotions", "candidate_id location"),
    "sources": ("sources", "source_id name location tier"),
    "source_chunks": ("chunks", "chunk_id run_id position char_start char_end"),
    "evidence": ("evidence", "evidence_id source_id"),
    "claims": ("claims", "claim_id topic_id statement approval_status"),
    "claim_evidence": ("claim_evidence", "claim_id evidence_id"),
    "verifications": ("verifications", "verification_id claim_id verdict confidence"),
    "verification_evidence": ("verification_evidence", "verification_id evidence_id evidence_role position"),
    "ai_prompt_versions": ("prompts", "prompt_id prompt_key version system_template user_template input_schema_version output_schema_version"),
    "ai_execution_runs": ("executions", "execution_id prompt_id model_id input_tokens output_tokens total_tokens cost_currency"),
    "note_drafts": ("notes", "note_id content_version_id topic_id approval_status release_status markdown"),
    "note_draft_claims": ("note_claims", "note_id claim_id position"),
    "question_bank_items": ("items", "item_id content_version_id question_text explanation correct_option_id approval_status release_status"),
    "question_bank_options": ("options", "option_id item_id position option_text"),
    "question_bank_item_claims": ("item_claims", "item_id claim_id position"),
    "content_packages": ("packages", "package_id content_version_id release_status"),
    "content_package_note_drafts": ("package_notes", "package_id note_id position"),
    "content_package_question_bank_items": ("package_items", "package_id item_id position"),
    "content_documents": ("stored_documents", "document_id package_id title release_status"),
    "pdf_artifacts": ("artifacts", "artifact_id document_id media_type byte_size release_status"),
}


def engine_columns(name: str) -> dict[str, str]:
    """Declared to engine name of the columns of a declared table."""
    return {c.split("=")[0]: c.split("=")[-1] for c in ENGINE[name][1].split()}


def audited_keys() -> list[tuple[str, str, list[str]]]:
    """rule, declared table and columns of each key that the engine tables hold."""
    return [(f"{t}({','.join(key)})", t, key) for t in ENGINE for key in UNIQUE.get(t, []) if set(key) <= set(engine_columns(t))]


def held_references() -> list[tuple[str, list[str], str, list[str], str]]:
    """References whose columns the engine tables hold, as in REFERENCES."""
    return [r for r in REFERENCES if r[0] in ENGINE and r[2] in ENGINE and set(r[1]) <= set(engine_columns(r[0])) and set(r[3]) <= set(engine_columns(r[2]))]


def audited_references() -> list[tuple[str, str, list[str], str, list[str]]]:
    """rule, child, its columns, parent and its columns of each reference that the engine tables hold."""
    return [(f"{child}({','.join(columns)})->{parent}", child, columns, parent, keys) for child, columns, parent, keys, _ in held_references()]

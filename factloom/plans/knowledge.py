"""Queries on curriculum, sources, claims, notes, questions and packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import curation, priority
from factloom.operators import relational as rel

from .registry import query

_YEARS = "array_to_string(list_sort(list_distinct(list(p.year))), ',')"
_STATS = """SELECT p.exam_id, q.topic_id, count(*) AS matched_question_count, count(DISTINCT q.paper_id) AS matched_paper_count,
 array_to_string(list_sort(list(DISTINCT p.year)), ',') AS matched_years FROM {questions} q JOIN {papers} p ON p.paper_id = q.paper_id GROUP BY p.exam_id, q.topic_id"""


@query(f"SELECT s.*, t.exam_paper_count FROM ({_STATS}) s JOIN (SELECT exam_id, count(*) AS exam_paper_count FROM {{papers}} GROUP BY exam_id) t ON t.exam_id = s.exam_id")
def topic_occurrence_stats(t) -> DataFrame:
    return priority.topic_occurrence_stats(t("papers"), t("questions")).withColumn("matched_years", rel.joined_text(F.col("matched_years")))


@query(
    f"""SELECT x.exam_id, x.topic_id, x.covered, coalesce(n, 0) AS exam_paper_count, coalesce(matched_question_count, 0) AS matched_question_count, coalesce(matched_paper_count, 0) AS matched_paper_count,
 coalesce(matched_years, '') AS matched_years, CASE WHEN NOT x.covered THEN 'LOW' WHEN matched_paper_count >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS band,
 CASE WHEN x.covered THEN 'DIRECT_SYLLABUS_COVERAGE' ELSE 'NOT_IN_SELECTED_SYLLABUS_VERSION' END || ',' ||
 CASE WHEN n IS NULL THEN 'NO_PREVIOUS_PAPER_DATA' WHEN matched_paper_count >= 2 THEN 'REPEATED_IN_PREVIOUS_PAPERS' WHEN matched_paper_count = 1 THEN 'APPEARED_IN_PREVIOUS_PAPER' ELSE 'NO_RECORDED_PREVIOUS_OCCURRENCE' END AS reasons,
 'topic-priority-v1' AS rule_version
 FROM {{syllabus_pairs}} x LEFT JOIN ({_STATS}) s ON s.exam_id = x.exam_id AND s.topic_id = x.topic_id LEFT JOIN (SELECT exam_id, count(*) AS n FROM {{papers}} GROUP BY exam_id) p ON p.exam_id = x.exam_id"""
)
def topic_priority(t) -> DataFrame:
    papers = t("papers")
    found = priority.topic_priority(t("syllabus_pairs"), priority.topic_occurrence_stats(papers, t("questions")), priority.paper_totals(papers))
    return found.withColumns({"matched_years": rel.joined_text(F.col("matched_years")), "reasons": F.array_join("reasons", ",")})


@query("SELECT p.paper_id, p.exam_id, p.year, q.position FROM {papers} p LEFT JOIN {questions} q ON q.paper_id = p.paper_id AND q.topic_id = 17")
def paper_question_outer(t) -> DataFrame:
    return priority.paper_question_outer(t("papers"), t("questions"), 17)


@query("SELECT x.exam_id, x.topic_id, s.topic_id IS NOT NULL AS covered FROM {syllabus_pairs} x LEFT JOIN {syllabus_topics} s ON s.syllabus_id = x.exam_id AND s.topic_id = x.topic_id")
def syllabus_coverage(t) -> DataFrame:
    pairs = t("syllabus_pairs").select("exam_id", "topic_id")
    covered = t("syllabus_topics").select(F.col("syllabus_id").alias("exam_id"), "topic_id", F.lit(True).alias("covered"))
    return pairs.join(covered, ["exam_id", "topic_id"], "left").na.fill(False, ["covered"])


@query("SELECT candidate_id, run_id, location FROM {candidates} WHERE approval_status = 'APPROVED'")
def approved_candidates(t) -> DataFrame:
    return t("candidates").where("approval_status = 'APPROVED'").select("candidate_id", "run_id", "location").orderBy("candidate_id")


_CLAIMS = "SELECT c.claim_id, c.topic_id, c.statement, coalesce(array_to_string(list_sort(list(e.evidence_id) FILTER (WHERE e.evidence_id IS NOT NULL)), ','), '') AS evidence_ids FROM {claims} c LEFT JOIN {claim_evidence} e ON e.claim_id = c.claim_id WHERE c.approval_status = 'APPROVED' GROUP BY c.claim_id, c.topic_id, c.statement"


@query(_CLAIMS)
def approved_claims(t) -> DataFrame:
    return curation.approved_claims(t("claims"), t("claim_evidence")).withColumn("evidence_ids", rel.joined_text(F.col("evidence_ids")))


@query("SELECT t.topic_id, t.name, coalesce(array_to_string(list_sort(list(c.claim_id) FILTER (WHERE c.claim_id IS NOT NULL)), ','), '') AS claim_ids FROM {topics} t LEFT JOIN {claims} c ON c.topic_id = t.topic_id AND c.approval_status = 'APPROVED' GROUP BY t.topic_id, t.name")
def approved_claims_by_topic(t) -> DataFrame:
    found = rel.nest_children(t("topics"), t("claims").where("approval_status = 'APPROVED'"), key="topic_id", order_by=["claim_id"], fields=[], as_="claims")
    return found.select("topic_id", "name", rel.joined_text(F.col("claims.claim_id")).alias("claim_ids"))


_NOTES = "SELECT n.note_id, n.release_status, t.name AS topic_name, array_to_string(list(c.claim_id ORDER BY c.position), ',') AS claim_ids FROM {notes} n JOIN {topics} t ON t.topic_id = n.topic_id LEFT JOIN {note_claims} c ON c.note_id = n.note_id WHERE %s GROUP BY n.note_id, n.release_status, t.name"


@query(_NOTES % "n.approval_status = 'APPROVED'")
def approved_notes(t) -> DataFrame:
    return curation.notes_view(t("notes").where("approval_status = 'APPROVED'"), t("note_claims"), t("topics")).withColumn("claim_ids", rel.joined_text(F.col("claim_ids")))


@query(_NOTES % "n.release_status = 'RELEASED'")
def released_notes(t) -> DataFrame:
    return curation.notes_view(t("notes").where("release_status = 'RELEASED'"), t("note_claims"), t("topics")).withColumn("claim_ids", rel.joined_text(F.col("claim_ids")))


_ITEMS = """SELECT i.item_id, i.question_text, coalesce(c.claim_ids, '') AS claim_ids, o.options, o.correct_option_position FROM {items} i
 LEFT JOIN (SELECT item_id, array_to_string(list(claim_id ORDER BY position, claim_id), ',') AS claim_ids FROM {item_claims} GROUP BY item_id) c ON c.item_id = i.item_id
 LEFT JOIN (SELECT o.item_id, array_to_string(list(option_text ORDER BY position, option_id), '|') AS options, min(CASE WHEN o.option_id = i.correct_option_id THEN position END) AS correct_option_position FROM {options} o JOIN {items} i ON i.item_id = o.item_id GROUP BY o.item_id) o ON o.item_id = i.item_id
 WHERE %s"""


def _items(t, condition: str) -> DataFrame:
    found = curation.items_view(t("items").where(condition), t("options"), t("item_claims"))
    return found.select("item_id", "question_text", rel.joined_text(F.col("claim_ids")).alias("claim_ids"), F.array_join("options.option_text", "|").alias("options"), "correct_option_position")


@query(_ITEMS % "i.approval_status = 'APPROVED'")
def approved_items(t) -> DataFrame:
    return _items(t, "approval_status = 'APPROVED'")


@query(_ITEMS % "i.release_status = 'RELEASED'")
def released_items(t) -> DataFrame:
    return _items(t, "release_status = 'RELEASED'")


@query(
    """SELECT p.package_id, coalesce(n.ids, '') AS note_ids, coalesce(i.ids, '') AS item_ids FROM {packages} p
 LEFT JOIN (SELECT package_id, array_to_string(list(note_id ORDER BY position), ',') AS ids FROM {package_notes} GROUP BY package_id) n ON n.package_id = p.package_id
 LEFT JOIN (SELECT package_id, array_to_string(list(item_id ORDER BY position), ',') AS ids FROM {package_items} GROUP BY package_id) i ON i.package_id = p.package_id WHERE p.release_status = 'RELEASED'"""
)
def released_packages(t) -> DataFrame:
    found = curation.package_members(t("packages").where("release_status = 'RELEASED'"), t("package_notes"), t("package_items"))
    return found.select("package_id", rel.joined_text(F.col("note_ids")).alias("note_ids"), rel.joined_text(F.col("item_ids")).alias("item_ids"))


@query("SELECT document_id, package_id, title FROM {stored_documents} WHERE release_status = 'RELEASED'")
def released_documents(t) -> DataFrame:
    return t("stored_documents").where("release_status = 'RELEASED'").select("document_id", "package_id", "title").orderBy("document_id")


@query("SELECT artifact_id, document_id, filename, media_type, CAST(byte_size AS BIGINT) AS byte_size FROM {artifacts} WHERE release_status = 'RELEASED'")
def released_artifacts(t) -> DataFrame:
    return t("artifacts").where("release_status = 'RELEASED'").select("artifact_id", "document_id", "filename", "media_type", F.col("byte_size").cast("long").alias("byte_size")).orderBy("artifact_id")


@query(
    """SELECT i.item_id, coalesce(n, 0) >= 2 AND coalesce(has, FALSE) AS complete FROM {items} i LEFT JOIN (SELECT o.item_id, count(*) AS n, bool_or(o.option_id = i.correct_option_id) AS has FROM {options} o JOIN {items} i ON i.item_id = o.item_id GROUP BY o.item_id) o ON o.item_id = i.item_id"""
)
def item_completeness(t) -> DataFrame:
    return curation.item_completeness(t("items"), t("options")).select("item_id", "complete")


@query(
    """SELECT r.item_id, coalesce(min(CASE WHEN code <> 'OK' THEN lpad(CAST(position AS VARCHAR), 5, '0') || ':' || code END), 'OK') AS outcome FROM (
 SELECT n.note_id AS item_id, n.position, CASE WHEN c.claim_id IS NULL THEN 'NOT_FOUND' WHEN c.approval_status <> 'APPROVED' THEN 'NOT_APPROVED' WHEN c.topic_id <> t.topic_id THEN 'TOPIC_MISMATCH' ELSE 'OK' END AS code
 FROM {note_claims} n JOIN {notes} t ON t.note_id = n.note_id LEFT JOIN {claims} c ON c.claim_id = n.claim_id) r GROUP BY r.item_id"""
)
def claim_selection(t) -> DataFrame:
    requests = rel.nest_children(t("notes").select("note_id", "topic_id"), t("note_claims"), key="note_id", order_by=["position"], fields=["claim_id"], as_="wanted")
    found = curation.claim_selection(requests.select(F.col("note_id").alias("item_id"), "topic_id", F.col("wanted.claim_id").alias("claim_ids")), t("claims"))
    return found.select("item_id", F.when(F.col("code") == "OK", F.lit("OK")).otherwise(F.concat(F.lpad(F.col("position").cast("string"), 5, "0"), F.lit(":"), "code")).alias("outcome"))


@query("SELECT l.package_id, l.position, n.note_id, n.topic_id, n.markdown FROM {package_notes} l JOIN {notes} n ON n.note_id = l.note_id")
def package_notes(t) -> DataFrame:
    return t("package_notes").join(t("notes").select("note_id", "topic_id", "markdown"), "note_id").select("package_id", "position", "note_id", "topic_id", "markdown").orderBy("package_id", "position")


@query(f"SELECT l.package_id, l.position, x.* FROM {{package_items}} l JOIN ({_ITEMS % 'TRUE'}) x ON x.item_id = l.item_id")
def package_items(t) -> DataFrame:
    return t("package_items").join(_items(t, "true"), "item_id").orderBy("package_id", "position")


@query("SELECT c.claim_id, coalesce(array_to_string(list(e.evidence_id ORDER BY e.evidence_id) FILTER (WHERE e.evidence_id IS NOT NULL), ','), '') AS children FROM {claims} c LEFT JOIN {claim_evidence} e ON e.claim_id = c.claim_id GROUP BY c.claim_id")
def nest_children(t) -> DataFrame:
    found = rel.nest_children(t("claims").select("claim_id"), t("claim_evidence"), key="claim_id", order_by=["evidence_id"], fields=[], as_="children")
    return found.select("claim_id", rel.joined_text(F.col("children.evidence_id")).alias("children"))


@query("SELECT e.evidence_id, e.location_reference, s.name AS source_name, s.tier FROM {evidence} e LEFT JOIN {sources} s ON s.source_id = e.source_id")
def attach_parent(t) -> DataFrame:
    found = rel.attach_parent(t("evidence"), t("sources").withColumnRenamed("name", "source_name"), "source_id", ["source_name", "tier"])
    return found.select("evidence_id", "location_reference", "source_name", "tier")


@query(
    """SELECT v.verification_id, v.claim_id, c.statement, v.verdict, coalesce(string_agg(ve.evidence_role || '@' || coalesce(s.name, ''), ',' ORDER BY ve.position, ve.evidence_id), '') AS evidence FROM {verifications} v JOIN {claims} c ON c.claim_id = v.claim_id
 LEFT JOIN {verification_evidence} ve ON ve.verification_id = v.verification_id LEFT JOIN {evidence} e ON e.evidence_id = ve.evidence_id LEFT JOIN {sources} s ON s.source_id = e.source_id GROUP BY v.verification_id, v.claim_id, c.statement, v.verdict"""
)
def verification_view(t) -> DataFrame:
    found = curation.verification_view(t("verifications"), t("claims"), t("verification_evidence"), t("evidence"), t("sources"))
    listed = F.transform("evidence", lambda e: F.concat(e["evidence_role"], F.lit("@"), F.coalesce(e["source_name"], F.lit(""))))
    return found.select("verification_id", "claim_id", "statement", "verdict", F.array_join(listed, ",").alias("evidence"))


@query(
    """SELECT 'candidate' AS kind, candidate_id AS id FROM {candidates} c WHERE c.approval_status = 'APPROVED' AND NOT EXISTS (SELECT 1 FROM {promotions} p WHERE p.candidate_id = c.candidate_id)
 UNION ALL SELECT 'snapshot', doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {chunks} k WHERE k.run_id = d.doc_id)
 UNION ALL SELECT 'package', package_id FROM {packages} p WHERE release_status = 'RELEASED' AND NOT EXISTS (SELECT 1 FROM {stored_documents} s WHERE s.package_id = p.package_id)"""
)
def pending_work(t) -> DataFrame:
    """Approved candidates without promotion, snapshots without extraction, released packages without document."""
    gates = [
        ("candidate", rel.pending(t("candidates").where("approval_status = 'APPROVED'"), t("promotions"), "candidate_id"), "candidate_id"),
        ("snapshot", rel.pending(t("documents"), t("chunks").select(F.col("run_id").alias("doc_id")), "doc_id"), "doc_id"),
        ("package", rel.pending(t("packages").where("release_status = 'RELEASED'"), t("stored_documents"), "package_id"), "package_id"),
    ]
    out = [df.select(F.lit(kind).alias("kind"), F.col(key).alias("id")) for kind, df, key in gates]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    """SELECT n.note_id, n.topic_id, 'claim' AS kind, c.claim_id AS other_id, c.topic_id AS other_topic_id FROM {notes} n JOIN {note_claims} l ON l.note_id = n.note_id JOIN {claims} c ON c.claim_id = l.claim_id WHERE c.topic_id <> n.topic_id
 UNION ALL SELECT n.note_id, n.topic_id, 'version', v.content_version_id, v.topic_id FROM {notes} n JOIN {content_versions} v ON v.content_version_id = n.content_version_id WHERE v.topic_id <> n.topic_id"""
)
def same_topic_check(t) -> DataFrame:
    return curation.topic_mismatches(t("notes"), t("note_claims"), t("claims"), t("content_versions"))


@query("SELECT claim_id, evidence_id, count(*) AS n FROM (SELECT * FROM {claim_evidence} UNION ALL SELECT claim_id, evidence_id FROM {claim_evidence} WHERE claim_id % 3 = 0) x GROUP BY claim_id, evidence_id HAVING count(*) > 1")
def duplicate_keys(t) -> DataFrame:
    links = t("claim_evidence")
    return rel.duplicate_keys(links.unionByName(links.where("claim_id % 3 = 0")), ["claim_id", "evidence_id"])


@query("SELECT claim_id, arg_max(verdict, row(created_at, verification_id)) AS verdict, arg_max(confidence, row(created_at, verification_id)) AS confidence, max(created_at) AS created_at FROM {verifications} GROUP BY claim_id")
def latest_verification(t) -> DataFrame:
    return rel.latest_by(t("verifications"), "claim_id", ["created_at", "verification_id"], ["verdict", "confidence", "created_at"])


@query(
    """SELECT t.topic_id, p.part, CASE WHEN p.part = f.first THEN '# ' || t.name || chr(10) || chr(10) ELSE '' END || p.lines AS markdown, CASE WHEN p.part IS NULL THEN 'NO_APPROVED_CLAIMS' END AS conflict FROM {topics} t
 LEFT JOIN (SELECT topic_id, claim_id // 1000 AS part, string_agg('- ' || statement, chr(10) ORDER BY claim_id) AS lines FROM {claims} WHERE approval_status = 'APPROVED' GROUP BY topic_id, claim_id // 1000) p ON p.topic_id = t.topic_id
 LEFT JOIN (SELECT topic_id, min(claim_id // 1000) AS first FROM {claims} WHERE approval_status = 'APPROVED' GROUP BY topic_id) f ON f.topic_id = t.topic_id"""
)
def note_markdown(t) -> DataFrame:
    return curation.note_markdown(t("topics"), t("claims").where("approval_status = 'APPROVED'"))


_DOCUMENTS = """SELECT p.package_id, 'Content Package ' || p.package_id AS title, CASE WHEN b.bad IS NULL THEN m.markdown END AS markdown, CASE WHEN b.bad IS NULL THEN sha256(m.markdown) END AS sha256, b.bad AS error FROM {packages} p
 LEFT JOIN (SELECT l.package_id, min(CASE WHEN coalesce(o.n, 0) > 26 THEN 'TOO_MANY_OPTIONS' WHEN o.answer IS NULL THEN 'NO_ANSWER' END) AS bad FROM {package_items} l LEFT JOIN (SELECT o.item_id, count(*) AS n, min(CASE WHEN o.option_id = i.correct_option_id THEN option_text END) AS answer FROM {options} o JOIN {items} i ON i.item_id = o.item_id GROUP BY o.item_id) o ON o.item_id = l.item_id GROUP BY l.package_id) b ON b.package_id = p.package_id
 LEFT JOIN (SELECT package_id, string_agg(part, chr(10) || chr(10) ORDER BY section, position) || chr(10) AS markdown FROM (
  SELECT package_id, 0 AS section, 0 AS position, '# Content Package ' || package_id AS part FROM {packages}
  UNION ALL SELECT DISTINCT package_id, 1, 0, '## Notes' FROM {package_notes}
  UNION ALL SELECT l.package_id, 2, l.position, rtrim(n.markdown, chr(10)) FROM {package_notes} l JOIN {notes} n ON n.note_id = l.note_id
  UNION ALL SELECT DISTINCT package_id, 3, 0, '## Practice Questions' FROM {package_items}
  UNION ALL SELECT l.package_id, 4, l.position, '### Question ' || (l.position + 1) || chr(10) || chr(10) || i.question_text || chr(10) || chr(10) || o.lines || chr(10) || chr(10) || '**Answer:** ' || o.answer || chr(10) || chr(10) || '**Explanation:** ' || i.explanation
   FROM {package_items} l JOIN {items} i ON i.item_id = l.item_id LEFT JOIN (SELECT item_id, string_agg(label || '. ' || option_text, chr(10) ORDER BY place) AS lines, min(CASE WHEN option_id = correct_option_id THEN label || '. ' || option_text END) AS answer FROM (SELECT o.*, i.correct_option_id, row_number() OVER (PARTITION BY o.item_id ORDER BY o.position, o.option_id) AS place, chr(CAST(64 + least(60, row_number() OVER (PARTITION BY o.item_id ORDER BY o.position, o.option_id)) AS INTEGER)) AS label FROM {options} o JOIN {items} i ON i.item_id = o.item_id) z GROUP BY item_id) o ON o.item_id = l.item_id
 ) parts GROUP BY package_id) m ON m.package_id = p.package_id WHERE p.release_status = 'RELEASED'"""


@query(_DOCUMENTS)
def document_markdown(t) -> DataFrame:
    return curation.document_markdown(t("packages").where("release_status = 'RELEASED'"), t("package_notes"), t("notes"), t("package_items"), t("items"), t("options"))


@query(
    """SELECT v.content_version_id, coalesce(n.ids, '') AS note_ids, coalesce(i.ids, '') AS item_ids FROM {content_versions} v
 LEFT JOIN (SELECT content_version_id, array_to_string(list(note_id ORDER BY note_id), ',') AS ids FROM {notes} WHERE release_status = 'RELEASED' GROUP BY 1) n ON n.content_version_id = v.content_version_id
 LEFT JOIN (SELECT content_version_id, array_to_string(list(item_id ORDER BY item_id), ',') AS ids FROM {items} WHERE release_status = 'RELEASED' GROUP BY 1) i ON i.content_version_id = v.content_version_id"""
)
def released_assets_manifest(t) -> DataFrame:
    found = curation.released_assets_manifest(t("content_versions"), t("notes"), t("items"))
    return found.select("content_version_id", rel.joined_text(F.col("note_ids")).alias("note_ids"), rel.joined_text(F.col("item_ids")).alias("item_ids"))


@query("SELECT syllabus_id, topic_id, topic_name, row_number() OVER (PARTITION BY syllabus_id ORDER BY topic_id) - 1 AS position FROM {syllabus_topics}")
def assign_positions(t) -> DataFrame:
    return rel.numbered(t("syllabus_topics"), "syllabus_id", ["topic_id"])


@query("SELECT syllabus_id, topic_id, max(CASE WHEN version > 0 THEN version END) AS version, count(*) AS n_versions, count(*) FILTER (WHERE version <= 0 OR n > 1) AS n_invalid FROM (SELECT syllabus_id, topic_id, version, count(*) AS n FROM {version_log} GROUP BY ALL) x GROUP BY syllabus_id, topic_id")
def content_version_sequence(t) -> DataFrame:
    return curation.current_versions(t("version_log"))


@query("SELECT claim_id, topic_id, statement FROM {claims}")
def stable_listing(t) -> DataFrame:
    return t("claims").select("claim_id", "topic_id", "statement").orderBy("claim_id")


@query("SELECT package_id, 'note' AS kind, note_id AS member_id, position FROM {package_notes} UNION ALL SELECT package_id, 'item', item_id, position FROM {package_items}")
def package_members_union(t) -> DataFrame:
    return curation.package_members_union(t("package_notes"), t("package_items"))


@query(
    """SELECT p.package_id, coalesce(s.ids, '') AS stored, coalesce(r.ids, '') AS resolved FROM {packages} p
 LEFT JOIN (SELECT package_id, array_to_string(list(note_id ORDER BY position), ',') AS ids FROM {package_notes} GROUP BY 1) s ON s.package_id = p.package_id
 LEFT JOIN (SELECT l.package_id, array_to_string(list(l.note_id ORDER BY l.position), ',') AS ids FROM {package_notes} l JOIN {notes} n ON n.note_id = l.note_id WHERE n.note_id % 6 <> 0 GROUP BY 1) r ON r.package_id = p.package_id WHERE coalesce(s.ids, '') <> coalesce(r.ids, '')"""
)
def membership_equality(t) -> DataFrame:
    differ = curation.membership_differences(t("packages"), t("package_notes"), t("notes").where("note_id % 6 <> 0"))
    return differ.select("package_id", rel.joined_text(F.col("stored")).alias("stored"), rel.joined_text(F.col("resolved")).alias("resolved"))


@query(
    """SELECT claim_id, evidence_id, reason, count(*) AS n FROM (SELECT claim_id, evidence_id, CASE WHEN claim_id IN (SELECT claim_id FROM {claims} WHERE approval_status = 'APPROVED') THEN 'EXISTS' WHEN row_number() OVER (PARTITION BY claim_id, evidence_id) > 1 THEN 'REPEATED' ELSE 'WRITTEN' END AS reason
 FROM (SELECT * FROM {claim_evidence} UNION ALL SELECT * FROM {claim_evidence}) twice) x GROUP BY claim_id, evidence_id, reason"""
)
def append_if_absent(t) -> DataFrame:
    """All links, each given twice, appended to those of approved claims: what is written and what is refused."""
    links = t("claim_evidence")
    stored = links.join(t("claims").where("approval_status = 'APPROVED'").select("claim_id").hint("merge"), "claim_id", "left_semi")
    written, refused = rel.append(links.unionByName(links), stored, key=["claim_id", "evidence_id"], order=["evidence_id"])
    return written.withColumn("reason", F.lit("WRITTEN")).unionByName(refused).groupBy("claim_id", "evidence_id", "reason").agg(F.count("*").alias("n"))


@query("SELECT candidate_id, location, 'APPROVED' AS approval_status, note, row_number() OVER (ORDER BY candidate_id) AS source_number FROM {candidates} c WHERE approval_status = 'APPROVED' AND candidate_id NOT IN (SELECT candidate_id FROM {promotions})")
def promote_candidates(t) -> DataFrame:
    return curation.promote_candidates(t("candidates"), t("promotions"))

"""Read views over claims, notes, question items, packages and their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.storage import settled

from . import relational as rel

MAX_OPTIONS = 26


def approved_claims(claims: DataFrame, links: DataFrame) -> DataFrame:
    found = rel.nest_children(claims.where("approval_status = 'APPROVED'"), links, key="claim_id", order_by=["evidence_id"], fields=[], as_="_links")
    return found.select("claim_id", "topic_id", "statement", F.col("_links.evidence_id").alias("evidence_ids"))


def notes_view(notes: DataFrame, note_claims: DataFrame, topics: DataFrame) -> DataFrame:
    named = notes.join(topics.select("topic_id", F.col("name").alias("topic_name")), "topic_id")
    nested = rel.nest_children(named, note_claims, key="note_id", order_by=["position"], fields=["claim_id"], as_="_claims")
    return nested.select("note_id", "release_status", "topic_name", F.col("_claims.claim_id").alias("claim_ids"))


def items_view(items: DataFrame, options: DataFrame, item_claims: DataFrame) -> DataFrame:
    """Items with options and claim ids nested separately, so that neither multiplies the other."""
    nested = rel.nest_children(items, options, key="item_id", order_by=["position", "option_id"], fields=["option_text"], as_="options")
    nested = rel.nest_children(nested, item_claims, key="item_id", order_by=["position", "claim_id"], fields=[], as_="_claims")
    right = F.filter("options", lambda o: o["option_id"] == F.col("correct_option_id"))
    return nested.withColumn("claim_ids", F.col("_claims.claim_id")).withColumn("correct_option_position", F.array_min(F.transform(right, lambda o: o["position"]))).drop("_claims")


def item_completeness(items: DataFrame, options: DataFrame) -> DataFrame:
    """At least two options, the correct one among them."""
    nested = rel.nest_children(items, options, key="item_id", order_by=["position"], fields=["option_id"], as_="options")
    return nested.withColumn("complete", (F.size("options") >= 2) & F.coalesce(F.exists("options", lambda o: o["option_id"] == F.col("correct_option_id")), F.lit(False)))


def claim_selection(requests: DataFrame, claims: DataFrame) -> DataFrame:
    """requests: item_id, topic_id, claim_ids. The first claim in list order that can't be used decides: position and code, else OK."""
    wanted = requests.select("item_id", "topic_id", F.posexplode("claim_ids").alias("position", "claim_id"))
    known = claims.select("claim_id", F.col("topic_id").alias("claim_topic"), "approval_status", F.lit(True).alias("there"))
    code = F.when(F.col("there").isNull(), "NOT_FOUND").when(F.col("approval_status") != "APPROVED", "NOT_APPROVED").when(F.col("claim_topic") != F.col("topic_id"), "TOPIC_MISMATCH")
    coded = wanted.join(known.hint("merge"), "claim_id", "left").withColumn("code", code)
    failed = coded.where("code is not null").groupBy("item_id").agg(F.min(F.struct("position", "code")).alias("first"))
    return requests.select("item_id").join(failed.hint("merge"), "item_id", "left").select("item_id", F.col("first.position").alias("position"), F.coalesce("first.code", F.lit("OK")).alias("code"))


def package_members(packages: DataFrame, notes: DataFrame, items: DataFrame) -> DataFrame:
    found = rel.nest_children(packages, notes, key="package_id", order_by=["position"], fields=["note_id"], as_="_notes")
    found = rel.nest_children(found, items, key="package_id", order_by=["position"], fields=["item_id"], as_="_items")
    return found.withColumn("note_ids", F.col("_notes.note_id")).withColumn("item_ids", F.col("_items.item_id")).drop("_notes", "_items")


def package_members_union(notes: DataFrame, items: DataFrame) -> DataFrame:
    one = notes.select("package_id", F.lit("note").alias("kind"), F.col("note_id").alias("member_id"), "position")
    return one.unionByName(items.select("package_id", F.lit("item").alias("kind"), F.col("item_id").alias("member_id"), "position"))


def membership_differences(packages: DataFrame, members: DataFrame, notes: DataFrame) -> DataFrame:
    """Packages whose stored note ids, in order, are not those that resolve."""
    resolved = members.join(notes.select("note_id"), "note_id", "left_semi")
    both = rel.nest_children(packages.select("package_id"), members, key="package_id", order_by=["position"], fields=["note_id"], as_="_s")
    both = rel.nest_children(both, resolved, key="package_id", order_by=["position"], fields=["note_id"], as_="_r")
    return both.select("package_id", F.col("_s.note_id").alias("stored"), F.col("_r.note_id").alias("resolved")).where("not (stored <=> resolved)")


def verification_view(verifications: DataFrame, claims: DataFrame, links: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    named = rel.attach_parent(rel.attach_parent(links, evidence, "evidence_id", ["source_id"]), sources.withColumnRenamed("name", "source_name"), "source_id", ["source_name"])
    nested = rel.nest_children(verifications, named, key="verification_id", order_by=["position", "evidence_id"], fields=["evidence_role", "source_name"], as_="evidence")
    return nested.join(claims.select("claim_id", "statement"), "claim_id")


def note_markdown(topics: DataFrame, claims: DataFrame, *, part_ids: int = 1000) -> DataFrame:
    """A note a topic: a heading and its approved claims in id order, in parts. Topics without any are conflicts.

    A part holds the claims of a range of part_ids ids, so that no row grows with the table; a topic's parts in order,
    joined by line feeds, are its note. The heading stands in the first.
    """
    placed = claims.select("topic_id", "claim_id", "statement", F.floor(F.col("claim_id") / part_ids).alias("part"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_id", "statement"))), lambda c: F.concat(F.lit("- "), c["statement"])), "\n")
    parts = placed.groupBy("topic_id", "part").agg(lines.alias("lines"))
    first = placed.groupBy("topic_id").agg(F.min("part").alias("first"))
    found = topics.join(first, "topic_id", "left").join(parts, "topic_id", "left")
    heading = F.when(F.col("part") == F.col("first"), F.concat(F.lit("# "), "name", F.lit("\n\n"))).otherwise("")
    return found.select("topic_id", "part", F.concat(heading, "lines").alias("markdown"), F.when(F.col("part").isNull(), F.lit("NO_APPROVED_CLAIMS")).alias("conflict"))


def current_versions(versions: DataFrame) -> DataFrame:
    """syllabus_id, topic_id, the current version (the highest), how many there are, and how many are invalid: not positive, or given twice."""
    each = versions.groupBy("syllabus_id", "topic_id", "version").agg(F.count("*").alias("n"))
    invalid = F.count_if((F.col("version") <= 0) | (F.col("n") > 1))
    return each.groupBy("syllabus_id", "topic_id").agg(F.max(F.when(F.col("version") > 0, F.col("version"))).alias("version"), F.count("*").alias("n_versions"), invalid.alias("n_invalid"))


def topic_mismatches(notes: DataFrame, note_claims: DataFrame, claims: DataFrame, versions: DataFrame) -> DataFrame:
    """note_id, topic_id, kind, other_id and other_topic_id: claims and content versions of another topic than their note's."""
    own = notes.select("note_id", "topic_id", "content_version_id")
    by_claim = own.join(note_claims.select("note_id", "claim_id"), "note_id").join(claims.select("claim_id", F.col("topic_id").alias("other_topic_id")), "claim_id")
    by_version = own.join(versions.select("content_version_id", F.col("topic_id").alias("other_topic_id")), "content_version_id")
    both = by_claim.select("note_id", "topic_id", F.lit("claim").alias("kind"), F.col("claim_id").alias("other_id"), "other_topic_id")
    both = both.unionByName(by_version.select("note_id", "topic_id", F.lit("version").alias("kind"), F.col("content_version_id").alias("other_id"), "other_topic_id"))
    return both.where("other_topic_id <> topic_id")


def release_guards(notes: DataFrame, items: DataFrame, options: DataFrame, packages: DataFrame, package_notes: DataFrame, package_items: DataFrame) -> DataFrame:
    """asset_kind, asset_id and guard_ok: a note has a content version, an item is complete, a package has members."""
    own_notes = notes.select(F.lit("note").alias("asset_kind"), F.col("note_id").alias("asset_id"), F.col("content_version_id").isNotNull().alias("guard_ok"))
    own_items = item_completeness(items, options).select(F.lit("item").alias("asset_kind"), F.col("item_id").alias("asset_id"), F.col("complete").alias("guard_ok"))
    filled = package_notes.select("package_id").unionByName(package_items.select("package_id")).distinct().withColumn("filled", F.lit(True))
    own_packages = packages.select("package_id").join(filled, "package_id", "left").select(F.lit("package").alias("asset_kind"), F.col("package_id").alias("asset_id"), F.coalesce("filled", F.lit(False)).alias("guard_ok"))
    return own_notes.unionByName(own_items).unionByName(own_packages)


def released_assets_manifest(versions: DataFrame, notes: DataFrame, items: DataFrame) -> DataFrame:
    found = rel.nest_children(versions.select("content_version_id"), notes.where("release_status = 'RELEASED'"), key="content_version_id", order_by=["note_id"], fields=[], as_="_n")
    found = rel.nest_children(found, items.where("release_status = 'RELEASED'"), key="content_version_id", order_by=["item_id"], fields=[], as_="_i")
    return found.select("content_version_id", F.col("_n.note_id").alias("note_ids"), F.col("_i.item_id").alias("item_ids"))


def promote_candidates(candidates: DataFrame, promotions: DataFrame) -> DataFrame:
    """Approved candidates that were not promoted yet, as new sources numbered in id order, with the review frozen beside them.

    Numbers without gaps need no single task: rows are stored by ranges of ids, numbered within a range, and moved on by
    the number of rows in the ranges before, of which there are as many as partitions.
    """
    fresh = candidates.where("approval_status = 'APPROVED'").join(promotions.select("candidate_id"), "candidate_id", "left_anti")
    ranged = settled(fresh.select("candidate_id", "location", "approval_status", "note").repartitionByRange("candidate_id").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("candidate_id"))
    numbered = ranged.withColumn("own", within).join(before.hint("merge"), "part")
    return numbered.select("candidate_id", "location", "approval_status", "note", (F.col("before") + F.col("own")).cast("long").alias("source_number"))


def document_markdown(packages: DataFrame, package_notes: DataFrame, notes: DataFrame, package_items: DataFrame, items: DataFrame, options: DataFrame) -> DataFrame:
    """package_id, title, markdown, sha256, error: released notes and questions of each package as one document.

    A package with a question of more than 26 options, or without a resolvable answer, is an error and has no markdown.
    """
    found = rel.nest_children(packages.select("package_id"), package_notes.join(notes.select("note_id", "markdown"), "note_id"), key="package_id", order_by=["position"], fields=["markdown"], as_="_notes")
    nested = rel.nest_children(items, options, key="item_id", order_by=["position", "option_id"], fields=["option_text"], as_="_options")
    label = lambda i: F.char(F.lit(65) + i)
    lines = F.transform("_options", lambda o, i: F.struct(o["option_id"].alias("option_id"), F.concat(label(i), F.lit(". "), o["option_text"]).alias("line")))
    answer = F.get(F.filter(lines, lambda x: x["option_id"] == F.col("correct_option_id")), F.lit(0))["line"]
    body = F.array_join(F.array("question_text", F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.concat(F.lit("**Answer:** "), answer), F.concat(F.lit("**Explanation:** "), "explanation")), "\n\n")
    error = F.when(F.size("_options") > MAX_OPTIONS, "TOO_MANY_OPTIONS").when(answer.isNull(), "NO_ANSWER")
    questions = nested.select("item_id", error.alias("error"), F.when(error.isNull(), body).alias("body"))
    found = rel.nest_children(found, package_items.join(questions, "item_id"), key="package_id", order_by=["position"], fields=["body", "error"], as_="_items")
    titled = F.concat(F.lit("Content Package "), F.col("package_id").cast("string"))
    note_part = F.when(F.size("_notes") > 0, F.concat(F.array(F.lit("## Notes")), F.transform("_notes", lambda n: F.regexp_replace(n["markdown"], "\n+\\z", "")))).otherwise(F.array().cast("array<string>"))
    numbered = F.transform("_items", lambda q, i: F.concat(F.lit("### Question "), (i + 1).cast("string"), F.lit("\n\n"), q["body"]))
    item_part = F.when(F.size("_items") > 0, F.concat(F.array(F.lit("## Practice Questions")), numbered)).otherwise(F.array().cast("array<string>"))
    markdown = F.concat(F.array_join(F.concat(F.array(F.concat(F.lit("# "), titled)), note_part, item_part), "\n\n"), F.lit("\n"))
    failed = F.array_min(F.transform("_items", lambda q: q["error"]))
    done = found.select("package_id", titled.alias("title"), F.when(failed.isNull(), markdown).alias("markdown"), failed.alias("error"))
    return done.withColumn("sha256", F.sha2("markdown", 256))

"""Grounded claims: proposals with citations into chunks, checked as a whole run, then turned into evidence and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import exprs as E

INVALID = "CLAIM_EXTRACTION_GROUNDING_INVALID"


def extraction_limits(chunks: DataFrame, *, max_chunks: int = 50, max_chars: int = 50_000, max_bytes: int = 200_000) -> DataFrame:
    """A row a run: its counts, whether positions run from 0 without gaps, and whether it is within limits."""
    per = chunks.groupBy("run_id").agg(
        F.count("*").alias("n_chunks"), F.sum(F.length("chunk_text")).alias("n_chars"), F.sum(F.octet_length("chunk_text")).alias("n_bytes"), F.max("position").alias("last"), F.count_distinct("position").alias("places")
    )
    dense = (F.col("last") == F.col("n_chunks") - 1) & (F.col("places") == F.col("n_chunks"))
    return per.select("run_id", "n_chunks", "n_chars", "n_bytes", dense.alias("contiguous"), (dense & (F.col("n_chunks") <= max_chunks) & (F.col("n_chars") <= max_chars) & (F.col("n_bytes") <= max_bytes)).alias("eligible"))


#: What a prompt reads and writes that grounded claims are asked with.
INPUT, OUTPUT, VERSION = "grounded-claim-extraction.input", "grounded-claim-extraction.output", 1


def grounding_eligibility(runs: DataFrame, prompts: DataFrame) -> DataFrame:
    """runs: run_id, status, prompt_id. Those that succeeded and whose prompt has exactly the schemas of grounded claims."""
    made = (F.col("input_schema_key") == INPUT) & (F.col("input_schema_version") == VERSION) & (F.col("output_schema_key") == OUTPUT) & (F.col("output_schema_version") == VERSION)
    return runs.where("status = 'SUCCEEDED'").join(prompts.where(made).select("prompt_id"), "prompt_id", "left_semi")


def grounding_input(chunks: DataFrame, *, max_json_bytes: int = 250_000) -> DataFrame:
    """run_id, canonical JSON of its ordered chunks, its size, and whether that is allowed."""
    one = F.struct(F.col("position"), F.col("chunk_id").alias("source_chunk_id"), F.col("chunk_text").alias("text"))
    nested = chunks.groupBy("run_id").agg(F.array_sort(F.collect_list(one)).alias("chunks"))
    value = nested.select("run_id", F.to_json(F.struct("chunks", F.col("run_id").alias("source_extraction_run_id"))).alias("input_json"))
    return value.withColumn("json_bytes", F.octet_length("input_json").cast("long")).withColumn("allowed", F.col("json_bytes") <= max_json_bytes)


def citation_chunk_join(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations with their chunk's text within the same run, and whether their range is inside it."""
    own = citations.join(chunks.select("run_id", "chunk_id", "chunk_text"), ["run_id", "chunk_id"], "left")
    inside = (F.col("char_start") >= 0) & (F.col("char_start") < F.col("char_end")) & (F.col("char_end") <= F.length("chunk_text"))
    return own.withColumn("in_range", F.coalesce(inside, F.lit(False)))


def _cited(c: Column | str = "chunk_text") -> Column:
    return F.expr("substring(chunk_text, cast(char_start as int) + 1, cast(char_end - char_start as int))")


def validate_grounding(proposals: DataFrame, citations: DataFrame, chunks: DataFrame, *, max_claims: int = 25, max_citations: int = 5, max_evidence: int = 125) -> DataFrame:
    """run_id, status, error_code: any failure of a claim or citation voids its whole run."""
    claims = proposals.groupBy("run_id").agg(F.count("*").alias("n"), F.count_distinct("statement").alias("distinct"))
    claims = claims.select("run_id", ((F.col("n") > max_claims) | (F.col("n") > F.col("distinct"))).alias("bad_claims"))
    joined = citation_chunk_join(citations, chunks)
    joined = joined.withColumn("bad", ~F.col("in_range") | (F.col("in_range") & (E.strip(_cited()) == "")))
    per_claim = joined.groupBy("run_id", "claim_position").agg(F.count("*").alias("n"), F.count_distinct("chunk_id", "char_start", "char_end").alias("distinct"), F.max("bad").alias("bad"))
    bad_claim = (F.col("n") > max_citations) | (F.col("n") > F.col("distinct")) | F.col("bad")
    per_run = per_claim.groupBy("run_id").agg(F.max(bad_claim).alias("bad_citations"))
    evidence = distinct_evidence(citations, max_evidence=max_evidence).select("run_id", (~F.col("allowed")).alias("bad_evidence"))
    found = claims.join(per_run, "run_id", "left").join(evidence, "run_id", "left")
    bad = F.col("bad_claims") | F.coalesce("bad_citations", F.lit(False)) | F.coalesce("bad_evidence", F.lit(False))
    return found.select("run_id", F.when(bad, "FAILED").otherwise("SUCCEEDED").alias("status"), F.when(bad, F.lit(INVALID)).alias("error_code"))


def distinct_evidence(citations: DataFrame, *, max_evidence: int = 125) -> DataFrame:
    keys = citations.select("run_id", "chunk_id", "char_start", "char_end").distinct()
    return keys.groupBy("run_id").agg(F.count("*").alias("n_evidence")).withColumn("allowed", F.col("n_evidence") <= max_evidence)


def first_appearance_order(citations: DataFrame) -> DataFrame:
    """Distinct cited places of each run, numbered by the first claim and citation that cites them."""
    first = citations.groupBy("run_id", "chunk_id", "char_start", "char_end").agg(F.min(F.struct("claim_position", "citation_position")).alias("first"))
    return first.withColumn("position", (F.row_number().over(Window.partitionBy("run_id").orderBy("first")) - 1).cast("long")).drop("first")


def ground_claims(proposals: DataFrame, citations: DataFrame, chunks: DataFrame, valid: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of valid runs: evidence, claims (drafts, unverified), and claim citations with the evidence's position."""
    good = valid.where("status = 'SUCCEEDED'").select("run_id")
    cited = citations.join(good, "run_id", "left_semi")
    places = first_appearance_order(cited)
    evidence = places.join(chunks.select("run_id", "chunk_id", "chunk_text"), ["run_id", "chunk_id"])
    evidence = evidence.withColumn("content", _cited()).drop("chunk_text").withColumn("sha256", F.sha2("content", 256)).withColumn("location_reference", E.location_reference(F.col("run_id"), F.col("chunk_id"), F.col("char_start"), F.col("char_end")))
    claims = proposals.join(good, "run_id", "left_semi").select("run_id", F.col("claim_position").alias("position"), "statement", F.lit("DRAFT").alias("approval_status"), F.lit("UNVERIFIED").alias("verification_status"))
    links = cited.join(places.withColumnRenamed("position", "evidence_position"), ["run_id", "chunk_id", "char_start", "char_end"]).select("run_id", "claim_position", "citation_position", "evidence_position")
    return evidence, claims, links


def grounding_report(evidence: DataFrame, claims: DataFrame, links: DataFrame) -> DataFrame:
    """A row a run: its evidence and its claims with evidence positions in citation order, as text."""
    e = evidence.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("position", "content"))).alias("e"))
    ordered = links.groupBy("run_id", "claim_position").agg(F.array_sort(F.collect_list(F.struct("citation_position", "evidence_position"))).alias("c"))
    c = claims.join(ordered.withColumnRenamed("claim_position", "position"), ["run_id", "position"], "left").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("position", "c"))).alias("claims"))
    listed = F.transform("claims", lambda x: F.concat(x["position"].cast("string"), F.lit(":"), F.coalesce(F.array_join(F.transform(x["c"], lambda y: y["evidence_position"].cast("string")), ","), F.lit(""))))
    return c.join(e, "run_id", "left").select("run_id", F.array_join(F.transform("e", lambda x: x["content"]), "|").alias("evidence"), F.array_join(listed, ";").alias("claims"))


def run_status_rollup(failures: DataFrame, runs: DataFrame) -> DataFrame:
    """failures: run_id, ordinal, code (null: none). SUCCEEDED without any, else FAILED with the first code."""
    per = failures.where("code is not null").groupBy("run_id").agg(F.min_by("code", "ordinal").alias("error_code"), F.count("*").alias("n_failures"))
    return runs.select("run_id").distinct().join(per, "run_id", "left").select("run_id", F.when(F.col("error_code").isNull(), "SUCCEEDED").otherwise("FAILED").alias("status"), "error_code", F.coalesce("n_failures", F.lit(0).cast("long")).alias("n_failures"))

"""Queries that run a table's files as a stream to the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import lifecycle
from factloom.sources.chunk_sql import chunk_sql
from factloom.streaming import jobs

from .registry import query
from .review import STATE_SQL as _STATE
from .review import guards
from .text import _NORMAL

C = F.col


def _decisions(events: DataFrame) -> DataFrame:
    asset = F.concat(C("user_id").cast("string"), F.lit(":"), F.substring(C("ts").cast("string"), 1, 10))
    kinds = F.array(F.lit("note"), F.lit("item"), F.lit("package"), F.lit("document"))
    names = F.create_map(*[F.lit(x) for pair in (("click", "APPROVED"), ("error", "REJECTED"), ("view", "DRAFT"), ("purchase", "RELEASE")) for x in pair])
    decision = F.coalesce(F.try_element_at(names, C("event_type")), F.lit("WITHDRAW"))
    note = F.concat(F.lit("note "), C("event_id").cast("string"))
    return events.select(asset.alias("asset"), F.get(kinds, (C("user_id") % 4).cast("int")).alias("asset_kind"), C("event_id").alias("seq"), "ts", decision.alias("decision"), note.alias("note"), C("user_id").alias("asset_id"), (C("user_id") % 10 != 9).alias("guard_ok"))


@query(_STATE)
def stream_release_state(t) -> DataFrame:
    """The last state of each asset, with times and notes, from the decisions as a stream, guarded by the tables."""
    decisions = lifecycle.with_guards(_decisions(jobs.table_stream(t.spark, t.sf_dir, "events")), guards(t))
    return jobs.release_state_stream(decisions, jobs.shared_folder(t.spark))[0]


_EXTRACTED = f"(SELECT doc_id AS id, n || chr(10) AS text FROM (SELECT doc_id, {_NORMAL.format(x='text')} AS n FROM {{documents}} WHERE text IS NOT NULL) a WHERE n <> '')"


@query(f"SELECT id AS snapshot_id, position, char_start, char_end, text, sha256 FROM {chunk_sql(_EXTRACTED)} x")
def stream_extract(t) -> DataFrame:
    docs = jobs.table_stream(t.spark, t.sf_dir, "documents").where("text is not null")
    snapshots = docs.select(C("doc_id").alias("snapshot_id"), F.lit("text/plain").alias("content_type"), C("text").cast("binary").alias("content"))
    return jobs.extract_stream(snapshots, jobs.shared_folder(t.spark))[1].select("snapshot_id", "position", "char_start", "char_end", "text", "sha256")


@query("SELECT DISTINCT user_id AS claim_id, event_id % 50 AS evidence_id FROM {events}")
def stream_dedupe_links(t) -> DataFrame:
    events = jobs.table_stream(t.spark, t.sf_dir, "events").withColumn("ts", C("ts").cast("timestamp"))
    links = events.select("ts", C("user_id").alias("claim_id"), (C("event_id") % 50).alias("evidence_id"))
    return jobs.run_available(jobs.stream_dedupe_links(links, delay="3650 days"), jobs.shared_folder(t.spark)).select("claim_id", "evidence_id")

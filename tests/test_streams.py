"""Streams give what the batch forms give."""

import itertools
import os

import pytest
from pyspark.sql import functions as F

from factloom import plans
from factloom.operators import lifecycle
from factloom.operators import text as tx
from factloom.plans import streams
from factloom.streaming import jobs

FOLDER = "/root/testdata/sf0.001"


def test_release_state(spark):
    columns = ["asset", "asset_kind", "approval_status", "release_status", "n_refused"]
    stream = plans.QUERIES["stream_release_state"](spark, FOLDER).select(columns)
    batch = plans.QUERIES["release_state"](spark, FOLDER).select(columns)
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_release_state_over_batches(spark, tmp_path):
    """Three files, a batch each: state, times, notes and refused decisions are those of the whole log."""
    log = streams._decisions(spark.read.parquet(f"{FOLDER}/events.parquet"))
    rows = log.orderBy("ts", "seq").toPandas()
    cut = [0, len(rows) // 3, len(rows) // 2, len(rows)]
    for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        spark.createDataFrame(rows.iloc[a:b], log.schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    state, refused = jobs.release_state_stream(stream, f"file://{tmp_path}/out")
    wanted_state, wanted_refused = lifecycle.release_state(log)
    assert sorted(map(str, state.select(wanted_state.columns).collect())) == sorted(map(str, wanted_state.collect()))
    assert sorted(map(str, refused.select(wanted_refused.columns).collect())) == sorted(map(str, wanted_refused.collect()))


def test_refusals_are_the_same_in_both_forms(spark):
    """Every kind, guard, state and decision."""
    rows = list(itertools.product(["note", "item", "package", "document"], [True, False, None], lifecycle.APPROVALS, lifecycle.RELEASES, [*lifecycle.APPROVALS, "RELEASE", "WITHDRAW", "OTHER"]))
    df = spark.createDataFrame(rows, "kind string, guard_ok boolean, approval string, release string, decision string")
    found = df.withColumn("reason", lifecycle.refusal(*[F.col(c) for c in ("kind", "guard_ok", "approval", "release", "decision")])).collect()
    assert all(r.reason == lifecycle.refused(*r[:5]) for r in found)


@pytest.fixture
def files(spark, tmp_path):
    """A decision log cut into twenty files, each later than the one before, and a stream that takes one file a batch."""
    log = streams._decisions(spark.read.parquet(f"{FOLDER}/events.parquet"))
    rows = log.orderBy("ts", "seq").toPandas()
    cuts = [len(rows) * k // 20 for k in range(21)]

    def write(k):
        spark.createDataFrame(rows.iloc[cuts[k] : cuts[k + 1]], log.schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k:02}")

    return log, write, lambda: spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")


def test_release_state_over_twenty_batches_and_a_restart(spark, tmp_path, files):
    """The stream stops after twelve files and starts again: state and refusals are those of the whole log, and a batch writes its own assets only."""
    log, write, stream = files
    out = f"file://{tmp_path}/out"
    for k in range(12):
        write(k)
    jobs.release_state_stream(stream(), out)
    for k in range(12, 20):
        write(k)
    state, refused = jobs.release_state_stream(stream(), out)
    wanted_state, wanted_refused = lifecycle.release_state(log)
    assert sorted(map(str, state.select(wanted_state.columns).collect())) == sorted(map(str, wanted_state.collect()))
    assert sorted(map(str, refused.select(wanted_refused.columns).collect())) == sorted(map(str, wanted_refused.collect()))
    parts = sorted(os.listdir(tmp_path / "out" / "out"))
    assert len(parts) == 20
    written = {p: spark.read.parquet(f"{out}/out/{p}").where("seq is null").count() for p in parts}
    own = {k: spark.read.parquet(f"file://{tmp_path}/in/{k:02}").select("asset", "asset_kind").distinct().count() for k in range(20)}
    assert sorted(written.values()) == sorted(own.values())
    again, _ = jobs.release_state_stream(stream(), out)  # nothing new: nothing changes
    assert again.count() == wanted_state.count() and len(os.listdir(tmp_path / "out" / "out")) == 20


def test_extract(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("text is not null")
    batch = tx.extract_snapshots(docs.select(F.col("doc_id").alias("snapshot_id"), F.lit("text/plain").alias("content_type"), F.col("text").cast("binary").alias("content")))[1]
    columns = ["snapshot_id", "position", "char_start", "char_end", "sha256"]
    stream = plans.QUERIES["stream_extract"](spark, FOLDER)
    assert sorted(map(tuple, stream.select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))


def test_states_of_a_group_are_one_value(spark, tmp_path, files, monkeypatch):
    """Three groups, six batches: the store holds three values at most, and state and refusals are those of the whole log."""
    monkeypatch.setattr(jobs, "GROUPS", 3)
    log, write, stream = files
    for k in range(6):
        write(k)
    out = f"file://{tmp_path}/out"
    state, refused = jobs.release_state_stream(stream(), out)
    wanted_state, wanted_refused = lifecycle.release_state(spark.read.schema(log.schema).parquet(f"file://{tmp_path}/in/*"))
    assert sorted(map(str, state.select(wanted_state.columns).collect())) == sorted(map(str, wanted_state.collect()))
    assert sorted(map(str, refused.select(wanted_refused.columns).collect())) == sorted(map(str, wanted_refused.collect()))
    kept = spark.read.format("statestore").option("stateVarName", "states").load(f"{out}/state")
    assert 0 < kept.count() <= 3 < wanted_state.count()

"""Streaming forms: release state, extraction, de-duplicated links. Each gives what its batch form gives on ordered input."""

from __future__ import annotations

import json
from collections.abc import Generator, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from factloom.operators import lifecycle
from factloom.operators import text as tx
from factloom.sources.storage import shared_folder  # noqa: F401


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")


_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _micros(kind: str) -> Column:
    """ts as microseconds since 1970; local times are not tied to a zone."""
    return F.expr(f"cast(1000000 * cast(cast(ts - {_EPOCH} as interval second) as decimal(24, 6)) as long)") if kind == "timestamp_ntz" else F.unix_micros("ts")


def _time(column: str, kind: str) -> Column:
    back = F.expr(f"{_EPOCH} + make_dt_interval(0, 0, 0, cast({column} / 1000000.0 as decimal(18, 6)))") if kind == "timestamp_ntz" else F.timestamp_micros(column)
    return back.alias(column)


_STATE = "approval_status string, release_status string, reviewer_note string, decided_at long, released_at long, withdrawn_at long, release_note string, n_refused long"
_OUTCOME = f"asset string, asset_kind string, {_STATE}, seq long, decision string, reason string, approval string, release string"
_outcome = Row(*[c.split()[0] for c in _OUTCOME.split(", ")])
#: Keeps state on the executors' disks and its changes in the checkpoint; states of any number fit.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Into how many groups assets are dealt: a group's states are one value in the state store, read and written once a batch that decides on any of them.
GROUPS = 16_384
_UNDECIDED = ("DRAFT", "UNRELEASED", None, None, None, None, None, 0)


class _Fold(StatefulProcessor):
    """The new decisions of a group's assets of a batch, each asset's in order of time, from its stored state: its new state and the refused ones."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("states", "states string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        stored = self.stored.get()
        states = {(asset, kind): state for asset, kind, *state in json.loads(stored[0])} if stored else {}
        new: dict[tuple, list[Row]] = {}
        for r in rows:
            new.setdefault((r.asset, r.asset_kind), []).append(r)
        for asset, kind in new:
            states[asset, kind] = yield from self.folded(asset, kind, states.get((asset, kind), _UNDECIDED), new[asset, kind])
        self.stored.update((json.dumps([[*at, *state] for at, state in states.items()]),))

    def folded(self, asset: str, kind: str, state: Sequence, rows: list[Row]) -> Generator[Row, None, tuple]:
        approval, release, note, decided, released, withdrawn, release_note, refused = state
        for r in sorted(rows, key=lambda r: (r.ts, r.seq)):
            reason = lifecycle.refused(kind, r.guard_ok, approval, release, r.decision)
            if reason:
                refused += 1
                yield _outcome(asset, kind, *[None] * 8, r.seq, r.decision, reason, approval, release)
            elif r.decision in lifecycle.APPROVALS:
                kept = r.decision != "DRAFT"
                approval, note, decided = r.decision, r.note if kept else None, r.ts if kept else None
            elif r.decision == "RELEASE":
                release, released, release_note = "RELEASED", r.ts, r.note
            elif r.decision == "WITHDRAW":
                release, withdrawn, release_note = "WITHDRAWN", r.ts, r.note
        now = (approval, release, note, decided, released, withdrawn, release_note, refused)
        yield _outcome(asset, kind, *now, *[None] * 5)
        return now

    def close(self) -> None:
        pass


def release_state_stream(decisions: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """New decisions to states and refused decisions. states: the last state of each asset; refused: with the reason.

    States lie in Spark's state store, those of a group of assets as one value: a call of the store costs a Python worker
    far more than a state's size, so calls are a few a group and batch, not a few an asset. A batch reads and writes its own assets' groups only. What a
    batch changes is written under its number, so that one that runs again replaces itself; a stream that starts again in
    the same folder goes on where it stopped. Decisions count in the order of their batches, and by ts and seq within one.
    All rows of one group in one batch meet in a worker: let the source bound its batches (maxBytesPerTrigger).
    """
    spark = decisions.sparkSession
    kind = decisions.schema["ts"].dataType.simpleString()
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider"):  # Spark's default holds all states in memory
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = decisions.select(F.pmod(F.xxhash64("asset", "asset_kind"), F.lit(GROUPS)).alias("group"), "asset", "asset_kind", _micros(kind).alias("ts"), F.col("seq").cast("long").alias("seq"), "decision", "note", "guard_ok")
    outcomes = rows.groupBy("group").transformWithState(_Fold(), _OUTCOME, "Update", "None")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/part={number}")

    outcomes.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    found = spark.read.schema(f"{_OUTCOME}, batch int").option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    last = found.where("seq is null").groupBy("asset", "asset_kind").agg(F.max_by(F.struct(*[c.split()[0] for c in _STATE.split(", ")]), "batch").alias("s")).select("asset", "asset_kind", "s.*")
    states = last.select("asset", "asset_kind", "approval_status", "reviewer_note", _time("decided_at", kind), "release_status", _time("released_at", kind), _time("withdrawn_at", kind), "release_note", "n_refused")
    return states, found.where("seq is not null").select("asset", "asset_kind", "seq", "decision", "reason", "approval", "release")


def stream_dedupe_links(links: DataFrame, *, delay: str = "1 day") -> DataFrame:
    """The first arrival of each claim and evidence pair within the watermark. links: ts, claim_id, evidence_id."""
    return links.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["claim_id", "evidence_id"])


def run_available(stream: DataFrame, folder: str, *, mode: str = "append", partitions: int | None = None) -> DataFrame:
    """Process what has arrived and read the output back; rows carry the number of their batch."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/part={number}")  # a batch that runs again replaces itself

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    columns = [T.StructField(f.name, f.dataType) for f in stream.schema.fields]
    return spark.read.schema(T.StructType([*columns, T.StructField("batch", T.IntegerType())])).option("recursiveFileLookup", "true").parquet(f"{folder}/out")


def extract_stream(snapshots: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """New snapshots to runs and chunks. Each batch is written under its number, so a repeated batch changes nothing."""
    spark = snapshots.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        runs, chunks = tx.extract_snapshots(batch)
        runs.write.mode("overwrite").parquet(f"{folder}/runs/part={number}")
        chunks.write.mode("overwrite").parquet(f"{folder}/chunks/part={number}")

    snapshots.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return tuple(spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/{x}") for x in ("runs", "chunks"))

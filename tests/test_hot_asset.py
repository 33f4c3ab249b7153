"""One asset with a third of all decisions: the fold by ranges equals one that walks through them, and no range or row grows with the asset."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import lifecycle


@pytest.fixture(scope="module")
def log():
    r = random.Random(6)
    kinds = {a: r.choice(["note", "item", "package", "document"]) for a in range(400)}
    rows = []
    for seq in range(6_000):
        a = 0 if r.random() < 0.34 else r.randrange(400)
        rows.append((f"a{a}", kinds[a], 1_700_000_000 + seq // 3, seq, r.choice(["APPROVED", "REJECTED", "DRAFT", "RELEASE", "WITHDRAW"] if a else ["APPROVED", "APPROVED", "DRAFT", "WITHDRAW", "RELEASE"]), f"n{seq}", r.random() < 0.8))
    return rows


def walked(rows):
    states, refused = {}, []
    for asset, kind, ts, seq, decision, note, guard in sorted(rows, key=lambda x: (x[0], x[2], x[3])):
        s = states.setdefault(asset, ["DRAFT", "UNRELEASED", None, None, 0])
        reason = lifecycle.refused(kind, guard, s[0], s[1], decision)
        if reason:
            refused.append((asset, seq, reason, s[0], s[1]))
            s[4] += 1
        elif decision in lifecycle.APPROVALS:
            s[0], s[2] = decision, None if decision == "DRAFT" else note
        else:
            s[1], s[3] = {"RELEASE": "RELEASED", "WITHDRAW": "WITHDRAWN"}[decision], note
    return states, sorted(refused)


@pytest.mark.parametrize("bucket", [7, 1_000])
def test_hot_asset(spark, log, bucket):
    df = spark.createDataFrame(log, "asset string, asset_kind string, ts long, seq long, decision string, note string, guard_ok boolean").withColumn("ts", F.timestamp_seconds("ts")).repartition(5)
    state, refused = lifecycle.release_state(df, bucket=bucket)
    wanted, no = walked(log)
    assert {r.asset: [r.approval_status, r.release_status, r.reviewer_note, r.release_note, r.n_refused] for r in state.collect()} == wanted
    assert sorted((r.asset, r.seq, r.reason, r.approval, r.release) for r in refused.collect()) == no


def test_ranges_are_even(spark, log):
    df = spark.createDataFrame(log, "asset string, asset_kind string, ts long, seq long, decision string, note string, guard_ok boolean").withColumn("ts", F.timestamp_seconds("ts")).repartition(5)
    placed = lifecycle._ranged(df, 100)
    sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 1.6 * len(log) / len(sizes)
    assert placed.groupBy("part", "bucket").count().agg(F.max("count")).first()[0] == 100
    assert placed.where("asset = 'a0'").select("part").distinct().count() > 1
    order = placed.groupBy("part").agg(F.min(F.struct("asset", "asset_kind", "ts", "seq")).alias("a"), F.max(F.struct("asset", "asset_kind", "ts", "seq")).alias("b")).orderBy("part").collect()
    assert all(x.b < y.a for x, y in zip(order[:-1], order[1:], strict=True))


def test_guards_of_the_tables(spark):
    """A guard of several rows holds if all do; an asset that no table knows fails, a document needs none."""
    decisions = spark.createDataFrame([("a", "note", 1, False), ("b", "note", 2, True), ("c", "item", 1, True), ("d", "document", 9, False), ("e", "note", 3, True)], "asset string, asset_kind string, asset_id long, guard_ok boolean")
    guards = spark.createDataFrame([("note", 1, True), ("note", 2, False), ("note", 2, True), ("package", 1, True)], "asset_kind string, asset_id long, guard_ok boolean")
    found = lifecycle.with_guards(decisions, guards)
    assert {r.asset: r.guard_ok for r in found.collect()} == {"a": True, "b": False, "c": False, "d": True, "e": False} and "asset_id" not in found.columns

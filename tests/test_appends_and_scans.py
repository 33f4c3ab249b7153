"""Idempotent appends over several batches, and scans of stored tables under their declared schemas."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import relational as rel
from factloom.sources import schemas


@pytest.mark.parametrize("bits", [1 << 24, 64, 1 << 10])
def test_appends(spark, tmp_path, monkeypatch, bits):
    """Batch after batch onto a stored table, with keys that are there, that repeat and that are null; a small filter only lets more through."""
    monkeypatch.setattr(rel, "FILTER_BITS", bits)
    r = random.Random(bits)
    ddl = "a long, b string, n long"
    target = spark.createDataFrame([], ddl)
    stored = {}
    for batch in range(4):
        rows = [(r.choice([None, *range(30)]), r.choice(["x", "y", None]), batch * 1000 + i) for i in range(60)]
        new = spark.createDataFrame(rows, ddl).repartition(3)
        written, refused = rel.append(new, target, key=["a", "b"], order=["n"])
        want, no = {}, []
        for a, b, n in rows:
            reason = "NULL_KEY" if a is None or b is None else "EXISTS" if (a, b) in stored else "REPEATED" if (a, b) in want else None
            if reason:
                no.append((str(a), str(b), n, reason))
            else:
                want[a, b] = n
        assert {(x.a, x.b): x.n for x in written.collect()} == want and written.columns == new.columns
        assert sorted((str(x.a), str(x.b), x.n, x.reason) for x in refused.collect()) == sorted(no)
        assert {tuple(x)[:2] for x in rel.append_if_absent(new.dropna(), target, key=["a", "b"]).collect()} == set(want)
        there = {tuple(x) for x in rel.conflicts(new.dropna(), target, key=["a", "b"]).collect()}
        assert there == {(a, b) for a, b, n, reason in [(int(x[0]), *x[1:]) for x in no if x[3] != "NULL_KEY"]}
        stored |= want
        path = f"file://{tmp_path}/{batch}"
        written.write.parquet(path)
        target = target.unionByName(spark.read.parquet(path))
    again, _ = rel.append(target, target, key=["a", "b"], order=["n"])
    assert again.count() == 0


def test_filter_spares_the_target(spark):
    """Of a large target about as many keys are shuffled as there are new ones."""
    target = spark.range(200_000).select("id", F.lit("x").alias("k"))
    new = spark.range(199_990, 200_010).select("id", F.lit("x").alias("k"))
    maybe = rel.possible_members(target, new, ["id", "k"])
    assert 10 <= maybe.count() <= 15 and rel.append_if_absent(new, target, key=["id", "k"]).count() == 10


def test_conforming_rows(spark):
    ddl = "note_id string, content_version_id string, topic_id string, markdown string, release_status string, released_at string, `odd.name` string"
    rows = [
        ("1", "2", "3", "# a", None, "2024-01-01 00:00:00", "z"),
        ("x", "2", "3", "# a", "RELEASED", None, None),
        (None, None, "3", None, "RELEASED", "never", None),
        ("4", "5.5", "3", "", "UNRELEASED", None, None),
        (str(2**63), "1", "1", "a", None, None, None),
    ]
    stored = spark.createDataFrame(rows, ddl)
    typed, rejected = schemas.conforming(stored, "note_drafts")
    row = typed.collect()
    assert len(row) == 1 and row[0].note_id == 1 and row[0].release_status == "UNRELEASED" and row[0].approval_status == "DRAFT" and row[0].released_at.year == 2024 and typed.columns == schemas.columns("note_drafts")
    faults = {(r.stored["note_id"], r.stored["markdown"]): [(f.column, f.reason) for f in r.faults] for r in rejected.collect()}
    assert faults == {
        ("x", "# a"): [("note_id", "FAILED_CAST")],
        (None, None): [("note_id", "NULL"), ("content_version_id", "NULL"), ("markdown", "NULL"), ("released_at", "FAILED_CAST")],
        ("4", ""): [("content_version_id", "FAILED_CAST")],
        (str(2**63), "a"): [("note_id", "FAILED_CAST")],
    }
    assert schemas.table_faults(stored, "note_drafts") == [("odd.name", "UNKNOWN_COLUMN")]
    assert schemas.table_faults(stored.drop("topic_id"), "note_drafts") == [("odd.name", "UNKNOWN_COLUMN"), ("topic_id", "MISSING_COLUMN")]
    report = {(r.column, r.reason): r.n for r in schemas.conformity({"note_drafts": stored}).collect()}
    assert report == {(None, "TYPED"): 1, ("note_id", "FAILED_CAST"): 2, ("note_id", "NULL"): 1, ("content_version_id", "NULL"): 1, ("content_version_id", "FAILED_CAST"): 1, ("markdown", "NULL"): 1, ("released_at", "FAILED_CAST"): 1}
    assert schemas.conformity({"note_drafts": stored.limit(0)}).collect() == []


def test_every_declared_table_reads_its_own_rows(spark):
    """A row of values of the declared types conforms to each of the declared tables; an empty one has every fault of its required columns."""
    sample = {"long": "1", "int": "1", "double": "0.5", "string": "'x'", "timestamp": "timestamp'2024-01-01'", "binary": "X'00'", "decimal(18,6)": "1.5"}
    full = {n: spark.sql("SELECT " + ", ".join(f"CAST({sample[k]} AS {k}) AS {c}" for c, k in schemas.kinds(n).items())) for n in schemas.SCHEMAS}
    assert {tuple(r) for r in schemas.conformity(full).collect()} == {(n, None, "TYPED", 1) for n in schemas.SCHEMAS}
    assert all(schemas.table_faults(df, n) == [] for n, df in full.items())
    nulls = {n: spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {k}) AS {c}" for c, k in schemas.kinds(n).items())) for n in schemas.SCHEMAS}
    wanted = {(n, c, "NULL", 1) for n in schemas.SCHEMAS for c in schemas.required(n) if c not in schemas.DEFAULTS}
    assert {tuple(r) for r in schemas.conformity(nulls).collect()} == wanted

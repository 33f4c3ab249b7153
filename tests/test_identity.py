"""Identities before reuse: what is as recorded, what changed, what is gone."""

from pyspark.sql import functions as F

from factloom.operators import identity
from factloom.operators import text as tx


def judged(recorded, current, kind):
    return sorted((r.id, r.state, tuple(r.changed)) for r in identity.revalidate(recorded, current, kind).collect())


def test_states(spark):
    ddl = "prompt_id long, prompt_key string, version int, checksum string, extra string"
    then = spark.createDataFrame([(1, "a", 1, "x", "p"), (2, "a", 2, "y", "p"), (3, "b", 1, "z", "p"), (4, None, 1, "z", "p"), (5, "c", 1, "z", "p"), (5, "c", 1, "z", "q")], ddl)
    now = spark.createDataFrame([(1, "a", 1, "x", "q"), (2, "b", 2, "Y", "p"), (4, None, 1, "z", "p"), (5, "c", 2, "w", "p"), (5, "c", 1, "w", "p"), (6, "d", 1, "z", "p")], ddl)
    assert judged(then, now, "prompt") == [(1, "OK", ()), (2, "CHANGED", ("prompt_key", "checksum")), (3, "MISSING", ()), (4, "CHANGED", ("prompt_key",)), (5, "CHANGED", ("checksum",))]
    assert judged(then.limit(0), now, "prompt") == []
    assert {s for _, s, _ in judged(then, now.limit(0), "prompt")} == {"MISSING"}


def test_chunks_are_one_key(spark):
    """Any change of any chunk, their order or their number changes the digest; the order of rows does not."""
    texts = spark.createDataFrame([(1, "word " * 900), (2, "other words " * 300)], "run_id long, text string")
    chunks = tx.chunk_text(texts, id_col="run_id").withColumn("chunk_id", F.col("run_id") * 100 + F.col("position"))
    digest = lambda df: {r.run_id: r.chunks for r in identity.chunks_digest(df).collect()}
    whole = digest(chunks)
    assert digest(chunks.repartition(7).orderBy(F.desc("position"))) == whole and len(set(whole.values())) == 2
    last = F.col("position") == 3
    for broken in (
        chunks.where("position <> 2"), chunks.withColumn("text", F.when(last, F.concat("text", F.lit(" "))).otherwise(F.col("text"))), chunks.withColumn("char_end", F.when(last, F.col("char_end") + 1).otherwise(F.col("char_end"))),
        chunks.withColumn("sha256", F.when(last, None).otherwise(F.col("sha256"))), chunks.withColumn("chunk_id", F.col("chunk_id") + 1), chunks.withColumn("position", F.when(last, 4).when(F.col("position") == 4, 3).otherwise(F.col("position"))),
    ):
        found = digest(broken)
        assert found[1] != whole[1] and found[2] != whole[2]


def test_extraction(spark):
    ddl = "run_id long, snapshot_id long, source_id long, snapshot_sha256 string, status string, chunks string"
    then = spark.createDataFrame([(i, i, 1, "s", "SUCCEEDED", "d") for i in range(4)], ddl)
    now = spark.createDataFrame([(0, 0, 1, "s", "SUCCEEDED", "d"), (1, 1, 1, "s", "SUCCEEDED", "e"), (2, 9, 2, "t", "FAILED", "d")], ddl)
    assert judged(then, now, "extraction") == [(0, "OK", ()), (1, "CHANGED", ("chunks",)), (2, "CHANGED", ("snapshot_id", "source_id", "snapshot_sha256", "status")), (3, "MISSING", ())]

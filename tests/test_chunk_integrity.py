"""Chunks against their texts: every reason, odd rows, and a very long text."""

import time

from pyspark.sql import functions as F

from factloom.functions import exprs as E
from factloom.operators import text as tx

COLUMNS = ["id", "position", "char_start", "char_end", "text", "sha256"]


def cut(spark, rows):
    texts = spark.createDataFrame(rows, "id long, text string")
    return tx.chunk_text(texts), texts


def found(chunks, texts, **options):
    return {(r.id, r.position): r.reason for r in tx.chunk_integrity(chunks, texts, **options).collect()}


def test_every_reason(spark):
    body = "é\U0001f600 word " * 900
    chunks, texts = cut(spark, [(i, body + str(i)) for i in range(9)])
    assert found(chunks, texts) == {}
    first = F.col("position") == 1
    broken = chunks.withColumns(
        {
            "char_start": F.when(first & (F.col("id") == 0), -1).otherwise(F.col("char_start")),
            "char_end": F.when(first & (F.col("id") == 1), 10**6).when(first & (F.col("id") == 7), None).otherwise(F.col("char_end")),
            "text": F.when(first & (F.col("id") == 2), F.concat("text", F.lit("x"))).when(first & (F.col("id") == 3), F.rpad(F.lit(" "), F.length("text"), " ")).when(first & (F.col("id") == 4), F.overlay("text", F.lit("∅"), 5)).otherwise(F.col("text")),
            "sha256": F.when(first & (F.col("id") == 5), F.lit("0")).when(first & (F.col("id") == 6), None).otherwise(F.col("sha256")),
        }
    )
    assert found(broken, texts) == {(0, 1): "RANGE", (1, 1): "RANGE", (2, 1): "LENGTH", (3, 1): "BLANK", (4, 1): "TEXT", (5, 1): "HASH", (6, 1): "HASH", (7, 1): "RANGE"}
    sizes = {(r.id, r.position): r.n for r in chunks.select("id", "position", F.length("text").alias("n")).collect()}
    assert found(chunks, texts, size=500) == {k: "TOO_LONG" for k, n in sizes.items() if n > 500}


def test_odd_tables(spark):
    chunks, texts = cut(spark, [(1, None), (2, ""), (3, "one"), (4, "four")])
    assert found(chunks, texts) == {}
    assert found(chunks.limit(0), texts) == {} and found(chunks, texts.limit(0)) == {}
    assert found(chunks, texts.where("id <> 4").withColumn("text", F.lit("two"))) == {(3, 0): "TEXT"}


def test_a_long_text_is_linear(spark):
    """Two million characters; twice as many take about twice as long, not four times."""
    took = []
    for n in (2_000_000, 4_000_000):
        rows = spark.createDataFrame([(1, "ab cdefgh é" * (n // 11))], "id long, text string")
        chunks = tx.chunk_text(rows)
        began = time.perf_counter()
        assert tx.chunk_integrity(chunks, rows).count() == 0
        took.append(time.perf_counter() - began)
    assert took[1] < 3.5 * took[0] + 3 and took[1] < 60


def test_long_payloads(spark):
    df = spark.createDataFrame([("é" * 500_000,), ("",), ("a",)], "t string")
    encoded = df.select("t", E.encoded_base64(F.col("t").cast("binary")).alias("b"))
    assert encoded.where(E.decoded_base64(F.col("b")).cast("string") != F.col("t")).count() == 0
    refused = spark.createDataFrame([(x,) for x in ("a", "ab=", "a===", "ab==\n", "ab=c", "abcd ", "=")], "b string")
    assert refused.where(E.decoded_base64(F.col("b")).isNotNull()).count() == 0

"""Python sees bounded batches of a table, whatever its size and that of its rows."""

import tracemalloc

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom import plans
from factloom.operators import text as tx
from factloom.sources.storage import BATCH_BYTES, BATCH_ROWS

FOLDER = "/root/testdata/sf0.001"
SETTINGS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


@F.pandas_udf(T.LongType())
def size_of_batch(texts: pd.Series) -> pd.Series:
    return pd.Series([len(texts)] * len(texts))


@pytest.fixture
def fresh(spark):
    for name in SETTINGS:
        spark.conf.unset(name)
    return spark


def largest(spark, rows: int, width: int) -> int:
    texts = spark.range(rows).coalesce(1).select(F.repeat(F.lit("x"), width).alias("text"))
    return texts.select(size_of_batch("text").alias("n")).agg(F.max("n")).first()[0]


@pytest.mark.parametrize("name", ["fn_normalize_text", "chunk_text", "chunk_continuity"])
def test_query_bounds_batches(fresh, name):
    plans.QUERIES[name](fresh, FOLDER)
    assert largest(fresh, 5_000, 1) <= BATCH_ROWS
    assert largest(fresh, 100, 1 << 20) <= BATCH_BYTES >> 19


def test_chunks_are_made_in_arrow():
    """8 MB of texts, one of them long: what Python holds of their chunks is bounded by one text and some hundred chunks."""
    texts = pa.array(["word and word, " * 250] * 2_000 + ["x" * 500_000, "", None])
    tracemalloc.start()
    found = tx._pieces.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_000_000
    assert [len(x) for x in found[-2:]] == [0, 0] and len(found) == 2_003
    for i in (0, 1_999, 2_000):
        text, chunks = texts[i].as_py(), found[i].as_py()
        assert [(c["char_start"], c["char_end"]) for c in chunks] == [(w["char_start"], w["char_end"]) for w in tx._windows(text, tx.SIZE, tx.OVERLAP)]
        assert all(c["text"] == text[c["char_start"] : c["char_end"]] for c in chunks)


@pytest.mark.parametrize("name", ["validate_grounding", "propagate_deletes", "identity_revalidate", "audit_foreign_keys"])
def test_query_that_reads_chunks_bounds_batches(fresh, name):
    plans.QUERIES[name](fresh, FOLDER)
    assert largest(fresh, 100, 1 << 20) <= BATCH_BYTES >> 19

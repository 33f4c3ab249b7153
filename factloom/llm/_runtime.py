"""Shared helpers: tables, durable intermediates, bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one vectorised step works on at a time.
CHUNK_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset a temporary one serves a local master, as in tests; else it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; it must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Options of settle for rows that hold much: row groups of some MB, so that a reader never has many of them at a time.
LARGE_ROWS = {"parquet.block.size": str(8 * 2**20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def settle(df: DataFrame, **options: str) -> DataFrame:
    """Write a frame once into the shared folder and read it back: cuts lineage, survives lost executors, gives true sizes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def drop_settled(df: DataFrame) -> None:
    """Delete the files of a settled frame that no later step reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Rows and bytes that a worker holds of a table at a time.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 * 2**20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches end at some thousand rows, and at some MB where rows are long; smaller settings of the session stay."""
    for name, limit in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(name, None) or 0)
        if now <= 0 or now > limit:
            spark.conf.set(name, str(limit))


def text_input(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under names of our own, so that other columns of any name can't clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def whole_rows(df: DataFrame, *without: str, **columns: Column) -> DataFrame:
    """Each row of a frame (its columns but those `without`) as one struct `row`, beside columns of our own, which so can't clash with those of the frame."""
    own = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in without]
    return df.select((F.struct(*own) if own else F.lit(0)).alias("row"), *[c.alias(name) for name, c in columns.items()])


def unfolded(rows: DataFrame, names: list[str], **columns: Column) -> DataFrame:
    """The columns `names` of `row`, some of them put anew."""
    return rows.select(*[columns[n].alias(n) if n in columns else F.col("row")[n].alias(n) for n in names])


def chunks(batches: Iterator[pa.RecordBatch], text_at: int = 1, limit: int = CHUNK_CHARS) -> Iterator[tuple[list, list]]:
    """(ids, texts) of at most about `limit` characters at a time; a longer text comes alone. Null text comes as None."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(text_at).to_pylist()
        begin = size = 0
        for i, text in enumerate(texts):
            n = len(text) if text else 0
            if size and size + n > limit:
                yield ids[begin:i], texts[begin:i]
                begin, size = i, 0
            size += n
        if begin < len(texts):
            yield ids[begin:], texts[begin:]


def as_batch(columns: Sequence, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

"""Intermediate results in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that spark.checkpoint.dir names. Where that is unset a temporary one serves a local master, as in tests; else it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and _OWN:
        base = _OWN[0]
    elif not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; it must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="factloom-")
        _OWN.append(base)
    return f"{base.rstrip('/')}/factloom-{uuid.uuid4().hex}"


#: Rows and bytes that a Python worker holds of a table at a time.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 * 2**20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches end at some thousand rows, and at some MB where rows are long, so a worker's memory does not grow with a task; smaller settings of the session stay."""
    for name, limit in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(name, None) or 0)
        if now <= 0 or now > limit:
            spark.conf.set(name, str(limit))


def settled(df: DataFrame) -> DataFrame:
    """Written once and read back: no step below is computed twice, lost executors lose nothing, and sizes are true. The files go when the session ends."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)

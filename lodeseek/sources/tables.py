"""Chunks, manifests and index metadata as files: Parquet for the engine, JSON lines for exchange."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.operators.chunking import CHUNK, COLUMNS


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Parquet by repository."""
    chunks.select(*COLUMNS).write.mode("overwrite").partitionBy("repository").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).parquet(path).select(*COLUMNS)


def export_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines in chunk order; null fields are written. Many files, in order of their names."""
    chunks.select(*COLUMNS).orderBy(F.lower("file_path"), "file_path", "start_line", "end_line", "chunk_id").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def import_chunks(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as chunks; only LF ends a line, so other separators inside contents do no harm."""
    return spark.read.schema(CHUNK).option("lineSep", "\n").json(path)


def manifest(rows: DataFrame) -> DataFrame:
    """One row: how many judged files were accepted and skipped, and bytes accepted."""
    taken = F.col("reason").isNull()
    return rows.agg(F.count_if(taken).alias("n_accepted"), F.count_if(~taken).alias("n_skipped"), F.coalesce(F.sum(F.when(taken, F.col("size_bytes"))), F.lit(0)).alias("accepted_bytes"))


def workspace(spark: SparkSession) -> str:
    """A new path that driver and executors share: below spark.checkpoint.dir, or a new local folder where that is unset and Spark is one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-lodeseek-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/tables/{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"


def written(rows: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read from there."""
    path = f"{workspace(rows.sparkSession)}/rows"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that are started inside pass at most so many rows at once to and from Python. For long rows; the session's own limit holds where it is lower, and again afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)

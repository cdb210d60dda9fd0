"""What the corpus operators share: written tables, row keys, word splitting, tasks over Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters to lower case and every byte that is not part of a word to a blank, for the word class
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, letters and all bytes of characters beyond ASCII.
ALNUM_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where that is unset and Spark is one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-lodeseek-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/lodeseek/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there: lineage ends at reliable files."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_batch(df: DataFrame, make: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """One call of make for each Arrow batch (bounded in rows and bytes by Spark's settings)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from make(batch)

    return df.mapInArrow(run, schema)


def kept_rows(df: DataFrame, keep: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows of df that keep marks, batch by batch, with all columns.

    Spark reads the names of the columns it hands over as expressions, in which a dot is an access to a field. So columns
    travel under numbers, and keep sees their names.
    """
    names = df.columns

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pa.array(keep(batch.rename_columns(names))))

    kinds = ", ".join(f"`{i}` {kind}" for i, (_, kind) in enumerate(df.dtypes))
    return per_batch(df.toDF(*map(str, range(len(names)))), run, kinds).toDF(*names)


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's texts as UTF-8; null is empty."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


def text_column(df: DataFrame, column: str = "text") -> DataFrame:
    """df with the column as string, whatever simple type it had."""
    return df.withColumn(column, F.col(column).cast("string"))


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bits_set(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def group_bounds(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin in sorted arrays, with the length at the end."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)

"""Files that arrive as a stream, chunked as they come. Chunk ids follow from contents, so a file that comes again adds nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lodeseek.operators.chunking import COLUMNS, ChunkSettings, chunk_files


def chunk_stream(files: DataFrame, path: str, checkpoint: str, settings: ChunkSettings = ChunkSettings()) -> DataStreamWriter:
    """A writer that adds the chunks of a stream of files to the Parquet table at path, which may not exist yet."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        made = chunk_files(batch, settings).dropDuplicates(["chunk_id"])
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            names = made.select("repository").distinct()
            stored = spark.read.parquet(path).join(names, "repository", "left_semi").select("chunk_id")
            made = made.join(stored, "chunk_id", "left_anti")
        made.select(*COLUMNS).write.mode("append").partitionBy("repository").parquet(path)

    return files.where(F.col("text").isNotNull()).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)

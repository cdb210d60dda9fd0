"""A stored vector index: unit vectors of chunks, with the snapshot and the embedder's settings that they were made from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lodeseek.functions.text import embedding_text
from lodeseek.operators import vector
from lodeseek.plans import snapshots
from lodeseek.plans.snapshots import Incompatible, IndexInfo


def settings(embedder: vector.Embedder) -> tuple:
    return "vectors-1", type(embedder).__name__, embedder.dimension, embedder.max_tokens


@dataclass
class VectorIndex:
    """vectors(chunk_id, embedding, n_tokens) and what they were made from."""

    vectors: DataFrame
    info: IndexInfo

    def search(self, queries: DataFrame, embedder: vector.Embedder, k: int | None = 10) -> DataFrame:
        """(query_id, rank, chunk_id, score) for queries(query_id, query_text), embedded with the settings of the index."""
        if snapshots.settings_fingerprint(*settings(embedder)) != self.info.settings:
            raise Incompatible("the index was made with other embedder settings")
        return vector.search(self.vectors, vector.embed(queries, embedder, "query_text"), k)


def build(chunks: DataFrame, embedder: vector.Embedder, path: str) -> VectorIndex:
    """The index of chunks of one repository, written to path and read back with its checks."""
    snapshots.check_ids(chunks)
    info = snapshots.describe(chunks, *settings(embedder))
    rows = vector.embed(chunks.select("chunk_id", embedding_text().alias("text")), embedder).drop("text")
    rows.write.mode("overwrite").parquet(f"{path}/vectors")
    snapshots.store(chunks.sparkSession, info, path)
    return load(chunks.sparkSession, path)


def load(spark: SparkSession, path: str, expected: IndexInfo | None = None) -> VectorIndex:
    """The index at path. Vectors that are not finite, unit and of one size, ids that repeat, another count than stored, or another snapshot or setting than expected are errors."""
    info = snapshots.stored(spark, path)
    if expected is not None:
        snapshots.check_expected(info, expected)
    rows = spark.read.parquet(f"{path}/vectors")
    snapshots.check_ids(rows)
    found = vector.validation(rows).first()
    if found.n_vectors != info.n_chunks or not found.one_size or found.n_not_finite or found.n_not_unit:
        raise ValueError(f"not a sound vector index: {found.asDict()} for {info.n_chunks} chunks")
    return VectorIndex(rows, info)

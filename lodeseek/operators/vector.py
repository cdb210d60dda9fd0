"""Exact cosine search over a table of embeddings, and the interface of embedders."""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.functions import vectors as V
from lodeseek.functions.ranking import ranked
from lodeseek.functions.text import tokens
from lodeseek.operators import scan


def unit_vectors(rows: DataFrame, embedding: str = "embedding") -> DataFrame:
    """rows with unit vectors; rows that have none are left out."""
    return rows.withColumn(embedding, V.normalised(V.doubles(F.col(embedding)))).where(F.col(embedding).isNotNull())


def norms(rows: DataFrame) -> DataFrame:
    return rows.select("chunk_id", V.norm(V.doubles(F.col("embedding"))).alias("norm"))


def validation(rows: DataFrame) -> DataFrame:
    """One row: n_vectors, dimension, n_bad_size, n_not_finite, n_not_unit (further than 1.1e-5 from norm 1)."""
    e = V.doubles(F.col("embedding"))
    size = rows.select(F.size("embedding").alias("n"), V.is_finite(e).alias("finite"), V.norm(e).alias("norm"))
    out = size.agg(F.count("*").alias("n_vectors"), F.max("n").alias("dimension"), F.min("n").alias("least"), F.count_if(~F.col("finite")).alias("n_not_finite"), F.count_if(F.abs(F.col("norm") - 1) > 1.1e-5).alias("n_not_unit"))
    return out.select("n_vectors", "dimension", (F.col("least") == F.col("dimension")).alias("one_size"), "n_not_finite", "n_not_unit")


class Cosines(scan.Scorer):
    """Products of unit vectors. A product of matrices tells which pairs matter; those are added up one component after the other, as V.dot does."""

    reads, room = ("embedding",), 1e-12

    def __init__(self, queries: pa.Table):
        self.queries = queries.column("query_id").combine_chunks()
        self.asked = {d: (c, x) for d, c, x in _matrices(queries.column("embedding").combine_chunks())}

    def scores(self, rows: pa.RecordBatch) -> np.ndarray:
        found = np.full((rows.num_rows, len(self.queries)), -np.inf)
        for d, at, x in _matrices(rows.column("embedding")):
            if d in self.asked:
                columns, asked = self.asked[d]
                found[np.ix_(at, columns)] = x @ asked.T
        return found

    def exact(self, rows: pa.RecordBatch, found: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        out = np.empty(len(row))
        for d, at, x in _matrices(rows.column("embedding")):
            if d in self.asked:
                columns, asked = self.asked[d]
                line = np.full(rows.num_rows, -1)
                line[at] = np.arange(len(at))
                column_of = np.full(len(self.queries), -1)
                column_of[columns] = np.arange(len(columns))
                for here in np.array_split(np.flatnonzero(line[row] >= 0), 1 + len(row) // 65_536):
                    out[here] = np.cumsum(x[line[row[here]]] * asked[column_of[column[here]]], axis=1)[:, -1]
        return out


def _matrices(vectors: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, places, matrix) of the vectors of each dimension."""
    sizes, flat = pc.list_value_length(vectors).to_numpy(zero_copy_only=False), pc.list_flatten(vectors).to_numpy(zero_copy_only=False)
    starts, out = np.cumsum(sizes) - sizes, []
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        out.append((int(d), at, flat[(starts[at][:, None] + np.arange(d)).ravel()].reshape(len(at), d)))
    return out


def scanned(rows: DataFrame, queries: DataFrame, block: int = scan.BLOCK) -> scan.Scan:
    """The scan of rows(chunk_id, embedding) for queries(query_id, embedding): blocks of about `block` queries, which pass through the driver."""
    asked = unit_vectors(queries).select("query_id", "embedding")
    n = max(1, -(-asked.count() // block))
    parts = [asked if n == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)]
    return scan.Scan(unit_vectors(rows).select("chunk_id", "embedding"), [Cosines(p.toArrow()) for p in parts], dict(asked.dtypes)["query_id"])


def scores(rows: DataFrame, queries: DataFrame, block: int = scan.BLOCK) -> DataFrame:
    """(query_id, chunk_id, score) of all rows(chunk_id, embedding) for queries(query_id, embedding)."""
    return scanned(rows, queries, block).every()


def search(rows: DataFrame, queries: DataFrame, k: int | None = 10, block: int = scan.BLOCK) -> DataFrame:
    """(query_id, rank, chunk_id, score) of the first k of scores(); k None: all rows."""
    if k is not None and k <= 0:
        raise ValueError("k must be positive")
    own = scanned(rows, queries, block)
    return ranked(own.every() if k is None else own.heads(k), "score", "chunk_id", k=k).select("query_id", "rank", "chunk_id", "score")


class Embedder(ABC):
    """Texts to vectors, made once for each worker."""

    dimension: int
    max_tokens: int = 8192

    @abstractmethod
    def encode(self, texts: list[str]) -> np.ndarray: ...

    @abstractmethod
    def lengths(self, texts: list[str]) -> list[int]: ...

    def batches(self, lengths: list[int], preferred: int = 16, reference: int = 512) -> Iterator[list[int]]:
        """Places, longest first, in batches whose attention cost stays that of `preferred` texts of `reference` tokens."""
        order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
        while order:
            n = max(1, min(preferred, preferred * reference**2 // max(1, lengths[order[0]]) ** 2))
            yield order[:n]
            order = order[n:]


class HashingEmbedder(Embedder):
    """Words hashed to signed components: the same vector on every machine, without a model."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(t.split()) for t in texts]

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[i, h % self.dimension] += 1 if h >> 63 else -1
            if not out[i].any():
                out[i, 0] = 1
        return out


def embed(rows: DataFrame, embedder: Embedder, text: str = "text") -> DataFrame:
    """rows with embedding array<double> (unit) and n_tokens, in batches inside tasks."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part.fillna("").tolist()
            sizes = embedder.lengths(texts)
            out = np.zeros((len(texts), embedder.dimension))
            for places in embedder.batches(sizes):
                out[places] = embedder.encode([texts[i] for i in places])
            length = np.linalg.norm(out, axis=1, keepdims=True)
            if not np.isfinite(out).all() or (length == 0).any():
                raise ValueError("an embedder gave a vector that is not finite or has no length")
            yield pd.DataFrame({"embedding": list(out / length), "n_tokens": sizes})

    made = F.pandas_udf(run, "embedding array<double>, n_tokens int", F.PandasUDFType.SCALAR_ITER)
    return rows.withColumn("made", made(F.col(text))).select(*rows.columns, "made.*")


def truncation(rows: DataFrame, limit: int) -> DataFrame:
    """One row: how many of rows(chunk_id, n_tokens) are over the limit, and the longest."""
    return rows.agg(F.count_if(F.col("n_tokens") > limit).alias("n_over"), F.max("n_tokens").alias("longest"))


def over_limit(rows: DataFrame, limit: int) -> DataFrame:
    return rows.where(F.col("n_tokens") > limit).select("chunk_id", "n_tokens")


def overlap(query: str, text: str):
    """Share of a query's different tokens that a text holds (the built-in pair score of the tests and queries)."""
    asked = F.array_distinct(tokens(query))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, tokens(text))) / F.size(asked)).otherwise(F.lit(0.0))

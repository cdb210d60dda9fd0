"""Reranking of the first candidates by a score of query and text together."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.ranking import ranked

CANDIDATES, BATCH, MAX_TOKENS = 50, 4, 1024


class PairScorer(ABC):
    """Raw scores of (query, text) pairs, made once for each worker."""

    @abstractmethod
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...

    def column(self, query: Column, text: Column, batch: int = BATCH) -> Column:
        def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for queries, texts in parts:
                pairs = list(zip(queries.fillna(""), texts.fillna("")))
                found = [float(x) for at in range(0, len(pairs), batch) for x in self.score(pairs[at : at + batch])]
                if len(found) != len(pairs) or not np.isfinite(found).all():
                    raise ValueError("a scorer must give one finite score for each pair")
                yield pd.Series(found, dtype="float64")

        return F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)(query, text)


def check_limits(k: int, candidates: int) -> None:
    if k <= 0 or candidates <= 0 or k > candidates:
        raise ValueError("k must be positive and no more than the candidates")


def rerank(candidates: DataFrame, score: Callable[[Column, Column], Column], k: int = 10, most: int = CANDIDATES) -> DataFrame:
    """candidates(query_id, query_text, chunk_id, rank, text, ...) of rank `most` at most, by score alone; ties: earlier rank, smaller id.

    Their rank becomes hybrid_rank; other columns stay.
    """
    check_limits(k, most)
    first = candidates.where(F.col("rank") <= most).withColumnRenamed("rank", "hybrid_rank")
    scored = first.withColumn("reranker_score", score(F.col("query_text"), F.col("text")))
    return ranked(scored, "reranker_score", "hybrid_rank", "chunk_id", k=k)


def diagnostics(candidates: DataFrame, length: Column, max_tokens: int = MAX_TOKENS, most: int = CANDIDATES) -> DataFrame:
    """For each query: how many candidates were scored, how many are longer than the scorer reads, and the longest."""
    first = candidates.where(F.col("rank") <= most).withColumn("n", length)
    return first.groupBy("query_id").agg(F.count("*").alias("n_candidates"), F.count_if(F.col("n") > max_tokens).alias("n_truncated"), F.max("n").alias("longest"))

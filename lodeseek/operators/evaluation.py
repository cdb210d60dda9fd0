"""Retrieval quality: rankings of files, recall, hits and reciprocal ranks against relevant files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.functions.ranking import PLACES


def files(ranking: DataFrame) -> DataFrame:
    """(query_id, file_path, rank) of ranking(query_id, rank, file_path): each file at its best chunk, ranked anew."""
    best = ranking.groupBy("query_id", "file_path").agg(F.min("rank").alias("best"))
    return best.select("query_id", "file_path", F.row_number().over(Window.partitionBy("query_id").orderBy("best", "file_path")).alias("rank"))


def files_of_scores(scores: DataFrame) -> DataFrame:
    """files() of the complete ranking of scores(query_id, chunk_id, score, file_path), which is not made: a file's best chunk is a minimum."""
    place = F.struct((-F.bround("score", PLACES)).alias("behind"), "chunk_id")
    best = scores.groupBy("query_id", "file_path").agg(F.min(place).alias("best"))
    return best.select("query_id", "file_path", F.row_number().over(Window.partitionBy("query_id").orderBy("best", "file_path")).alias("rank"))


def by_query(ranking: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(query_id, n_relevant, recall_k, hit_k, reciprocal_rank) for every query of relevant(query_id, file_path)."""
    wanted = relevant.select("query_id", "file_path").distinct()
    met = wanted.join(ranking.select("query_id", "file_path", "rank"), ["query_id", "file_path"], "left")
    n = F.count("*")
    columns = [c for k in ks for c in ((F.count_if(F.col("rank") <= k) / n).alias(f"recall_{k}"), F.max(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"hit_{k}"))]
    return met.groupBy("query_id").agg(n.alias("n_relevant"), *columns, F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"))


def summary(scores: DataFrame) -> DataFrame:
    """One row: the number of queries and the mean of each measure."""
    names = [c for c in scores.columns if c.startswith(("recall_", "hit_", "reciprocal"))]
    return scores.agg(F.count("*").alias("n_queries"), *[F.avg(c).alias("mrr" if c == "reciprocal_rank" else c) for c in names])

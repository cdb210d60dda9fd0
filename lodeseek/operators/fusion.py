"""Reciprocal rank fusion of two complete rankings, and the hybrid search built on it.

The first k of the fusion of two complete rankings need only the heads of both. The first k chunks of either ranking have 1 / (c + k)
at least, c being the fusion's constant. A chunk beyond rank d in both has less than 2 / (c + d), so with d = c + 2 * k no
such chunk is among the first k. Chunks of one head alone get their rank in the other ranking by counting who is ahead of them.
Both rankings are scanned (see scan.py), so no table of all scores is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.ranking import ranked
from lodeseek.operators import vector
from lodeseek.operators.lexical import B, K1, LexicalIndex
from lodeseek.sources.tables import written

RRF_K = 60


def faults(ranking: DataFrame) -> DataFrame:
    """One row for ranking(query_id, chunk_id, rank, score): how many rows break each rule; all zero for a sound one."""
    row = ranking.agg(
        F.count_if(F.coalesce(F.col("chunk_id").cast("string"), F.lit("")) == "").alias("n_no_id"),
        F.count_if(F.coalesce(F.col("rank"), F.lit(0)) < 1).alias("n_bad_rank"),
        F.count_if(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))).alias("n_bad_score"),
    )
    twice = lambda c: ranking.groupBy("query_id", c).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias(f"n_repeated_{c}"))
    return row.crossJoin(twice("chunk_id")).crossJoin(twice("rank"))


def check(ranking: DataFrame) -> None:
    found = {k: v for k, v in faults(ranking).first().asDict().items() if v}
    if found:
        raise ValueError(f"not a ranking: {found}")


def fuse(first: DataFrame, second: DataFrame, k: int | None = 10, rrf_k: int = RRF_K, names: tuple[str, str] = ("vector", "bm25"), checked: bool = False) -> DataFrame:
    """(query_id, rank, chunk_id, rrf_score, then rank, raw_score and contribution of each side) of the union of two rankings.

    A side that lacks a chunk gives a null rank and score and adds 0. Rankings that break a rule of faults() are an
    error, unless the caller has `checked` that they cannot.
    """
    if rrf_k <= 0:
        raise ValueError("rrf_k must be positive")
    for ranking in () if checked else (first, second):
        check(ranking)
    a, b = (r.select("query_id", "chunk_id", F.col("rank").alias(f"{n}_rank"), F.col("score").alias(f"{n}_raw_score")) for r, n in zip((first, second), names))
    both = a.join(b, ["query_id", "chunk_id"], "full")
    for n in names:
        both = both.withColumn(f"{n}_contribution", F.coalesce(1 / (rrf_k + F.col(f"{n}_rank")), F.lit(0.0)))
    scored = both.withColumn("rrf_score", F.col(f"{names[0]}_contribution") + F.col(f"{names[1]}_contribution"))
    sides = [f"{n}_{c}" for n in names for c in ("rank", "raw_score", "contribution")]
    return ranked(scored, "rrf_score", "chunk_id", k=k).select("query_id", "rank", "chunk_id", "rrf_score", *sides)


def hybrid(index: LexicalIndex, embeddings: DataFrame, queries: DataFrame, k: int | None = 10, rrf_k: int = RRF_K, k1: float = K1, b: float = B) -> DataFrame:
    """fuse() of the full vector ranking and of all chunks with a lexical score, for queries(query_id, query_text, embedding).

    With k the complete rankings are not made: see above. A query's candidates are 2 * (rrf_k + 2 * k) chunks at most.
    """
    asked, words = queries.select("query_id", "embedding"), queries.select("query_id", "query_text")
    if k is None:
        return fuse(vector.search(embeddings, asked, None), index.search(words, None, k1, b), None, rrf_k, checked=True)
    if k <= 0 or rrf_k <= 0:
        raise ValueError("k and rrf_k must be positive")
    depth, key = rrf_k + 2 * k, ["query_id", "chunk_id"]
    scans = vector.scanned(embeddings, asked), index.scanned(words, k1, b)
    heads = [written(ranked(s.heads(depth), "score", "chunk_id", k=depth).select(*key, "rank", "score")) for s in scans]
    known = [h.select(*key, (1 / (rrf_k + F.col("rank"))).alias(f"part_{i}")) for i, h in enumerate(heads)]
    both = known[0].join(known[1], key, "full").na.fill(0.0, ["part_0", "part_1"])
    least = ranked(both.withColumn("sure", F.col("part_0") + F.col("part_1")), "sure", "chunk_id", k=k).groupBy("query_id").agg(F.min("sure").alias("least"), F.count("*").alias("n"))
    most = F.col("part_0") + F.col("part_1") + F.when((F.col("part_0") == 0) | (F.col("part_1") == 0), F.lit(1 / (rrf_k + depth + 1))).otherwise(F.lit(0.0))
    left = written(both.join(least, "query_id").where((F.col("n") < k) | (most > F.col("least") - 1e-9)).select(*key, "part_0", "part_1"))
    sides = []
    for i, (head, scan) in enumerate(zip(heads, scans)):
        missing = written(left.where(F.col(f"part_{i}") == 0).select(*key))
        own = scan.places(written(scan.only(missing).every().join(missing, key, "left_semi")))
        sides.append(head.join(left.select(*key), key, "left_semi").select(*key, "rank", "score").unionByName(own.select(*key, "rank", "score")))
    return fuse(*sides, k, rrf_k, checked=True)


def with_chunks(ranking: DataFrame, chunks: DataFrame) -> DataFrame:
    """ranking with the chunks' columns. Rankings cut to k are small, but their number of queries is not bounded, so they are written and Spark chooses the join by their size."""
    return written(ranking).join(chunks, "chunk_id")

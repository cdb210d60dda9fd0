"""What an index was made from: fingerprints of corpora and settings, and the checks before two indexes are used together.

A corpus fingerprint is folded in two levels, by the first four digits of chunk_id and then over those 65,536
buckets, so that no task reads the whole corpus. It is a version of its own: a single running hash over all
chunks in order would be another value.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.functions.canonical import json_array


class Incompatible(ValueError):
    """Two artifacts that were not made from the same snapshot or settings."""


def corpus_fingerprint(chunks: DataFrame) -> DataFrame:
    """(repository, fingerprint, n_chunks) of chunks(repository, commit_hash, chunk_id, content_hash): equal for equal chunks in any order."""
    line = F.concat(F.lit('["'), F.col("chunk_id"), F.lit('","'), F.col("content_hash"), F.lit('"]'))
    rows = chunks.select("repository", F.coalesce("commit_hash", F.lit("null")).alias("commit_hash"), F.substring("chunk_id", 1, 4).alias("bucket"), line.alias("line"))
    buckets = rows.groupBy("repository", "commit_hash", "bucket").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("digest"), F.count("*").alias("n"))
    own = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "digest"))), lambda x: x.digest), "\n")
    whole = buckets.groupBy("repository", "commit_hash").agg(own.alias("own"), F.sum("n").alias("n_chunks"))
    return whole.select("repository", F.sha2(F.concat_ws("\n", "repository", "commit_hash", "own"), 256).alias("fingerprint"), "n_chunks")


def settings_fingerprint(*values) -> str:
    """SHA-256 of settings and of the fingerprints they build on, as a compact JSON array."""
    return hashlib.sha256(json.dumps(values, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


@dataclass(frozen=True)
class IndexInfo:
    """The snapshot and settings of an index; None in an expectation stands for any value."""

    repository: str | None = None
    commit_hash: str | None = None
    n_chunks: int | None = None
    corpus: str | None = None
    settings: str | None = None


def describe(chunks: DataFrame, *settings) -> IndexInfo:
    rows = corpus_fingerprint(chunks).limit(2).collect()
    if len(rows) != 1:
        raise Incompatible("an index covers one repository")
    commit = chunks.select("commit_hash").first()[0]
    return IndexInfo(rows[0].repository, commit, rows[0].n_chunks, rows[0].fingerprint, settings_fingerprint(*settings))


def store(spark: SparkSession, info: IndexInfo, path: str) -> None:
    """Write an index's info beside its tables."""
    row = spark.createDataFrame([tuple(asdict(info).values())], "repository string, commit_hash string, n_chunks long, corpus string, settings string")
    row.write.mode("overwrite").parquet(f"{path}/info")


def stored(spark: SparkSession, path: str) -> IndexInfo:
    return IndexInfo(**spark.read.parquet(f"{path}/info").first().asDict())


def check_expected(info: IndexInfo, expected: IndexInfo) -> None:
    for name, value in asdict(expected).items():
        if value is not None and getattr(info, name) != value:
            raise Incompatible(f"{name}: {getattr(info, name)} is not {value}")


def check_together(first: IndexInfo, second: IndexInfo) -> str:
    """The corpus fingerprint that two indexes share."""
    for name in ("repository", "commit_hash", "n_chunks", "corpus"):
        if getattr(first, name) != getattr(second, name):
            raise Incompatible(f"the indexes differ in {name}")
    return first.corpus


def compared(first: DataFrame, second: DataFrame) -> DataFrame:
    """(repository, same_count, same_corpus, together) for each repository of two chunk tables: whether indexes of both may be used together."""
    a, b = (corpus_fingerprint(c).select("repository", F.col("n_chunks").alias(f"n_{i}"), F.col("fingerprint").alias(f"fp_{i}")) for i, c in enumerate((first, second)))
    count, corpus = F.col("n_0").eqNullSafe(F.col("n_1")), F.col("fp_0").eqNullSafe(F.col("fp_1"))
    return a.join(b, "repository", "full").select("repository", count.alias("same_count"), corpus.alias("same_corpus"), (count & corpus).alias("together"))


def check_ids(chunks: DataFrame) -> None:
    """Raise if a chunk id stands twice or is empty, or a corpus has no chunk."""
    found = chunks.groupBy("chunk_id").count().agg(F.count("*").alias("n"), F.count_if(F.coalesce("chunk_id", F.lit("")) == "").alias("empty"), F.max("count").alias("most")).first()
    if not found.n or found.empty or found.most > 1:
        raise ValueError("chunk ids must be there, filled and different")


@dataclass(frozen=True)
class Methods:
    """The settings that fix a result, beside the corpus: changing one changes every fingerprint built on it."""

    tokenizer: str = "tokens-1"
    text_format: str = "chunk-text-1"
    k1: float = 1.5
    b: float = 0.75
    embedder: str = "hashing-64"
    embedder_revision: str = "1"
    max_tokens: int = 8192
    normalized: bool = True
    rrf_version: str = "rrf-1"
    rrf_k: int = 60
    reranker: str = "overlap"
    reranker_revision: str = "1"
    candidates: int = 50
    pair_tokens: int = 1024
    tie_policy: str = "score-hybrid-rank-chunk-id"
    prompt: str = "prompt-1"
    context_format: str = "context-1"
    method: str = "hybrid"
    k: int = 5
    scope: str = "all"
    generator: str = "first-source"
    max_output_tokens: int = 2000


def named_fingerprints(chunks: DataFrame, methods: Methods = Methods()) -> DataFrame:
    """(repository, corpus, bm25, vector, hybrid, rerank, answers): each the SHA-256 of a JSON array of settings and of the fingerprints below it.

    Sources and the vector settings are escaped to ASCII, the others are raw, as readers of either kind expect. Batch sizes are in none of them.
    """
    m = methods
    commits = chunks.groupBy("repository").agg(F.first("commit_hash").alias("commit_hash"))
    rows = corpus_fingerprint(chunks).select("repository", F.col("fingerprint").alias("corpus")).join(commits, "repository")
    own, commit, corpus = F.col("repository"), F.col("commit_hash"), F.col("corpus")
    digest = lambda *values, ascii_only=False: F.sha2(json_array(*values, ascii_only=ascii_only), 256)
    rows = rows.withColumn("bm25", digest(own, commit, m.tokenizer, m.text_format, m.k1, m.b, corpus))
    rows = rows.withColumn("vector", digest(m.text_format, m.embedder, m.embedder_revision, m.max_tokens, m.normalized, corpus, ascii_only=True))
    rows = rows.withColumn("hybrid", digest(own, commit, corpus, F.col("vector"), F.col("bm25"), "hybrid", m.rrf_version, m.rrf_k, m.embedder, m.tokenizer))
    rows = rows.withColumn("rerank", digest(own, commit, corpus, F.col("hybrid"), "hybrid", m.candidates, m.reranker, m.reranker_revision, m.pair_tokens, m.text_format, "rerank-1", m.tie_policy))
    below = {"vector": "vector", "bm25": "bm25", "hybrid": "hybrid", "reranked": "rerank"}[m.method]
    return rows.withColumn("answers", digest("answers-1", m.prompt, m.context_format, m.method, F.col(below), m.k, m.scope, m.generator, m.generator, m.max_output_tokens)).drop("commit_hash")

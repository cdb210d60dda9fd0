"""Stored lexical indexes that carry their snapshot and settings, and hybrid search that takes only indexes of one snapshot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lodeseek.functions.text import lexical_text
from lodeseek.operators import fusion, lexical, vector, vector_index
from lodeseek.operators.vector_index import VectorIndex
from lodeseek.plans import snapshots
from lodeseek.plans.snapshots import Incompatible, IndexInfo, Methods


def settings(k1: float = lexical.K1, b: float = lexical.B) -> tuple:
    return "lexical-1", Methods.tokenizer, Methods.text_format, k1, b


@dataclass(frozen=True)
class StoredLexical:
    """A lexical index and what it was made from. Searches take its own parameters, so a result follows from info."""

    index: lexical.LexicalIndex
    info: IndexInfo
    k1: float
    b: float

    def search(self, queries: DataFrame, k: int | None = 10) -> DataFrame:
        return self.index.search(queries, k, self.k1, self.b)


def build(chunks: DataFrame, path: str, k1: float = lexical.K1, b: float = lexical.B) -> StoredLexical:
    """The lexical index of chunks of one repository, written to path and read back with its checks. The info comes last: without it nothing can be loaded."""
    lexical.check_parameters(k1, b)
    snapshots.check_ids(chunks)
    info = snapshots.describe(chunks, *settings(k1, b))
    lexical.build(chunks.select("chunk_id", lexical_text().alias("text")), path)
    snapshots.store(chunks.sparkSession, info, path)
    return load(chunks.sparkSession, path, k1=k1, b=b)


def load(spark: SparkSession, path: str, expected: IndexInfo | None = None, k1: float = lexical.K1, b: float = lexical.B) -> StoredLexical:
    """The index at path. Other parameters, another snapshot than expected, another count of chunks than stored, or terms and statistics that do not follow from the tokens are errors."""
    info = snapshots.stored(spark, path)
    if info.settings != snapshots.settings_fingerprint(*settings(k1, b)):
        raise Incompatible("the lexical index was made with other settings")
    if expected is not None:
        snapshots.check_expected(info, expected)
    index = lexical.validated(spark, path)
    if index.stats.first().n_documents != info.n_chunks:
        raise Incompatible("the lexical index holds another number of chunks than its info")
    return StoredLexical(index, info, k1, b)


@dataclass(frozen=True)
class HybridIndex:
    """A lexical and a vector index of one snapshot; any other two are an error here, so no search can be made over them."""

    lexical: StoredLexical
    vectors: VectorIndex

    def __post_init__(self):
        snapshots.check_together(self.lexical.info, self.vectors.info)

    @property
    def info(self) -> IndexInfo:
        """What a result follows from, beside the query: the snapshot, and the settings of both indexes and of the fusion."""
        own = self.lexical.info
        both = snapshots.settings_fingerprint("hybrid", Methods.rrf_version, Methods.rrf_k, own.settings, self.vectors.info.settings)
        return IndexInfo(own.repository, own.commit_hash, own.n_chunks, own.corpus, both)

    def search(self, queries: DataFrame, embedder: vector.Embedder, k: int | None = 10) -> DataFrame:
        """fusion.fuse()'s rows for queries(query_id, query_text), embedded with the settings of the vector index.

        Null, blank and tokenless queries and repeated ids are errors, as is an embedder of other settings.
        """
        if snapshots.settings_fingerprint(*vector_index.settings(embedder)) != self.vectors.info.settings:
            raise Incompatible("the vector index was made with other embedder settings")
        lexical.check_queries(queries)
        asked = vector.embed(queries.select("query_id", "query_text"), embedder, "query_text")
        return fusion.hybrid(self.lexical.index, self.vectors.vectors, asked, k, Methods.rrf_k, self.lexical.k1, self.lexical.b)


def open_both(spark: SparkSession, lexical_path: str, vector_path: str, expected: IndexInfo | None = None) -> HybridIndex:
    """The two stored indexes as one; `expected` may name the repository, commit, corpus or count that the caller works on."""
    return HybridIndex(load(spark, lexical_path, expected), vector_index.load(spark, vector_path, expected))

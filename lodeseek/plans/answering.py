"""Answers to a table of questions: retrieve by one of four methods, cut to the scope, number the evidence, generate, check citations."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lodeseek.functions.text import lexical_text
from lodeseek.operators import evidence as E
from lodeseek.operators import fusion, reranking, vector
from lodeseek.operators.hybrid_index import HybridIndex
from lodeseek.operators.lexical import LexicalIndex
from lodeseek.plans.snapshots import IndexInfo, check_together, settings_fingerprint

METHODS = ("vector", "bm25", "hybrid", "reranked")


@dataclass(frozen=True)
class Request:
    """How questions are answered."""

    method: str = "hybrid"
    k: int = 5
    scope: str = "all"
    max_output_tokens: int = 2000
    dry_run: bool = False

    def __post_init__(self):
        if self.method not in METHODS or self.scope not in E.SCOPES:
            raise ValueError(f"method must be one of {METHODS} and scope one of {E.SCOPES}")
        if self.k <= 0 or self.max_output_tokens <= 0:
            raise ValueError("k and max_output_tokens must be positive")

    @property
    def candidates(self) -> int:
        most = reranking.CANDIDATES if self.method == "reranked" else None
        return E.over_fetch(self.k, self.scope, most)

    def fingerprint(self, retrieval: str, generator: str) -> str:
        return settings_fingerprint("answers-1", self.method, retrieval, self.k, self.scope, generator, self.max_output_tokens)


class Generator(ABC):
    """Answers from a prompt, as a column; a remote model would be a pandas UDF here."""

    name: str

    @abstractmethod
    def answer(self, instructions: str, prompt: Column) -> Column: ...


class FirstSource(Generator):
    """The same answer for the same prompt, without a model: it names the first source of the evidence."""

    name = "first-source"

    def answer(self, instructions: str, prompt: Column) -> Column:
        path = F.regexp_extract(prompt, r"\[S1\]\nFile: ([^\n]*)", 1)
        return F.concat(F.lit("The closest excerpt is in "), path, F.lit(" [S1]."))


@dataclass
class Retriever:
    """Chunks with the indexes that were made of them. Indexes whose infos are given must share a snapshot to be used together."""

    chunks: DataFrame
    index: LexicalIndex | None = None
    embeddings: DataFrame | None = None
    score: Callable[[Column, Column], Column] = vector.overlap
    index_info: IndexInfo | None = None
    embeddings_info: IndexInfo | None = None

    @classmethod
    def over(cls, chunks: DataFrame, both: HybridIndex, score: Callable[[Column, Column], Column] = vector.overlap) -> Retriever:
        """A retriever over stored indexes, which are of one snapshot. Questions need the vectors of the same embedder."""
        return cls(chunks, both.lexical.index, both.vectors.vectors, score, both.lexical.info, both.vectors.info)

    def retrieve(self, questions: DataFrame, method: str, k: int) -> DataFrame:
        """(query_id, rank, score, chunk columns) of questions(query_id, query_text[, embedding])."""
        if method in ("hybrid", "reranked") and self.index_info and self.embeddings_info:
            check_together(self.index_info, self.embeddings_info)
        if method == "bm25":
            found = self.index.search(questions, k)
        elif method == "vector":
            found = vector.search(self.embeddings, questions, k)
        elif method == "hybrid":
            found = fusion.hybrid(self.index, self.embeddings, questions, k).withColumn("score", F.col("rrf_score"))
        elif method == "reranked":
            first = fusion.hybrid(self.index, self.embeddings, questions, reranking.CANDIDATES).select("query_id", "rank", "chunk_id")
            first = first.join(self.chunks.select("chunk_id", lexical_text().alias("text")), "chunk_id").join(questions.select("query_id", "query_text"), "query_id")
            found = reranking.rerank(first, self.score, k).withColumn("score", F.col("reranker_score"))
        else:
            raise ValueError(f"method must be one of {METHODS}")
        return fusion.with_chunks(found.select("query_id", "rank", "chunk_id", "score"), self.chunks)


def check_questions(questions: DataFrame) -> None:
    """Raise if a question is null or blank, or an id stands twice."""
    found = questions.agg(F.count_if(F.trim(F.coalesce("query_text", F.lit(""))) == "").alias("blank"), F.count("*").alias("n"), F.count_distinct("query_id").alias("ids")).first()
    if found.blank or found.n != found.ids:
        raise ValueError("each question needs a text and an id of its own")


def answer(retriever: Retriever, questions: DataFrame, request: Request = Request(), generator: Generator = FirstSource(), watch: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, evidence). answers: query_id, query_text, prompt, n_sources, answer, cited, unknown, valid.

    Questions without evidence, and all in a dry run, keep a null answer that is not valid; no text is generated for them.
    watch counts, in the run that makes the answers, n_questions, n_without_evidence, n_sources, n_answered and n_valid.
    """
    check_questions(questions)
    ranking = E.in_scope(retriever.retrieve(questions, request.method, request.candidates), request.scope)
    found = E.evidence(ranking, request.k)
    rows = questions.select("query_id", "query_text").join(E.contexts(found), "query_id", "left")
    rows = rows.select("query_id", "query_text", E.prompt(F.col("query_text"), F.col("context")).alias("prompt"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"))
    made = F.lit(None).cast("string") if request.dry_run else F.when(F.col("n_sources") > 0, generator.answer(E.INSTRUCTIONS, F.col("prompt")))
    answers = E.validated(rows.withColumn("answer", made), found)
    if watch is not None:
        counts = {"n_without_evidence": F.col("n_sources") == 0, "n_answered": F.col("answer").isNotNull(), "n_valid": F.col("valid")}
        answers = answers.observe(watch, F.count("*").alias("n_questions"), F.sum("n_sources").alias("n_sources"), *(F.count_if(c).alias(n) for n, c in counts.items()))
    return answers, found

"""Chunks: line windows of whole files, structural units with their gaps, identities, order, counts and comparison."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.functions import text as T
from lodeseek.functions.canonical import folded
from lodeseek.operators.structure import GRAMMARS, chunk_source
from lodeseek.operators.units import python_parts

#: The columns of a chunk, in order.
CHUNK = (
    "chunk_id string, repository string, commit_hash string, file_path string, language string, chunk_type string, symbol_name string, parent_symbol string, "
    "start_line int, end_line int, part_index int, part_count int, content_hash string, content string, parser_status string"
)
COLUMNS = [c.split()[0] for c in CHUNK.split(", ")]


@dataclass(frozen=True)
class ChunkSettings:
    """Lines of a fallback window, lines it shares with the one before, and lines of a structural part."""

    max_lines: int = 80
    overlap: int = 10
    max_unit_lines: int = 200

    def __post_init__(self):
        if self.max_lines <= self.overlap or self.overlap < 0 or self.max_unit_lines <= 0:
            raise ValueError("max_lines must be over overlap, and max_unit_lines positive")


def line_chunks(files: DataFrame, max_lines: int = 80, overlap: int = 10) -> DataFrame:
    """files with start_line, end_line, part_index, part_count and content for each window of their column text."""
    return files.withColumn("w", F.explode(T.windows(T.lines(F.col("text")), max_lines, overlap))).select("*", "w.*").drop("w", "text")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def chunk_id() -> Column:
    """SHA-256 of the chunk's JSON array of eleven fields."""
    string = lambda c: T.json_string(F.col(c))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    names = ["repository", "commit_hash", "file_path", "chunk_type", "symbol_name", "parent_symbol"]
    fields = [*map(string, names), *map(number, ("start_line", "end_line", "part_index", "part_count")), string("content_hash")]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *fields), F.lit("]")), 256)


def identified(parts: DataFrame) -> DataFrame:
    """parts (chunks without ids and hashes) as chunks."""
    return parts.withColumn("content_hash", content_hash(F.col("content"))).withColumn("chunk_id", chunk_id()).select(*COLUMNS)


def structural_parts(files: DataFrame, settings: ChunkSettings = ChunkSettings()) -> DataFrame:
    """Units and gaps of files(repository, commit_hash, file_path, language, extension, text) that have a grammar; files without units come back as windows."""
    keep = ["repository", "commit_hash", "file_path", "language"]
    names = ["chunk_type", "symbol_name", "parent_symbol", "start_line", "end_line", "part_index", "part_count", "content", "parser_status"]
    kinds = dict(zip(names, [pa.string()] * 3 + [pa.int32()] * 4 + [pa.string()] * 2))
    schema = ", ".join(f"{c} string" for c in keep) + ", " + ", ".join(f"{n} {'int' if t == pa.int32() else 'string'}" for n, t in kinds.items())

    def run(batches):
        for batch in batches:
            which, rows = [], []
            for i, (extension, text) in enumerate(zip(batch.column("extension").to_pylist(), batch.column("text").to_pylist())):
                own = chunk_source(GRAMMARS[extension], text.encode(), settings.max_lines, settings.overlap, settings.max_unit_lines)
                which += [i] * len(own)
                rows += own
            at = pa.array(which, pa.int64())
            cols = [batch.column(c).take(at) for c in keep] + [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays(cols, names=keep + names)

    return files.select(*keep, "extension", "text").mapInArrow(run, schema)


def chunk_files(files: DataFrame, settings: ChunkSettings = ChunkSettings()) -> DataFrame:
    """Chunks of files(repository, commit_hash, file_path, language, extension, text): by structure where there is a grammar, else by lines.

    Python goes through the joins of units.py, other grammars through the scanner of structure.py. An empty file is one empty chunk. The order of rows is not fixed; see ordered().
    """
    known = F.col("extension").isin(*GRAMMARS)
    plain = line_chunks(files.where(~F.coalesce(known, F.lit(False))).drop("extension"), settings.max_lines, settings.overlap)
    none = F.lit(None).cast("string")
    plain = plain.withColumns({"chunk_type": F.lit("file"), "symbol_name": none, "parent_symbol": none, "parser_status": F.lit("fallback_unsupported_language")})
    python = F.coalesce(F.col("extension") == ".py", F.lit(False))
    parts = structural_parts(files.where(known & ~python), settings).unionByName(plain)
    python = files.where(python)
    if not python.isEmpty():  # a constant extension is decided without a job
        parts = parts.unionByName(python_parts(python, settings.max_lines, settings.overlap, settings.max_unit_lines))
    return identified(parts)


def document_files(documents: DataFrame, repository: str = "corpus") -> DataFrame:
    """documents(doc_id, text, source) as files: one Markdown file each; null texts are left out."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return documents.where("text IS NOT NULL").select(
        F.lit(repository).alias("repository"), F.lit(None).cast("string").alias("commit_hash"), path.alias("file_path"), F.lit("Markdown").alias("language"), F.lit(".md").alias("extension"), "text"
    )


def chunk_order() -> list[Column]:
    return [folded(F.col("file_path")), *map(F.col, ("file_path", "start_line", "end_line", "chunk_id"))]


def ordered(chunks: DataFrame) -> DataFrame:
    """Chunks by path in full case folding, path, lines and id (a range-partitioned sort)."""
    return chunks.orderBy(*chunk_order())


def counts(chunks: DataFrame) -> DataFrame:
    """Chunks, structural ones and fallback ones for each language."""
    fallback = F.col("parser_status").startswith("fallback")
    structural = ~fallback & (F.col("parser_status") != "file_context")
    return chunks.groupBy("language").agg(F.count("*").alias("n_chunks"), F.count_if(structural).alias("n_structural"), F.count_if(fallback).alias("n_fallback"))


def difference(stored: DataFrame, made: DataFrame) -> DataFrame:
    """Chunks that only one of two corpora has, repeats counted; empty if they are equal."""
    a, b = stored.select(*COLUMNS), made.select(*COLUMNS)
    return a.exceptAll(b).withColumn("side", F.lit("stored")).unionByName(b.exceptAll(a).withColumn("side", F.lit("made")))

"""Structural chunks of Python files: a parser lists each file's definitions, and joins and windows over that table do the rest.

What lies in what is a join of intervals, what no unit covers is a running maximum over the units of a file, and content is cut
from the file's bytes by place. A file is at most as large as a repository takes (2 MiB), so a window over one is small.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.functions import text as T
from lodeseek.operators.intervals import inside_any, narrowest

NODE = "key string, id long, start long, end long, kind string, name string, has_errors boolean"
PLACE = ["repository", "commit_hash", "file_path", "language"]
PART = ["chunk_type", "symbol_name", "parent_symbol", "start_line", "end_line", "part_index", "part_count", "content", "parser_status"]


def definitions(source: bytes) -> list[tuple[int, int, str, str]] | None:
    """(start, end, "class" or "function", name) of every definition, in bytes; None for a file with syntax errors."""
    try:
        found = [n for n in ast.walk(ast.parse(source)) if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef))]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    begins = [0] + [m.end() for m in re.finditer(rb"\r\n|\r|\n", source)]
    return [(begins[n.lineno - 1] + n.col_offset, begins[n.end_lineno - 1] + n.end_col_offset, "class" if isinstance(n, ast.ClassDef) else "function", n.name) for n in found]


def nodes(files: DataFrame) -> DataFrame:
    """NODE rows of files(key, text): one for each definition, and one with id -1 for the file itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                found = definitions(text.encode())
                rows.append((key, -1, 0, 0, "file", "", found is None))
                rows += [(key, i, *x, False) for i, x in enumerate(found or ())]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["key", "id", "start", "end", "kind", "name", "has_errors"])

    return files.select("key", "text").mapInArrow(run, NODE)


def units(parsed: DataFrame) -> DataFrame:
    """(key, start, end, chunk_type, symbol_name, parent_symbol) of nodes(): functions that lie in no other function, and classes that own none of these.

    A function's parent is the narrowest class around it; in a class it is a method, or the constructor by its name.
    """
    own = ["key", "id", "start", "end"]
    functions, classes = parsed.where("kind = 'function'"), parsed.where("kind = 'class'")
    outermost = functions.join(inside_any(functions.select(*own), functions.select(*own), "key").select("key", "id"), ["key", "id"], "left_anti")
    names = classes.select("key", F.col("id").alias("container_id"), F.col("name").alias("parent_symbol"))
    owned = narrowest(classes.select(*own), outermost.select(*own, "name"), "key")
    bare = classes.join(owned.where("container_id IS NOT NULL").select("key", F.col("container_id").alias("id")), ["key", "id"], "left_anti")
    alone = narrowest(classes.select(*own), bare.select(*own, "name"), "key").withColumn("chunk_type", F.lit("class"))
    kind = F.when(F.col("container_id").isNull(), "function").when(F.col("name") == "__init__", "constructor").otherwise("method")
    rows = owned.withColumn("chunk_type", kind).unionByName(alone).join(names, ["key", "container_id"], "left")
    return rows.select("key", "start", "end", "chunk_type", F.col("name").alias("symbol_name"), "parent_symbol")


def gaps(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, start, end) of what no unit of found(key, start, end, chunk_type) covers, up to sizes(key, size), for files with units."""
    in_file = Window.partitionBy("key").orderBy("start", "end", "chunk_type")
    reached = F.coalesce(F.max("end").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = found.select("key", reached.alias("from"), F.col("start").alias("to"))
    after = found.groupBy("key").agg(F.max("end").alias("from")).join(sizes, "key").select("key", "from", F.col("size").alias("to"))
    return before.unionByName(after).where("from < to").select("key", F.col("from").alias("start"), F.col("to").alias("end"))


def _cut(pieces: DataFrame, files: DataFrame, most: int, status: str) -> DataFrame:
    """pieces(key, start, end, chunk_type, symbol_name, parent_symbol) as parts of at most `most` lines; blank pieces are none."""
    whole = F.col("bytes")
    text = whole.substr(F.col("start") + 1, F.col("end") - F.col("start")).cast("string")
    above = whole.substr(F.lit(1).cast("long"), F.col("start")).cast("string")
    rows = pieces.join(files.select("key", *PLACE, F.encode("text", "UTF-8").alias("bytes")), "key").select(*PLACE, "chunk_type", "symbol_name", "parent_symbol", text.alias("text"), line_of(above).alias("line"))
    rows = rows.where(F.col("text").rlike(r"\S") | (F.col("chunk_type") != "file"))
    rows = rows.withColumn("w", F.explode(T.windows(T.lines(F.col("text")), most, 0)))
    place = lambda c: (F.col(f"w.{c}") + F.col("line") - 1).cast("int").alias(c)
    return rows.select(*PLACE, "chunk_type", "symbol_name", "parent_symbol", place("start_line"), place("end_line"), "w.part_index", "w.part_count", "w.content", F.lit(status).alias("parser_status"))


def line_of(above: Column) -> Column:
    """The line that begins or goes on after a text."""
    return F.char_length(above) - F.char_length(F.replace(above, F.lit("\n"), F.lit(""))) + 1


def python_parts(files: DataFrame, max_lines: int, overlap: int, max_unit_lines: int) -> DataFrame:
    """Chunks without ids of files(repository, commit_hash, file_path, language, text) in Python: units, and what lies between them; or windows of all of it.

    A path stands once in a commit of a repository. Files with syntax errors and files without definitions are cut by lines.
    """
    from lodeseek.sources.tables import written

    key = F.to_json(F.struct("repository", "commit_hash", "file_path"))
    files = written(files.select(*PLACE, "text", key.alias("key")))
    parsed = written(nodes(files))
    found = written(units(parsed))
    none = F.lit(None).cast("string")
    between = gaps(found, files.select("key", F.octet_length("text").cast("long").alias("size")))
    between = between.select("key", "start", "end", F.lit("file").alias("chunk_type"), none.alias("symbol_name"), none.alias("parent_symbol"))
    status = F.when(F.col("has_errors"), "fallback_syntax_errors").otherwise("fallback_no_structures")
    plain = files.join(found.select("key"), "key", "left_anti").join(parsed.where("id = -1").select("key", status.alias("parser_status")), "key")
    plain = plain.withColumn("w", F.explode(T.windows(T.lines(F.col("text")), max_lines, overlap)))
    plain = plain.select(*PLACE, F.lit("file").alias("chunk_type"), none.alias("symbol_name"), none.alias("parent_symbol"), *(f"w.{c}" for c in ("start_line", "end_line", "part_index", "part_count", "content")), "parser_status")
    return _cut(found, files, max_unit_lines, "parsed").unionByName(_cut(between, files, max_lines, "file_context")).unionByName(plain)

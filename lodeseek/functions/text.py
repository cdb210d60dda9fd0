"""Text as columns: code-aware tokens, line windows, document formats, paths, JSON strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an identifier is, and its components (camel case, acronyms, digits).
IDENTIFIER = "[A-Za-z0-9]+(?:[_-][A-Za-z0-9]+)*"
COMPONENT = "[A-Z]+(?=[A-Z][a-z]|[0-9]|$)|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
LINE = r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+"
WHITE = r"^[ \t\n\x0B\f\r]*$"


def tokens(text: Column | str) -> Column:
    """array<string>: each identifier in lower case, then its components where it has more than one. ASCII only; null gives null."""
    text = F.col(text) if isinstance(text, str) else text

    def one(word: Column) -> Column:
        parts = F.flatten(F.transform(F.split(word, "[_-]+"), lambda s: F.regexp_extract_all(s, F.lit(COMPONENT), F.lit(0))))
        return F.concat(F.array(F.lower(word)), F.when(F.size(parts) > 1, F.transform(parts, F.lower)).otherwise(F.array().cast("array<string>")))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)), one))


def lines(text: Column) -> Column:
    """The lines with their ends (LF, CR or CR LF); an empty text is one empty line."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(LINE), F.lit(0)))


def windows(own: Column, most: int, overlap: int = 0) -> Column:
    """array<struct<start_line, end_line, part_index, part_count, content>> over an array of lines.

    Windows have `most` lines and share `overlap` with the one before; part_index is null where there is one window.
    """
    if most <= overlap or overlap < 0:
        raise ValueError("a window must be longer than its overlap")
    n, step = F.size(own), most - overlap
    count = F.when(n <= most, 1).otherwise(1 + F.ceil((n - most) / F.lit(step))).cast("int")

    def window(i: Column) -> Column:
        start = (i - 1) * step + 1
        return F.struct(
            start.alias("start_line"),
            F.least(start + most - 1, n).alias("end_line"),
            F.when(count > 1, i).alias("part_index"),
            count.alias("part_count"),
            F.array_join(F.slice(own, start, most), "").alias("content"),
        )

    return F.transform(F.sequence(F.lit(1), count), window)


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """Lower-cased last suffix with its dot; none for names that begin with their only dot."""
    return F.lower(F.regexp_extract(name_of(path), r".(\.[^.]+)$", 1))


def is_absolute(path: Column) -> Column:
    return path.rlike(r"^(/|[A-Za-z]:[\\/]|\\\\)")


def is_documentation(language: Column, path: Column) -> Column:
    return (F.lower(F.coalesce(language, F.lit(""))) == "markdown") | (suffix(path) == ".md")


def slug(name: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", "")
    return F.when(out == "", "repository").otherwise(out)


def json_string(text: Column) -> Column:
    """The text as a JSON string, or null as the word null."""
    return F.coalesce(F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1), F.lit("null")) if text is not None else F.lit("null")


def _lines_of(*fields: tuple[str, Column], body: Column) -> Column:
    return F.concat(*[F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("")), F.lit("\n")) for name, value in fields], F.lit("Code:\n"), body)


def _described() -> list[tuple[str, Column]]:
    # The headings of a chunk's text.
    return [(n, F.col(c)) for n, c in (("File", "file_path"), ("Language", "language"), ("Type", "chunk_type"), ("Symbol", "symbol_name"), ("Parent", "parent_symbol"))]


def lexical_text() -> Column:
    """A chunk as the lexical index and the pair scorer read it."""
    return _lines_of(*_described(), body=F.col("content"))


def embedding_text() -> Column:
    """A chunk as an embedder reads it."""
    return _lines_of(("Repository", F.col("repository")), *_described(), body=F.col("content"))


def evidence_text() -> Column:
    """A numbered piece of evidence as a generator reads it."""
    extra = [("Lines", F.concat_ws("-", "start_line", "end_line")), ("Retrieval rank", F.col("retrieval_rank"))]
    return F.concat(F.lit("["), F.col("source_id"), F.lit("]\n"), _lines_of(*_described(), *extra, body=F.col("content")))


def display_symbol() -> Column:
    both = F.col("parent_symbol").isNotNull() & F.col("symbol_name").isNotNull()
    return F.when(both, F.concat_ws(".", "parent_symbol", "symbol_name")).otherwise(F.coalesce("symbol_name", "parent_symbol", F.lit("(file context)")))

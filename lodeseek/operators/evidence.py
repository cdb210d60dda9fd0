"""From a ranking to numbered evidence, context, prompt and checked citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.functions.text import evidence_text, is_absolute, is_documentation

SCOPES = ("all", "code", "docs")
MARKER = r"\[(S[1-9][0-9]*)\]"
INSTRUCTIONS = (
    "Answer from the numbered repository excerpts alone. After each statement name the excerpts that show it, as in [S1]. "
    "Use no other numbers. If the excerpts do not answer the question, say that the evidence is not enough."
)


def in_scope(ranking: DataFrame, scope: str) -> DataFrame:
    """The rows of code or of documentation; ranks stay as they were."""
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}")
    docs = is_documentation(F.col("language"), F.col("file_path"))
    return ranking if scope == "all" else ranking.where(docs if scope == "docs" else ~docs)


def over_fetch(k: int, scope: str, most: int | None = None) -> int:
    """How many rows to rank so that k are likely left in the scope; never more than `most`."""
    n = k if scope == "all" else max(50, 10 * k)
    return n if most is None else min(n, most)


def evidence(ranking: DataFrame, k: int) -> DataFrame:
    """ranking with source_id S1, S2, ... and retrieval_rank: the first row of each chunk, k a query. Absolute paths are an error."""
    if k <= 0:
        raise ValueError("k must be positive")
    rows = ranking.withColumn("file_path", F.when(is_absolute(F.col("file_path")), F.raise_error(F.lit("evidence paths must be relative"))).otherwise(F.col("file_path")))
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("rank"))).where("nth = 1")
    numbered = first.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id"))).where(F.col("nth") <= k)
    return numbered.withColumn("source_id", F.concat(F.lit("S"), F.col("nth").cast("string"))).withColumnRenamed("rank", "retrieval_rank").drop("nth")


def contexts(found: DataFrame) -> DataFrame:
    """(query_id, context, n_sources): the evidence of each query in order, k pieces at most."""
    nth = F.substring("source_id", 2, 10).cast("int")
    own = F.sort_array(F.collect_list(F.struct(nth.alias("n"), evidence_text().alias("t"))))
    return found.groupBy("query_id").agg(F.array_join(F.transform(own, lambda x: x.t), "\n\n").alias("context"), F.count("*").alias("n_sources"))


def prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("QUESTION:\n"), question, F.lit("\n\nREPOSITORY EVIDENCE:\n\n"), context, F.lit("\n\nAnswer from this evidence alone."))


def cited(answer: Column) -> Column:
    """array<string>: the source ids that an answer names, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(MARKER), F.lit(1)))


#: Fixed value: what counts as code in an answer, a fence or a span within one line.
CODE = r"```[\s\S]*?```|`[^`\n]+`"


def linked(answer: Column) -> Column:
    """The answer with a link in place of each marker [S...] outside code, to the source of that name; any digits count here, 0 too.

    What stands between pieces of code is taken apart from them, so no text is scanned twice. A piece that begins with an unclosed backtick stays as it is.
    """
    outside, code = F.split(answer, CODE, -1), F.regexp_extract_all(answer, F.lit(CODE), F.lit(0))
    link = lambda x: F.when(x.startswith("`"), x).otherwise(F.regexp_replace(x, r"\[(S[0-9]+)\]", r"[$1](#source-$1)"))
    return F.array_join(F.zip_with(outside, code, lambda x, y: F.concat(link(x), F.coalesce(y, F.lit("")))), "")


def with_cited(found: DataFrame, answers: DataFrame) -> DataFrame:
    """The evidence with is_cited: whether the validated answer to its query names it. Queries without an answer cite nothing."""
    own = answers.select("query_id", F.explode("cited").alias("source_id")).distinct().withColumn("is_cited", F.lit(True))
    return found.join(own, ["query_id", "source_id"], "left").withColumn("is_cited", F.coalesce("is_cited", F.lit(False)))


def sources(found: DataFrame) -> DataFrame:
    """The evidence as a client sees it: named by source, without the ids of chunks."""
    names = {"source_id": "id", "symbol_name": "symbol"}
    columns = ["source_id", "file_path", "symbol_name", "parent_symbol", "start_line", "end_line", "language", "chunk_type", "retrieval_rank", "content"]
    return found.select("query_id", *(F.col(c).alias(names.get(c, c)) for c in columns))


def validated(answers: DataFrame, found: DataFrame, by: str = "query_id") -> DataFrame:
    """answers(query_id, answer) with cited, unknown and valid: valid answers cite something and nothing that is not there.

    With `by`, a column of both, answers share the evidence that has its value; it is not copied for each of them.
    """
    own = found.groupBy(by).agg(F.collect_set("source_id").alias("available"))
    none = F.array().cast("array<string>")
    rows = answers.join(own, by, "left").withColumn("cited", F.coalesce(cited(F.col("answer")), none))
    rows = rows.withColumn("unknown", F.array_except("cited", F.coalesce("available", none))).drop("available")
    return rows.withColumn("valid", (F.size("cited") > 0) & (F.size("unknown") == 0))


def cited_evidence(answers: DataFrame, found: DataFrame, by: str = "query_id") -> DataFrame:
    """The evidence that validated answers cite, with its place (from 1) among the citations; `by` as in validated()."""
    own = answers.select(*dict.fromkeys(["query_id", by]), F.posexplode("cited").alias("at", "source_id"))
    return own.join(found, [by, "source_id"]).withColumn("place", F.col("at") + 1).drop("at")


def markdown(answers: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, export): an answer with the list of its sources."""
    line = F.concat(F.lit("- **"), F.col("source_id"), F.lit("** `"), F.col("file_path"), F.lit("` lines "), F.concat_ws("-", "start_line", "end_line"))
    own = F.sort_array(F.collect_list(F.struct(F.substring("source_id", 2, 10).cast("int").alias("n"), line.alias("t"))))
    listed = found.groupBy("query_id").agg(F.array_join(F.transform(own, lambda x: x.t), "\n").alias("sources"))
    return answers.join(listed, "query_id", "left").select("query_id", F.concat(F.coalesce("answer", F.lit("")), F.lit("\n\n## Sources\n\n"), F.coalesce("sources", F.lit(""))).alias("export"))

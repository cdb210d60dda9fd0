"""Documents to packed sequences: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last give
the columns of documents; the last gives the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import decontaminate, line_dedup, near_sets, packing, toxicity
from lodeseek.llm.common import written
from lodeseek.llm.queries import table, tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold, learned from the labels of documents that are there; null texts score as empty ones."""
    return toxicity.accepted(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that an earlier document holds, and all rows stay; n_chars, where there is such a column, follows the new text."""
    found = line_dedup.dedup(docs, first_only=False, moved=False)
    fields = {c: F.col("row").getField(c) for c in docs.columns}
    if "n_chars" in fields:
        n = F.when(F.col("n_removed") > 0, F.char_length(fields["text"])).otherwise(fields["n_chars"])
        fields["n_chars"] = n.cast(docs.schema["n_chars"].dataType)
    return found.select(*(x.alias(c) for c, x in fields.items()))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an earlier near copy (sets of five words, similarity 0.8); texts without words are one group, rows without doc_id stay."""
    return near_sets.keep_first(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; an empty benchmark and null texts take nothing away."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences of all documents; null texts hold the end id alone."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_lines),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: SQL cannot express the scores, fingerprints and tokens; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

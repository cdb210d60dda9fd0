"""Mixing sources to target weights, with DataFrame functions alone.

Sizes add up by source before anything is joined. Sources are numbered in parts of their range, each source
gets its target and so its repetition rate, and a document is taken floor(rate) times plus once more if its
draw is below the fraction. A draw comes from a hash of the document's id and the seed of its source: of
SEEDS seeds, the one whose draws bring the source nearest to its target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.llm.common import quoted, written

BLANK, FILLED = r"[\x20\x09-\x0D]*", r"[^\x20\x09-\x0D]+"
SEEDS = 32
DRAWS = 1 << 32


def n_words(text: Column) -> Column:
    """How many runs of anything but ASCII white space a text has; null: none. Each run with the blanks around it becomes one letter, so nothing is split."""
    one_each = F.regexp_replace(text, f"{BLANK}{FILLED}{BLANK}", "w")
    return F.when(text.rlike(FILLED), F.char_length(one_each)).otherwise(0).cast("long")


def _drawn(key: Column, text: Column) -> tuple[Column, Column]:
    """at and step, what the draws of a document are made of. A null id draws by its text."""
    digest = F.md5(F.coalesce(key.cast("string"), text.cast("string"), F.lit("")).cast("binary"))
    part = lambda i: F.conv(F.substring(digest, i, 8), 16, 10).cast("long")
    return part(1).alias("at"), part(9).alias("step")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, at, step) of docs(doc_id, text, source, ...)."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(text).alias("size"), *_drawn(F.col("doc_id"), text))


def numbered(sources: DataFrame) -> DataFrame:
    """sources(source, ...) with place from 0 by code point, null last: numbered within parts of the range, after those in the parts before."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = written(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources")
    before = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each part
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.join(F.broadcast(before), "part").withColumn("place", F.col("before") + own - 1).drop("part", "before")


def _is_full(most: int, num: int, den: int) -> Column:
    """Whether weight * num / den reaches most times the size."""
    whole = lambda c, n: c.cast("decimal(19,0)") * F.lit(n).cast("decimal(19,0)")
    return whole(most * F.col("source_size"), den) <= whole(F.col("weight"), num)


def level(sources: DataFrame, percent: int, most: int) -> tuple[int, int]:
    """Words for each unit of weight, as a fraction, of the sources below most times their size.

    Sources that the level fills stop there and leave the rest to the others, until the level fills no more; it
    only rises, so each round needs sums alone.
    """
    total, weights = (int(x or 0) for x in sources.agg(F.sum("source_size"), F.sum("weight")).first())
    full = (0, 0, 0)
    while True:
        num, den = percent * total - 100 * most * full[1], 100 * (weights - full[2])
        now = tuple(int(x or 0) for x in sources.where(_is_full(most, num, den)).agg(F.count("*"), F.sum("source_size"), F.sum("weight")).first())
        if now == full:
            return num, den
        full = now


def targets(rows: DataFrame, weights: Sequence[int] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """(source, source_size, target, rate) of rows(source, size): percent of all words, shared by weight, and at most `most` times a source.

    weights repeat over the sources by code point, null last. A source without words has target and rate 0.
    """
    if not weights or min(weights) < 1 or percent < 0 or most < 1:
        raise ValueError("weights and most must be positive whole numbers, percent none below 0")
    sources = numbered(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    sources = written(sources.withColumn("weight", weight), "weights")
    num, den = level(sources, percent, most)
    target = F.when(_is_full(most, num, den), (most * F.col("source_size")).cast("double")).otherwise((F.col("weight") * F.lit(num)).cast("double") / F.lit(float(den)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return sources.select("source", "source_size", target.alias("target")).withColumn("rate", rate)


def _copies(seed: Column | int) -> Column:
    """How often a row(at, step, rate) is taken under a seed."""
    draw = (F.col("at") + F.col("step") * seed) % DRAWS
    whole = F.floor("rate")
    return whole + F.when(draw / float(DRAWS) < F.col("rate") - whole, 1).otherwise(0)


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows(source, ...) with the columns of their source, null being a source too; Spark broadcasts the sources while their table is small, and splits a hot source's rows where it is not."""
    named = sources.withColumnRenamed("source", "of_source")
    return rows.join(named, rows.source.eqNullSafe(named.of_source)).drop("of_source")


def plan(rows: DataFrame, weights: Sequence[int] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """targets() with the seed of each source, for rows of sized()."""
    goal = written(targets(rows, weights, percent, most), "targets")
    sums = _with_source(rows, goal).groupBy("source").agg(F.first("target").alias("target"), *(F.sum(F.col("size") * _copies(k)).alias(f"s{k}") for k in range(SEEDS)))
    best = F.array_min(F.array(*(F.struct(F.abs(F.col(f"s{k}") - F.col("target")).alias("off"), F.lit(k).alias("seed")) for k in range(SEEDS))))
    return written(_with_source(goal, sums.select("source", best["seed"].alias("seed"))), "plan")


def taken(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, n_copies, taken) for every row of sized(), by the sources of plan()."""
    found = _with_source(rows, sources).withColumn("n_copies", _copies(F.col("seed")))
    return found.select("doc_id", "size", "source_size", "target", "n_copies", (F.col("size") * F.col("n_copies")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """taken() for every row of docs(doc_id, text, source, ...); the texts are read once.

    Null texts and texts of blanks have size 0 and are taken as 0 words. Null is a source of its own, the last. Rows with
    one doc_id share their draws, so reruns and repeated rows agree; rows without an id draw by their text.
    Texts may be of any length, other columns are not read, and an empty table gives an empty result.
    """
    rows = written(sized(docs), "sizes")
    return taken(rows, plan(rows, weights, percent, most))


def emit(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """(row, copy): the mixed corpus, every row of docs as often as mix() takes it, copies counted from 1. docs is read twice; only rates are joined to it."""
    rows = written(sized(docs), "sizes")
    row = F.struct(*map(quoted, docs.columns)).alias("row")
    whole = docs.select(row, F.col("source").cast("string").alias("source"), *_drawn(F.col("doc_id"), F.col("text")))
    found = _with_source(whole, plan(rows, weights, percent, most)).withColumn("n_copies", _copies(F.col("seed")))
    return found.where("n_copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))).alias("copy"))

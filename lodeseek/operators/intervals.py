"""Containment of intervals as an equi-join on cells, so that no file is one task's work and no pair of distant intervals meets.

An interval's level is the number of binary digits of its length; a level has cells of an eighth of its longest interval. A
container stands in every cell of its level that it touches, nine at most. A span asks, at each level that there is,
for the cell of its start, which any container of that level around it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A level's longest interval is 2**FINE cells.
FINE = 3


def _level(start: Column, end: Column) -> Column:
    return F.length(F.bin(F.greatest(end - start, F.lit(1)).cast("long")))


def _cell(at: Column, level: Column) -> Column:
    width = F.greatest(level - FINE, F.lit(0)).cast("int")
    return F.call_function("shiftright", at, width)


def narrowest(containers: DataFrame, spans: DataFrame, by: str = "file_path") -> DataFrame:
    """spans(by, id, start, end) with container_id, container_start and container_end: the narrowest of containers(by, id, start, end) that holds a span and is not equal to it.

    Ends are exclusive. Of equally narrow containers the first start counts, then the smallest id. Spans without a container have nulls, and so have
    those with a null bound. A span's id is its own within `by`. Both tables may be the same.
    """
    boxes = containers.select(F.col(by), F.col("id").alias("container_id"), F.col("start").cast("long").alias("container_start"), F.col("end").cast("long").alias("container_end"))
    boxes = boxes.where("container_start <= container_end").withColumn("level", _level(F.col("container_start"), F.col("container_end")))
    cells = F.sequence(_cell(F.col("container_start"), F.col("level")), _cell(F.col("container_end"), F.col("level")))
    boxes = boxes.withColumn("cell", F.explode(cells))
    levels = sorted(r.level for r in boxes.select("level").distinct().collect())  # 64 at most
    asked = spans.select(F.col(by), F.col("id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    least = _level(F.col("start"), F.col("end"))
    asked = asked.where("start <= end").withColumn("level", F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: x >= least)))
    met = asked.withColumn("cell", _cell(F.col("start"), F.col("level"))).join(boxes, [by, "level", "cell"])
    around = (F.col("container_start") <= F.col("start")) & (F.col("container_end") >= F.col("end"))
    equal = (F.col("container_start") == F.col("start")) & (F.col("container_end") == F.col("end"))
    best = F.min(F.struct((F.col("container_end") - F.col("container_start")).alias("width"), "container_start", "container_id", "container_end")).alias("best")
    found = met.where(around & ~equal).groupBy(by, "id").agg(best)
    return spans.join(found, [by, "id"], "left").select(*spans.columns, "best.container_id", "best.container_start", "best.container_end")


def inside_any(containers: DataFrame, spans: DataFrame, by: str = "file_path") -> DataFrame:
    """The spans that lie in some container other than their equal."""
    return narrowest(containers, spans, by).where("container_id IS NOT NULL").select(*spans.columns)

"""The one order of all rankings: score, rounded to 12 places, from the highest; then the smaller id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.sources.tables import workspace

PLACES = 12


def score_order(score: str) -> Column:
    return F.bround(F.col(score), PLACES).desc()


def ranked(rows: DataFrame, score: str, *ties: str, by: tuple[str, ...] = ("query_id",), k: int | None = None) -> DataFrame:
    """rows with a rank from 1 within `by`; with k, only the first k (Spark then keeps k rows a task before the shuffle)."""
    if k is None:
        return _all_ranked(rows, [score_order(score), *ties], by)
    if k <= 0:
        raise ValueError("k must be positive")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(score_order(score), *ties))).where(F.col("rank") <= k)


def _all_ranked(rows: DataFrame, order: list, by: tuple[str, ...]) -> DataFrame:
    """Complete rankings, of which one may be longer than a task should sort.

    Rows are dealt by ranges of the order and written, so that their parts stay as they are; a row's rank is
    its place in its part and the number of rows of its ranking in the parts before.
    """
    dealt = rows.repartitionByRange(*by, *order).withColumn("rank_part", F.spark_partition_id())
    path = f"{workspace(rows.sparkSession)}/ranking"
    dealt.write.parquet(path)
    held = rows.sparkSession.read.schema(dealt.schema).parquet(path)
    sizes = held.groupBy(*by, "rank_part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("rank_part").rowsBetween(Window.unboundedPreceding, -1))
    keys = [*by, "rank_part"]
    starts = sizes.select(*(F.col(c).alias(f"of_{c}") for c in keys), F.coalesce(before, F.lit(0)).alias("rank_start"))
    placed = held.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in keys]
    met = placed.join(starts, same).withColumn("rank", (F.col("rank") + F.col("rank_start")).cast("int"))
    return met.drop("rank_part", "rank_start", *(f"of_{c}" for c in keys))


def numbered(rows: DataFrame, order: list[Column], name: str = "ord") -> DataFrame:
    """rows with their place from 1 in a total order over all of them: places in range parts, after the sizes of the parts before. No task sees all rows."""
    dealt = rows.repartitionByRange(*order).withColumn("ord_part", F.spark_partition_id())
    path = f"{workspace(rows.sparkSession)}/numbered"
    dealt.write.parquet(path)
    held = rows.sparkSession.read.schema(dealt.schema).parquet(path)
    sizes = held.groupBy("ord_part").agg(F.count("*").alias("n"))
    before = sizes.select("ord_part", (F.sum("n").over(Window.orderBy("ord_part")) - F.col("n")).alias("ord_before"))  # a row for each part
    own = F.row_number().over(Window.partitionBy("ord_part").orderBy(*order))
    return held.join(F.broadcast(before), "ord_part").withColumn(name, F.col("ord_before") + own).drop("ord_part", "ord_before")

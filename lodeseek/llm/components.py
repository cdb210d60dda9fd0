"""Connected components of an edge table, as a Spark loop of joins and minimum aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import written


#: Nodes with over a HEAVY-th of all edges, HEAVY at most of them, and over LEAST edges: their minima are broadcast.
HEAVY, LEAST = 4096, 4096


def _with_low(rows: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """rows(u, ...) with m of low(u, m, n). A node with very many edges would be one task's work in a join by node."""
    most = max(LEAST, total // HEAVY)
    few, heavy = low.where(F.col("n") <= most), low.where(F.col("n") > most).select("u", F.col("m").alias("of_heavy"))
    marked = rows.join(F.broadcast(heavy), "u", "left")  # HEAVY rows at most
    met = marked.where("of_heavy IS NULL").drop("of_heavy").join(few.select("u", "m"), "u")
    return met.unionByName(marked.where("of_heavy IS NOT NULL").withColumnRenamed("of_heavy", "m"))


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node reachable.

    Large-star and small-star rounds: each round hangs every neighbour of a node under the smallest node
    that either of them knows, so the number of rounds grows with the logarithm of the longest path; more than `limit`
    would need a path of 2**limit nodes. A round is a partial minimum and a join on the node, with the hubs apart. Edges
    stay distributed; only their count and a checksum reach the driver. Null ends and loops are ignored.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    count = F.count("*").alias("n")
    total, mark = e.count(), None
    for _ in range(limit):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m"), count).select("u", F.least("u", "m").alias("m"), "n"), "low")
        large = _with_low(both, low, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large.where("u <> v"), "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m"), count), "low")
        small = _with_low(large, low, total).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        e = written(small.select("x.u", "x.v").where("u <> v").distinct(), "small")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first())
        if now == mark:
            break
        mark, total = now, now[0]
    else:
        raise RuntimeError(f"components: no end after {limit} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

"""Snapshots as trees of digests, compared from the root down.

A file's digest is made of its chunks, a folder's of the names and digests of what is in it, by way of buckets, so that no folder is
gathered whole. Nodes are stored by depth. Two trees are read level by level, and only below folders that differ.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.plans.snapshots import Incompatible
from lodeseek.sources.tables import written

NODE = "path string, parent string, is_file boolean, digest string, n_files long, depth int"


class Stale(Incompatible):
    """A stored snapshot is not the one that was asked for."""


def _folded(rows: DataFrame, keys: list[str], item: Column, *more: Column) -> DataFrame:
    """rows by keys with the digest of their sorted items."""
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(item)), "\n"), 256).alias("digest"), *more)


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def nodes(chunks: DataFrame, path: str) -> DataFrame:
    """The tree of one snapshot's chunks(file_path, chunk_id, content_hash), written to path: every file and folder, the root being "". One round for each depth."""
    spark = chunks.sparkSession
    files = _folded(chunks, ["file_path"], F.concat_ws(" ", "chunk_id", "content_hash")).withColumnRenamed("file_path", "path")
    level = written(files.select("path", F.lit(True).alias("is_file"), "digest", F.lit(1).cast("long").alias("n_files"), F.size(F.split("path", "/")).alias("depth")))
    deepest = level.agg(F.max("depth")).first()[0] or 0
    files, above = level, None
    for depth in range(deepest, -1, -1):
        here = files.where(F.col("depth") == depth)
        here = here if above is None else here.unionByName(above)
        here = written(here.select("path", _parent(F.col("path")).alias("parent"), "is_file", "digest", "n_files", "depth"))
        here.write.mode("overwrite").parquet(f"{path}/depth={depth}")
        item = F.concat_ws(" ", F.col("path"), F.when(F.col("is_file"), "file").otherwise("folder"), F.col("digest"))
        buckets = _folded(here.withColumn("bucket", F.substring(F.md5("path"), 1, 3)), ["parent", "bucket"], item, F.sum("n_files").alias("n_files"))
        above = _folded(buckets, ["parent"], F.concat_ws(" ", "bucket", "digest"), F.sum("n_files").alias("n_files"))
        above = above.select(F.col("parent").alias("path"), F.lit(False).alias("is_file"), "digest", "n_files", F.lit(depth - 1).alias("depth"))
    return load(spark, path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODE).parquet(path)


def root(tree: DataFrame) -> str | None:
    found = tree.where("depth = 0").select("digest").first()
    return found and found.digest


def check_root(tree: DataFrame, digest: str) -> None:
    """Raise if the tree is not the snapshot with this root digest."""
    if root(tree) != digest:
        raise Stale(f"the stored snapshot is {root(tree)}, not {digest}")


@dataclass
class Difference:
    """files(path, change) and how many nodes of both trees were compared for them."""

    files: DataFrame
    n_compared: int


def compare(first: DataFrame, second: DataFrame) -> Difference:
    """The files that were added, removed or changed from the first tree to the second. A level is read below differing folders alone."""
    spark, depth, n, found = first.sparkSession, 0, 0, []
    asked: DataFrame | None = None
    while True:
        sides = []
        for tree, name in ((first, "a"), (second, "b")):
            rows = tree.where(F.col("depth") == depth)
            rows = rows if asked is None else rows.join(asked, "parent", "left_semi")
            sides.append(rows.select("path", "is_file", F.col("digest").alias(name)))
        met = written(sides[0].join(sides[1], ["path", "is_file"], "full"))
        n += met.count()
        other = met.where(~F.col("a").eqNullSafe(F.col("b")))
        change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
        found.append(other.where("is_file").select("path", change.alias("change")))
        asked = other.where("NOT is_file").select(F.col("path").alias("parent"))
        if asked.isEmpty():
            break
        depth += 1
    files = spark.createDataFrame([], "path string, change string")
    for rows in found:
        files = files.unionByName(rows)
    return Difference(files, n)

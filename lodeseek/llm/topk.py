"""Exact top-k search with multi-resolution segment statistics.

A vector is cut into segments; means and deviations of two vectors' segments bound their distance from
below: |q - x|^2 >= sum of length * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2), and so their inner product
from above. Levels go from few long segments to pairs of components, and on to levels where a part of the segments is
down to one component each, whose mean says all. A candidate whose bound at one level is under the query's
k-th best score so far is out; only the rest go on to the next level, and what survives the last gets its exact score.
At each level the candidates with a query's highest bounds are scored first, so that the k-th best score is a good one
before others are judged by it. Vectors are integers, so scores are exact.

`Search.columns` counts what is multiplied. It stays under the dense product where neighbouring components are alike or
vectors lie in clusters. Between random vectors segment means say little until pairs, and it is more than the dense product.

Queries come in blocks of bounded size, one job for each. A task holds one block and streams its part of the
candidates; k rows for each query and task are written, and all meet in the end.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.llm.common import group_bounds, shared_dir, written

K = 5
SCALE = 256
SCORES = "query_id long, vec_id long, score long"
#: Queries that are broadcast at once.
BLOCK = 4096
#: Candidates, and queries of a block, that are compared at once.
STEP, ROWS = 2048, 512


def levels(dimension: int) -> list[np.ndarray]:
    """Segment borders from coarse to fine: 4, 8, 16, ... segments of two components or more, pairs, and pairs of which a quarter, half and three quarters are split."""
    out, n = [], 4
    while 2 * n < dimension:
        out.append(np.linspace(0, dimension, n + 1).astype(int))
        n *= 2
    for part in range(4):
        single = dimension * part // 4
        out.append(np.unique([*range(single + 1), *range(single, dimension, 2), dimension]))
    return out


def statistics(x: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Rows of sqrt(length) * mean and sqrt(length) * deviation, segment by segment."""
    n = np.diff(borders)
    total = np.add.reduceat(x, borders[:-1], axis=1)
    square = np.add.reduceat(x * x, borders[:-1], axis=1)
    mean = total / n
    dev = np.sqrt(np.maximum(square / n - mean * mean, 0))
    return np.concatenate((mean, dev), axis=1) * np.sqrt(np.tile(n, 2))


class Search:
    """The best k scores, each of another vec_id, of each query of a block over the candidates that came by."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.levels = levels(queries.shape[1])
        self.stats = [statistics(queries, b) for b in self.levels]
        self.norm = np.einsum("ij,ij->i", queries, queries)
        self.least = np.full(len(ids), -np.inf)
        self.score = np.zeros((len(ids), 0))
        self.name = np.zeros((len(ids), 0), np.int64)
        #: Pairs that came by, pairs that got an exact score, and columns multiplied for bounds and scores.
        self.compared = self.survived = self.columns = 0

    def add(self, names: np.ndarray, x: np.ndarray) -> None:
        """Bring candidates; a query's own row is no candidate of it."""
        norm = np.einsum("ij,ij->i", x, x)
        own = [statistics(x, b) for b in self.levels]
        exact = np.concatenate([self._scores(slice(a, a + ROWS), names, x, own, norm) for a in range(0, len(self.ids), ROWS)])
        self._keep(exact, names)

    def _scores(self, part: slice, names: np.ndarray, x: np.ndarray, own: list[np.ndarray], norm: np.ndarray) -> np.ndarray:
        """Scores of the candidates that may be among the best k of a part of the queries; -inf for all others."""
        slack = 1e-9 * (1 + norm + self.norm.max(initial=0))
        queries, stats = self.queries[part], [s[part] for s in self.stats]
        other = self.ids[part, None] != names[None, :]
        exact = np.full(other.shape, -np.inf)
        self.compared += other.size
        high = np.where(other, stats[0] @ own[0].T + slack, -np.inf)
        self.columns += high.size * stats[0].shape[1]
        most = min(len(names), 2 * self.k)
        row = np.repeat(np.arange(len(high)), most)
        col = np.argpartition(high, len(names) - most, axis=1)[:, len(names) - most :].ravel()
        fine = other[row, col] & (high[row, col] >= self.least[part][row])
        row, col = row[fine], col[fine]
        exact[row, col] = self._products(queries, x, row, col)
        self.survived += len(row)
        least = np.maximum(self.least[part], self._kth(exact, names, row, col))
        other[row, col] = False
        q, c = np.nonzero(other & (high >= least[:, None]))
        for s, o in zip(stats[1:], own[1:]):
            bound = self._products(s, o, q, c) + slack[c]
            first = self._highest(q, bound, most)
            exact[q[first], c[first]] = self._products(queries, x, q[first], c[first])
            self.survived += len(first)
            row, col = np.append(row, q[first]), np.append(col, c[first])
            least = np.maximum(least, self._kth(exact, names, row, col))
            keep = bound >= least[q]
            keep[first] = False
            q, c = q[keep], c[keep]
        self.survived += len(q)
        exact[q, c] = self._products(queries, x, q, c)
        return exact

    @staticmethod
    def _highest(q: np.ndarray, bound: np.ndarray, most: int) -> np.ndarray:
        """Where the `most` highest bounds of each query are; q ascends."""
        starts = group_bounds(q)
        found = [np.zeros(0, np.int64)]
        for a, b in zip(starts[:-1], starts[1:]):
            n = min(most, b - a)
            found.append(a + np.argpartition(bound[a:b], b - a - n)[b - a - n :])
        return np.concatenate(found)

    def _kth(self, exact: np.ndarray, names: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """The k-th best of the given scores, each name once; -inf where there are fewer names."""
        if not len(row):
            return np.full(len(exact), -np.inf)
        order = np.lexsort((-exact[row, col], names[col], row))
        row, col = row[order], col[order]
        new = np.append(True, (row[1:] != row[:-1]) | (names[col[1:]] != names[col[:-1]]))
        row, score = row[new], exact[row[new], col[new]]
        order = np.lexsort((-score, row))
        row, score = row[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        out = np.full(len(exact), -np.inf)
        at = place == self.k - 1
        out[row[at]] = score[at]
        return out

    def _products(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Inner products of rows i of a with rows j of b; where most pairs are asked for, by one matrix product."""
        if len(i) * 8 > len(a) * len(b):
            self.columns += len(a) * len(b) * a.shape[1]
            return (a @ b.T)[i, j]
        self.columns += len(i) * a.shape[1]
        return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", a[i[k : k + 65536]], b[j[k : k + 65536]]) for k in range(0, len(i), 65536))])

    def _merge(self, exact: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One column for each name, with its best score; names kept so far that come again move to their column."""
        order = np.argsort(names, kind="stable")
        starts = group_bounds(names[order])[:-1]
        if len(starts) < len(names):
            exact, names = np.maximum.reduceat(exact[:, order], starts, axis=1), names[order][starts]
        else:
            exact, names = exact[:, order], names[order]
        at = np.minimum(np.searchsorted(names, self.name), len(names) - 1)
        row, col = np.nonzero((names[at] == self.name) & np.isfinite(self.score))
        exact[row, at[row, col]] = np.maximum(exact[row, at[row, col]], self.score[row, col])
        self.score[row, col] = -np.inf
        return exact, names

    def _keep(self, exact: np.ndarray, names: np.ndarray) -> None:
        exact, names = self._merge(exact, names)
        score = np.concatenate((self.score, exact), axis=1)
        name = np.concatenate((self.name, np.broadcast_to(names, exact.shape)), axis=1)
        if score.shape[1] > self.k:
            # all candidates that reach the k-th score, so that ties are told apart by id
            kth = np.partition(score, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k]
            top_s = np.full((len(score), self.k), -np.inf)
            top_n = np.zeros((len(score), self.k), np.int64)
            row, col = np.nonzero((score >= kth[:, None]) & np.isfinite(score))
            s, n = score[row, col], name[row, col]
            order = np.lexsort((n, -s, row))
            row, s, n = row[order], s[order], n[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            best = place < self.k
            top_s[row[best], place[best]], top_n[row[best], place[best]] = s[best], n[best]
            score, name = top_s, top_n
        self.score, self.name = score, name
        if score.shape[1] >= self.k:
            self.least = score.min(axis=1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, col = np.nonzero(np.isfinite(self.score))
        return self.ids[row], self.name[row, col], self.score[row, col].astype(np.int64)


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id long, v array<double>): floor(scale * x) of the vectors that are whole and finite."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(scale * e).cast("double")).alias("v"))


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query holds, its k highest inner products among the other rows.

    Ties go to the smaller vec_id. Vectors that are null or empty, or hold a null or non-finite component, take no
    part, nor do rows without vec_id. Vectors of another length than a query's are not compared with it.
    Rows that repeat a vec_id are one candidate with the highest of their scores, and no candidate of
    their own id; as queries each different vector is searched, and the best scores of the id count. Vectors may be of any length.
    """
    rows = written(scaled(vectors, scale), "vectors")
    asked = written(rows.where(is_query).select("vec_id", "v", F.size("v").alias("n")).distinct(), "queries")
    sizes = asked.groupBy("n").agg(F.count("*").alias("many")).collect()  # one row for each length of vector
    spark = vectors.sparkSession
    at = f"{shared_dir(spark)}/best-{uuid.uuid4().hex[:12]}"
    spark.createDataFrame([], SCORES).write.parquet(at)
    for size in sizes:
        candidates = rows.where(F.size("v") == size.n)
        candidates = candidates if len(sizes) == 1 else written(candidates, "candidates")
        blocks = -(-size.many // block)
        dealt = asked.where(F.col("n") == size.n).withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)))
        for b in range(blocks):
            part = dealt.where(F.col("block") == b).select("vec_id", "v").toArrow()  # about `block` rows
            if part.num_rows:
                _searched(candidates, part, k).write.mode("append").parquet(at)
    best = spark.read.schema(SCORES).parquet(at).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _searched(candidates: DataFrame, queries: pa.Table, k: int) -> DataFrame:
    """(query_id, vec_id, score): for one block of queries the best k of each task's candidates."""
    shared = candidates.sparkSession.sparkContext.broadcast((queries["vec_id"].to_numpy(), _matrix(queries["v"].combine_chunks())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Search(*shared.value, k)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                own = batch.slice(at, STEP)
                one.add(own.column("vec_id").to_numpy(), _matrix(own.column("v")))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in one.rows()], names=["query_id", "vec_id", "score"])

    return candidates.mapInArrow(run, SCORES)

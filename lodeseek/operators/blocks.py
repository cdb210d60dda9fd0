"""First k chunks by BM25 over documents in slices, most of which a short query never scores.

A task deals the documents it reads, by like length, into slices of about SLICE documents, so nothing is shuffled for them. A
slice is one row: its documents, and a block for each of its terms, the head of which is the number of postings, the greatest
term frequency and the least document length. With a query's weights these bound the score of every document in the slice
from above, for any k1 and b, and they are columns of their own, so that Spark reads them without the documents. The slices
of greatest bound are scored first; the k-th score found there rules out every slice whose bound is below it. What is left is
scanned where it is read (see scan.py), which passes on each query's first k.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodeseek.functions.ranking import ranked
from lodeseek.operators import lexical, scan
from lodeseek.operators.lexical import B, K1, LexicalIndex
from lodeseek.sources.tables import batches_of, written

SLICE = 64
#: Slices that are scored first, besides those that 2 * k documents fill.
FIRST = 4
#: Room for sums of doubles that come in another order.
ROOM = 1e-9
HEADER = ["term", "slice", "n", "max_tf", "min_dl"]
_DOCUMENT = ["chunk_id", "dl", "terms", "tf"]
#: Postings whose heads are made at once, or those of one slice.
_AT_ONCE = 1 << 18
#: Documents that pass to Python at once.
_BATCH = 2048
#: Slices are long rows, and Spark decodes a whole row group of them at once. So row groups are small, and their bytes are counted every few rows.
_ROW_GROUPS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 8}


def _portions(lengths: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices from one number to before another, with at most _AT_ONCE postings or a slice alone; `lengths` are the postings of each document, `starts` where slices begin."""
    before = np.append(0, lengths.cumsum())[np.append(starts, len(lengths))]
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(before, before[i] + _AT_ONCE, "right")) - 1)
        yield i, j
        i = j


def _heads(documents: pa.Table, starts: np.ndarray) -> dict[str, pa.Array]:
    """terms, n, max_tf and min_dl of slices that begin at `starts` of documents(dl, terms, tf), each in order of its terms."""
    term = pc.list_flatten(pc.split_pattern(documents.column("terms").combine_chunks(), " ")).dictionary_encode()
    names, tf = term.dictionary, documents.column("tf").combine_chunks()
    order = pc.array_sort_indices(names).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    doc = np.repeat(np.arange(documents.num_rows), pc.list_value_length(tf).to_numpy(zero_copy_only=False))
    own = np.searchsorted(starts, doc, "right") - 1
    cell, width = own * max(1, len(order)) + place[term.indices.to_numpy()], max(1, len(order))
    by = np.argsort(cell, kind="stable")
    cell = cell[by]
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
    of, token = np.divmod(cell[first], width)
    at = np.searchsorted(of, np.arange(len(starts) + 1)).astype(np.int32)
    over = lambda f, x: f.reduceat(x[by], first) if len(cell) else np.zeros(0)
    listed = lambda x: pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32)))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at), names.take(pa.array(order[token]))), " ")
    return {
        "terms": pc.if_else(pa.array(np.diff(at) > 0), joined, pa.scalar(None, pa.string())),
        "n": listed(np.diff(np.append(first, len(cell)))),
        "max_tf": listed(over(np.maximum, pc.list_flatten(tf).to_numpy(zero_copy_only=False))),
        "min_dl": listed(over(np.minimum, documents.column("dl").to_numpy()[doc])),
    }


def _dealt(size: int):
    """The documents of a task in slices: those of like length, and at last what is left of each length in order of length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, left = TaskContext.get().partitionId() << 32, None

        def slices(documents: pa.Table, order: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal made
            starts = np.arange(0, len(order), size)
            for i, j in _portions(pc.list_value_length(documents.column("tf")).to_numpy()[order], starts):
                own = documents.take(pa.array(order[i * size : j * size]))
                parts = pa.StructArray.from_arrays([own.column(c).combine_chunks() for c in _DOCUMENT], _DOCUMENT)
                postings = pa.ListArray.from_arrays(pa.array(np.append(starts[: j - i], own.num_rows).astype(np.int32)), parts)
                yield pa.RecordBatch.from_pydict({"slice": pa.array(made + np.arange(j - i)), **_heads(own, starts[: j - i]), "postings": postings})
                made += j - i

        def full_ones(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            """The slices that documents of like length fill; returns what is left."""
            length = np.floor(4 * np.log2(rows.column("dl").to_numpy() + 1)).astype(int)
            order = np.argsort(length, kind="stable")
            length = length[order]
            # Of the rows of one length, as many as fill slices.
            start = np.searchsorted(length, length)
            full = np.arange(len(length)) - start < (np.searchsorted(length, length, "right") - start) // size * size
            yield from slices(rows, order[full])
            return rows.take(pa.array(order[~full]))

        for batch in batches:
            rows = [pa.Table.from_batches([batch])]
            left = yield from full_ones(pa.concat_tables(rows if left is None else [left, *rows]).combine_chunks())
        if left is not None:
            yield from slices(left, np.arange(left.num_rows))

    return run


def build(spark: SparkSession, path: str, size: int = SLICE) -> BlockIndex:
    """Slices of the stored lexical index at path, beside it. They are made where the documents are read, about `size` to a slice, so a term of any frequency is cut by slices and nothing is shuffled."""
    documents = lexical.load(spark, path).documents.select(*_DOCUMENT)
    schema = f"slice long, terms string, n array<int>, max_tf array<int>, min_dl array<int>, postings array<struct<chunk_id: {dict(documents.dtypes)['chunk_id']}, dl: int, terms: string, tf: array<int>>>"
    with batches_of(spark, _BATCH):
        documents.mapInArrow(_dealt(size), schema).write.mode("overwrite").options(**_ROW_GROUPS).parquet(f"{path}/blocks")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> BlockIndex:
    return BlockIndex(spark.read.parquet(f"{path}/blocks"), lexical.load(spark, path))


def differences(index: BlockIndex) -> DataFrame:
    """One row: n_terms, n_postings and n_blocks, and how many blocks have a head that their documents do not give."""

    def others(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """How many heads of the slices differ that begin at `starts`."""
        ends = np.append(starts, rows.num_rows)
        for i, j in _portions(pc.list_value_length(rows.column("tf")).to_numpy(), starts):
            part, count = rows.slice(starts[i], ends[j] - starts[i]).combine_chunks(), 0
            heads, stored = _heads(part, starts[i:j] - starts[i]), part.take(pa.array(starts[i:j] - starts[i])).combine_chunks()
            stored = {c: stored.column(f"own_{c}").combine_chunks() for c in heads}
            for k in () if all(heads[c].equals(stored[c]) for c in heads) else range(j - i):
                a, b = ({t: x for t, *x in zip((h["terms"][k].as_py() or "").split(), *(h[c][k].as_py() or () for c in HEADER[2:]))} for h in (heads, stored))
                count += sum(a.get(t) != b.get(t) for t in a.keys() | b.keys())
            yield pa.RecordBatch.from_pydict({"other": pa.array([count], pa.int64())})

    def whole_ones(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """others() of all slices but the last, which may go on; returns a copy of that one, so that the batch is not held."""
        starts = np.flatnonzero(rows.column("at").to_numpy() == 0)
        last = max(starts, default=0)
        yield from others(rows.slice(0, last), starts[:-1])
        return rows.take(pa.array(np.arange(last, rows.num_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            rows = [pa.Table.from_batches([batch])]
            left = yield from whole_ones(pa.concat_tables(rows if left is None else [left, *rows]))
        if left is not None and left.num_rows:
            yield from others(left, np.zeros(1, int))

    first = [F.when(F.col("at") == 0, F.col(c)).alias(f"own_{c}") for c in ("terms", *HEADER[2:])]
    documents = index.slices.select("terms", *HEADER[2:], F.posexplode("postings").alias("at", "x")).select("at", *first, "x.dl", "x.terms", "x.tf")
    with batches_of(documents.sparkSession, _BATCH):
        found = written(documents.mapInArrow(run, "other long").agg(F.coalesce(F.sum("other"), F.lit(0)).alias("n_other_headers")))
    by_term = index.heads.groupBy("term").agg(F.count("*").alias("blocks"), F.sum("n").alias("n"))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counts = by_term.agg(F.count("*").alias("n_terms"), count("n").alias("n_postings"), count("blocks").alias("n_blocks"))
    return counts.crossJoin(F.broadcast(found))  # one row each


class _Open(lexical.Weights):
    """Scores of documents(dl, terms, tf, open) for the queries that their slice is open to."""

    reads = (*lexical.Weights.reads, "open")

    def scores(self, rows: pa.RecordBatch) -> np.ndarray:
        found = super().scores(rows)
        column = pc.index_in(pc.list_flatten(rows.column("open")), value_set=self.queries).fill_null(-1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows.column("open")).to_numpy(zero_copy_only=False))
        is_open = np.zeros(found.shape, bool)
        is_open[row[column >= 0], column[column >= 0]] = True
        return np.where(is_open, found, -np.inf)


#: Wanted terms that go to every task, about 100 MB in memory; more are joined as Spark chooses.
WANTED = 1 << 20


def _met_where_read(wanted: DataFrame) -> DataFrame:
    """The wanted terms, written once. Few of them go to the blocks, so that blocks are not shuffled to meet them."""
    wanted = written(wanted)
    return F.broadcast(wanted) if wanted.count() <= WANTED else wanted


@dataclass
class BlockIndex:
    """slices(slice, terms, n, max_tf, min_dl: the heads of the slice's blocks, postings: its documents) of a lexical index."""

    slices: DataFrame
    index: LexicalIndex

    @property
    def blocks(self) -> DataFrame:
        return self.slices

    @property
    def heads(self) -> DataFrame:
        """(term, slice, n, max_tf, min_dl): one row for each block."""
        return self.slices.selectExpr("slice", "inline(arrays_zip(split(terms, ' '), n, max_tf, min_dl)) AS (term, n, max_tf, min_dl)").select(*HEADER)

    def bounds(self, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
        """(query_id, slice, bound, n_blocks, n_postings): no document of the slice has a higher score. Reads heads alone."""
        wanted = _met_where_read(lexical.query_terms(queries).join(self.index.terms, "term"))
        met = self.heads.join(wanted, "term").crossJoin(F.broadcast(self.index.stats.select("avg_length")))  # one row
        tf, dl = F.col("max_tf"), F.col("min_dl")
        part = F.col("qtf") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avg_length")))
        return met.groupBy("query_id", "slice").agg((F.sum(part) * (1 + ROOM) + ROOM).alias("bound"), F.count("*").alias("n_blocks"), F.sum("n").alias("n_postings"))

    def scanned(self, queries: DataFrame, slices: DataFrame, k1: float = K1, b: float = B) -> scan.Scan:
        """The scan of the documents in slices(query_id, slice), each for the queries that name its slice."""
        own = written(slices.groupBy("slice").agg(F.collect_set("query_id").alias("open")))
        rows = self.slices.select("slice", "postings").join(own, "slice").select("open", F.inline("postings"))
        return scan.Scan(rows, self.index.weights(queries, k1, b, _Open), dict(queries.dtypes)["query_id"])

    def scores(self, queries: DataFrame, slices: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
        """(query_id, chunk_id, score) of all chunks in slices(query_id, slice) that hold a term of the query."""
        return self.scanned(queries, slices, k1, b).every()

    def search(self, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, watch: Observation | None = None) -> DataFrame:
        """(query_id, rank, chunk_id, score): what the lexical index's own search gives, rank by rank.

        watch counts, as slices are judged, all slices, blocks and postings of the queries' terms and those that were
        scored: n_slices, n_blocks, n_postings, scored_slices, scored_blocks, scored_postings.
        """
        lexical.check_parameters(k1, b)
        lexical.check_queries(queries)
        if k <= 0:
            raise ValueError("k must be positive")
        bounds = written(self.bounds(queries, k1, b))
        first = written(ranked(bounds, "bound", "slice", k=FIRST + -(-2 * k // SLICE)).select("query_id", "slice", F.lit(True).alias("is_first")))
        known = written(self.scanned(queries, first, k1, b).heads(k))
        least = ranked(known, "score", "chunk_id", k=k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("found"))
        judged = bounds.join(first, ["query_id", "slice"], "left").join(least, "query_id", "left")
        judged = judged.withColumn("is_open", F.coalesce((F.col("found") < k) | (F.col("bound") >= F.col("least")), F.lit(True)))
        if watch is not None:
            scored = F.coalesce("is_first", "is_open")
            counts = [(c, F.col(f"n_{c}")) for c in ("blocks", "postings")] + [("slices", F.lit(1))]
            judged = written(judged.observe(watch, *(F.sum(x).alias(f"n_{c}") for c, x in counts), *(F.sum(F.when(scored, x).otherwise(0)).alias(f"scored_{c}") for c, x in counts)))
        rest = self.scanned(queries, judged.where("is_first IS NULL AND is_open"), k1, b).heads(k)
        return ranked(known.unionByName(rest), "score", "chunk_id", k=k).select("query_id", "rank", "chunk_id", "score")

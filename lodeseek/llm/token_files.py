"""Token-ID output: shards of token ids as wavelet matrices in Parquet, read back by position, count or occurrence.

One row of the table is one shard: `part` and `shard` order the shards; `doc_ids` and `starts` give the
documents and where each begins in the shard; `symbols` lists the ids that occur, ascending; `planes` are
the bit planes, highest first and eight bits a byte from the low end, of each token's place in `symbols`. Rank
directories follow from the planes and are made on loading. Shards follow ascending doc_id.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseek.llm.common import shared_dir, text_column
from lodeseek.llm.succinct import BitVector, WaveletMatrix
from lodeseek.llm.tokens import byte_bpe

END_ID = 2
#: A shard ends with the document that brings it to so many ids.
SHARD_IDS = 1 << 18


class Shard:
    """One row of the table, loaded: access, counting and occurrence lookup by token id."""

    def __init__(self, row: dict):
        self.symbols = np.asarray(row["symbols"], np.int64)
        self.size = int(row["n_ids"])
        self.starts = np.asarray(row["starts"], np.int64)
        self.doc_ids = row["doc_ids"]
        self.matrix = WaveletMatrix([BitVector(packed=np.frombuffer(p, np.uint8), size=self.size) for p in row["planes"]], self.size)

    def ids(self) -> np.ndarray:
        return self.symbols[self.matrix.decode()].astype(np.uint32)

    def access(self, positions: np.ndarray) -> np.ndarray:
        return self.symbols[self.matrix.access(np.asarray(positions, np.int64))]

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        at = int(np.searchsorted(self.symbols, token))
        if at == len(self.symbols) or self.symbols[at] != token:
            return 0
        ends = np.array([start, self.size if end is None else end], np.int64)
        a, b = self.matrix.rank(np.full(2, at), ends)
        return int(b - a)

    def occurrences(self, token: int) -> np.ndarray:
        if not (n := self.count(token)):
            return np.zeros(0, np.int64)
        return self.matrix.select(int(np.searchsorted(self.symbols, token)), np.arange(n))


SCHEMA = "part int, shard int, n_ids long, doc_ids array<long>, starts array<long>, symbols array<int>, planes array<binary>"


def _shard(part: int, shard: int, doc_ids: list, arrays: list[np.ndarray]) -> dict:
    ids = np.concatenate(arrays)
    present = np.zeros(int(ids.max()) + 1, bool)
    present[ids] = True
    symbols = np.flatnonzero(present)
    place = np.cumsum(present, dtype=np.int64) - 1
    width = max(1, int(len(symbols) - 1).bit_length())
    matrix = WaveletMatrix.of(place[ids].astype(np.uint16 if width <= 16 else np.uint32), width)
    starts = np.cumsum([0] + [len(a) for a in arrays[:-1]])
    return {"part": part, "shard": shard, "n_ids": len(ids), "doc_ids": doc_ids, "starts": starts, "symbols": symbols.astype(np.int32), "planes": [p.packed() for p in matrix.planes]}


_ARROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("symbols", pa.list_(pa.int32())), ("planes", pa.list_(pa.binary()))])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of docs(doc_id long, text, ...), end_id after each document, in ascending doc_id order.

    Null and empty texts hold the end id alone. Rows that repeat a doc_id follow each other; a null doc_id
    comes first. Extra columns are not read. An empty table writes a table without shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, size = TaskContext.get().partitionId(), 0, 0
        names: list = []
        arrays: list[np.ndarray] = []
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                names.append(doc_id)
                arrays.append(np.append(bpe.encode(text or ""), np.uint32(end_id)))
                size += len(arrays[-1])
                if size >= shard_ids:
                    yield pa.RecordBatch.from_pylist([_shard(part, shard, names, arrays)], schema=_ARROW)
                    names, arrays, size, shard = [], [], 0, shard + 1
        if names:
            yield pa.RecordBatch.from_pylist([_shard(part, shard, names, arrays)], schema=_ARROW)

    rows = text_column(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows.mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)


def shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def shard_starts(table: DataFrame) -> DataFrame:
    """(part, shard, base): ids before each shard. Parts are added up first, so one task sees a row for each part only."""
    by_part = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = by_part.select("part", before.alias("first"))
    return table.select("part", "shard", own.alias("own")).join(first, "part").select("part", "shard", (F.col("first") + F.col("own")).alias("base"))


def documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files; start counts the ids before it."""
    schema = "part int, shard int, doc_id long, own long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                one = Shard(row)
                ids, ends = one.ids(), np.append(one.starts[1:], one.size)
                own = [ids[a:b] for a, b in zip(one.starts, ends)]
                n = len(own)
                cols = {"part": pa.array(np.full(n, row["part"], np.int32)), "shard": pa.array(np.full(n, row["shard"], np.int32)), "doc_id": pa.array(one.doc_ids, pa.int64()), "own": pa.array(one.starts), "n_tokens": pa.array(ends - one.starts), "ids_crc32": pa.array([zlib.crc32(a.astype("<u4").tobytes()) for a in own], pa.int64())}
                if with_ids:
                    cols["ids"] = pa.array([a.astype(np.int32) for a in own], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

    table = shards(spark, path)
    rows = table.mapInArrow(run, schema)
    found = rows.join(shard_starts(table.select("part", "shard", "n_ids")), ["part", "shard"])
    return found.select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write docs to files in the shared folder and give documents() of them."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex[:12]}"
    write(docs, path, tokenizer, end_id, shard_ids)
    return documents(spark, path)

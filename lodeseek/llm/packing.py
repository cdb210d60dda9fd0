"""Packing: shortest-pack-first over the length histogram.

Documents become pieces of at most `limit` tokens: full ones, and what is left at the end. Only the
histogram of piece lengths, `limit` numbers at most, reaches the driver. It places lengths longest first,
each into the packs that are shortest so far, and counts packs by pattern, so its work does not grow with
the documents. Patterns come back to the pieces by rank: each length's slots cover its ranks 0, 1, ...
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.llm.common import text_column, written
from lodeseek.llm.tokens import byte_bpe

LIMIT = 2048
END_ID = 1


def shortest_pack_first(counts: dict[int, int], limit: int) -> list[tuple[int, list[int]]]:
    """(number of packs, lengths in them) from (length: how many).

    Lengths go longest first; a length goes to the shortest packs that exist while it fits there, and
    opens packs of its own for the rest.
    """
    open_: list[tuple[int, int, int, list[int]]] = []  # by -space: the shortest pack first
    done: list[tuple[int, list[int]]] = []
    order = 0
    for length in sorted(counts, reverse=True):
        left, made = counts[length], []
        while left and open_ and -open_[0][0] >= length:
            space, _, n, pattern = heapq.heappop(open_)
            used = min(left, n)
            left -= used
            made.append((-space - length, used, [*pattern, length]))
            if n > used:
                order += 1
                heapq.heappush(open_, (space, order, n - used, pattern))
            if left and (not open_ or -open_[0][0] < length):  # a pack may take this length again
                for s, m, p in made:
                    order += 1
                    heapq.heappush(open_, (-s, order, m, p))
                made = []
        per_pack = limit // length
        if left and length * 2 <= limit:  # full rows of this length, and one pack for what is over
            for k, m in ((per_pack, left // per_pack), (left % per_pack, 1)):
                if k and m:
                    made.append((limit - k * length, m, [length] * k))
        elif left:
            made.append((limit - length, left, [length]))
        for s, m, p in made:
            if s:
                order += 1
                heapq.heappush(open_, (-s, order, m, p))
            else:
                done.append((m, p))
    return done + [(n, p) for _, _, n, p in sorted(open_)]


def slots(packs: list[tuple[int, list[int]]]) -> tuple[np.ndarray, ...]:
    """(length, first rank, first sequence, offset) of every place in a pattern, by length and rank."""
    rows, taken, sequence = [], Counter(), 0
    for n, pattern in packs:
        at = 0
        for length in pattern:
            rows.append((length, taken[length], sequence, at))
            taken[length] += n
            at += length
        sequence += n
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, part, nth[, ids]): documents cut at multiples of `limit`.

    part and nth say which task made the piece and how many of its length that task had made before.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, bpe = TaskContext.get().partitionId(), Counter(), byte_bpe(tokenizer)
        for batch in batches:
            rows, which, made = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(bpe.encode(text or ""), np.uint32(end_id))
                for at in range(0, len(ids), limit):
                    own = ids[at : at + limit]
                    n = len(own)
                    which.append(i)
                    rows.append((at, n, zlib.crc32(own.astype("<u4").tobytes()), len(ids), part, seen[n]))
                    seen[n] += 1
                    if with_ids:
                        made.append(own.astype(np.int32))
            cols = [batch.column("doc_id").take(pa.array(which, pa.int64()))]
            cols += [pa.array(c, pa.int32() if k == 4 else pa.int64()) for k, c in enumerate(zip(*rows))] if rows else [pa.array([], pa.int32() if k == 4 else pa.int64()) for k in range(6)]
            cols += [pa.array(made, pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"] + ["ids"] * with_ids)

    return text_column(docs.select("doc_id", "text")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all docs(doc_id, text, ...) with their sequence_id and offset there.

    Null and empty texts hold the end id alone. Repeated rows and rows without doc_id are packed like any
    other. A piece lies whole in one sequence; a sequence is gapless from offset 0 and holds at most
    `limit` tokens. with_ids adds the token ids. Extra columns are not read. An empty table gives no rows.
    """
    made = written(pieces(docs, tokenizer, limit, end_id, with_ids), "pieces")
    by_task = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = written(by_task.select("part", "length", "n", before.alias("before")), "offsets")
    counts = {r.length: r.n for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # limit rows at most
    length, first, sequence, offset = slots(shortest_pack_first(counts, limit))
    start = length << 44 | first

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(start, n << 44 | rank, side="right") - 1
            cols = {c: batch.column(c) for c in batch.schema.names if c != "rank"}
            cols |= {"sequence_id": pa.array(sequence[at] + rank - first[at]), "offset": pa.array(offset[at])}
            yield pa.RecordBatch.from_pydict(cols)

    ranked = made.join(offsets.drop("n"), ["part", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    kinds = dict(made.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", sequence_id long, offset long"
    return ranked.select(*keep, "rank").mapInArrow(place, schema)

"""SimHash near-dedup: fingerprints of word shingles, and all pairs within a few bits through vantage-point trees.

A pair within `max_distance` bits is, by the pigeonhole principle, within band = floor(max_distance / pieces)
bits on at least one of `pieces` disjoint bit ranges. There is one vantage-point tree for each range, on half
of the bits and with a band of 1 for the usual 2 bits. The vantage point of a level is compared on that level's share
of the range, and the points around it are cut into shells by their Hamming distance from it. By the triangle
bound |d(x, v) - d(y, v)| <= d(x, y) the shells of a pair differ by no more than its bits in that share, so over all
levels of a tree by no more than the band. A point therefore goes to its own shell and, as long as
the band is not used up, to the next shells inward, which its boundary band overlaps; all other branches are pruned. Two
points of a pair meet where each level has the inner one of their shells. A path through all levels
names a shard. Vantage points come from a fixed seed, so no sample, tree or fingerprint passes through the driver;
the number of levels follows from the number of points, and the copies of a point grow with the levels only.

A shard that holds more than `capacity` fingerprints is not gathered: its rows go back out and descend in
max_distance + 1 new trees with a level for each bit and a band of 0, so a point has one shard in each. Such bits are
not used again, and they run out after a few rounds, which bounds every shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.llm.common import bits_set, group_bounds, per_batch, quoted, shuffle_parts, signed, text_column, texts, written
from lodeseek.llm.components import components

SHINGLE = 3
MAX_DISTANCE = 2
#: Bit ranges, each with a tree.
PIECES = 2
#: Most fingerprints that one shard compares in memory.
CAPACITY = 4096
#: Words of a shingle, bits and bit ranges of a search for near copies by shingle sets.
SET_SHINGLE, SET_DISTANCE, SET_PIECES = 5, 3, 2
#: Documents of one component that are settled among themselves before the others meet them.
HEADS = 64
#: Names for a document's id and text hash beside whatever columns a table has.
KEPT_ID, KEPT_KEY = "__kept_doc_id", "__kept_text_key"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit majority of the XXH64 (seed 42) of all word shingles, repeats included; 0 where there is no word."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    one = xxhash.xxh64_intdigest
    h = np.fromiter((one(x, 42) for x in joined), np.uint64, len(words) - shingle + 1)
    over = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = np.ascontiguousarray(h[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        over += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(over * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp long, *keep) for every row of docs(doc_id, text, *keep). Null text has no words: fingerprint zero."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = np.array([fingerprint(t, shingle) for t in texts(batch)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(signed(fp)), *map(batch.column, keep)], names=["doc_id", "fp", *keep])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"doc_id {kinds['doc_id']}, fp long", *(f"{c} {kinds[c]}" for c in keep)])
    return per_batch(text_column(docs.select("doc_id", "text", *keep)), run, schema)


def _ranges(mask: int, pieces: int) -> list[int]:
    """The set bits of mask dealt to `pieces` masks, in runs."""
    bits = [b for b in range(64) if mask >> b & 1]
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits, int), pieces) if len(part)]


def _vantage(mask: int, level: int) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(f"{mask}/{level}".encode(), 7) & mask)


def paths(fp: np.ndarray, start: np.ndarray, mask: int, band: int, levels: int, inward: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fp, path key, whether it is the point's own shard): the shards that each point visits in one tree.

    A point visits shells up to `band` off its own, all levels together: on both sides, or with `inward` on the inner side alone.
    """
    at, key, used = np.arange(len(fp)), start.copy(), np.zeros(len(fp), np.int64)
    for level, share in enumerate(_ranges(mask, levels)):
        d = bits_set((fp & np.uint64(share)) ^ _vantage(share, level)).astype(np.int64)
        steps = []
        for s in range(-band, 1 if inward else band + 1):
            go = (used + abs(s) <= band) & (d[at] + s >= 0)
            steps.append((at[go], d[at[go]] + s, key[go], used[go] + abs(s)))
        at, shell, key, used = (np.concatenate(x) for x in zip(*steps))
        key = (key ^ shell.astype(np.uint64)) * _MIX
        key ^= key >> np.uint64(29)
    return at, key, used == 0


def levels_for(points: int, bits: int, capacity: int) -> int:
    """The least number of levels, 2 or more, at which the fullest shard of evenly spread points holds `capacity` of them at most."""
    for n in range(2, bits):
        share = round(bits / n)
        fullest = math.comb(share, share // 2) / 2**share
        if points * (1 + n) * fullest**n <= capacity:
            return n
    return bits


def _route(rows: DataFrame, max_distance: int, pieces: int, levels: int | None) -> DataFrame:
    """(key, mask, fp) of all shards, from rows(key, mask, fp): mask holds the bits that have had no level of their own.

    With levels None there is one for each bit, which takes the range from the mask.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, mask, fp = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("key", "mask", "fp"))
        for m in np.unique(mask):
            sel = mask == m
            for j, part in enumerate(_ranges(int(m), pieces)):
                start = (key[sel] + np.uint64(j + 1)) * _MIX
                at, path, _ = paths(fp[sel], start, part, max_distance // pieces, levels or part.bit_count(), inward=True)
                left = np.full(len(at), np.uint64(int(m) if levels else int(m) & ~part & (2**64 - 1)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (signed(path), signed(left), signed(fp[sel][at]))], names=["key", "mask", "fp"])

    return per_batch(rows, run, "key long, mask long, fp long")


def linked(fp: np.ndarray, max_distance: int) -> np.ndarray:
    """For each fingerprint of one shard the smallest one that it is linked with, directly or through others.

    The points stand in order of their distance from one vantage point, so a point is compared only with
    those whose distance from it differs by max_distance at most. Each point is visited once, and leaves
    the shard's open points when it is reached.
    """
    v = fp[0]
    order = np.argsort(bits_set(fp ^ v), kind="stable")
    p = fp[order]
    d = bits_set(p ^ v).astype(np.int64)
    top = np.arange(len(p))
    open_, open_d = np.arange(len(p)), d.copy()
    while len(open_):
        group, todo = [open_[0]], [open_[0]]
        open_, open_d = open_[1:], open_d[1:]
        while todo and len(open_):
            x = todo.pop()
            lo, hi = np.searchsorted(open_d, [d[x] - max_distance, d[x] + max_distance + 1])
            if hit := np.flatnonzero(bits_set(p[open_[lo:hi]] ^ p[x]) <= max_distance).tolist():
                new = open_[lo:hi][hit].tolist()
                group += new
                todo += new
                keep = np.ones(len(open_), bool)
                keep[lo + np.array(hit)] = False
                open_, open_d = open_[keep], open_d[keep]
        top[group] = min(group, key=lambda i: int(p[i]))
    out = np.empty_like(fp)
    out[order] = p[top]
    return out


def _search(rows: DataFrame, max_distance: int, capacity: int) -> DataFrame:
    """(a, b, key, mask) from routed rows: links a-b between fingerprints of a shard, or, with a null, b of a shard over capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "key", "mask"]
        held: list[tuple] = []  # parts of the shard that the last batch did not end
        size, spilling = 0, None

        def rows_of(parts: list[tuple]) -> tuple:
            return tuple(np.concatenate(x) for x in zip(*parts))

        def back(fp: np.ndarray, key: np.uint64, mask: np.uint64) -> pa.RecordBatch:
            n = len(fp)
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(signed(fp)), pa.array(signed(np.full(n, key))), pa.array(signed(np.full(n, mask)))], names=names)

        def links(key: np.ndarray, mask: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            bounds = group_bounds(key, mask)
            a, b = [], []
            for i in np.flatnonzero(np.diff(bounds) > 1).tolist():
                own = np.unique(fp[bounds[i] : bounds[i + 1]])
                if len(own) == 2:
                    if int(bits_set(own[0] ^ own[1])) <= max_distance:
                        a.append(own[:1])
                        b.append(own[1:])
                elif len(own) > 2:
                    low = linked(own, max_distance)
                    far = low != own
                    a.append(low[far])
                    b.append(own[far])
            if a:
                a, b = signed(np.concatenate(a)), signed(np.concatenate(b))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64())], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, mask, fp = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("key", "mask", "fp"))
            starts = group_bounds(key, mask)
            if spilling == (key[0], mask[0]):  # more rows of a shard that is over capacity
                yield back(fp[: starts[1]], key[0], mask[0])
                key, mask, fp = (x[starts[1] :] for x in (key, mask, fp))
                if not len(key):
                    continue
                starts = starts[1:] - starts[1]
            elif held and (held[-1][0][0], held[-1][1][0]) != (key[0], mask[0]):
                yield from links(*rows_of(held))
                held, size = [], 0
            spilling = None
            lengths = np.diff(starts)
            lengths[0] += size
            last = starts[-2]
            ready = list(held)
            held, size = [], 0
            big = {i for i in np.flatnonzero((lengths > capacity) & (mask[starts[:-1]] != 0)).tolist()}
            for i in sorted(big):
                if i == 0:
                    for part in ready:
                        yield back(part[2], key[0], mask[0])
                    ready = []
                yield back(fp[starts[i] : starts[i + 1]], key[starts[i]], mask[starts[i]])
            keep = np.ones(len(key), bool)
            for i in big:
                keep[starts[i] : starts[i + 1]] = False
            if len(lengths) - 1 in big:
                spilling = (key[last], mask[last])
            else:
                tail = tuple(x[last:].copy() for x in (key, mask, fp))
                held, size = (ready if last == 0 else []) + [tail], int(lengths[-1])
                keep[last:] = False
                ready = [] if last == 0 else ready
            ready.append((key[keep], mask[keep], fp[keep]))
            yield from links(*rows_of(ready))
        if held:
            yield from links(*rows_of(held))

    return rows.mapInArrow(run, "a long, b long, key long, mask long")


def near_links(points: DataFrame, max_distance: int = MAX_DISTANCE, pieces: int | None = None, capacity: int = CAPACITY, levels: int | None = None) -> DataFrame:
    """Edges (a, b) that link every two distinct fp of points(fp) within max_distance bits, directly or through others.

    A shard gives one edge for each of its linked points, not all pairs, so the edges grow with the points.
    """
    pieces = pieces or PIECES
    levels = levels or levels_for(points.count(), 64 // pieces, capacity)
    todo = points.select(F.lit(0).cast("long").alias("key"), F.lit(-1).cast("long").alias("mask"), "fp")
    found: list[DataFrame] = []
    for turn in range(64):
        routed = _route(todo, max_distance, max_distance + 1, None) if turn else _route(todo, max_distance, pieces, levels)
        dealt = routed.repartition(shuffle_parts(points), "key").sortWithinPartitions("key", "mask", "fp")
        out = written(_search(dealt, max_distance, capacity), "links")
        found.append(out.where("a IS NOT NULL").select("a", "b"))
        todo = out.where("a IS NULL").select("key", "mask", F.col("b").alias("fp")).distinct()
        if todo.isEmpty():
            break
        todo = written(todo, "overfull")
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def near_dedup(docs: DataFrame, max_distance: int = MAX_DISTANCE, shingle: int = SHINGLE, capacity: int = CAPACITY, pieces: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id, component, *keep) for every row of docs(doc_id, text, ...).

    component_id is the smallest doc_id among the documents whose fingerprints are linked, component their
    smallest fp. Empty and null texts share fingerprint zero and are linked like any others. Repeated rows each keep
    their row. A null doc_id keeps its row and never names a component, unless no other document is in it: then it
    is null. Extra columns are not read, but for those of keep. An empty table gives an empty result.
    """
    rows = written(fingerprints(docs, shingle, keep), "fingerprints")
    points = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "points")
    comp = components(near_links(points.select("fp"), max_distance, pieces, capacity))
    placed = written(points.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("component")), "placed")
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = written(placed.join(least, "component").select("fp", "component", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component", *keep)


def shingle_set(text: bytes, shingle: int = SET_SHINGLE) -> np.ndarray:
    """The different XXH64 values of a text's word shingles, in order; one value for fewer words, none for no word."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) > shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64))


def shingle_sets(docs: DataFrame, shingle: int, keep: tuple[str, ...]) -> DataFrame:
    """(*keep, shingles array<long>) of docs(text, *keep)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [signed(shingle_set(t, shingle)) for t in texts(batch)]
        yield pa.RecordBatch.from_arrays([*map(batch.column, keep), pa.array(sets, pa.list_(pa.int64()))], names=[*keep, "shingles"])

    kinds = dict(docs.dtypes)
    return per_batch(docs.select("text", *keep), run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "shingles array<long>"]))


def leaders(members: DataFrame, max_distance: int, similarity: float) -> DataFrame:
    """(doc_id, text_key) of the members(component, doc_id, text_key, fp, shingles) that no earlier leader is linked with.

    Two are linked if their fingerprints differ by max_distance bits at most and the Jaccard similarity of their sets is
    `similarity` or more (two empty sets: 1). In order of doc_id and text_key, a member without a link to a leader is
    one. A round settles the first HEADS members of each component among themselves and drops what is linked with
    their leaders from the rest, so a large component is never gathered; the rounds follow the component with the most members left.
    """

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "text_key"], kind="stable")
        sets = [np.asarray(x, np.int64) for x in group["shingles"]]
        fp = group["fp"].to_numpy(np.int64)
        kept: list[int] = []
        for i, own in enumerate(sets):
            near = np.flatnonzero(bits_set((fp[kept] ^ fp[i]).view(np.uint64)) <= max_distance)
            for j in near.tolist():
                other = sets[kept[j]]
                both = len(np.intersect1d(own, other, assume_unique=True))
                if both >= similarity * (len(own) + len(other) - both):
                    break
            else:
                kept.append(i)
        return group.iloc[kept]

    first = Window.partitionBy("component").orderBy("doc_id", "text_key")
    found, left = [], members
    while not left.isEmpty():
        heads = left.withColumn("place", F.row_number().over(first)).where(F.col("place") <= HEADS).drop("place")
        heads = written(heads, "heads")
        ahead = written(heads.groupBy("component").applyInPandas(settle, members.schema), "leaders")
        found.append(ahead.select("doc_id", "text_key"))
        last = heads.groupBy("component").agg(F.max(F.struct("doc_id", "text_key")).alias("last"), F.count("*").alias("n")).where(F.col("n") == HEADS).select("component", "last")
        rest = left.join(last, "component").where(F.struct("doc_id", "text_key") > F.col("last")).drop("last").alias("m")
        both = F.size(F.array_intersect("m.shingles", "l.shingles"))
        linked_ = (F.bit_count(F.col("m.fp").bitwiseXOR(F.col("l.fp"))) <= max_distance) & (both >= similarity * (F.size("m.shingles") + F.size("l.shingles") - both))
        left = written(rest.join(ahead.alias("l"), (F.col("m.component") == F.col("l.component")) & linked_, "left_anti"), "rest")
    kept = found[0] if found else members.select("doc_id", "text_key")
    for more in found[1:]:
        kept = kept.unionByName(more)
    return kept


def keep_first(docs: DataFrame, similarity: float | None = None, words: int = SET_SHINGLE, max_distance: int = MAX_DISTANCE, **how) -> DataFrame:
    """docs with one document of each group of linked fingerprints: the one with the smallest doc_id.

    With `similarity` the fingerprints only find candidates: a document goes if it is linked, as leaders() says for
    sets of shingles of `words` words, with one that stays and comes before it. So each document that goes is that similar
    to one that stays, and no two that stay are linked.

    Documents are told apart by doc_id and text: where different texts share a doc_id, each stays or goes with
    its own group, and within a group the one with the smaller text hash is first. Rows that repeat doc_id and
    text are one document, of which one row stays. Rows without doc_id stay. Columns are those of docs.
    """
    text = F.col("text").cast("string")
    own = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"))
    groups = near_dedup(own, max_distance, keep=("text_key",), **how)
    if similarity is None:
        kept = groups.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("first.*")
    else:
        # One row for each text of a component: its copies go with any link, and empty texts are one text.
        different = written(groups.groupBy("component", "fp", "text_key").agg(F.min("doc_id").alias("doc_id")), "different")
        many = different.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
        several = written(different.join(many, "component", "left_semi"), "several")
        named = several.join(own, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
        columns = ("component", "doc_id", "text_key", "fp")
        members = written(shingle_sets(named.select(*columns, "text"), words, columns), "members")
        alone = different.join(many, "component", "left_anti").select("doc_id", "text_key")
        kept = alone.unionByName(leaders(members, max_distance, similarity))
    kept = written(kept, "kept")
    named = docs.withColumns({KEPT_ID: F.col("doc_id"), KEPT_KEY: F.xxhash64(text)})
    kept = kept.toDF(KEPT_ID, KEPT_KEY)
    named = named.join(kept, [KEPT_ID, KEPT_KEY], "left_semi")
    many = own.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_key")
    twice = written(many.toDF(KEPT_ID, KEPT_KEY), "repeated")
    if not twice.isEmpty():
        again = named.join(twice, [KEPT_ID, KEPT_KEY], "left_semi").dropDuplicates([KEPT_ID, KEPT_KEY])
        named = named.join(twice, [KEPT_ID, KEPT_KEY], "left_anti").unionByName(again)
    return named.select(*map(quoted, docs.columns)).unionByName(docs.where("doc_id IS NULL"))

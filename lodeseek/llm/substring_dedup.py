"""Substring dedup: a compressed FM-index per shard, backward search over wavelet trees, matching statistics up to a window.

A window of `window` words is removed where its word sequence also starts in a document with a smaller
doc_id. Documents are not held against every shard. A window has a minimizer: the smallest hash among its
word grams, so that equal windows have an equal minimizer. A document's minimizers are its anchors, and the
words that windows around an anchor can cover are the anchor's segment. Hashes route segments and tell them apart:

* an anchor of one document only lies in no repeated window and is done with;
* segments of one anchor with the same words (equal hashes of the gram and of the segment, 128 bits together) are one
  segment, held by its smallest doc_id;
* an anchor with more than `capacity` different segments is not gathered: each of them that has copies is routed by itself,
  and each window in two of them is a segment of its own, under the window's hash.

What is removed is decided by matching statistics. Different segments of an anchor meet in a shard, an FM-index over them.
Each is streamed from its end: a backward step reads one more word, and the match is held at `window` words by
widening it to the suffixes that begin with these words. The smallest doc_id among these says from which document on
the window goes, for the segment's own document and for all that hold it word for word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import per_batch, shuffle_parts, signed, text_column, texts, written
from lodeseek.llm.succinct import WaveletMatrix

WINDOW = 50
GRAM = 8
#: Words that one shard indexes, about, and most segments that one anchor brings to it.
SHARD_WORDS = 1 << 17
CAPACITY = 1024
_B = 0x9E3779B97F4A7C15 | 1
_B_INVERSE = pow(_B, -1, 1 << 64)
#: Segments with over a HEAVY-th of all rows, HEAVY at most of them, and over LEAST rows: what was decided about them is broadcast.
HEAVY, LEAST = 2048, 1024
#: Words whose hashes a worker remembers; the memory is emptied when full, which changes no result.
REMEMBERED = 500_000


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 11)
        return h


_word_hash = _WordHash()


class Rolling:
    """Hashes of any run of a document's words from one pass over them."""

    def __init__(self, words: list[bytes]):
        n = len(words)
        w = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, n)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.append(np.uint64(1), np.full(n, _B, np.uint64)))
            self.back = np.cumprod(np.append(np.uint64(1), np.full(n, _B_INVERSE, np.uint64)))
            self.sums = np.append(np.uint64(0), np.cumsum(w * power[:n], dtype=np.uint64))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ h >> np.uint64(32)


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """The least (or, with np.maximum, the greatest) of each `width` neighbours."""
    size = 1
    while 2 * size <= width:
        x = least(x[:-size], x[size:])
        size *= 2
    return least(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors_of(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, segment hash, first word of the segment, words in it) of each minimizer of a document."""
    n = len(words)
    if n < window:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    roll = Rolling(words)
    at = np.arange(n - gram + 1)
    h = roll.of(at, at + gram)
    width = window - gram + 1
    low = _sliding(h, width, np.minimum)
    # a gram is a minimizer if it is the least of some window that holds it
    padded = np.concatenate((np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)))
    at = np.flatnonzero(_sliding(padded, width, np.maximum) == h)
    begin, end = np.maximum(at - (window - gram), 0), np.minimum(at + window, n)
    seg = roll.of(begin, end) ^ ((at - begin + 1).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return h[at], seg, begin, end - begin


def anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, seg, doc_id, text_key, begin, size) of every anchor of the rows that have a doc_id."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parts, counts = [], []
        for text in texts(batch):
            parts.append(anchors_of(text.split(), window, gram))
            counts.append(len(parts[-1][0]))
        anchor, seg, begin, size = (np.concatenate(x) for x in zip(*parts))
        at = pa.array(np.repeat(np.arange(len(counts)), counts))
        cols = [pa.array(signed(anchor)), pa.array(signed(seg)), batch.column("doc_id").take(at), batch.column("text_key").take(at), pa.array(begin.astype(np.int32)), pa.array(size.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(cols, names=["anchor", "seg", "doc_id", "text_key", "begin", "size"])

    return per_batch(docs, run, "anchor long, seg long, doc_id long, text_key long, begin int, size int")


class FmIndex:
    """FM-index over segments of word numbers, each with its document's id.

    Separators are smaller than words and all different, so the suffixes have one order. In the transform
    they share symbol 0, since no search reads one.
    """

    def __init__(self, segments: list[np.ndarray], doc_ids: np.ndarray, vocabulary: int, window: int):
        self.window, k = window, len(segments)
        sizes = np.array([len(s) for s in segments])
        text = np.concatenate([x for j, s in enumerate(segments) for x in (s + k, np.array([j]))])
        n = len(text)
        owner = np.repeat(np.arange(k), sizes + 1)
        rank, size, deep = text, 1, None
        while True:
            if size <= window < 2 * size:
                deep, deep_size = rank, size
            if size > sizes.max():
                break
            far = np.append(rank[size:], np.zeros(min(size, n), rank.dtype))[:n]
            _, rank = np.unique(rank * (n + k + vocabulary) + far, return_inverse=True)
            size *= 2
        order = np.argsort(rank)
        head = deep[order], deep[np.minimum(order + window - deep_size, n - 1)]
        new = np.append(True, (head[0][1:] != head[0][:-1]) | (head[1][1:] != head[1][:-1]))
        first = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        self.class_start, self.class_end = first[of], np.append(first[1:], n)[of]
        self.class_least = np.minimum.reduceat(doc_ids[owner[order]], first)[of]
        before = text[order - 1]
        symbols = np.where(before < k, 0, before - k + 1)
        width = max(1, int(vocabulary).bit_length())
        self.bwt = WaveletMatrix.of(symbols.astype(np.uint32), width)
        counts = np.bincount(text[text >= k] - k, minlength=vocabulary)
        self.below = k + np.cumsum(counts) - counts  # suffixes that begin with a smaller symbol
        self.begin = self.bwt.down(np.arange(1, vocabulary + 1), np.zeros(vocabulary, np.int64))
        self.size = n

    def step(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that begin with the word and go on as those of [lo, hi) do."""
        both = self.bwt.down(np.tile(word + 1, 2), np.concatenate((lo, hi)))
        lo, hi = both[: len(lo)], both[len(lo) :]
        base = self.below[word] - self.begin[word]
        return lo + base, hi + base

    def least(self, segments: list[np.ndarray]) -> list[np.ndarray]:
        """For each segment, from its first window on, the smallest id of a document that holds the window."""
        sizes = np.array([len(s) for s in segments])
        order = np.argsort(-sizes, kind="stable")
        most = int(sizes.max())
        table = np.zeros((most, len(segments)), np.int64)  # row t: the word that step t reads
        for j, i in enumerate(order.tolist()):
            table[: sizes[i], j] = segments[i][::-1]
        left = sizes[order]
        lo, hi = np.zeros(len(segments), np.int64), np.full(len(segments), self.size)
        found = np.zeros((len(segments), most), np.int64)
        for t in range(most):
            n = int(np.searchsorted(-left, -t))  # segments with a word left: sizes over t
            lo, hi = self.step(table[t, :n], lo[:n], hi[:n])
            if t >= self.window:
                lo, hi = self.class_start[lo], self.class_end[lo]
            if t >= self.window - 1:
                found[order[:n], t] = self.class_least[lo]
        return [found[i, self.window - 1 : n][::-1] for i, n in enumerate(sizes.tolist())]


def _search(rows: DataFrame, window: int, shard_words: int) -> DataFrame:
    """(key, seg, n, spans) from rows(key, seg, n, doc_id, words) sorted by key: the words [start, end) of each segment that go from documents with a larger id than `least`."""
    spans = "array<struct<start int, end int, least long>>"

    def shard(held: list[tuple]) -> pa.RecordBatch:
        vocabulary: dict[bytes, int] = {}
        segments = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in r[4].split()], np.int64) for r in held]
        found = FmIndex(segments, np.array([r[3] for r in held], np.int64), len(vocabulary), window).least(segments)
        sizes = np.array([len(x) for x in found])
        low, ends = np.concatenate(found), np.cumsum(sizes)
        new = np.append(True, low[1:] != low[:-1])
        new[ends[:-1]] = True  # runs of windows with one least id
        first = np.flatnonzero(new)
        owner = np.searchsorted(ends, first, side="right")
        start = first - (ends - sizes)[owner]
        end = np.append(first[1:], len(low)) - (ends - sizes)[owner] + window - 1
        offsets = np.searchsorted(owner, np.arange(len(held) + 1))
        span = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(low[first])], names=["start", "end", "least"])
        cols = [pa.array([r[k] for r in held], pa.int64()) for k in range(3)]
        return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), span)], names=["key", "seg", "n", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "seg", "n", "doc_id", "words"))):
                if size >= shard_words and row[0] != held[-1][0]:
                    yield shard(held)
                    held, size = [], 0
                held.append(row)
                size += row[4].count(b" ") + 1
        if held:
            yield shard(held)

    return rows.mapInArrow(run, f"key long, seg long, n long, spans {spans}")


def _with_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, text_key, text, own) of the documents of rows(doc_id, text_key, ...): own lists the other columns, of one document's segments."""
    fields = [c for c in rows.columns if c not in ("doc_id", "text_key")]
    by_doc = rows.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(*fields)).alias("own"))
    return docs.join(by_doc.withColumnsRenamed({"doc_id": "d", "text_key": "k"}), F.expr("doc_id = d AND text_key = k")).select("doc_id", "text_key", "text", "own")


def _words(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, seg, n, doc_id, text_key, begin, words) of rows(key, seg, n, doc_id, text_key, begin, size)."""
    kept = ["key", "seg", "n", "begin"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for doc_id, text_key, text, own in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), texts(batch), batch.column("own").to_pylist()):
            words = text.split()
            held = [b" ".join(words[x["begin"] : x["begin"] + x["size"]]) for x in own]
            cols = [pa.array([x[c] for x in own], pa.int32() if c == "begin" else pa.int64()) for c in kept]
            cols += [pa.array([k] * len(own), pa.int64()) for k in (doc_id, text_key)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(held, pa.binary())], names=[*kept, "doc_id", "text_key", "words"])

    twice = docs.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1")
    once = docs if twice.isEmpty() else docs.dropDuplicates(["doc_id", "text_key"])
    return per_batch(_with_text(once, rows), run, "key long, seg long, n long, begin int, doc_id long, text_key long, words binary")


def _windows(parts: DataFrame, window: int) -> DataFrame:
    """(key, doc_id, text_key, begin, segment, seg, place): every window of the segments parts(key, seg, doc_id, text_key, begin, words), by its hash.

    Where segments of a document overlap, a window is named by one of them: the segment's key and seg, and the window's place there.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        which, keys, places = [], [], []
        for i, words in enumerate(batch.column("words").to_pylist()):
            own = words.split()
            at = np.arange(len(own) - window + 1)
            which.append(np.full(len(at), i))
            keys.append(signed(Rolling(own).of(at, at + window)))
            places.append(at.astype(np.int32))
        which, place = pa.array(np.concatenate(which)), np.concatenate(places)
        begin = batch.column("begin").take(which).to_numpy() + place
        cols = [pa.array(np.concatenate(keys)), *(batch.column(c).take(which) for c in ("doc_id", "text_key")), pa.array(begin), *(batch.column(c).take(which) for c in ("key", "seg")), pa.array(place)]
        yield pa.RecordBatch.from_arrays(cols, names=["key", "doc_id", "text_key", "begin", "segment", "seg", "place"])

    made = per_batch(parts, run, "key long, doc_id long, text_key long, begin int, segment long, seg long, place int")
    return made.groupBy("key", "doc_id", "text_key", "begin").agg(F.min(F.struct("segment", "seg", "place")).alias("x")).select("key", "doc_id", "text_key", "begin", "x.*")


def spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, capacity: int = CAPACITY, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, text_key, start, end): words that windows of a smaller doc_id cover, in spans that may overlap, from docs(doc_id, text_key, text)."""
    gram = min(gram, window)
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = written(anchors(docs, window, gram), "anchors")
    ids = found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = written(ids.where("low < high").select("anchor"), "shared")
    rows = written(found.join(shared, "anchor").withColumnRenamed("anchor", "key"), "repeated")
    first, count = F.min(F.struct("doc_id", "text_key", "begin", "size")).alias("first"), F.count("*").alias("n")
    segments = written(rows.groupBy("key", "seg").agg(first, count), "segments")
    hot = written(segments.groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") > capacity).select("key"), "hot")
    every = written(_words(docs, segments.select("key", "seg", "n", "first.*")), "parts")
    of_hot = every.join(hot, "key", "left_semi")
    windows = written(_windows(of_hot, window), "windows")
    holder = F.min(F.struct("doc_id", "text_key", "begin", "segment", "seg", "place")).alias("first")
    twice = windows.groupBy("key").agg(holder, count, F.max("doc_id").alias("high")).where("first.doc_id < high").drop("high")
    twice = written(twice, "window-segments")
    alone = F.xxhash64("key", "seg").alias("key")
    part = ["key", "seg", "n", "doc_id", "words"]
    named = twice.select(F.col("key").alias("window"), F.col("n").alias("many"), F.col("first.segment").alias("key"), "first.seg", "first.place")
    cut = F.encode(F.array_join(F.slice(F.split(F.decode("words", "UTF-8"), " "), F.col("place") + 1, window), " "), "UTF-8")
    of_windows = of_hot.join(named, ["key", "seg"]).select(F.col("window").alias("key"), F.col("window").alias("seg"), F.col("many").alias("n"), "doc_id", cut.alias("words"))
    parts = every.join(hot, "key", "left_anti").select(*part).unionByName(of_hot.where("n > 1").select(alone, *part[1:])).unionByName(of_windows)
    parts = parts.repartition(shuffle_parts(docs), "key").sortWithinPartitions("key", "doc_id", "seg")
    decided = written(_search(parts, window, shard_words), "decided")
    place = ["seg", "doc_id", "text_key", "begin"]
    held = rows.join(hot.withColumn("hot", F.lit(True)), "key", "left").select(F.when(F.col("hot"), alone).otherwise(F.col("key")).alias("key"), *place)
    held = held.unionByName(windows.join(twice.select("key"), "key", "left_semi").withColumn("seg", F.col("key")).select("key", *place))
    most = max(LEAST, (rows.count() + windows.count()) // HEAVY)
    heavy = decided.where(F.col("n") > most).select("key", "seg", F.col("spans").alias("heavy"))
    marked = held.join(F.broadcast(heavy), ["key", "seg"], "left")  # HEAVY rows at most
    light = marked.where("heavy IS NULL").drop("heavy").join(decided.where(F.col("n") <= most).select("key", "seg", "spans"), ["key", "seg"])
    met = light.unionByName(marked.where("heavy IS NOT NULL").withColumnRenamed("heavy", "spans"))
    late = met.select("doc_id", "text_key", "begin", F.explode(F.filter("spans", lambda x: x.least < F.col("doc_id"))).alias("x"))
    return late.select("doc_id", "text_key", (F.col("begin") + F.col("x.start")).alias("start"), (F.col("begin") + F.col("x.end")).alias("end"))


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, capacity: int = CAPACITY, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept) for every row of docs(doc_id long, text, ...).

    removed lists the spans [start, end) of words that are cut, kept is the other words, joined by a blank.
    Words are runs of characters other than ASCII white space, unchanged. Windows are judged on the input.
    Null texts have no words; texts shorter than the window and rows without doc_id lose nothing, and the latter
    remove nothing. Rows that repeat a doc_id do not remove each other's words. Extra columns are not
    read. An empty table gives an empty result.
    """
    docs = text_column(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("text_key", F.xxhash64("text"))
    cuts = written(spans(docs, window, gram, capacity, shard_words).distinct(), "spans")
    cuts = cuts.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    met = docs.join(written(cuts, "cuts"), F.expr("doc_id = d AND text_key = k"), "left").select("doc_id", "text", "cuts")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n_words, n_removed, removed, kept = [], [], [], []
        for text, own in zip(texts(batch), batch.column("cuts").to_pylist()):
            words = text.split()
            merged: list[dict] = []
            for x in own or ():
                if merged and x["start"] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], x["end"])
                else:
                    merged.append(dict(x))
            n_words.append(len(words))
            n_removed.append(sum(x["end"] - x["start"] for x in merged))
            for x in reversed(merged):
                del words[x["start"] : x["end"]]
            removed.append(merged)
            kept.append(b" ".join(words).decode())
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, span), pa.array(kept)], names=["doc_id", "n_words", "n_removed", "removed", "kept"])

    return per_batch(met, run, "doc_id long, n_words long, n_removed long, removed array<struct<start int, end int>>, kept string")

"""Benchmark decontamination with suffix arrays over the training text.

Every Arrow batch of documents is a shard with a suffix array over its words. All benchmark suffixes that start a window
are binary-searched in it: what begins with a suffix's window lies together. A position whose next words are not all
benchmark words can start no match, so the array holds only the others: with this it is small, and no match is lost.
Suffixes are ordered by their first `window` words, so both sides take some 4 * window bytes a word however long texts and items are.

How far a match goes on is decided over all places of its window (`Places`): the benchmark as a sequence of window
numbers has a suffix array too, and a position's interval in it is narrowed by 2^l windows, 2^(l-1), ... down to one.

The benchmark reaches the tasks in blocks of bounded size (`block_bytes` of text, or one item), one broadcast after
another, so what is broadcast does not grow with it; documents are read once for each block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import ALNUM_TABLE, kept_rows, per_batch, text_column, texts, written

WINDOW = 10
#: Text of the items that are broadcast at once: 2,000,000 words at most, of 50 bytes or so.
BLOCK_BYTES = 4 << 20


def words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased."""
    return text.translate(ALNUM_TABLE).split()


def _keys(numbers: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The `window` numbers from each place on as one string of bytes, which sorts as they do."""
    padded = np.append(numbers, np.zeros(window, numbers.dtype)).astype(">u4")
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, window)[at]).view(f"S{4 * window}").ravel()


class Suffixes:
    """The benchmark's suffixes that start a window, in order, with one entry for those that start with the same window.

    Word numbers count from 1; a window shorter than `window`, of a short item, ends in zeros.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names, self.window = [name for name, _ in items], window
        numbers, item, place, need = [], [], [], []
        for k, (_, text) in enumerate(items):
            own = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.uint32)
            size = min(window, len(own))
            numbers.append(np.append(own, np.zeros(window, np.uint32)))
            starts = len(own) - size + 1 if size else 0
            item.append(np.full(starts, k, np.int32))
            place.append(np.arange(starts, dtype=np.int32))
            need.append(np.full(starts, size, np.int32))
        item, place, need = (np.concatenate([np.zeros(0, np.int32), *x]) for x in (item, place, need))
        first = np.cumsum([0, *map(len, numbers)])[:-1]
        numbers = np.concatenate([np.zeros(0, np.uint32), *numbers])
        keys = _keys(numbers, first[item] + place, window) if len(item) else np.zeros(0, f"S{4 * window}")
        order = np.argsort(keys, kind="stable")
        item_of, size_of = item, need
        keys, item = keys[order], item[order]
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        #: For each different window: its key, words, the item and word where it first stands, and where its items begin in `items`.
        self.keys, self.need, self.item, self.place = keys[new], need[order][new], item[new], place[order][new]
        ends = np.append(new[1:], len(keys))
        once = np.append(True, (item[1:] != item[:-1])) if len(item) else np.zeros(0, bool)
        once[new] = True
        before = np.append(0, np.cumsum(once))
        #: The items' windows one after another, by number from 1; 0 for short items, and once after each item.
        self.first = np.cumsum([0, *(np.bincount(item_of, minlength=len(items)) + 1)])
        self.sequence = np.zeros(self.first[-1], np.int32)
        number = np.empty(len(order), np.int32)
        number[order] = np.cumsum(np.isin(np.arange(len(order)), new))
        self.sequence[np.arange(len(order)) + item_of] = np.where(size_of == window, number, 0)
        self.items, self.items_from, self.items_to = item[once], before[new], before[ends]
        short = self.need < window
        self.upper = self.keys.copy()
        if short.any():
            raw = self.keys[short].view(np.uint8).reshape(-1, window, 4).copy()
            raw[np.arange(window)[None, :] >= self.need[short][:, None]] = 255
            self.upper[short] = raw.reshape(-1, 4 * window).view(self.keys.dtype).ravel()
        #: For each word number, how many words the shortest window that starts with it has.
        self.least = np.full(len(self.vocabulary) + 1, np.iinfo(np.int32).max, np.int32)
        if len(item):
            np.minimum.at(self.least, numbers[first[self.item] + self.place], self.need)


def suffix_array(numbers: np.ndarray, tests: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, where they start) of the positions that can start a match; numbers has 0 for a word that no item holds."""
    n = len(numbers)
    known = numbers > 0
    breaks = np.append(np.flatnonzero(~known), n)
    at = np.flatnonzero(known)
    run = breaks[np.searchsorted(breaks, at)] - at  # words up to the next unknown one
    at = at[run >= tests.least[numbers[at]]]
    keys = _keys(numbers, at, tests.window) if len(at) else tests.keys[:0]
    order = np.argsort(keys, kind="stable")
    return keys[order], at[order]


def search(tests: Suffixes, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, number of the window) of all windows that start there, by position. A position has one of each length at most."""
    lo, hi = np.searchsorted(keys, tests.keys), np.searchsorted(keys, tests.upper, side="right")
    n = np.maximum(hi - lo, 0)
    rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    position, which = at[rank], np.repeat(np.arange(len(n)), n)
    order = np.lexsort((which, position))
    return position[order], which[order]


class Places:
    """The suffix array of a sequence of window numbers, in which 0 ends a run of windows.

    Suffixes are ordered by as many windows as the longest run has. `level` holds for each the smallest l for
    which its first 2^l windows differ from those of the suffix before it, and with it the classes of all stretches of
    2^l windows. Classes are made where a document needs them: 12 bytes a window for each doubling of its longest run.
    """

    def __init__(self, sequence: np.ndarray):
        n = len(sequence)
        ends = np.append(np.flatnonzero(sequence == 0), n)
        at = np.flatnonzero(sequence)
        run = ends[np.searchsorted(ends, at)] - at  # windows up to the end of the run
        self.depth = int(run.max(initial=0)).bit_length()
        rank, order = sequence.astype(np.int64), np.argsort(sequence[at], kind="stable")
        self.level = np.full(len(at), 255, np.uint8)
        self.level[np.flatnonzero(np.diff(rank[at[order]], prepend=0))] = 0
        for step in range(1, self.depth + 1):
            width = 1 << (step - 1)
            after = np.where(run > width, rank[np.minimum(at + width, n - 1)], 0)
            pair = rank[at] << 32 | after
            order = np.argsort(pair, kind="stable")
            new = np.diff(pair[order], prepend=-1) != 0
            self.level[new & (self.level == 255)] = step
            rank[at[order]] = np.cumsum(new)
        self.sequence, self.order = sequence, at[order].astype(np.int32)
        self._classes: list[tuple[np.ndarray, np.ndarray]] = []

    def classes(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(class of the 2^level windows from each place on, from 1 in their order; the two classes one level below that each consists of)."""
        while len(self._classes) <= level:
            step = len(self._classes)
            if not step:
                self._classes.append((self.sequence, np.zeros(0, np.int64)))
                continue
            below, width = self._classes[-1][0], 1 << (step - 1)
            new = self.level <= step
            own = np.zeros(len(self.sequence), np.int32)
            own[self.order] = np.cumsum(new)
            one = self.order[new].astype(np.int64)
            whole = np.minimum(one + width, len(below) - 1)
            ends = np.append(np.flatnonzero(self.sequence == 0), len(self.sequence))
            after = np.where(ends[np.searchsorted(ends, one)] - one > width, below[whole], 0)
            self._classes.append((own, below[one].astype(np.int64) << 32 | after))
        return self._classes[level]

    def _edge(self, level: int, after: np.ndarray, wanted: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The first suffix of [lo, hi) whose class, `after` windows on, is not below the wanted one."""
        own, lo, hi = self.classes(level)[0], lo.copy(), hi.copy()
        while len(left := np.flatnonzero(lo < hi)):
            mid = (lo[left] + hi[left]) >> 1
            low = own[self.order[mid] + after[left]] < wanted[left]
            lo[left[low]], hi[left[~low]] = mid[low] + 1, mid[~low]
        return lo

    def longest(self, numbers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows, place) of the longest stretch of numbers from each of the places `at` (all that hold a number; 0 ends numbers) that the sequence has."""
        if not len(at):
            return at, at
        runs = np.diff(np.append(np.flatnonzero(np.append(True, np.diff(at) != 1)), len(at)))
        top = min(int(runs.max()).bit_length(), self.depth) - 1
        blocks = [numbers.astype(np.int32)]
        for level in range(1, top + 1):
            below, pairs = blocks[-1], self.classes(level)[1]
            own = np.flatnonzero(below)
            pair = below[own].astype(np.int64) << 32 | below[own + (1 << (level - 1))]
            found = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            block = np.zeros_like(below)
            block[own] = np.where((pairs[found] == pair) & (pair & 0xFFFFFFFF > 0), found + 1, 0)
            blocks.append(block)
        lo, hi, n = np.zeros(len(at), np.int64), np.full(len(at), len(self.order)), np.zeros(len(at), np.int64)
        for level in range(top, -1, -1):
            wanted = blocks[level][at + n].astype(np.int64)
            go = np.flatnonzero(wanted)
            a = self._edge(level, n[go], wanted[go], lo[go], hi[go])
            b = self._edge(level, n[go], wanted[go] + 1, a, hi[go])
            fine = go[b > a]
            lo[fine], hi[fine] = a[b > a], b[b > a]
            n[fine] += 1 << level
        return n, self.order[lo].astype(np.int64)


def longest(position: np.ndarray, which: np.ndarray, size: int, tests: Suffixes, places: Places) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, words, item, word of the item) of the longest match from each position, for the results of search() in `size` words."""
    full = tests.need[which] == tests.window
    numbers = np.zeros(size + 1, np.int32)
    numbers[position[full]] = which[full] + 1
    n, place = places.longest(numbers, position[full])
    length, item, start = tests.need[which].astype(np.int64), tests.item[which].astype(np.int64), tests.place[which].astype(np.int64)
    length[full] += n - 1
    item[full] = np.searchsorted(tests.first, place, side="right") - 1
    start[full] = place - tests.first[item[full]]
    order = np.lexsort((-length, position))
    first = order[np.flatnonzero(np.diff(position[order], prepend=-1))]
    return position[first], length[first], item[first], start[first]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about block_bytes; an item is never cut."""
    items = text_column(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // block_bytes) + 1
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted((r.item_id, r.text.encode()) for r in block.collect())


def _numbered(batch: pa.RecordBatch, tests: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers of all texts, each with a 0 after it; where each text begins and the last ends)."""
    get = tests.vocabulary.get
    parts, sizes = [], [0]
    for text in texts(batch):
        own = words(text)
        parts += [np.fromiter(map(get, own, repeat(0)), np.uint32, len(own)), np.zeros(1, np.uint32)]
        sizes.append(len(own) + 1)
    return np.concatenate(parts), np.cumsum(sizes)


FOUND = "doc_id {kind}, text_key long, n_words long, matches array<struct<start int, length int, item_id string, item_start int>>, items array<string>"
MATCHES = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("item_id", pa.string()), ("item_start", pa.int32())]))


def _found(docs: DataFrame, items: list[tuple[str, bytes]], window: int) -> DataFrame:
    """(doc_id, text_key, n_words, matches, items) for every row: the matches of one block."""
    suffixes = Suffixes(items, window)
    shared = docs.sparkSession.sparkContext.broadcast((suffixes, Places(suffixes.sequence)))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tests, places = shared.value
        numbers, first = _numbered(batch, tests)
        position, which = search(tests, *suffix_array(numbers, tests))
        at, length, item, start = longest(position, which, len(numbers), tests, places)
        bounds, own_bounds = np.searchsorted(position, first), np.searchsorted(at, first)
        rows, names = [], []
        for d in range(batch.num_rows):
            own = slice(own_bounds[d], own_bounds[d + 1])
            rows.append([{"start": s, "length": n, "item_id": tests.names[i], "item_start": p} for s, n, i, p in zip((at[own] - first[d]).tolist(), length[own].tolist(), item[own].tolist(), start[own].tolist())])
            w = np.unique(which[bounds[d] : bounds[d + 1]])
            own = {i for a, b in zip(tests.items_from[w].tolist(), tests.items_to[w].tolist()) for i in tests.items[a:b].tolist()}
            names.append(sorted({tests.names[i] for i in own}))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(np.diff(first) - 1, pa.int64()), pa.array(rows, MATCHES), pa.array(names, pa.list_(pa.string()))], names=["doc_id", "text_key", "n_words", "matches", "items"])

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return per_batch(keyed, run, FOUND.format(kind=kind))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text_key, n_words, matches, items) for every row of docs(doc_id, text, ...).

    matches lists the words where a benchmark window starts, in order, with the longest verbatim match from there: start
    and length in words of the document, item_id, and the item's word where it starts. Of several places of the longest match
    one counts, the same in every run. items names all items with a window in the document, sorted. Items of fewer words
    than `window` count when they are matched whole. Null texts and items without words match nothing; an item without item_id is named by the
    empty string. Repeated rows keep their rows. Texts and items may be of any length.
    """
    docs = text_column(docs.select("doc_id", "text"))
    found = [_found(docs, items, window) for items in _blocks(benchmark, block_bytes)]
    if len(found) == 1:
        return found[0]
    base, rest = found[0], [written(f.where(F.size("matches") > 0).select("doc_id", "text_key", "matches", "items").distinct(), "block") for f in found[1:]]
    more = rest[0]
    for f in rest[1:]:
        more = more.unionByName(f)
    more = written(more.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("matches")).alias("more"), F.flatten(F.collect_list("items")).alias("named")), "matches")
    same = base.alias("b").join(more.alias("m"), F.expr("b.doc_id <=> m.doc_id AND b.text_key = m.text_key"), "left")
    joined = lambda a, b: F.concat(a, F.coalesce(b, F.expr(f"filter({a}, x -> false)")))
    every = same.select("b.doc_id", "b.text_key", "n_words", joined("matches", "more").alias("matches"), F.array_sort(F.array_distinct(joined("items", "named"))).alias("items"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Of the blocks' matches from one word the longest stays."""
        rows = []
        for found in batch.column("matches").to_pylist():
            best = {}
            for m in sorted(found, key=lambda m: (m["start"], -m["length"], m["item_id"], m["item_start"])):
                best.setdefault(m["start"], m)
            rows.append([*best.values()])
        yield batch.set_column(3, "matches", pa.array(rows, MATCHES))

    return per_batch(every, run, FOUND.format(kind=dict(docs.dtypes)["doc_id"]))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs(doc_id, text, ...)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hit, n_items, digest = [], [], []
        for own, items in zip(batch.column("matches").to_pylist(), batch.column("items").to_pylist()):
            over, upto = 0, 0
            for m in sorted(own, key=lambda m: m["start"]):
                end = m["start"] + m["length"]
                over += max(0, end - max(upto, m["start"]))
                upto = max(upto, end)
            hit.append(over)
            n_items.append(len(items))
            digest.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
        cols = [batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest), pa.array([h > 0 for h in hit])]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return per_batch(matches(docs, benchmark, window, block_bytes).drop("text_key"), run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that hold a benchmark window; columns and other rows unchanged.

    The test runs where the rows are: the texts of one block are judged in the task that reads them, and
    a row goes on with its columns, so nothing is shuffled.
    """
    for items in _blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Suffixes(items, window))

        def keep(batch: pa.RecordBatch, shared=shared) -> np.ndarray:
            tests = shared.value
            numbers, first = _numbered(batch, tests)
            position, _ = search(tests, *suffix_array(numbers, tests))
            fine = np.ones(batch.num_rows, bool)
            fine[np.searchsorted(first, position, side="right") - 1] = False
            return fine

        docs = kept_rows(docs, keep)
    return docs

"""Spelling variants: words one edit apart, found in blocks of a forward and a reversed dictionary.

One inserted, deleted or replaced letter leaves the first or the second half of the shorter word as it is.
So two near words stand in one block of words that share a prefix, or in one that share a suffix. A block
over CAPACITY words is subdivided: the edit leaves half of what its words do not share yet, so each word goes on into a
block of a longer prefix and one of a longer suffix, until blocks are small or leave one letter open. Tasks then scan the
sorted blocks and verify each pair with the two words' common prefix and suffix.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import group_bounds, text_column, written

#: The letters of a run, and the least length and count of a word.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LETTERS, LEAST_COUNT = 6, 5
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: One of so many runs, by a hash of document and run, loses a letter.
SPOILT = 199
#: How many times as frequent as a word its form must be.
TIMES = 5
CAPACITY = 64
#: Words that a task counts before it passes their counts on, and bytes of words that it compares at once.
HELD, COMPARED = 200_000, 32 << 20


def spoilt(doc_id: str, run: str, every: int) -> str:
    """The run, or the run without the letter that its hash points at, if the hash is divisible by `every`."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, every: int = SPOILT, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): how often each word of least_letters letters and more occurs in docs(doc_id, text, ...), if at least least_count times.

    A word is a run of letters with only A-Z lower-cased, after spoilt(). Tasks count before the shuffle, and a text is read run by run, however long.
    """
    letters = re.compile(f"(?:{RUN.pattern[:-1]}){{{least_letters},}}")  # a shorter run stays shorter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own: Counter[str] = Counter()
                for raw, n in Counter(m.group() for m in letters.finditer(text or "")).items():
                    own[raw.translate(LOWER)] += n
                for word, n in own.items():
                    word = spoilt("" if doc_id is None else doc_id, word, every)
                    if len(word) >= least_letters:
                        total[word] += n
                if len(total) >= HELD:
                    yield out()
                    total.clear()
        if total:
            yield out()

    rows = text_column(text_column(docs.select("doc_id", "text")), "doc_id").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _block(m: Column, i: Column, j: Column) -> Column:
    """The block of words of m and m + 1 letters that share their first i and last j letters. It routes only: words of blocks with equal hashes fail verification."""
    word = F.col("word")
    shared = F.concat(F.substr(word, F.lit(1), i), F.when(j > 0, F.substr(word, F.char_length(word) - j + 1, j)).otherwise(""))
    return F.xxhash64(m, i, j, shared)


def _members(rows: DataFrame, nodes: Column) -> DataFrame:
    """rows(word, n, ...) in the blocks of nodes, an array of (m, i, j)."""
    found = rows.select("word", "n", F.explode(nodes).alias("x")).select("word", "n", "x.m", "x.i", "x.j")
    return found.withColumn("block", _block(F.col("m"), F.col("i"), F.col("j")))


def _node(m: Column, i: Column, j: Column) -> Column:
    return F.struct(m.cast("int").alias("m"), i.cast("int").alias("i"), j.cast("int").alias("j"))


def _halves(m: Column, i: Column, j: Column) -> list[Column]:
    """Both halves of what a node's words do not share yet, one of which an edit leaves alone."""
    half = F.floor((m - i - j) / 2)
    return [_node(m, i + half, j), _node(m, i, m - i - half)]


def blocks(words: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(word, n, m, i, j, block): words(word, n) in blocks of at most `capacity` words, or of words that differ in one place.

    A word meets others of its length and one longer (m: its length) and of one shorter (m: that length).
    """
    size, none = F.char_length("word"), F.lit(0)
    rest, done = written(_members(words, F.array(*_halves(size, none, none), *_halves(size - 1, none, none))), "members"), []
    while True:
        counts = rest.groupBy("block", "m", "i", "j").agg(F.count("*").alias("size"))
        over = written(counts.where((F.col("size") > capacity) & (F.col("m") - F.col("i") - F.col("j") > 1)).select("block", F.lit(True).alias("over")).distinct(), "over")
        if over.isEmpty():
            break
        marked = written(rest.join(over, "block", "left"), "marked")
        done.append(marked.where("over IS NULL").drop("over"))
        rest = written(_members(marked.where("over"), F.array(*_halves(F.col("m"), F.col("i"), F.col("j")))), "members")
    for rows in done:
        rest = rest.unionByName(rows)
    return rest


def _first_difference(letters: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.argmax(letters[a] != letters[b], axis=1)


def _matrix(words: list[str]) -> np.ndarray:
    """The code points of words, zeros after their ends; one column more than the longest needs."""
    width = max(map(len, words)) + 1
    return np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width)


def near_pairs(words: list[str], m: np.ndarray, i: np.ndarray, j: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of near words in rows that are sorted by block and then by length.

    A pair is taken in the one block that the halving leads to: its first difference is after the shared prefix, and
    before the shared suffix of the shorter word.
    """
    size = np.array([len(w) for w in words])
    forward, backward = _matrix(words), _matrix([w[::-1] for w in words])
    found = [np.zeros((0, 2), np.int64)]
    for d in range(1, len(words)):
        same = (block[d:] == block[:-d]) & (m[d:] == m[:-d]) & (i[d:] == i[:-d]) & (j[d:] == j[:-d])
        if not same.any():
            break
        a = np.flatnonzero(same & (size[:-d] == m[:-d]))  # two longer words meet in another block
        b = a + d
        head = _first_difference(forward, a, b)
        fits = (head >= i[a]) & ((j[a] == 0) | (head < m[a] - j[a]))
        a, b, head = a[fits], b[fits], head[fits]
        tail = _first_difference(backward, a, b)
        near = (head + tail >= size[b] - 1) & (size[b] - m[b] <= 1)
        found.append(np.stack([a[near], b[near]], 1))
    pairs = np.concatenate(found)
    return pairs[:, 0], pairs[:, 1]


def _verified(words: list[str], n: np.ndarray, *keys: np.ndarray) -> pa.RecordBatch:
    """(word, n_near, form, form_n) of words that have a near one in their block; form is the most frequent of these."""
    a, b = near_pairs(words, *keys)
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    order = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    best = np.full(len(words), len(words), np.int64)
    np.minimum.at(best, a, rank[b])
    count = np.bincount(a, minlength=len(words))
    own = np.flatnonzero(count)
    form = [order[k] for k in best[own]]
    columns = [pa.array([words[k] for k in own], pa.string()), pa.array(count[own], pa.int64()), pa.array([words[k] for k in form], pa.string()), pa.array(n[form] if form else [], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "form", "form_n"])


def _slices(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows of whole blocks (starts, with the end) whose matrix stays within COMPARED bytes, or of one block."""
    at, widest = 0, 0
    for k in range(len(starts) - 1):
        here = int(sizes[starts[k] : starts[k + 1]].max()) + 1
        if starts[k] > starts[at] and (starts[k + 1] - starts[at]) * max(widest, here) * 4 > COMPARED:
            yield int(starts[at]), int(starts[k])
            at, widest = k, 0
        widest = max(widest, here)
    if len(starts) > 1:
        yield int(starts[at]), int(starts[-1])


def near_words(words: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(word, n_near, form, form_n) of each word of words(word, n) that has a near one; n_near counts them, and form is the one of greatest n, the first by code point of equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def checked(table: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = [table.column(c).to_numpy() for c in ("m", "i", "j", "block")]
            own, n = table.column("word").to_pylist(), table.column("n").to_numpy()
            starts = group_bounds(keys[3])
            for x, y in _slices(starts, np.array([len(w) for w in own])):
                yield _verified(own[x:y], n[x:y], *(k[x:y] for k in keys))

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            starts = group_bounds(held.column("block").to_numpy())
            if len(starts) > 2:  # the last block may go on
                yield from checked(held.slice(0, starts[-2]))
                held = held.slice(starts[-2])
        if held is not None and held.num_rows:
            yield from checked(held)

    rows = blocks(words, capacity).repartition("block").sortWithinPartitions("block", F.char_length("word"), "word")
    parts = rows.mapInArrow(run, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form"))).alias("best")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "best.form", (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where forms(word, form) lead. Every round doubles the steps; as a form is TIMES as frequent as its word, there are few."""
    hop = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = hop.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(hop.join(ahead, "root", "left"), "roots")
        if moved.where("next IS NOT NULL").isEmpty():
            return hop
        hop = moved.select("word", F.coalesce("next", "root").alias("root"))


def groups(words: DataFrame, times: int = TIMES, capacity: int = CAPACITY) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of words(word, n), which names each word once.

    Words are near if one inserted, deleted or replaced code point makes one of the other. form is the near word of greatest n (of equals the
    first by code point) if its n is at least `times` the word's, else null; root is where forms lead, or the word itself.
    """
    words = written(words, "words")
    near = written(near_words(words, capacity), "near")
    found = words.join(near, "word", "left")
    enough = F.col("form_n") >= times * F.col("n")
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")), "forms")
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, every: int = SPOILT) -> DataFrame:
    """groups() of the words of docs(doc_id, text, ...).

    Null and empty texts have no words, and no words give an empty result. A null doc_id is hashed as an empty one. Repeated rows count
    again. Texts and words may be of any length, and other columns are not read.
    """
    return groups(word_counts(docs, every))

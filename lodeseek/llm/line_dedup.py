"""Line dedup: overlapping documents, aligned with patience diff, cut in the later one.

`dedup` aligns a document with every earlier one that can take a line from it. Equal sequences of lines are
reduced to their first document. What documents meet by are runs: the shortest sequences of lines that follow each
other and together weigh `min_words`, one line where it is long enough. Every place of every common block is in a run that
both documents hold. A document is first aligned with the first holder of each of its runs, then, for runs that
still have an uncut place, with the next ones, `HOLDERS` in all. Runs that are still uncut then and have more holders
stand in other places everywhere. For them the holders are reduced to outlines: the lines that another of these holders
has too, in order, with a mark for what lies between. Alignments depend on outlines alone, so the first document of each
outline stands for all that have it: a later one is aligned with it and loses all that any alignment could take. Only
first documents go on, against four times as many others in each round, until nothing open has an earlier one left.
Every alignment that could cut a line is so decided, and no line goes without one. With `moved` the runs that are open
after `HOLDERS` holders are cut without an alignment instead. Repeated long lines are numbered in each document.

With `first_only` a line is rare in a document that holds it once and where it has `min_words` words, and each
document is paired only with the first holder of each of its rare lines.

What goes through the joins is line hashes; texts are shuffled once, to meet the cuts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.llm.common import per_batch, quoted, text_column, written

MIN_WORDS = 3
#: Earlier holders of a run that a document is aligned with, by rounds.
ROUNDS = (1, 4, 16)
HOLDERS = ROUNDS[-1]
#: Pairs of one first holder that a join keeps together; more are split, and its lines copied to each part.
PAIRS = 4096
#: Scripts that put no blanks between words.
_NO_BLANKS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_PRIME = (1 << 61) - 1
_BASE = 0x1B873593CC9E2D51 % _PRIME


def line_key(line: str) -> int:
    """Signed hash of a line without the white space around it; 0 for a blank one."""
    line = line.strip()
    return xxhash.xxh64_intdigest(line.encode()) - (1 << 63) if line else 0


def weight(line: str) -> int:
    """Words of a line; two characters of a script without blanks, or 16 of any, count as a word at least."""
    line = line.strip()
    n = 0 if line.isascii() else len(_NO_BLANKS.findall(line))
    return min(max(len(line.split()), n // 2, len(line) // 16), 32_000)


def numbered(lines: list[int], weights: list[int], min_words: int) -> list[int]:
    """Lines of min_words, from their second occurrence on, under a hash of line and occurrence."""
    seen: Counter = Counter()
    out = []
    for x, w in zip(lines, weights):
        if w >= min_words:
            seen[x] += 1
            if seen[x] > 1:
                x = xxhash.xxh64_intdigest(f"{x}/{seen[x]}") - (1 << 63)
        out.append(x)
    return out


def runs(lines: list[int], weights: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """(key, from, to) of the shortest runs that weigh min_words, from each place on and back from each place."""
    spans = set()
    i = total = 0
    for end, w in enumerate(weights, 1):
        total += w
        while total - weights[i] >= min_words:
            total -= weights[i]
            i += 1
        if total >= min_words:
            spans.add((i, end))
    end, total = len(weights), 0
    for i in range(len(weights) - 1, -1, -1):
        total += weights[i]
        while total - weights[end - 1] >= min_words:
            end -= 1
            total -= weights[end]
        if total >= min_words:
            spans.add((i, end))
    if all(b - a == 1 for a, b in spans):
        return [(lines[a], a, b) for a, b in sorted(spans)]
    sums, powers = [0], [1]
    for x in lines:
        sums.append((sums[-1] * _BASE + x) % _PRIME)
        powers.append(powers[-1] * _BASE % _PRIME)
    out = []
    for a, b in sorted(spans):
        key = lines[a] if b - a == 1 else xxhash.xxh64_intdigest(f"{(sums[b] - sums[a] * powers[b - a]) % _PRIME}/{b - a}") - (1 << 63)
        out.append((key, a, b))
    return out


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, in order of the first place, in which the second places rise (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        if p == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[p], at[p] = j, k
        back.append(at[p - 1] if p else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) with a[i] == b[j], rising in both: equal ends, lines unique in both, and the gaps between these."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        once = {x for x, k in Counter(b[j:n]).items() if k == 1}
        once &= {x for x, k in Counter(a[i:m]).items() if k == 1}
        if not once:
            continue
        where = {b[k]: k for k in range(j, n) if b[k] in once}
        for p, q in _rising([(k, where[a[k]]) for k in range(i, m) if a[k] in once]):
            out.append((p, q))
            todo.append((i, p, j, q))
            i, j = p + 1, q + 1
        todo.append((i, m, j, n))
    return sorted(out)


def common_blocks(first: list[int], later: list[int], weights: list[int], min_words: int) -> list[int]:
    """Places in `later` of aligned blocks (lines that follow each other in both) of min_words words or more."""
    shared = set(first) & set(later)
    at_a, at_b = ([k for k, x in enumerate(s) if x in shared] for s in (first, later))
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for p, q in [*patience([first[k] for k in at_a], [later[k] for k in at_b]), (-1, -1)]:
        here = (at_a[p], at_b[q]) if p >= 0 else (-9, -9)
        if here != (last[0] + 1, last[1] + 1):
            if sum(weights[k] for k in block) >= min_words:
                out += block
            block = []
        block.append(here[1])
        last = here
    return out


def sequences(docs: DataFrame, number_from: int | None = None) -> DataFrame:
    """(doc_id, text_key, lines, weights) of each different document that has an id: hashes and word counts of its lines.

    With number_from, weights are those of `weight`, and repeated lines of that weight are numbered.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, weights = [], []
        for text in batch.column("text").to_pylist():
            lines = text.split("\n")
            own = [line_key(x) for x in lines]
            weights.append([min(len(x.split()), 32_000) if number_from is None else weight(x) for x in lines])
            keys.append(own if number_from is None else numbered(own, weights[-1], number_from))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(keys, pa.list_(pa.int64())), pa.array(weights, pa.list_(pa.int16()))], names=["doc_id", "text_key", "lines", "weights"])

    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return per_batch(rows, run, f"doc_id {kind}, text_key long, lines array<long>, weights array<smallint>")


def pairs(seqs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(first_id, first_key, doc_id, text_key): each document with the first holder of each of its rare lines."""
    kind = dict(seqs.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        which, keys = [], []
        for i, (lines, weights) in enumerate(zip(batch.column("lines").to_pylist(), batch.column("weights").to_pylist())):
            heavy = {x: w for x, w in zip(lines, weights)}
            own = [x for x, n in Counter(lines).items() if n == 1 and heavy[x] >= min_words]
            which += [i] * len(own)
            keys += own
        at = pa.array(which, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column("doc_id").take(at), batch.column("text_key").take(at)], names=["line", "doc_id", "text_key"])

    lines = written(per_batch(seqs, run, f"line long, doc_id {kind}, text_key long"), "lines")
    held = lines.groupBy("line").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count("*").alias("n")).where("n > 1")
    held = written(held.select("line", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key")), "held")
    found = lines.join(held, "line").where("NOT (doc_id = first_id AND text_key = first_key)")
    return found.select("first_id", "first_key", "doc_id", "text_key").distinct()


def aligned(two: DataFrame, seqs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, text_key, place, size): the places that alignments of two(first_id, first_key, doc_id, text_key) cut, and how many lines there are."""
    kind, ends = dict(seqs.dtypes)["doc_id"], ["first_id", "first_key"]
    parts = written(two.groupBy(*ends).agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("parts")).where("parts > 1"), "parts")
    first = seqs.select(F.col("doc_id").alias("first_id"), F.col("text_key").alias("first_key"), F.col("lines").alias("first_lines"))
    later = two.join(seqs, ["doc_id", "text_key"])
    if parts.isEmpty():
        both = later.join(first, ends)
    else:
        part = F.pmod(F.xxhash64("doc_id", "text_key"), "parts").cast("int").alias("part")
        copied = first.join(parts, ends).select(*ends, "first_lines", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        hot = later.join(parts, ends).select(*later.columns, part).join(copied, [*ends, "part"]).drop("part")
        both = later.join(parts, ends, "left_anti").join(first, ends).unionByName(hot)

    def align(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        which, places, sizes = [], [], []
        for i, (a, b, w) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("first_lines", "lines", "weights")))):
            own = common_blocks(a, b, w, min_words)
            which += [i] * len(own)
            places += own
            sizes += [len(b)] * len(own)
        at = pa.array(which, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("text_key").take(at), pa.array(places, pa.int32()), pa.array(sizes, pa.int32())], names=["doc_id", "text_key", "place", "size"])

    return per_batch(both.select("doc_id", "text_key", "first_lines", "lines", "weights"), align, f"doc_id {kind}, text_key long, place int, size int")


def flagged(places: DataFrame) -> DataFrame:
    """(doc_id, text_key, cut array<boolean>) from rows(doc_id, text_key, place, size), which may repeat."""
    kind = dict(places.dtypes)["doc_id"]

    def flags(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cut = []
        for places, n in zip(batch.column("places").to_pylist(), batch.column("size").to_pylist()):
            own = [False] * n
            for k in places:
                own[k] = True
            cut.append(own)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(cut, pa.list_(pa.bool_()))], names=["doc_id", "text_key", "cut"])

    own = places.distinct().groupBy("doc_id", "text_key").agg(F.collect_list("place").alias("places"), F.max("size").alias("size"))
    return per_batch(own, flags, f"doc_id {kind}, text_key long, cut array<boolean>")


def first_cuts(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, cut array<boolean>): for documents that lose lines, which ones, by the first holders of rare lines."""
    docs = text_column(docs.select("doc_id", "text"))
    seqs = written(sequences(docs).dropDuplicates(["doc_id", "text_key"]), "sequences")
    two = written(pairs(seqs, min_words), "pairs")
    return flagged(aligned(two, seqs, min_words))


def _open(keys: DataFrame, seqs: DataFrame, cut: DataFrame, min_words: int, places: bool = False) -> DataFrame:
    """(key, doc_id, text_key) of the rows of keys whose run has an uncut place in its document; or (doc_id, text_key, place, size) of such runs."""
    kind = dict(seqs.dtypes)["doc_id"]
    own = keys.groupBy("doc_id", "text_key").agg(F.collect_set("key").alias("keys"))
    rows = own.join(seqs, ["doc_id", "text_key"]).join(cut, ["doc_id", "text_key"], "left").select("doc_id", "text_key", "keys", "lines", "weights", "cut")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        which, out, sizes = [], [], []
        for i, (own, lines, weights, gone) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("keys", "lines", "weights", "cut")))):
            asked, gone = set(own), gone or [False] * len(lines)
            left = [(key, a, b) for key, a, b in runs(lines, weights, min_words) if key in asked and not all(gone[a:b])]
            found = {k for _, a, b in left for k in range(a, b)} if places else {key for key, _, _ in left}
            which += [i] * len(found)
            out += found
            sizes += [len(lines)] * len(found)
        at = pa.array(which, pa.int64())
        doc = [batch.column("doc_id").take(at), batch.column("text_key").take(at)]
        if places:
            yield pa.RecordBatch.from_arrays([*doc, pa.array(out, pa.int32()), pa.array(sizes, pa.int32())], names=["doc_id", "text_key", "place", "size"])
        else:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), *doc], names=["key", "doc_id", "text_key"])

    return per_batch(rows, run, f"doc_id {kind}, text_key long, place int, size int" if places else f"key long, doc_id {kind}, text_key long")


def outlines(seqs: DataFrame) -> DataFrame:
    """(doc_id, text_key, outline): of each sequence the lines that another one has too, with a mark for what lies between, as 128 bits of hash."""
    kind, name = dict(seqs.dtypes)["doc_id"], ["doc_id", "text_key"]
    held = seqs.select(*name, F.explode(F.array_distinct("lines")).alias("line"))
    known = held.join(held.groupBy("line").count().where("count > 1"), "line", "left_semi").groupBy(*name).agg(F.collect_list("line").alias("known"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for lines, known in zip(batch.column("lines").to_pylist(), batch.column("known").to_pylist()):
            known, last, text = set(known or ()), -1, []
            for k, x in enumerate(lines):
                if x in known:
                    text.append(("," if k == last + 1 else ";") + str(x))
                    last = k
            out.append(xxhash.xxh3_128_digest("".join(text)[1:]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in name), pa.array(out, pa.binary())], names=[*name, "outline"])

    return per_batch(seqs.join(known, name, "left").select(*name, "lines", "known"), run, f"doc_id {kind}, text_key long, outline binary")


def cuts(docs: DataFrame, min_words: int = MIN_WORDS, moved: bool = True) -> DataFrame:
    """(doc_id, text_key, cut array<boolean>): for documents that lose lines, which ones, by all earlier documents."""
    name, ends = ["doc_id", "text_key"], ["first_id", "first_key"]
    docs = text_column(docs.select("doc_id", "text"))
    every = written(sequences(docs, min_words).dropDuplicates(name), "sequences")
    kind = dict(every.dtypes)["doc_id"]
    first = every.groupBy(F.xxhash64("lines").alias("all"), F.hash("lines").alias("more")).agg(F.min(F.struct(*name)).alias("first"))
    first = written(first.select("first.*"), "representatives")
    seqs = written(every.join(first, name, "left_semi"), "different")
    heavy = F.aggregate("weights", F.lit(0).cast("long"), lambda n, w: n + w) >= min_words
    copies = every.join(first, name, "left_anti").where(heavy).select(*name, F.transform("weights", lambda w: F.lit(True)).alias("cut"))

    def keys(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        which, out = [], []
        for i, (lines, weights) in enumerate(zip(batch.column("lines").to_pylist(), batch.column("weights").to_pylist())):
            own = {key for key, _, _ in runs(lines, weights, min_words)}
            which += [i] * len(own)
            out += own
        at = pa.array(which, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), *(batch.column(c).take(at) for c in name)], names=["key", *name])

    held = written(per_batch(seqs, keys, f"key long, doc_id {kind}, text_key long"), "runs")
    shared = written(held.join(held.groupBy("key").count().where("count > 1"), "key", "left_semi"), "shared")
    as_first = [F.col(c).alias(x) for c, x in zip(name, ends)]
    before = F.struct(*(F.col(x).alias(c) for c, x in zip(name, ends))) < F.struct(*name)

    def first_of(rows: DataFrame, upto: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("key").orderBy(*name))
        return written(rows.select("key", *name).withColumn("rank", rank).where(F.col("rank") <= upto + 1), "holders")

    places, done = None, None

    def align(two: DataFrame) -> DataFrame:
        """The cuts of all pairs so far, these included."""
        nonlocal places, done
        two = written(two if done is None else two.join(done, [*ends, *name], "left_anti"), "pairs")
        found = written(aligned(two, seqs, min_words), "places")
        done = two if done is None else done.unionByName(two)
        places = found if places is None else places.unionByName(found)
        return written(flagged(places), "flags")

    def meet(todo: DataFrame, holders: DataFrame, last: int, upto: int) -> tuple[DataFrame, DataFrame]:
        """The cuts after the holders of ranks last + 1 to upto, and what is open and has more."""
        met = holders.where((F.col("rank") > last) & (F.col("rank") <= upto)).select("key", *as_first)
        cut = align(todo.join(met, "key").where(before).select(*ends, *name).distinct())
        # a document of rank r has r - 1 earlier holders
        rest = todo.join(holders.where(F.col("rank") <= upto + 1).select("key", *name), ["key", *name], "left_anti")
        return cut, written(_open(rest, seqs, cut, min_words), "open")

    holders, todo, last = first_of(shared, HOLDERS), shared, 0
    for upto in ROUNDS:
        cut, todo = meet(todo, holders, last, upto)
        if todo.isEmpty():
            return cut.unionByName(copies)
        last = upto
    if moved:
        return flagged(places.unionByName(written(_open(todo, seqs, cut, min_words, places=True), "moved"))).unionByName(copies)
    of_open = written(shared.join(todo.select("key").distinct(), "key", "left_semi"), "holders-of-open")
    outline = written(outlines(seqs.join(of_open.select(*name).distinct(), name, "left_semi")), "outlines")
    alike = outline.join(outline.groupBy("outline").agg(F.min(F.struct(*name)).alias("x")), "outline")
    alike = written(alike.select(*name, *(F.col(f"x.{c}").alias(x) for c, x in zip(name, ends))), "alike")
    cut = align(todo.select(*name).distinct().join(alike, name).where(before).select(*ends, *name))
    own = alike.where(~before).select(*name)
    todo, of_open = (written(x.join(own, name, "left_semi"), "of-outlines") for x in (todo, of_open))
    last, upto = 0, 4 * HOLDERS
    while not todo.isEmpty():
        cut, todo = meet(todo, first_of(of_open.join(todo.select("key").distinct(), "key", "left_semi"), upto), last, upto)
        last, upto = upto, 4 * upto
    return cut.unionByName(copies)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, first_only: bool = True, moved: bool = True) -> DataFrame:
    """(row, n_lines, n_removed) for every row of docs(doc_id, text, ...): row is the document's struct with its new text.

    Lines end at \\n and are compared without the white space around them. Rows that agree on doc_id and
    text are one document; of rows with one doc_id and different texts the one with the smaller text hash
    is earlier. Rows without doc_id or text stay as they are and cut nothing; a null text has no lines, an
    empty one has one. A document may lose all its lines: its text is then empty.
    """
    cut = written(first_cuts(docs, min_words) if first_only else cuts(docs, min_words, moved), "cuts")
    columns = docs.columns
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*map(quoted, columns)).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64(text).alias("own_key"), text.alias("own_text"))
    met = rows.join(cut.hint("shuffle_hash"), (F.col("own_id") == F.col("doc_id")) & (F.col("own_key") == F.col("text_key")), "left")
    lines = F.split("own_text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.coalesce(F.get("cut", i), F.lit(False))), "\n")
    new = F.when(F.col("cut").isNull(), F.col("own_text")).otherwise(kept)
    fields = [new.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in columns]
    removed = F.coalesce(F.size(F.filter("cut", lambda x: x)), F.lit(0))
    n_lines = F.when(F.col("own_text").isNull(), 0).otherwise(F.size(lines))
    return met.select(F.struct(*fields).alias("row"), n_lines.cast("long").alias("n_lines"), F.when(F.col("cut").isNull(), 0).otherwise(removed).cast("long").alias("n_removed"))


def cleaned(docs: DataFrame, min_words: int = MIN_WORDS, first_only: bool = True, moved: bool = True) -> DataFrame:
    """docs with the aligned blocks cut from the texts of later documents; all rows stay."""
    return dedup(docs, min_words, first_only, moved).select("row.*")

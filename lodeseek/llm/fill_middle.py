"""Fill-in-middle: one scan of a byte automaton finds units and sentinels, a second pass finds the cuts.

Texts are cut into lanes of LANE bytes, which step through the transition table together. A lane is run
from every state, since what stands before it is not known yet; afterwards the states of a text's lanes
follow one another, and so do the numbers of units that their transitions emitted. A cut lies in the lane
whose count reaches it, and only those lanes are run again, from their known state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import per_batch, text_column, texts

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 documents so many stay as they are, and of 100 of the others so many have their suffix first.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20
LANE = 128
#: States: after anything else, after a letter, after "<", after "<" and the letter of a sentinel.
OTHER, LETTER, OPEN, NAMED = range(4)
#: Classes of bytes: other starts of a code point, letters, letters of sentinels, "<", ">", continuations, and what fills a lane.
START, ALPHA, NAME, LESS, GREATER, CONTINUATION, FILL = range(7)
STATES, CLASSES = 4, 7
#: A transition's value: the next state times CLASSES, with flags for a unit that begins here and for a sentinel that ends here.
UNIT, SENTINEL, NEXT = 64, 128, 63


def _classes() -> np.ndarray:
    of = np.full(256, START, np.uint8)
    of[0x80:0xC0] = CONTINUATION
    for first, last in (b"AZ", b"az"):
        of[first : last + 1] = ALPHA
    of[list(b"PSM")] = NAME
    of[ord("<")], of[ord(">")] = LESS, GREATER
    return of


def _transitions() -> np.ndarray:
    to = np.zeros((STATES, CLASSES), np.uint8)
    for state in range(STATES):
        in_word = state in (LETTER, NAMED)
        for kind in range(CLASSES):
            letter = kind in (ALPHA, NAME)
            if kind == FILL:
                after = state
            elif kind == NAME and state == OPEN:
                after = NAMED
            else:
                after = LETTER if letter else OPEN if kind == LESS else OTHER
            begins = kind not in (CONTINUATION, FILL) and not (letter and in_word)
            to[state, kind] = after * CLASSES + UNIT * begins + SENTINEL * (kind == GREATER and state == NAMED)
    return to.ravel()


CLASS_OF, STEP = _classes(), _transitions()


class Scan:
    """The units of a batch of texts (UTF-8)."""

    def __init__(self, data: list[bytes]):
        size = np.array([len(x) for x in data], np.int64)
        self.size, lanes = size, np.maximum(-(-size // LANE), 1)
        self.first = np.append(0, np.cumsum(lanes))  # of each text's lanes, and their number at the end
        kinds = np.full(self.first[-1] * LANE, FILL, np.uint8)
        for x, at in zip(data, self.first * LANE):
            kinds[at : at + len(x)] = CLASS_OF[np.frombuffer(x, np.uint8)]
        self.kinds = np.ascontiguousarray(kinds.reshape(-1, LANE).T)
        ends, units, ended = self._from_every_state()
        begins, state, firsts = np.zeros(self.first[-1], np.intp), 0, set(self.first[:-1].tolist())
        for lane, to in enumerate(ends.T.tolist()):
            state = 0 if lane in firsts else state
            begins[lane] = state
            state = to[state]
        self.begins, every = begins, np.arange(self.first[-1])
        self.units = np.append(0, np.cumsum(units[begins, every], dtype=np.int64))  # before each lane
        self.n = self.units[self.first[1:]] - self.units[self.first[:-1]]
        self.has_sentinel = np.logical_or.reduceat(ended[begins, every], self.first[:-1]) if data else np.zeros(0, bool)

    def _from_every_state(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each first state and lane: the last state, the number of units, and whether a sentinel ended."""
        n = self.kinds.shape[1]
        at = np.repeat((np.arange(STATES, dtype=np.uint8) * CLASSES)[:, None], n, 1)
        units, flags = np.zeros((STATES, n), np.uint8), np.zeros((STATES, n), np.uint8)
        for kinds in self.kinds:
            made = STEP[at + kinds]
            at = made & NEXT
            units += (made & UNIT) >> 6
            flags |= made
        return at // CLASSES, units, (flags & SENTINEL) > 0

    def cuts(self, which: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The byte at which the first `after` units of each text of `which` end."""
        found = np.where(after >= self.n[which], self.size[which], 0)
        inside = np.flatnonzero((after > 0) & (after < self.n[which]))
        goal = self.units[self.first[which[inside]]] + after[inside]  # units before the one that begins at the cut
        lane = np.searchsorted(self.units, goal, "right") - 1
        left, at = goal - self.units[lane], (self.begins[lane] * CLASSES).astype(np.uint8)
        place = np.full(len(inside), -1, np.int64)
        for i in range(LANE):
            made = STEP[at + self.kinds[i, lane]]
            at = made & NEXT
            unit = (made & UNIT) > 0
            place[unit & (left == 0) & (place < 0)] = i
            left -= unit
        found[inside] = (lane - self.first[which[inside]]) * LANE + place
        return found


def _seeds(doc_id) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def _code_points(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of docs(doc_id, text, ...).

    A unit is a run of ASCII letters or any other code point. A text is cut after two numbers of units that a hash of
    its doc_id gives, and prefix, suffix and middle follow their sentinels, the prefix first (psm) or the suffix (spm).
    A tenth of the documents, empty ones and those that hold a sentinel stay as they are (plain), with null lengths.
    Null texts are empty. A null doc_id is hashed as an empty one. Equal rows have equal results, very long texts only take more lanes,
    other columns are not read, and an empty table gives an empty result.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data = texts(batch)
        scan = Scan(data)
        h = np.array([_seeds(x) for x in batch.column("doc_id").to_pylist()], np.int64).reshape(-1, 4)
        plain = (scan.n == 0) | scan.has_sentinel | (h[:, 2] % 100 >= 100 - PLAIN_PERCENT)
        cut = np.flatnonzero(~plain)
        ends = np.sort(h[cut, :2] % (scan.n[cut, None] + 1), axis=1)
        first, second = scan.cuts(cut, ends[:, 0]).tolist(), scan.cuts(cut, ends[:, 1]).tolist()
        form, chars, output = ["plain"] * len(data), [(None, None)] * len(data), list(data)
        for i, a, b in zip(cut.tolist(), first, second):
            text = data[i]
            before, middle, after = text[:a], text[a:b], text[b:]
            chars[i] = _code_points(before), _code_points(middle)
            if h[i, 3] % 100 < SUFFIX_FIRST_PERCENT:
                form[i], output[i] = "spm", b"".join((SUFFIX, after, PREFIX, before, MIDDLE, middle))
            else:
                form[i], output[i] = "psm", b"".join((PREFIX, before, SUFFIX, after, MIDDLE, middle))
        columns = [batch.column("doc_id"), pa.array(scan.n), pa.array(form), *(pa.array([c[k] for c in chars], pa.int64()) for k in (0, 1)), pa.array(output, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    found = per_batch(text_column(docs.select("doc_id", "text")), run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return found.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No part holds a sentinel, so the three in the output are its own."""
    part = F.split(output, "<[PSM]>", -1)  # what stands before the first sentinel is empty
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))

"""Toxicity: a lexicon learned from labelled documents, misspellings by Levenshtein automata, and quotation apart from abuse.

Training reads a bounded sample of labelled rows (`sample_rows`, the smallest hashes of doc_id). A term is a
whole word or a stem (a word's first 4 to 8 characters and any ending). Its evidence is the number of
distinct contexts (word before, word after) that it has in toxic and in other texts of the sample, so that
copies of a document add nothing. Terms form a trie. The Levenshtein automaton for one edit runs on all
of the trie at once: a state is a set of (trie node, edits so far), made when a word first needs it. A
word that dies in the automaton costs a few dictionary look-ups.

A document's score is a logistic function of what its hits say: the strongest evidence and the number of
hits, apart for hits in plain context and hits inside quotation marks or after a reporting word in the
window before them. Weights are fitted to the sample, with a pull to fixed priors.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import kept_rows, per_batch, text_column, written

WORD = re.compile(r"[^\W_]+")
#: Most labelled rows that training reads.
SAMPLE_ROWS = 20_000
MIN_CONTEXTS, MIN_SHARE = 6, 0.7
#: Share of toxic uses that a misspelled term is taken to have before any has been seen, and how many uses that weighs.
FUZZY_SHARE, FUZZY_WEIGHT = 0.9, 2
STEMS = range(4, 9)
FUZZY_FROM = 5
WINDOW = 80
THRESHOLD = 0.3
#: Words that say another's words follow; quotation marks that open and close.
REPORTS = re.compile(r"\b(said|says|wrote|writes|quote|quoted|called|so-called|citing|cited|sagte|schrieb|zitat|dijo|escribió|dit|écrit)\b")
OPEN, CLOSE = "\"“«„‹", "\"”»“›"
#: Prior weights: intercept, strongest plain evidence, log of plain hits, strongest quoted evidence, log of misspelled hits.
PRIOR = np.array([-3.0, 1.0, 0.3, 0.4, 0.1])
REMEMBERED = 300_000


def held_out(doc_id) -> F.Column:
    """True for ids whose crc32, as text, leaves 2 when divided by 4; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


class Automaton:
    """Word -> (term, edits) over a trie of words and stems; stems match without edits, short words too."""

    DEAD = -1

    def __init__(self, words: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word_at: dict[int, str] = {}
        self.stem_at: dict[int, str] = {}
        self.fuzzy: set[int] = set()  # nodes on the way to a word that may be misspelled
        for term in words:
            path = self._add(term)
            self.word_at[path[-1]] = term
            if len(term) >= FUZZY_FROM:
                self.fuzzy.update(path)
        for term in stems:
            self.stem_at[self._add(term)[-1]] = f"{term}*"
        self.states: dict[frozenset, int] = {}
        self.made: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.stem_of: list[str | None] = []
        self.letters = {c for level in self.children for c in level}
        self.start = self._state(self._closed({(0, 0)}))

    def _add(self, term: str) -> list[int]:
        node, path = 0, [0]
        for c in term:
            if c not in self.children[node]:
                self.children.append({})
                self.children[node][c] = len(self.children) - 1
            node = self.children[node][c]
            path.append(node)
        return path

    def _closed(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With the states where a letter of the term is left out."""
        more = {(child, 1) for node, edits in pairs if edits == 0 for child in self.children[node].values() if child in self.fuzzy}
        return frozenset(pairs | more)

    def _state(self, pairs: frozenset) -> int:
        if not pairs:
            return self.DEAD
        if pairs not in self.states:
            self.states[pairs] = len(self.made)
            self.made.append(pairs)
            self.moves.append({})
            stems = [self.stem_at[n] for n, edits in pairs if edits == 0 and n in self.stem_at]
            self.stem_of.append(stems[0] if stems else None)
        return self.states[pairs]

    def _move(self, state: int, letter: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, edits in self.made[state]:
            if letter in self.children[node]:
                child = self.children[node][letter]
                if edits == 0 or child in self.fuzzy:
                    out.add((child, edits))
            if edits == 0 and node in self.fuzzy:
                out.add((node, 1))  # a letter too many
                out.update((child, 1) for child in self.children[node].values() if child in self.fuzzy)  # another letter
        self.moves[state][letter] = to = self._state(self._closed(out))
        return to

    def find(self, word: str) -> list[tuple[str, int]]:
        """Terms that the word is: the term itself, a term with one edit, or the longest stem that it begins with."""
        state, stem = self.start, None
        for letter in word:
            letter = letter if letter in self.letters else "\0"
            to = self.moves[state].get(letter)
            state = self._move(state, letter) if to is None else to
            if state == self.DEAD:
                break
            stem = self.stem_of[state] or stem
        found = [] if state == self.DEAD else [(self.word_at[n], edits) for n, edits in self.made[state] if n in self.word_at]
        if exact := [x for x in found if x[1] == 0]:
            return exact
        if stem:
            return [(stem, 0)]
        return sorted({(term, 1) for term, edits in found if len(term) >= FUZZY_FROM})[:1]


@dataclass
class Model:
    """share: (term, edits) -> smoothed share of toxic contexts; weights: of the features."""

    share: dict[tuple[str, int], float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self):
        terms = {t for t, _ in self.share}
        self.automaton = Automaton(sorted(t for t in terms if not t.endswith("*")), sorted(t[:-1] for t in terms if t.endswith("*")))
        self.seen: dict[str, tuple[tuple[str, int], float] | None] = {}

    def hit(self, word: str) -> tuple[tuple[str, int], float] | None:
        if word not in self.seen:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            found = self.automaton.find(word)
            self.seen[word] = None
            if found:
                p = self.share.get(found[0], FUZZY_SHARE)
                self.seen[word] = (found[0], math.log(p / (1 - p)))
        return self.seen[word]

    def features(self, text: str) -> np.ndarray:
        low = text.lower()
        words = set(WORD.findall(low))
        hits = {w: h for w in words if (h := self.hit(w))}
        plain = quoted = 0.0
        n = fuzzy = 0
        if hits:
            for m in re.finditer(r"[^\W_]+", low):
                if (h := hits.get(m[0])) is None:
                    continue
                (_, edits), evidence = h
                if is_quoted(low, m.start(), m.end()):
                    quoted = max(quoted, evidence)
                elif evidence > 0:
                    plain = max(plain, evidence)
                    n += edits == 0
                    fuzzy += edits > 0
        return np.array([1.0, plain, math.log1p(n), quoted, math.log1p(fuzzy)])

    def score(self, text: str) -> float:
        return float(1 / (1 + math.exp(-np.clip(self.features(text) @ self.weights, -30, 30))))


def is_quoted(text: str, start: int, end: int) -> bool:
    """Whether the window around a hit opens a quotation before it and closes it after it, or reports another's words."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    before = before[before.rfind("\n") + 1 :]
    after = after.split("\n", 1)[0]
    for a, b in zip(OPEN, CLOSE):
        if a == b:
            opened = before.count(a) % 2 == 1
        else:
            opened = before.rfind(a) > before.rfind(b)
        if opened and b in after:
            return True
    return bool(REPORTS.search(before[-30:]))


def _terms(word: str) -> list[str]:
    return [word] * (len(word) >= 3) + [f"{word[:k]}*" for k in STEMS if k < len(word)]


def _contexts(rows: DataFrame, wanted: set[str] | None) -> dict[str, int]:
    """Term -> distinct contexts in the texts of rows(text), for all terms or the wanted ones."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        import xxhash

        keep, seen = shared.value, set()
        for text in batch.column("text").to_pylist():
            words = WORD.findall((text or "").lower())
            for a, w, b in zip(["", *words], words, [*words[1:], ""]):
                own = [t for t in _terms(w) if keep is None or t in keep]
                if own:
                    h = xxhash.xxh64_intdigest(f"{a} {w} {b}") >> 1
                    seen.update((t, h) for t in own)
        terms, marks = zip(*sorted(seen)) if seen else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(marks, pa.int64())], names=["term", "context"])

    pairs = per_batch(rows.select("text"), run, "term string, context long").distinct()
    counts = pairs.groupBy("term").agg(F.count("*").alias("n"))
    if wanted is None:
        counts = counts.where(F.col("n") >= MIN_CONTEXTS)
    return {r.term: r.n for r in counts.collect()}  # bounded by the sample


def choose(toxic: dict[str, int], other: dict[str, int]) -> dict[tuple[str, int], float]:
    """The lexicon: terms whose contexts are toxic ones beyond what longer chosen terms explain."""
    explained: tuple[Counter, Counter] = (Counter(), Counter())
    chosen: dict[str, tuple[int, int]] = {}
    for term in sorted(toxic, key=lambda t: (t.endswith("*"), -len(t), t)):
        a, b = toxic[term] - explained[0][term], other.get(term, 0) - explained[1][term]
        if a >= MIN_CONTEXTS and a / max(1, a + b) >= MIN_SHARE:
            chosen[term] = (a, max(0, b))
            bare = term.rstrip("*")
            for k in STEMS:
                if k < len(bare):
                    explained[0][f"{bare[:k]}*"] += a
                    explained[1][f"{bare[:k]}*"] += max(0, b)
    return {(t, 0): (a + 0.5) / (a + b + 1) for t, (a, b) in chosen.items()}


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, pull: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression over rows that count n times, which pays `pull` for each squared step from PRIOR."""
    w = PRIOR.copy()
    n = np.ones(len(y)) if n is None else n
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + pull * (w - PRIOR)
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    w[1:] = np.maximum(w[1:], 0)
    return w


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, toxic), never from rows held out.

    Labels that are null, or whose doc_id is null or unknown, teach nothing; of several labels for one id
    the highest counts. Without a toxic row every score is the prior's.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = text_column(docs.where("doc_id IS NOT NULL").select("doc_id", "text"))
    rows = written(texts.join(F.broadcast(ids), "doc_id").select("text", "label"), "labelled")  # ids: sample_rows at most
    toxic = _contexts(rows.where("label = 1"), None)
    other = _contexts(rows.where("label = 0"), set(toxic))
    share = choose(toxic, other)
    model = Model(share)
    model.share |= _misspelled(rows, model)
    points = _features(rows, model)
    y, n = points[:, 0], points[:, 1]
    if len(y) and 0 < y.sum() < len(y):
        model = Model(model.share, fit(points[:, 2:], y, n))
    return Model(model.share, model.weights)


def _misspelled(rows: DataFrame, model: Model) -> dict[tuple[str, int], float]:
    """Shares for terms with one edit: contexts of the misspelled words, drawn to FUZZY_SHARE."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], set] = defaultdict(set)
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            for w in set(WORD.findall((text or "").lower())):
                if (h := shared.value.hit(w)) and h[0][1]:
                    seen[(h[0][0], label)].add(w)
        flat = [(t, y, w) for (t, y), own in seen.items() for w in sorted(own)]
        yield pa.RecordBatch.from_pydict({"term": pa.array([x[0] for x in flat], pa.string()), "label": pa.array([x[1] for x in flat], pa.int32()), "word": pa.array([x[2] for x in flat], pa.string())})

    words = per_batch(rows, run, "term string, label int, word string").distinct()
    counts = words.groupBy("term").agg(F.sum("label").alias("a"), F.count("*").alias("n")).collect()  # bounded by the sample
    return {(r.term, 1): (r.a + FUZZY_WEIGHT * FUZZY_SHARE) / (r.n + FUZZY_WEIGHT) for r in counts}


def _features(rows: DataFrame, model: Model) -> np.ndarray:
    """Rows of label, count and features: how many different texts of the sample have them."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = [shared.value.features(t or "").tolist() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("key"), pa.array(x, pa.list_(pa.float64()))], names=["label", "key", "x"])

    keyed = rows.select("label", F.xxhash64("text").alias("key"), "text")
    found = per_batch(keyed, run, "label int, key long, x array<double>").distinct().groupBy("label", "x").agg(F.count("*").alias("n")).toPandas()  # sample_rows at most
    return np.array([[r.label, r.n, *r.x] for r in found.itertuples()]).reshape(-1, 2 + len(PRIOR))


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text, ...).

    Null counts as empty: no hit, so the intercept's score. Repeated rows keep their rows; a null doc_id
    is not held out. Extra columns are not read.
    """
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        s = [shared.value.score(t or "") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    found = per_batch(text_column(docs.select("doc_id", "text")), run, f"doc_id {kind}, score double")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score `threshold` or more; columns and other rows unchanged, nothing shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batch: pa.RecordBatch) -> np.ndarray:
        texts = batch.column("text").cast(pa.string()).to_pylist()
        return np.array([shared.value.score(t or "") < threshold for t in texts])

    return kept_rows(docs, keep)

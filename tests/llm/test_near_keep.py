"""The pipeline's near-dedup stage, with its own settings, against similarities that are computed here."""

import random

import numpy as np
import pytest

from lodeseek.llm import near_sets

COLUMNS = "doc_id long, text string, row int, band string, `a.b` double"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    kept = []
    for d, t in sorted({(d, t or "") for d, t in rows if d is not None}):
        s = shingles(t)
        if not any(similarity(s, x) >= 0.8 for _, x in kept):
            kept.append((d, s))
    return [d for d, _ in kept]


def edited(text, n, r):
    """A word replaced in n places, and sometimes a piece cut off or put in front."""
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
    if r.random() < 0.3:
        w = w[len(w) // r.choice((9, 12, 40)) :]
    return " ".join(w)


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, i, "x", 0.5) for i, (d, t) in enumerate(rows)], COLUMNS).repartition(5)
    got = near_sets.keep_first(docs)
    assert got.columns == docs.columns
    return sorted(x.doc_id for x in got.collect() if x.doc_id is not None)


def test_against_brute_force(spark):
    r = random.Random(3)
    base = [" ".join(f"v{r.randrange(900)}" for _ in range(n)) for n in (300, 250, 400, 90, 40, 12)]
    texts = [edited(b, n, r) for b in base for n in (0, 1, 1, 2, 3, 4, 6, 9, 14, 40)] + ["", None, " \t", "one two", "ONE two", "one three", base[0], "long word " * 60_000]
    r.shuffle(texts)
    rows = list(enumerate(texts)) + [(None, base[1]), (None, None), (0, texts[0]), (3, base[2]), (5, texts[5])]
    want = brute(rows)
    assert run(spark, rows) == want
    assert len(want) < len(rows) - 20


def test_recall_at_the_threshold(spark):
    """Pairs a little over 0.8, far beyond what two or three fingerprint bits reach: all but a fiftieth are found, and nothing else goes."""
    r = random.Random(8)
    rows, goes = [], set()
    for i in range(150):
        words = [f"p{i}x{k}" for k in range(200)]
        other = list(words)
        for k in r.sample(range(40), 4):
            other[5 * k] = f"q{i}x{k}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        if similarity(shingles(rows[-2][1]), shingles(rows[-1][1])) >= 0.8:
            goes.add(2 * i + 1)
    far = [(1000 + i, " ".join([f"p{i}x{k}" for k in range(170)] + [f"z{i}x{k}" for k in range(30)])) for i in range(50)]
    far = [x for x in far if similarity(shingles(x[1]), shingles(rows[2 * (x[0] - 1000)][1])) < 0.8]
    gone = {d for d, _ in rows + far} - set(run(spark, rows + far))
    assert len(goes) > 100 and len(far) > 40
    assert gone <= goes and len(gone) >= 0.98 * len(goes)


def test_a_large_group(spark, monkeypatch):
    r = random.Random(4)
    base = " ".join(f"v{r.randrange(900)}" for _ in range(200))
    rows = [(i, edited(base, r.randrange(9), r)) for i in range(150)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, "x"), (None, None)], [(1, None)]])
def test_few_rows(spark, rows):
    assert run(spark, rows) == [d for d, _ in rows if d is not None]


def test_minima_estimate_similarity():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 4000).astype(np.uint64)
    b = np.concatenate([a[:3600], r.integers(0, 1 << 63, 400).astype(np.uint64)])
    assert abs((near_sets.minima(a) == near_sets.minima(b)).mean() - 3600 / 4400) < 0.12

"""Substring dedup against a brute-force version."""

import random

import pytest
from pyspark.sql import functions as F

from lodeseek.llm import substring_dedup


def brute(rows, window):
    first = {}
    for doc_id, text in rows:
        words = (text or "").split()
        for i in range(len(words) - window + 1):
            if doc_id is not None:
                first[tuple(words[i : i + window])] = min(doc_id, first.get(tuple(words[i : i + window]), doc_id))
    out = []
    for doc_id, text in rows:
        words = (text or "").split()
        gone = set()
        for i in range(len(words) - window + 1):
            if doc_id is not None and first[tuple(words[i : i + window])] < doc_id:
                gone.update(range(i, i + window))
        out.append((doc_id, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=str)


def corpus(seed, n=60, longest=200):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") * r.randrange(1, 4)
    passages = [[word() for _ in range(r.randrange(8, 60))] for _ in range(6)]
    rows = []
    for d in range(n):
        words = [word() for _ in range(r.randrange(longest))]
        for _ in range(r.randrange(4)):
            at = r.randrange(len(words) + 1)
            words[at:at] = r.choice(passages)
        rows.append((d, " ".join(words)))
    rows += [(100 + k, rows[k][1]) for k in range(10)] + [(200, "x " * 120), (201, "x " * 90), (202, "x y " * 70), (203, "y x " * 70)]
    rows += [(300, None), (301, ""), (302, " \n "), (None, rows[3][1]), (None, None), (5, rows[6][1]), (5, rows[6][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,window,gram,capacity,shard_words", [(1, 12, 4, 1024, 1 << 17), (2, 12, 4, 2, 300), (3, 50, 8, 8, 2000), (4, 5, 8, 3, 50)])
def test_as_brute_force(spark, seed, window, gram, capacity, shard_words):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*x, "extra", 1) for x in rows], "doc_id long, text string, removed string, seg long").repartition(5)
    found = substring_dedup.dedup(docs, window, gram, capacity, shard_words).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found), key=str) == brute(rows, window)
    assert all(sum(x.end - x.start for x in r.removed) == r.n_removed for r in found)


def test_minimizers_cover_every_window():
    r = random.Random(7)
    words = [r.choice([b"a", b"b", b"cc"]) for _ in range(400)]
    _, _, begin, size = substring_dedup.anchors_of(words, 50, 8)
    spans = [(int(b), int(b + n)) for b, n in zip(begin, size)]
    assert all(any(b <= i and i + 50 <= e for b, e in spans) for i in range(351))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.dedup(docs).count() == 0


def test_long_text(spark):
    text = " ".join(f"w{k}" for k in range(60_000))
    docs = spark.createDataFrame([(1, text), (2, f"start {text} end")], "doc_id long, text string")
    found = {r.doc_id: r for r in substring_dedup.dedup(docs).select("doc_id", "n_removed", F.length("kept").alias("n"), "kept").collect()}
    assert found[1].n_removed == 0 and found[2].n_removed == 60_000 and found[2].kept == "start end"

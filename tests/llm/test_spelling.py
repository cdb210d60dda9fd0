import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from __spark_entry__ import SMALLEST
from lodeseek.llm import queries, spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words):
    out = {}
    for w, n in words.items():
        near = [x for x in words if abs(len(x) - len(w)) < 2 and one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= 5 * n else None
        out[w] = form, n, len(near), words[form] if form else None
    rows = []
    for w, (form, n, near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, near, form_n))
    return sorted(rows)


def check(spark, words, **options):
    rows = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    found = spelling.groups(rows, **options)
    assert sorted(map(tuple, found.select("word", "form", "root", "n", "n_near", "form_n").collect())) == brute(words)


def family(r, alphabet, n, length):
    """Random words with edits of edits, so that there are chains and ties."""
    words = {"".join(r.choices(alphabet, k=r.randrange(6, length))) for _ in range(n)}
    for _ in range(2):
        for w in list(words):
            k = r.randrange(len(w))
            for x in (w[:k] + r.choice(alphabet) + w[k + 1 :], w[:k] + r.choice(alphabet) + w[k:], w[:k] + w[k + 1 :]):
                if len(x) >= 6:
                    words.add(x)
    return {w: r.choice((1, 2, 5, 25, 125, 125, 700)) for w in sorted(words)}


@pytest.mark.parametrize("capacity", [2, 7, 64])
def test_groups_as_brute_force(spark, capacity):
    """Few letters make crowded blocks, which a small capacity subdivides down to one open letter."""
    r = random.Random(capacity)
    check(spark, family(r, "abé", 60, 9) | family(r, "abcdeßñ", 40, 16), capacity=capacity)


def test_skewed_block(spark):
    """One block of two thirds of all words: the same first and last letters."""
    r = random.Random(3)
    words = {f"prefix{''.join(r.choices('abcd', k=5))}suffix": r.randrange(1, 300) for _ in range(400)} | family(r, "xyz", 20, 9)
    check(spark, words, capacity=8)


def test_blocks_stay_small(spark):
    words = [(f"prefix{a}{b}{c}tail", 5) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    rows = spelling.blocks(spark.createDataFrame(words, "word string, n long"), 16).groupBy("m", "i", "j", "block").count().collect()
    assert all(r["count"] <= 16 or r.m - r.i - r.j <= 1 for r in rows)


def test_long_words(spark):
    long = "ab" * 40_000
    check(spark, {long: 5, long[:-1]: 30, long[1:]: 200, long + "c": 1, "abcdef": 5, "abcdeg": 25, "abcdefg": 1})


def test_chain_and_ties(spark):
    check(spark, {"aaaaaa": 1, "aaaaab": 5, "aaaabb": 25, "aaabbb": 125, "aabbbb": 625, "abbbbb": 3125, "aaaaac": 5, "zzzzzz": 1, "zzzzzy": 4})


def counted(rows):
    out = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 5}


def test_word_counts(spark):
    r = random.Random(1)
    names = ["".join(r.choices("abcdeABÉé", k=r.randrange(3, 10))) for _ in range(60)]
    rows = [(i, "".join(r.choice(names) + r.choice((" ", ", ", "1", "\n", "_", "ā")) for _ in range(r.randrange(90)))) for i in range(120)]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, "nullid nullid nullid nullid nullid"), (None, None), (500, ""), (501, "long " * 10 + "Endless " * 60_000)]
    docs = spark.createDataFrame([(d, t, "w", 4) for d, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    expected = counted(rows)
    assert {x.word: x.n for x in spelling.word_counts(docs).collect()} == expected
    found = spelling.variants(docs)
    assert sorted(map(tuple, found.select("word", "form", "root", "n", "n_near", "form_n").collect())) == brute(expected)
    spoiled = [(d, w) for d in range(400) for w in names if spelling.spoilt(str(d), w, 199) != w]
    assert spoiled  # the hash does reach words


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (None, "short words only")], "doc_id long, text string")).count() == 0


def test_query_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALLEST}/documents.parquet')")
    mine = queries.op12_spelling_variants(spark, SMALLEST)
    theirs = con.execute(queries.ORACLE_SQL["op12_spelling_variants"])
    names = [c[0] for c in theirs.description]
    assert sorted(map(repr, (tuple(r) for r in mine.select(*names).collect()))) == sorted(map(repr, theirs.fetchall()))

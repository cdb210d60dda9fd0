import random

from lodeseek.llm import decontaminate
from tests.llm.test_decontaminate import frames, sample, split


def brute(text, bench, window):
    """{start: words of the longest match from there}, over all places of all items."""
    w, out = split(text), {}
    for _, t in bench:
        own = split(t)
        k = min(window, len(own))
        for i in range(len(own) - k + 1 if k else 0):
            for j in range(len(w) - k + 1):
                n = 0
                while n < min(len(own) - i, len(w) - j) and own[i + n] == w[j + n]:
                    n += 1
                if n >= k:
                    out[j] = max(out.get(j, 0), n)
    return out


def held(spark, docs, bench, window, block_bytes):
    d, b = frames(spark, docs, bench)
    texts = dict(docs)
    for row in decontaminate.matches(d, b, window, block_bytes).collect():
        assert {m.start: m.length for m in row.matches} == brute(texts[row.doc_id], bench, window)
        assert len({m.start for m in row.matches}) == len(row.matches)
        w = split(texts[row.doc_id])
        for m in row.matches:
            named = [split(t) for n, t in bench if ("" if n is None else str(n)) == m.item_id]
            assert any(w[m.start : m.start + m.length] == own[m.item_start : m.item_start + m.length] for own in named)


def test_longest_of_two_items(spark):
    run = " ".join(f"w{i}" for i in range(30))
    docs = [(1, f"zz {run} zz")]
    for bench in ([(1, " ".join(run.split()[:10]) + " aa bb"), (2, run)], [(2, run), (1, " ".join(run.split()[:10]) + " aa bb")]):
        d, b = frames(spark, docs, bench)
        found = decontaminate.matches(d, b).first().matches
        assert [(m.start, m.length, m.item_id, m.item_start) for m in found] == [(i + 1, 30 - i, "2", i) for i in range(21)]


def test_no_longer_match_exists(spark):
    docs, bench = sample()
    docs = [(i, t) for i, t in docs[:-2] if i is not None]
    held(spark, docs, bench, 10, 1 << 20)
    held(spark, docs, bench, 10, 100)
    r = random.Random(5)
    say = lambda n, letters: " ".join(r.choice(letters) for _ in range(n))
    bench = [(i, say(r.randrange(40), "ab" if i % 2 else "abc")) for i in range(25)] + [(90, "a " * 70), (91, "a b " * 30), (92, None), (93, "a b " * 30)]
    docs = [(i, say(r.randrange(120), "ab" if i % 3 else "abcd")) for i in range(40)] + [(90, "a " * 100), (91, "b a " * 50 + "x " + "a " * 33), (92, None), (93, "")]
    for window in (1, 3, 10):
        held(spark, docs, bench, window, 1 << 20)
    held(spark, docs, bench, 3, 60)

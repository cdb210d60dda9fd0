import hashlib
import random
import re

from lodeseek.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, bench, window=10):
    out = []
    for d, t in docs:
        w, hit, items = split(t), set(), set()
        for name, text in bench:
            own = split(text)
            k = min(window, len(own))
            for i in range(len(own) - k + 1 if k else 0):
                for j in range(len(w) - k + 1):
                    if w[j : j + k] == own[i : i + k]:
                        hit |= {*range(j, j + k)}
                        items.add("" if name is None else str(name))
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def sample():
    r = random.Random(8)
    vocab = ["Alpha", "beta", "gámma", "δ", "x1", "y", "z9", "q"]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    bench = [(1, say(30)), (10, say(14)), (2, "only three Words"), (3, ""), (4, None), (5, "... !"), (None, say(12)), (1, say(11))]
    docs = [(0, None), (1, ""), (2, "no match here"), (3, "say ONLY three-words now"), (None, bench[1][1])]
    for i in range(60):
        src = split(r.choice([b for b in bench if b[1]])[1])
        cut = src[r.randrange(0, 3) : r.randrange(8, 40)]
        docs.append((10 + i, say(r.randrange(30)) + ", " + "-".join(cut).upper() + "\n" + say(5)))
    docs += [docs[-1], (200, say(3000) + " " + bench[0][1] + " " + bench[0][1])]
    return docs, bench


def frames(spark, docs, bench):
    d = spark.createDataFrame([(a, b, "m") for a, b in docs], "doc_id long, text string, matches string").repartition(4)
    return d, spark.createDataFrame([(a, b, "n") for a, b in bench], "item_id long, text string, doc_id string")


def test_report_against_brute_force(spark):
    docs, bench = sample()
    d, b = frames(spark, docs, bench)
    want = brute(docs, bench)
    assert sorted((tuple(x) for x in decontaminate.report(d, b).collect()), key=str) == want
    assert sorted((tuple(x) for x in decontaminate.report(d, b, block_bytes=100).collect()), key=str) == want


def test_matches_are_longest(spark):
    docs, bench = sample()
    d, b = frames(spark, docs, bench)
    texts = {}
    for i, t in docs:
        texts.setdefault(i, []).append(split(t))
    for row in decontaminate.matches(d, b).collect():
        for m in row.matches:
            items = [split(t) for n, t in bench if ("" if n is None else str(n)) == m.item_id]
            w = next(w for w in texts[row.doc_id] if len(w) == row.n_words)
            assert any(w[m.start : m.start + m.length] == own[m.item_start : m.item_start + m.length] for own in items)


def test_clean(spark):
    docs, bench = sample()
    d, b = frames(spark, docs, bench)
    bad = {x[0] for x in brute(docs, bench) if x[5]}
    for size in (1 << 20, 100):
        got = decontaminate.clean(d, b, block_bytes=size)
        assert got.columns == d.columns
        assert sorted(str(x.doc_id) for x in got.collect()) == sorted(str(i) for i, _ in docs if i not in bad)


def test_empty(spark):
    docs, bench = sample()
    d, b = frames(spark, docs, bench)
    assert decontaminate.report(d.limit(0), b).count() == 0
    assert decontaminate.report(d, b.limit(0)).where("contaminated").count() == 0
    assert decontaminate.clean(d, b.limit(0)).count() == len(docs)

import random

from lodeseek.llm import simhash


def links(a, b, bits=7, least=0.8):
    fa, fb = (simhash.fingerprint(x.encode()) for x in (a, b))
    words = [x.lower().split() for x in (a, b)]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    alike = len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1
    return bin(fa ^ fb).count("1") <= bits and alike >= least


def brute(rows):
    kept = []
    for d, t in sorted({(d, t or "") for d, t in rows if d is not None}):
        if not any(links(t, x) for _, x in kept):
            kept.append((d, t))
    return [d for d, _ in kept]


def edited(text, n, r):
    words = text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, shingles int").repartition(5)
    got = simhash.keep_first(docs, similarity=0.8, max_distance=7, pieces=4)
    assert got.columns == docs.columns
    return sorted(x.doc_id for x in got.collect() if x.doc_id is not None)


def test_near_copies_against_brute_force(spark):
    r = random.Random(3)
    base = [" ".join(f"v{r.randrange(900)}" for _ in range(n)) for n in (300, 250, 400, 90)]
    texts = [edited(b, n, r) for b in base for n in (0, 1, 1, 2, 3, 4, 6, 12, 40)] + ["", None, " \t", "one two", "ONE two", "one three", base[0]]
    r.shuffle(texts)
    rows = list(enumerate(texts)) + [(None, base[1]), (0, texts[0]), (3, base[2])]
    assert run(spark, rows) == brute(rows)
    assert len(brute(rows)) < len(rows) - 15


def test_a_component_over_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HEADS", 3)
    r = random.Random(4)
    base = " ".join(f"v{r.randrange(900)}" for _ in range(200))
    rows = [(i, edited(base, r.randrange(12), r)) for i in range(60)]
    assert run(spark, rows) == brute(rows)
    assert 3 < len(brute(rows)) < 60


def test_no_rows(spark):
    assert run(spark, []) == []

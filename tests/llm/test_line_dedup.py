import random

from lodeseek.llm import line_dedup


def brute(rows, min_words=3):
    """Every document against the first holder of each of its rare lines, one after another."""
    docs = sorted({(d, t) for d, t in rows if d is not None and t is not None}, key=lambda x: x[0])
    split = lambda t: [x.strip() for x in t.split("\n")]
    gone = {}
    for d, t in docs:
        mine = split(t)
        firsts = set()
        for line in mine:
            if mine.count(line) == 1 and len(line.split()) >= min_words:
                for d2, t2 in docs:
                    if split(t2).count(line) == 1:
                        if (d2, t2) != (d, t):
                            firsts.add((d2, t2))
                        break
        cut = set()
        for _, t2 in firsts:
            a = [line_dedup.line_key(x) for x in split(t2)]
            b = [line_dedup.line_key(x) for x in mine]
            run, last = [], (-2, -2)
            for i, j in [*line_dedup.patience(a, b), (-5, -5)]:
                if (i, j) != (last[0] + 1, last[1] + 1):
                    if sum(len(mine[k].split()) for k in run) >= min_words:
                        cut |= set(run)
                    run = []
                run.append(j)
                last = (i, j)
        gone[d, t] = cut
    out = []
    for d, t in rows:
        if d is None or t is None:
            out.append((d, t, 0))
        else:
            cut = gone[d, t]
            out.append((d, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut), len(cut)))
    return sorted(out, key=str)


def lines(r, n):
    return ["".join(r.choices("abc", k=6)) + " " + " ".join(r.choices("defgh", k=r.randrange(0, 5))) for _ in range(n)]


def test_patience_is_an_alignment():
    r = random.Random(3)
    for _ in range(500):
        a, b = ([r.randrange(12) for _ in range(r.randrange(15))] for _ in range(2))
        out = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in out)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(out, out[1:]))
        assert len(line_dedup.patience(a, a)) == len(a)


def test_finds_a_moved_block():
    a = [1, 2, 3, 4, 5, 6]
    b = [9, 2, 3, 4, 8, 7, 6]
    assert line_dedup.patience(a, b) == [(1, 1), (2, 2), (3, 3), (5, 6)]


def test_against_brute_force(spark):
    r = random.Random(4)
    pool = lines(r, 30)
    rows = [(None, pool[0]), (None, "\n".join(pool[:4])), (500, None), (501, ""), (502, "\n\n"), (503, "a  b  c")]
    texts = []
    for i in range(60):
        own = lines(r, r.randrange(1, 6))
        if r.random() < 0.6:
            k = r.randrange(len(pool) - 6)
            own[len(own) // 2 : len(own) // 2] = pool[k : k + r.randrange(1, 6)]
        if texts and r.random() < 0.3:
            own = r.choice(texts).split("\n") + own[:1]
        if r.random() < 0.3:
            own += [f"  {pool[3]}\t", pool[3]]
        texts.append("\n".join(own))
        rows.append((i, texts[-1]))
    rows += [rows[-1], rows[-1], (600, rows[-1][1]), (601, "\n".join(lines(r, 3000) + pool))]
    docs = spark.createDataFrame([(d, t, "x", 7) for d, t in rows], "doc_id long, text string, cut string, own_id int").repartition(5)
    got = line_dedup.dedup(docs)
    assert got.select("row.*").columns == docs.columns
    assert sorted(((x.row.doc_id, x.row.text, x.n_removed) for x in got.collect()), key=str) == brute(rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert line_dedup.cleaned(docs).count() == 0 and line_dedup.cleaned(docs).columns == docs.columns

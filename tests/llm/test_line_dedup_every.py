import random

from lodeseek.llm import line_dedup
from tests.llm.test_line_dedup import lines


def brute(rows, min_words=3):
    """{doc_id: places cut} of every document against every earlier one, ids unique."""
    seqs = {}
    for d, t in sorted(rows):
        own = t.split("\n")
        weights = [line_dedup.weight(x) for x in own]
        seqs[d] = (line_dedup.numbered([line_dedup.line_key(x) for x in own], weights, min_words), weights)
    out = {}
    for d, (mine, weights) in seqs.items():
        out[d] = {k for e, (other, _) in seqs.items() if e < d for k in line_dedup.common_blocks(other, mine, weights, min_words)}
    return out


def kept(rows, cut):
    return {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut[d]) for d, t in rows}


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return {x.row.doc_id: x.row.text for x in line_dedup.dedup(docs, first_only=False).collect()}


def test_every_block_is_in_runs():
    r = random.Random(8)
    for _ in range(300):
        n = r.randrange(1, 9)
        weights = [r.choice([0, 0, 1, 1, 2, 3, 5]) for _ in range(n)]
        spans = line_dedup.runs(list(range(n)), weights, 3)
        for a in range(n):
            for b in range(a + 1, n + 1):
                inside = {k for _, x, y in spans if a <= x and y <= b for k in range(x, y)}
                assert inside == (set(range(a, b)) if sum(weights[a:b]) >= 3 else set())


def test_later_holders(spark):
    one, two, three = "first long line here", "second long line here", "a third line of words"
    rows = [(1, f"{two}\n{one}"), (2, f"{one}\n{two}"), (3, f"{one}\n{two}"), (4, f"{three}\n{one}\n{two}")]
    got = found(spark, rows)
    assert got[3] == "" and got[4] == three and len(got[2].split("\n")) == 1
    assert got == kept(rows, brute(rows))


def test_repeated_and_short_lines(spark):
    twice = "\n".join(["a line of words", "b", "a line of words", "c"])
    verse = "roses\nare\nred\n\nviolets\nare\nblue"
    han = "\u5929\u5730\u7384\u9ec4\u5b87\u5b99\u6d2a\u8352"
    rows = [(1, twice), (2, f"{twice}\nown end of this"), (3, verse), (4, f"own start of this\n{verse}"), (5, han), (6, f"{han}\nx"), (7, "x\ny"), (8, "x\ny"), (9, "a\n\n" + twice)]
    got = found(spark, rows)
    assert got[2] == "own end of this" and got[4] == "own start of this" and got[6] == "x" and got[8] == "x\ny" and got[9] == "a\n"
    assert got == kept(rows, brute(rows))


def test_against_every_earlier_document(spark):
    r = random.Random(4)
    pool = lines(r, 30) + ["x", "", "y z", ""]
    rows = []
    for i in range(80):
        own = [y for y in lines(r, r.randrange(1, 6))]
        for _ in range(r.randrange(3)):
            k = r.randrange(len(pool) - 4)
            at = r.randrange(len(own))
            own[at:at] = pool[k : k + r.randrange(1, 6)]
        if rows and r.random() < 0.2:
            own = r.choice(rows)[1].split("\n") + own[: r.randrange(2)]
        rows.append((i, "\n".join(own)))
    assert found(spark, rows) == kept(rows, brute(rows))


def test_more_holders_than_rounds(spark):
    hot, other = "one very common line", "another very common line"
    rows = [(i, f"{hot}\nown line number x{i}\n{other}") for i in range(40)] + [(50, f"{other}\nown line number x50\n{hot}"), (51, f"{other}\nown line number x51\n{hot}")]
    got = found(spark, rows)
    assert all(got[d] == f"own line number x{d}" for d in (*range(1, 40), 50, 51))

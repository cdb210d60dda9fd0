"""Lines that stand in other places everywhere, against an alignment and weights of its own."""

import random

import pytest

from lodeseek.llm import line_dedup


def size(line):
    return max(len(line.split()), len(line) // 16)


def align(a, b):
    """Patience diff of two lists of (place, line), written recursively."""
    if not a or not b:
        return []
    if a[0][1] == b[0][1]:
        return [(a[0][0], b[0][0]), *align(a[1:], b[1:])]
    if a[-1][1] == b[-1][1]:
        return [*align(a[:-1], b[:-1]), (a[-1][0], b[-1][0])]
    once = lambda s: [k for k, x in enumerate(s) if [y[1] for y in s].count(x[1]) == 1]
    pairs = [(i, j) for i in once(a) for j in once(b) if a[i][1] == b[j][1]]
    tails = []  # the smallest ends of rising chains by length, as patience sorting keeps them
    for i, j in pairs:
        n = next((n for n, chain in enumerate(tails) if chain[-1][1] >= j), len(tails))
        tails[n:n + 1] = [[*(tails[n - 1] if n else []), (i, j)]]
    out, i, j = [], 0, 0
    if not tails:
        return []
    for p, q in [*tails[-1], (len(a), len(b))]:
        out += align(a[i:p], b[j:q])
        if p < len(a):
            out.append((a[p][0], b[q][0]))
        i, j = p + 1, q + 1
    return out


def brute(rows, min_words=3):
    split, kept = {}, {}
    for d, t in sorted(rows):
        own, seen = [], {}
        for x in (y.strip() for y in t.split("\n")):
            seen[x] = seen.get(x, 0) + 1
            own.append((x, seen[x] if size(x) >= min_words else 1))
        gone = set()
        for other in split.values():
            both = set(own) & set(other)
            chosen = [[(k, x) for k, x in enumerate(s) if x in both] for s in (other, own)]
            block, last = [], None
            for p in [*align(*chosen), None]:
                if p is None or last is None or p != (last[0] + 1, last[1] + 1):
                    if sum(size(own[k][0]) for k in block) >= min_words:
                        gone |= set(block)
                    block = []
                if p:
                    block.append(p[1])
                last = p
        split[d] = own
        kept[d] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
    return kept


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return {x.row.doc_id: x.row.text for x in line_dedup.dedup(docs, first_only=False, moved=False).collect()}


ONE, TWO = "one very common line", "another very common line"


@pytest.mark.parametrize("n", [2, 40])
def test_crossed_lines_fare_alike(spark, n):
    rows = [(i, f"{ONE}\nown words of document x{i}\n{TWO}") for i in range(n)]
    rows += [(50, f"{TWO}\nown words of document x50\n{ONE}"), (51, f"{TWO}\nown words of document x51\n{ONE}")]
    got = found(spark, rows)
    assert got == brute(rows)
    assert len(got[50].split("\n")) == 2 and got[51] == "own words of document x51"


def test_no_holder_is_left_out(spark):
    """60 holders cross the last document; only one, far down the ranks, lets its line be cut."""
    marks = [f"mark number {i} of all" for i in range(90)]
    crossed = [(i, "\n".join([ONE, *marks[: 3 + i % 5], f"m{i}"])) for i in range(60)]
    last = (99, "\n".join([*marks[:7], f"own words here x{99}", ONE]))
    without = found(spark, [*crossed, last])
    assert without == brute([*crossed, last])
    assert without[99].endswith(ONE)
    rows = [*crossed, (80, f"{marks[70]}\n{ONE}"), last]
    got = found(spark, rows)
    assert got == brute(rows)
    assert got[99] == "own words here x99"


@pytest.mark.parametrize("rounds", [(1, 4, 16), (1, 2)])
def test_shuffled_lines(spark, monkeypatch, rounds):
    monkeypatch.setattr(line_dedup, "ROUNDS", rounds)
    monkeypatch.setattr(line_dedup, "HOLDERS", rounds[-1])
    r = random.Random(12)
    pool = [f"line {'abcdefgh'[i]} of pool" for i in range(8)] + ["", "x"]
    rows = [(i, "\n".join(y for x in r.sample(pool, r.randrange(2, 9)) for y in [x, f"o{i}"][: r.randrange(1, 3)])) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(20)]
    assert found(spark, rows) == brute(rows)


def test_split_holders(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PAIRS", 3)
    rows = [(i, f"{ONE}\nown words of document x{i}\n{TWO if i % 2 else ''}") for i in range(30)]
    assert found(spark, rows) == brute(rows)

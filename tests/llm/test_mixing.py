import hashlib
import random
import re
from fractions import Fraction

import duckdb

from __spark_entry__ import SMALLEST
from lodeseek.llm import mixing, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def goals(sizes, weights=(3, 1, 2), percent=150, most=2):
    """Targets by source as exact fractions: whoever is above most times the own size gives the excess to the rest."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, Fraction(percent * sum(sizes.values()), 100), set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > most * sizes[s]}
        for s in above or open_:
            target[s] = Fraction(most * sizes[s]) if above else share[s]
        left -= sum(target[s] for s in above)
        open_ -= above or open_
    return target


def brute(rows):
    rows = [(d, s, len(WORD.findall(t or "")), hashlib.md5((t or "" if d is None else str(d)).encode()).hexdigest()) for d, t, s in rows]
    sizes = {}
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
    target = {s: float(t) for s, t in goals(sizes).items()}

    def copies(s, x, seed):
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        return int(rate) + ((int(x[:8], 16) + seed * int(x[8:16], 16)) % 2**32 / 2**32 < rate - int(rate))

    seed = {s: min(range(32), key=lambda k: (abs(sum(n * copies(s, x, k) for _, y, n, x in rows if y == s) - target[s]), k)) for s in sizes}
    return [(d, n, sizes[s], target[s], n * copies(s, x, seed[s])) for d, s, n, x in rows]


def corpus():
    r = random.Random(2)
    text = lambda: r.choice((" ", "\n", "")) + "".join(r.choice(("ab", "é中", "x-y", "\x00")) + r.choice((" ", "\t\n", "\x0b", " ")) for _ in range(int(r.paretovariate(0.8)) % 900))
    rows = [(i, text(), r.choice(("hot", "hot", "hot", "Zeta", "alpha", "ärger", "\U0001f600", "￿", None, "")) if i % 3 else "hot") for i in range(400)]
    rows += [(400, None, "only null"), (401, "  \t\n " * 200, "only blank"), (402, "one", "one word"), (403, "w " * 200_000, "long"), (5, "twice", "alpha"), (5, "twice", "alpha"), (None, "no id", "alpha"), (None, "nor here", None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, 1.5, "x", 3) for d, t, s in rows], "doc_id long, text string, source string, target double, `a.b` string, part int").repartition(5)


def test_as_brute_force(spark):
    rows = corpus()
    found = mixing.mix(frame(spark, rows)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, brute(rows)))
    assert all(r.taken <= 2 * r.size for r in found)


def test_taken_words_come_near_the_targets(spark):
    found = queries.op13_source_mix(spark, SMALLEST.replace("0.001", "0.01")).groupBy("target", "source_size").sum("taken").collect()
    assert len(found) == 20
    for r in found:
        assert abs(r["sum(taken)"] - r.target) <= 0.02 * r.source_size


def test_emit(spark):
    rows = corpus()
    docs = frame(spark, rows)
    copies = mixing.emit(docs)
    assert copies.select("row.*").columns == docs.columns
    made = sorted(map(repr, ((r.row.doc_id, r.row.text, r.row.source) for r in copies.collect())))
    times = brute(rows)
    n = mixing.mix(docs).select("doc_id", "size", "n_copies").collect()
    assert len(made) == sum(r.n_copies for r in n)
    assert sum(len(WORD.findall(r.row.text or "")) for r in copies.collect()) == sum(t[4] for t in times)


def test_other_weights_and_limits(spark):
    rows = spark.createDataFrame([(f"s{i:03}", (i * 37) % 101) for i in range(300)], "source string, size long").repartition(7)
    for weights, percent, most in (((1,), 100, 1), ((5, 1), 250, 3), ((3, 1, 2), 500, 2), ((1, 1000), 90, 1), ((2, 1), 0, 1)):
        sizes = {r.source: r.size for r in rows.collect()}
        want = goals(sizes, weights, percent, most)
        got = {r.source: r.target for r in mixing.targets(rows, weights, percent, most).collect()}
        assert got == {s: float(t) for s, t in want.items()}


def test_empty(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    only = mixing.mix(frame(spark, [(1, None, None), (2, " ", "a")])).collect()
    assert [(r.size, r.target, r.taken) for r in only] == [(0, 0.0, 0)] * 2


def test_plan_is_native(spark):
    plan = mixing.mix(frame(spark, corpus()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALLEST}/documents.parquet')")
    mine = queries.op13_source_mix(spark, SMALLEST)
    theirs = con.execute(queries.ORACLE_SQL["op13_source_mix"])
    assert [c[0] for c in theirs.description] == mine.columns
    assert sorted(map(repr, (tuple(r) for r in mine.collect()))) == sorted(map(repr, theirs.fetchall()))

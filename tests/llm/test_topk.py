import math
import random

import numpy as np
from pyspark.sql import functions as F

from lodeseek.llm import topk


def brute(rows, k=5, every=5):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in fine if i % every == 0}:
        best = {}
        for i, v in fine:
            if i == q:
                for j, w in fine:
                    if j != q and len(w) == len(v):
                        s = sum(a * b for a, b in zip(v, w))
                        best[j] = max(best.get(j, s), s)
        for rank, (j, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.append((q, rank, j, s))
    return sorted(out)


def sample(n, d, seed):
    r = np.random.default_rng(seed)
    return [(i, (r.normal(size=d) / math.sqrt(d)).tolist()) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)


def test_against_brute_force(spark):
    rows = [(i, np.array(v, np.float32).tolist()) for i, v in sample(300, 64, 1)]
    rows += [(400, rows[3][1]), (401, rows[3][1]), (405, rows[3][1]), (10, rows[11][1]), (10, rows[10][1])]
    rows += [(500, None), (501, []), (502, [None] * 64), (503, [float("nan")] * 64), (504, [float("inf")] + [0.0] * 63), (None, rows[0][1]), (505, [0.5, 0.25]), (510, [0.25, 0.5]), (515, [0.0] * 64)]
    for block in (4096, 7):
        got = topk.top_k(frame(spark, rows), F.col("vec_id") % 5 == 0, block=block)
        assert sorted(tuple(x) for x in got.collect()) == brute(rows)


def test_bounds_hold_and_prune():
    r = random.Random(2)
    x = np.array([[r.gauss(0, 50) // 1 for _ in range(32)] for _ in range(200)])
    for borders in topk.levels(32):
        s = topk.statistics(x, borders)
        assert (s @ s.T + 1e-6 >= x @ x.T).all()
    one = topk.Search(np.arange(20), x[:20] * 4, 5)
    for at in range(0, 200, 20):
        one.add(np.arange(at, at + 20), x[at : at + 20] * (0.05 if at else 4))
    assert one.survived < one.compared / 2


def test_few_and_none(spark):
    assert topk.top_k(frame(spark, []), F.col("vec_id") % 5 == 0).count() == 0
    rows = sample(3, 5, 4)
    assert sorted(tuple(x) for x in topk.top_k(frame(spark, rows), F.col("vec_id") % 5 == 0).collect()) == brute([(i, np.array(v, np.float32).tolist()) for i, v in rows])


def test_ids_that_repeat_over_k_times_in_one_partition(spark):
    rows = [(i, np.array(v, np.float32).tolist()) for i, v in sample(60, 16, 6)]
    rows += [(401, rows[0][1])] * 30 + [(402, [2 * x for x in rows[5][1]])] * 12 + [(403, rows[k % 10][1]) for k in range(40)]
    random.Random(3).shuffle(rows)
    want = brute(rows)
    assert all(sum(x[0] == q for x in want) == 5 for q in range(0, 60, 5))
    for parts in (1, 4):
        got = topk.top_k(frame(spark, rows).repartition(parts), F.col("vec_id") % 5 == 0)
        assert sorted(tuple(x) for x in got.collect()) == want


def test_ids_that_repeat_over_steps():
    x = np.array([[float(k % 7), float(k % 5), 1.0, 2.0] for k in range(60)])
    names = np.array([k % 9 if k % 3 else 100 for k in range(60)])
    for step in (1, 4, 60):
        one = topk.Search(np.array([500]), np.array([[3.0, 2.0, 1.0, 1.0]]), 5)
        for at in range(0, 60, step):
            one.add(names[at : at + step], x[at : at + step])
        best = {}
        for n, s in zip(names.tolist(), (x @ np.array([3.0, 2.0, 1.0, 1.0])).tolist()):
            best[n] = max(best.get(n, s), s)
        want = sorted(best.items(), key=lambda y: (-y[1], y[0]))[:5]
        assert sorted(zip(*(a.tolist() for a in one.rows()[1:]))) == sorted((n, int(s)) for n, s in want)


def test_random_vectors_are_pruned(spark):
    """The table of random unit vectors, as the query reads it: well under half of the pairs come to an exact score."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("embedding IS NOT NULL").select("vec_id", "embedding").collect()
    ids = np.array([x.vec_id for x in rows])
    x = np.floor(256 * np.array([x.embedding for x in rows], np.float64))
    one = topk.Search(ids[ids % 50 == 0], x[ids % 50 == 0], 5)
    for at in range(0, len(ids), topk.STEP):
        one.add(ids[at : at + topk.STEP], x[at : at + topk.STEP])
    assert one.survived < one.compared / 5
    scores = (x[ids % 50 == 0] @ x.T).astype(np.int64)
    want = []
    for q, own in zip(ids[ids % 50 == 0].tolist(), scores):
        order = np.lexsort((ids, -own))
        want += [(q, int(ids[i]), int(own[i])) for i in [i for i in order if ids[i] != q][:5]]
    assert sorted(zip(*(a.tolist() for a in one.rows()))) == sorted(want)

import random

import numpy as np
import xxhash

from lodeseek.llm import simhash


def brute(rows, most=2):
    def fp(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").translate({i: " " for i in range(9, 14)}).split(" ")
        w = [x for x in w if x]
        if not w:
            return 0
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most and comp[i] != comp[j]:
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    low = {}
    for (d, _), c in zip(rows, comp):
        if d is not None:
            low[c] = min(low.get(c, d), d)
    return sorted(((d, f"{f:016x}", low.get(c)) for (d, _), f, c in zip(rows, fps, comp)), key=str)


def sample(n=120, seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.choice([1, 2, 3, 40, 200]))]
        rows.append((i, " ".join(w)))
        if i % 4 == 0:
            w[r.randrange(len(w))] = "Edited"
            rows.append((1000 + i, "\t".join(w)))
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (5003, rows[0][1]), (5003, rows[0][1]), (None, rows[0][1])]


def test_against_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, key int")
    got = simhash.near_dedup(df).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(rows)


def test_small_shards_split(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = {b ^ sum(1 << r.randrange(64) for _ in range(k)) & (2**64 - 1) for b in base for k in (0, 1, 2, 3, 4) for _ in range(40)}
    fps = np.array(sorted(fps), np.uint64)
    want = simhash.linked(fps, 2)
    edges = simhash.near_links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(3), capacity=16)
    from lodeseek.llm.components import components

    got = {int(np.int64(x.node).view(np.uint64)): x.root for x in components(edges).collect()}
    groups = {}
    for f, w in zip(fps.tolist(), want.tolist()):
        groups.setdefault(w, set()).add(f)
    mine = {}
    for f in fps.tolist():
        mine.setdefault(got.get(f, ("alone", f)), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_linked_is_transitive_closure():
    r = random.Random(9)
    fps = np.unique(np.array([r.getrandbits(10) << 20 for _ in range(150)], np.uint64))
    low = simhash.linked(fps, 1)
    for i, x in enumerate(fps.tolist()):
        for j, y in enumerate(fps.tolist()):
            if bin(x ^ y).count("1") <= 1:
                assert low[i] == low[j]
    assert all(low[np.flatnonzero(low == m)].min() == m and fps[low == m].min() == m for m in np.unique(low))


def test_overlapping_shells_cover_a_wider_band():
    r = random.Random(11)
    x = np.array([r.getrandbits(64) for _ in range(50)], np.uint64)
    y = x ^ np.uint64(1 << 3) ^ np.uint64(1 << 40)
    zero = np.zeros(len(x), np.uint64)
    for mask in simhash._ranges(2**64 - 1, 2):
        at, key, home = simhash.paths(y, zero, mask, 1, 4)
        _, own, _ = simhash.paths(x, zero, mask, 0, 4)
        for i in range(len(x)):
            assert own[i] in key[at == i]


def test_empty_table(spark):
    assert simhash.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_first(spark):
    rows = sample(40)
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, other int")
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns
    want = {d for d, _, c in brute(rows) if d == c and d is not None}
    ids = [x.doc_id for x in got.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert ids.count(None) == 1

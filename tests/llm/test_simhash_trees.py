"""The trees as the query uses them: what they prune, where they overlap, and that no pair is lost."""

import random

import numpy as np

from lodeseek.llm import simhash


def points(n, seed):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(n)]
    near = [b ^ sum(1 << k for k in r.sample(range(64), r.choice([1, 2]))) for b in base[: n // 4]]
    return np.array(sorted({*base, *near}), np.uint64)


def visits(fp, levels):
    """(tree, path, place in fp) of all shards that the points visit."""
    out = []
    for j, part in enumerate(simhash._ranges(2**64 - 1, simhash.PIECES)):
        at, key, home = simhash.paths(fp, np.full(len(fp), j + 1, np.uint64), part, simhash.MAX_DISTANCE // simhash.PIECES, levels, inward=True)
        out += [(j, k, i, h) for k, i, h in zip(key.tolist(), at.tolist(), home.tolist())]
    return out


def test_branches_are_pruned_and_borders_overlap():
    fp = points(4000, 1)
    levels = simhash.levels_for(len(fp), 64 // simhash.PIECES, 64)
    found = visits(fp, levels)
    assert simhash.MAX_DISTANCE // simhash.PIECES == 1
    away = sum(not h for *_, h in found)
    assert away > len(fp)  # boundary bands send points to the shard next to their own
    assert len(found) <= len(fp) * simhash.PIECES * (1 + levels)
    shards = len({x[:2] for x in found})
    assert len(found) / len(fp) < shards / 20  # of all shards a point visits few


def test_every_near_pair_meets():
    fp = points(3000, 2)
    for levels in (2, 5, 9, 32):
        shards = {}
        for j, k, i, _ in visits(fp, levels):
            shards.setdefault((j, k), set()).add(i)
        held = [set() for _ in fp]
        for name, own in shards.items():
            for i in own:
                held[i].add(name)
        pairs = [(i, k) for i in range(len(fp)) for k in range(i) if (int(fp[i]) ^ int(fp[k])).bit_count() <= 2] if levels == 2 else pairs
        assert len(pairs) > 700
        assert all(held[i] & held[k] for i, k in pairs)


def test_levels_grow_slowly():
    sizes = [simhash.levels_for(n, 32, simhash.CAPACITY) for n in (0, 1000, 10**5, 10**7, 10**9)]
    assert sizes == sorted(sizes) and sizes[0] == 2 and sizes[-1] < 30


def test_keep_first_keeps_different_texts_of_one_id(spark):
    a, b = "one two three four five six", "quite other words stand here now"
    docs = spark.createDataFrame([(1, a, 1), (5, a, 2), (5, b, 3), (7, b, 4), (7, b, 4)], "doc_id long, text string, text_key int")
    assert sorted(tuple(x) for x in simhash.keep_first(docs).collect()) == [(1, a, 1), (5, b, 3)]

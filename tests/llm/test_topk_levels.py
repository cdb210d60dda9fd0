import numpy as np

from lodeseek.llm import topk


def clustered(n, d, seed):
    """Vectors around few centres, whose neighbouring components are alike, as in signals."""
    r = np.random.default_rng(seed)
    smooth = np.repeat(r.normal(size=(20, d // 8)) * 60, 8, axis=1)
    return np.floor(smooth[r.integers(0, 20, n)] + r.normal(size=(n, d)) * 3)


def searched(x, n_queries):
    one = topk.Search(np.arange(n_queries), x[:n_queries], 5)
    for at in range(0, len(x), 256):
        one.add(np.arange(at, min(at + 256, len(x))), x[at : at + 256])
    exact = x[:n_queries] @ x.T
    exact[np.arange(n_queries), np.arange(n_queries)] = -np.inf
    want = [(q, v, exact[q, v]) for q in range(n_queries) for v in sorted(range(len(x)), key=lambda v: (-exact[q, v], v))[:5]]
    assert sorted(zip(*map(list, one.rows()))) == sorted(want)
    return one


def test_fewer_columns_than_the_dense_product():
    one = searched(clustered(2000, 64, 3), 40)
    assert one.columns < one.compared * 64 / 2 and one.survived < one.compared / 5


def test_random_vectors_are_exact_too():
    searched(np.floor(np.random.default_rng(4).normal(size=(1500, 64)) * 32), 30)
    for d in (1, 2, 3, 7, 8, 9, 17):
        searched(np.floor(np.random.default_rng(d).normal(size=(300, d)) * 32), 10)

"""The dictionary of the secret scan against a full sort, and all-letter candidates."""

import random

from lodeseek.llm import secret_scan


def test_most_frequent_words(spark):
    r = random.Random(6)
    rows = [(f"w{i}", min(1_000_000, int(r.paretovariate(0.6)))) for i in range(5000)]
    counts = spark.createDataFrame(rows, "word string, n long").repartition(7)
    for k in (0, 1, 50, 900, 4999, 9000):
        want = [w for w, _ in sorted(rows, key=lambda x: (-x[1], x[0]))[:k]]
        assert secret_scan._most_frequent(counts, k) == want
    assert secret_scan._most_frequent(counts.limit(0), 5) == []


def test_letters_alone_may_be_a_candidate():
    found = {t[a:b] for t in ["key qWeRtYuIoPaSdFgHjKlZ end", "a camelCaseName here", "alllowercaselettersonly"] for a, b, _ in secret_scan.candidates(t)}
    assert found == {"qWeRtYuIoPaSdFgHjKlZ"}

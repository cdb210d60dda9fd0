import pickle
import random
import time

from lodeseek.llm import decontaminate
from tests.llm.test_decontaminate import brute


def test_memory_is_linear_in_words(spark):
    r = random.Random(4)
    words = [f"w{r.randrange(3000)}" for _ in range(100_000)]
    item = " ".join(words)
    at = time.time()
    size = len(pickle.dumps(decontaminate.Suffixes([("a", item.encode())], 10)))
    assert size < 120 * len(words) and time.time() - at < 60
    docs = [(1, "some x " + " ".join(words[50_000:90_000]) + " end"), (2, item), (3, "w1 w2 " * 500), (4, " ".join(words[99_990:]))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {x.doc_id: x for x in decontaminate.matches(d, spark.createDataFrame([("a", item)], "item_id string, text string")).collect()}
    assert max(m.length for m in rows[1].matches) == 40_000 and len(rows[2].matches) == 99_991
    assert not rows[3].matches and [tuple(m) for m in rows[4].matches] == [(0, 10, "a", 99_990)]


def test_periodic_texts_and_shared_windows(spark):
    bench = [(1, "a " * 3000), (2, "a b " * 40), (3, "a a"), (4, "x y z"), (5, "x y z"), (6, "a " * 12 + "b")]
    docs = [(1, "a " * 2000), (2, "b a " * 30), (3, "x y z a a"), (4, "a"), (5, "a " * 9 + "b"), (6, "q x y z q")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    small = [(i, t[:60]) for i, t in docs]
    want = brute(small, [(i, t[:120]) for i, t in bench])
    got = decontaminate.report(spark.createDataFrame(small, d.schema), spark.createDataFrame([(i, t[:120]) for i, t in bench], b.schema)).collect()
    assert sorted((tuple(x) for x in got), key=str) == want
    assert {x.doc_id: x.n_items for x in decontaminate.report(d, b).collect()} == {1: 3, 2: 1, 3: 3, 4: 0, 5: 2, 6: 2}
    assert decontaminate.clean(d, b).select("doc_id").collect()[0][0] == 4

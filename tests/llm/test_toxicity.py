import random
import zlib

import pytest

from lodeseek.llm import toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_automaton_against_edit_distance():
    r = random.Random(6)
    terms = sorted({"".join(r.choices("abcd", k=r.randrange(3, 9))) for _ in range(40)})
    stems = ["zyxw", "dddd"]
    a = toxicity.Automaton(terms, stems)
    for _ in range(4000):
        w = "".join(r.choices("abcdz", k=r.randrange(1, 10)))
        if r.random() < 0.5:
            w = r.choice(terms)
            k = r.randrange(len(w))
            w = r.choice([w, w[:k] + w[k + 1 :], w[:k] + "z" + w[k:], w[:k] + "q" + w[k + 1 :]])
        got = a.find(w)
        near = sorted(t for t in terms if len(t) >= toxicity.FUZZY_FROM and edits(w, t) == 1)
        if w in terms:
            assert got == [(w, 0)]
        elif any(w.startswith(s) for s in stems):
            assert got[0][1] == 0
        elif near:
            assert got == [(near[0], 1)]
        else:
            assert got == []


def corpus(n=900, seed=1):
    r = random.Random(seed)
    vocab = ["".join(r.choices("aeionrst", k=r.randrange(2, 9))) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        w = r.choices(vocab, k=r.randrange(20, 120))
        y = int(r.random() < 0.15)
        if y:
            for _ in range(r.randrange(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(["Blargface", "grumptoad", "vexpod" + r.choice(["ing", "er", "olo", "ist", "ent"])]))
        docs.append((i, " ".join(w), "en"))
        labels.append((i, y, 1))
    return docs, labels


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    model = toxicity.train(d, spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, toxic int, text int"))
    return d, dict((i, y) for i, y, _ in labels), model


def test_held_out_accuracy(trained):
    d, labels, model = trained
    got = toxicity.scores(d, model).collect()
    own = [x for x in got if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got)
    right = sum(x.predicted == labels[x.doc_id] for x in own)
    assert right / len(own) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)


def test_misspelling_and_quotation(trained):
    _, _, model = trained
    plain, quoted = "you are a blargface there", "they wrote \"blargface\" there"
    assert model.score(plain) >= 0.3
    assert model.score("you are a blargfce there") > model.score("you are a tree there")
    assert model.score(quoted) < model.score(plain)


def test_accepted_keeps_clean_rows(trained, spark):
    d, labels, model = trained
    got = toxicity.accepted(d, model)
    assert got.columns == d.columns
    kept = {x.doc_id for x in got.collect()}
    assert len(kept ^ {i for i, y in labels.items() if not y}) < 0.03 * len(labels)


def test_odd_rows(trained, spark):
    _, _, model = trained
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "x " * 100_000, 3), (3, "blargface", 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, held_out int")
    got = toxicity.scores(d, model).collect()
    assert len(got) == 5 and [x.predicted for x in got] == [0, 0, 0, 0, 1]
    assert toxicity.scores(d.limit(0), model).count() == 0
    nothing = toxicity.train(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(x.predicted == 0 for x in toxicity.scores(d, nothing).collect())

import random

import pytest

import corpus_pipeline
from lodeseek.llm import toxicity
from lodeseek.llm.queries import tokenizer
from lodeseek.llm.tokens import byte_bpe
from tests.llm import test_decontaminate, test_line_dedup, test_simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture_rows():
    r = random.Random(12)
    vocab = ["".join(r.choices("aeionrst", k=r.randrange(2, 9))) for _ in range(300)]
    say = lambda n: " ".join(r.choices(vocab, k=n))
    bench = [(i, say(25)) for i in range(5)]
    docs, labels = [], []
    for i in range(260):
        lines = [say(r.randrange(3, 40)) for _ in range(r.randrange(1, 5))]
        kind = i % 10
        if kind == 1:
            lines.append(docs[r.randrange(len(docs))][1].split("\n")[0])
        if kind == 2:
            lines = docs[r.randrange(len(docs))][1].split("\n")
        if kind == 3 and i % 20 == 3:
            lines[0] += " " + bench[r.randrange(5)][1]
        toxic = kind == 4 or kind == 5 and i % 20 == 5
        if toxic:
            lines[-1] = f"{lines[-1]} grumptoad {say(2)} vexpod {say(2)} grumptoad {say(1)}"
        docs.append((i, "\n".join(lines)))
        labels.append((i, int("grumptoad" in docs[-1][1]), 1))
    docs += [(300, None), (301, ""), (302, ""), (303, docs[0][1]), (303, docs[0][1])]
    return docs, labels, bench


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    docs, labels, bench = fixture_rows()
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, docs, labels, bench


def test_stages_against_brute_force(spark, tables):
    at, docs, labels, bench = tables
    frame = spark.read.parquet(f"{at}/documents.parquet")
    model = toxicity.train(frame, spark.read.parquet(f"{at}/labels.parquet"))
    want = [(d, t) for d, t in docs if model.score(t or "") < 0.3]
    toxic = {d for d, t in docs if "grumptoad" in (t or "")}
    assert {d for d, _ in docs} - {d for d, _ in want} == toxic
    steps = [want]
    steps.append([(d, t) for d, t, _ in test_line_dedup.brute(want)])
    first = {d for d, _, c in test_simhash.brute(steps[-1]) if d == c}
    steps.append(sorted({x for x in steps[-1] if x[0] in first}, key=str))
    bad = {x[0] for x in test_decontaminate.brute(steps[-1], bench) if x[5]}
    steps.append([x for x in steps[-1] if x[0] not in bad])
    for (name, stage), rows in zip(corpus_pipeline.STAGES[:-1], steps):
        frame = stage(spark, frame, at)
        assert frame.dtypes == spark.read.parquet(f"{at}/documents.parquet").dtypes, name
        assert sorted(((x.doc_id, x.text) for x in frame.collect()), key=str) == sorted(rows, key=str), name
        frame = spark.createDataFrame(frame.collect(), frame.schema)
    bpe = byte_bpe(tokenizer("byte_bpe_50k.json"))
    sizes = sorted((d, len(bpe.encode(t or "")) + 1) for d, t in steps[-1])
    for packed in (corpus_pipeline.STAGES[-1][1](spark, frame, at), corpus_pipeline.run(spark, at)):
        got = packed.collect()
        assert sorted({(x.doc_id, x.doc_tokens) for x in got}) == sizes
        assert sum(x.length for x in got) == sum(n for _, n in sizes)

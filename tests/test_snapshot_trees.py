"""Canonical text, global order, trees of digests and named fingerprints, against plain Python."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lodeseek.functions import canonical
from lodeseek.functions.ranking import numbered
from lodeseek.plans import snapshots, tree

TEXTS = ["", "plain", 'quote " and \\ back', "tab\tline\nreturn\rbell\x07\x08\x0c\x1f\x7f", "Straße ΣΟΦΟΣ ﬁ İ", "emoji 🙂 and \U0010ffff", "  ÿ", None, "ẞ ΐ ŉ ᾳ ǰ"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")


@pytest.mark.parametrize("ascii_only", [False, True])
def test_json(texts, ascii_only):
    one = canonical.json_string(F.col("t"), ascii_only)
    many = canonical.json_array(F.col("t"), 1.5, None, True, "ß🙂", 60, ascii_only=ascii_only)
    for r in texts.select("i", one.alias("x"), many.alias("y")).collect():
        t = TEXTS[r.i]
        assert r.x == (None if t is None else json.dumps(t, ensure_ascii=ascii_only))
        assert r.y == json.dumps([t, 1.5, None, True, "ß🙂", 60], ensure_ascii=ascii_only, separators=(",", ":"))


def test_folding(texts):
    rows = texts.select("i", canonical.folded(F.col("t")).alias("x")).collect()
    assert {r.i: r.x for r in rows} == {i: None if t is None else t.casefold() for i, t in enumerate(TEXTS)}


def test_numbered(spark):
    r = random.Random(2)
    rows = [(r.choice(("Straße", "strasse", "a", "B", "ς", "Σ")), r.randrange(10**6)) for _ in range(2000)]
    found = numbered(spark.createDataFrame(rows, "p string, i int").repartition(6), [canonical.folded(F.col("p")), F.col("p"), F.col("i")])
    got = [(x.p, x.i) for x in sorted(found.collect(), key=lambda x: x.ord)]
    assert got == sorted(rows, key=lambda x: (x[0].casefold(), x[0], x[1]))
    assert sorted(x.ord for x in found.collect()) == list(range(1, 2001))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def corpus(spark, files):
    rows = [("repo", "c1", p, hashlib.sha256(f"{p}{i}{t}".encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for p, parts in files.items() for i, t in enumerate(parts)]
    return spark.createDataFrame(rows, "repository string, commit_hash string, file_path string, chunk_id string, content_hash string")


@pytest.fixture(scope="module")
def files():
    return {f"d{a}/e{b}/f{c}.py": [f"{a}{b}{c}", "x"] for a in range(5) for b in range(4) for c in range(6)} | {"top.md": ["t"], "d0/read.md": ["r"]}


def test_trees(spark, files, tmp_path):
    first = tree.nodes(corpus(spark, files), str(tmp_path / "a"))
    assert first.where("is_file").count() == len(files) and first.where("path = ''").first().n_files == len(files)
    same = tree.nodes(corpus(spark, files).repartition(5), str(tmp_path / "same"))
    assert tree.root(first) == tree.root(same)
    again = tree.compare(first, same)
    assert again.files.count() == 0 and again.n_compared == 1
    other = dict(files)
    other["d1/e1/f1.py"] = ["changed", "x"]
    other["d1/e1/new.py"] = ["n"]
    del other["top.md"]
    other["d9/only.py"] = ["o"]
    found = tree.compare(first, tree.nodes(corpus(spark, other), str(tmp_path / "b")))
    assert {(r.path, r.change) for r in found.files.collect()} == {("d1/e1/f1.py", "changed"), ("d1/e1/new.py", "added"), ("top.md", "removed"), ("d9/only.py", "added")}
    assert found.n_compared < 25 < first.count()  # the other folders are not read
    tree.check_root(first, tree.root(same))
    with pytest.raises(tree.Stale):
        tree.check_root(first, "0" * 64)


def test_a_file_that_becomes_a_folder(spark, tmp_path):
    a, b = tree.nodes(corpus(spark, {"x": ["1"], "y": ["2"]}), str(tmp_path / "a")), tree.nodes(corpus(spark, {"x/z": ["1"], "y": ["2"]}), str(tmp_path / "b"))
    assert {(r.path, r.change) for r in tree.compare(a, b).files.collect()} == {("x", "removed"), ("x/z", "added")}


def test_empty_snapshot(spark, files, tmp_path):
    none = tree.nodes(corpus(spark, {"a": ["1"]}).limit(0), str(tmp_path / "none"))
    some = tree.nodes(corpus(spark, files), str(tmp_path / "some"))
    assert tree.root(none) is None and tree.compare(none, some).files.where("change = 'added'").count() == len(files)


def test_named_fingerprints(spark, files):
    methods = snapshots.Methods(tokenizer="ß🙂", embedder="modèle", method="reranked")
    chunks = corpus(spark, files)
    row = snapshots.named_fingerprints(chunks, methods).first()

    def digest(*values, ascii_only=False):
        return hashlib.sha256(json.dumps(values, ensure_ascii=ascii_only, separators=(",", ":")).encode()).hexdigest()

    assert row.corpus == snapshots.corpus_fingerprint(chunks).first().fingerprint
    assert row.bm25 == digest("repo", "c1", "ß🙂", "chunk-text-1", 1.5, 0.75, row.corpus)
    assert row.vector == digest("chunk-text-1", "modèle", "1", 8192, True, row.corpus, ascii_only=True)
    assert row.hybrid == digest("repo", "c1", row.corpus, row.vector, row.bm25, "hybrid", "rrf-1", 60, "modèle", "ß🙂")
    assert row.rerank == digest("repo", "c1", row.corpus, row.hybrid, "hybrid", 50, "overlap", "1", 1024, "chunk-text-1", "rerank-1", "score-hybrid-rank-chunk-id")
    assert row.answers == digest("answers-1", "prompt-1", "context-1", "reranked", row.rerank, 5, "all", "first-source", "first-source", 2000)
    assert row.bm25 == snapshots.settings_fingerprint("repo", "c1", "ß🙂", "chunk-text-1", 1.5, 0.75, row.corpus)

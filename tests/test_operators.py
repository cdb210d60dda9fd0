"""Rankings, fusion, reranking, evidence, evaluation, snapshots and answers on small hand-made tables."""

import math

import pytest
from pyspark.sql import functions as F

from lodeseek.functions.ranking import ranked
from lodeseek.operators import chunking, evaluation, evidence, fusion, lexical, reranking, structure, vector
from lodeseek.plans import answering, snapshots

CODE = [
    ("connection", "handleConnection", None, "def handleConnection():\n    register client"),
    ("presence", "registerSocket", "PresenceService", "def registerSocket():\n    update presence"),
    ("unrelated", "calculate_total", None, "def calculate_total():\n    return invoice"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(c, "ExampleRepo", "abc123", f"src/{c}.py", "Python", "method" if p else "function", s, p, 10, 12, None, 1, "h" + c, t, "parsed") for c, s, p, t in CODE]
    return spark.createDataFrame(rows, chunking.CHUNK)


@pytest.fixture(scope="module")
def index(spark, chunks, tmp_path_factory):
    from lodeseek.functions.text import lexical_text

    return lexical.build(chunks.select("chunk_id", lexical_text().alias("text")), str(tmp_path_factory.mktemp("index")))


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query_text string")


def listed(df, *names):
    return [tuple(r) for r in df.orderBy("query_id", "rank").select(*names).collect()]


def test_bm25_scores(spark, index):
    found = listed(index.search(ask(spark, "invoice", "connection", "handleConnection", "presence", "def", "nonexistentxyz"), 10), "query_id", "chunk_id", "score")
    wanted = [(0, "unrelated", 1.002307266), (1, "connection", 1.654410788), (2, "connection", 4.500340227), (3, "presence", 1.596698784), (4, "connection", 0.136455438), (4, "unrelated", 0.136455438), (4, "presence", 0.128043801)]
    assert [x[:2] for x in found] == [x[:2] for x in wanted]
    assert all(math.isclose(a[2], b[2], abs_tol=1e-8) for a, b in zip(found, wanted))
    stats = index.stats.first()
    assert (stats.n_documents, stats.total_length, stats.avg_length, stats.median_length) == (3, 63, 21.0, 20.0)


def test_bm25_refuses_bad_input(spark, index):
    with pytest.raises(ValueError):
        index.search(ask(spark, "x"), 0)
    with pytest.raises(ValueError):
        index.search(ask(spark, "x"), 5, k1=0)
    with pytest.raises(ValueError):
        lexical.check_queries(ask(spark, "...///"))
    lexical.check_queries(ask(spark, "fine"))


def test_repeated_query_tokens_count_again(spark, index):
    one, two = (listed(index.search(ask(spark, q), 1), "score")[0][0] for q in ("invoice", "invoice invoice"))
    assert math.isclose(two, 2 * one)


def test_vector_search(spark):
    rows = spark.createDataFrame([("chunk-b", [3.0, 0.0, 0.0]), ("chunk-a", [0.0, 4.0, 0.0]), ("chunk-c", [1.0, 1.0, 0.0]), ("none", None), ("zero", [0.0] * 3)], "chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [2.0, 0.0, 0.0]), (2, [0.0, 0.0, 1.0])], "query_id long, embedding array<double>")
    found = listed(vector.search(rows, asked, 10), "query_id", "chunk_id", "score")
    assert [(q, c, round(s, 8)) for q, c, s in found] == [(1, "chunk-b", 1.0), (1, "chunk-c", 0.70710678), (1, "chunk-a", 0.0), (2, "chunk-a", 0.0), (2, "chunk-b", 0.0), (2, "chunk-c", 0.0)]
    assert listed(vector.search(rows, asked, 10, block=1), "query_id", "chunk_id", "score") == found


def test_embedder_batches_and_vectors(spark):
    model = vector.HashingEmbedder(8)
    assert list(model.batches([3000, 20, 1000, 10]))[0] == [0]
    assert sorted(i for b in model.batches([5] * 40) for i in b) == list(range(40))
    rows = vector.embed(spark.createDataFrame([("a", "one two"), ("b", None)], "chunk_id string, text string"), model).collect()
    assert [r.n_tokens for r in rows] == [2, 0] and all(math.isclose(sum(x * x for x in r.embedding), 1) for r in rows)


def ranking(spark, rows):
    return spark.createDataFrame([(0, c, r, float(s)) for c, r, s in rows], "query_id long, chunk_id string, rank int, score double")


@pytest.mark.parametrize("first,second,top", [
    ([("z-last", 1, 999)], [("a-first", 1, 0.001)], ["a-first", "z-last"]),
    ([("v", 1, 1), ("both", 2, 1)], [("b", 1, 1), ("both", 2, 1)], ["both", "b", "v"]),
    ([], [], []),
])
def test_fusion(spark, first, second, top):
    found = fusion.fuse(ranking(spark, first), ranking(spark, second), None)
    assert [x[0] for x in listed(found, "chunk_id")] == top


def test_fusion_contributions(spark):
    (row,) = fusion.fuse(ranking(spark, [("x", 2, 5)]), ranking(spark, [("x", 3, 7)])).collect()
    assert row.rrf_score == 1 / 62 + 1 / 63
    (row,) = fusion.fuse(ranking(spark, [("x", 1, 5)]), ranking(spark, [])).collect()
    assert (row.rrf_score, row.bm25_rank, row.bm25_contribution) == (1 / 61, None, 0.0)


@pytest.mark.parametrize("rows", [[("a", 1, 1), ("a", 2, 1)], [("a", 1, 1), ("b", 1, 1)], [("a", 0, 1)], [("", 1, 1)], [("a", 1, float("nan"))], [("a", 1, float("inf"))]])
def test_bad_rankings(spark, rows):
    with pytest.raises(ValueError):
        fusion.check(ranking(spark, rows))


def test_rerank(spark):
    rows = [(0, "q", f"c{i:02}", i, "x" * i) for i in range(1, 61)]
    cand = spark.createDataFrame(rows, "query_id long, query_text string, chunk_id string, rank int, text string")
    length = lambda q, t: F.length(t).cast("double")
    found = listed(reranking.rerank(cand, length, 3), "chunk_id", "hybrid_rank")
    assert found == [("c50", 50), ("c49", 49), ("c48", 48)]
    assert listed(reranking.rerank(cand, lambda q, t: F.lit(1.0), 2), "chunk_id") == [("c01",), ("c02",)]
    diag = reranking.diagnostics(cand, F.length("text"), 40).first()
    assert (diag.n_candidates, diag.n_truncated, diag.longest) == (50, 10, 50)
    with pytest.raises(ValueError):
        reranking.rerank(cand, length, 51)


def test_pair_scorer(spark):
    class Words(reranking.PairScorer):
        def score(self, pairs):
            return [len(set(a.split()) & set(b.split())) for a, b in pairs]

    df = spark.createDataFrame([("a b", "b c"), ("a", None)], "q string, t string")
    assert [r[0] for r in df.select(Words().column(F.col("q"), F.col("t"))).collect()] == [1.0, 0.0]


def hits(spark):
    rows = [(0, r, c, f"d/{c}{e}", lang) for r, c, e, lang in [(1, "a", ".md", "Markdown"), (2, "b", ".py", "Python"), (3, "c", ".MD", "x"), (4, "d", ".py", "Python"), (5, "b", ".py", "Python")]]
    df = spark.createDataFrame(rows, "query_id long, rank int, chunk_id string, file_path string, language string")
    extra = {"chunk_type": "file", "symbol_name": None, "parent_symbol": None, "start_line": 1, "end_line": 2, "content": "text"}
    return df.withColumns({k: F.lit(v).cast("string") for k, v in extra.items()})


def test_scope_and_evidence(spark):
    rows = hits(spark)
    assert [r.rank for r in evidence.in_scope(rows, "code").orderBy("rank").collect()] == [2, 4, 5]
    assert [r.rank for r in evidence.in_scope(rows, "docs").orderBy("rank").collect()] == [1, 3]
    found = evidence.evidence(evidence.in_scope(rows, "code"), 5).orderBy("source_id").collect()
    assert [(r.source_id, r.retrieval_rank, r.chunk_id) for r in found] == [("S1", 2, "b"), ("S2", 4, "d")]
    with pytest.raises(Exception, match="relative"):
        evidence.evidence(rows.withColumn("file_path", F.lit("C:\\repo\\bad.py")), 5).collect()


def test_more_than_nine_sources_keep_their_order(spark):
    rows = hits(spark).limit(1).drop("rank", "chunk_id").crossJoin(spark.range(1, 13).select(F.col("id").cast("int").alias("rank"), F.col("id").cast("string").alias("chunk_id")))
    context = evidence.contexts(evidence.evidence(rows, 12)).first()
    assert context.n_sources == 12 and [x.split("]")[0] for x in context.context.split("\n\n")] == [f"[S{i}" for i in range(1, 13)]


def test_citations(spark):
    found = evidence.evidence(hits(spark), 3)
    texts = ["[S2] and [S1] and [S2]", "Claim [S1] [S9].", "none", "[S] [S0] [S-1] S1 [s1]"]
    rows = evidence.validated(spark.createDataFrame([(0, t) for t in texts], "query_id long, answer string"), found).collect()
    got = {r.answer: (r.cited, r.unknown, r.valid) for r in rows}
    assert [got[t] for t in texts] == [(["S2", "S1"], [], True), (["S1", "S9"], ["S9"], False), ([], [], False), ([], [], False)]
    one = evidence.validated(spark.createDataFrame([(0, texts[0])], "query_id long, answer string"), found)
    assert [(r.place, r.chunk_id) for r in evidence.cited_evidence(one, found).orderBy("place").collect()] == [(1, "b"), (2, "a")]
    assert "**S1** `d/a.md` lines 1-2" in evidence.markdown(one, found).first().export


def test_evaluation(spark):
    rank = spark.createDataFrame([(0, 1, "x"), (0, 2, "y"), (0, 3, "x"), (0, 4, "z")], "query_id long, rank int, file_path string")
    files = evaluation.files(rank)
    assert [(r.file_path, r.rank) for r in files.orderBy("rank").collect()] == [("x", 1), ("y", 2), ("z", 3)]
    relevant = spark.createDataFrame([(0, "y"), (0, "gone"), (1, "x")], "query_id long, file_path string")
    rows = {r.query_id: r for r in evaluation.by_query(files, relevant).collect()}
    assert (rows[0].recall_1, rows[0].recall_3, rows[0].hit_3, rows[0].reciprocal_rank) == (0.0, 0.5, 1, 0.5)
    assert (rows[1].recall_5, rows[1].hit_5, rows[1].reciprocal_rank) == (0.0, 0, 0.0)
    assert evaluation.summary(evaluation.by_query(files, relevant)).first().mrr == 0.25


def test_snapshots(spark, chunks):
    a, b = snapshots.describe(chunks, "bm25", 1.5), snapshots.describe(chunks.repartition(5), "vector")
    assert snapshots.check_together(a, b) == a.corpus and a.settings != b.settings
    snapshots.check_expected(a, snapshots.IndexInfo(repository="ExampleRepo", commit_hash=None))
    with pytest.raises(snapshots.Incompatible):
        snapshots.check_expected(a, snapshots.IndexInfo(commit_hash="other"))
    with pytest.raises(snapshots.Incompatible):
        snapshots.check_together(a, snapshots.describe(chunks.withColumn("content_hash", F.lit("x")), "v"))
    with pytest.raises(ValueError):
        snapshots.check_ids(chunks.unionByName(chunks))
    snapshots.check_ids(chunks)


def test_ranks_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(i % 3, f"c{i}", (i * 7 % 11) / 3) for i in range(200)], "query_id long, chunk_id string, score double")
    a, b = (sorted(map(tuple, ranked(rows.repartition(n), "score", "chunk_id", k=9).collect())) for n in (1, 8))
    assert a == b and len(a) == 27


def test_complete_rankings_of_one_query_in_many_parts(spark):
    rows = spark.createDataFrame([(None if i % 9 == 0 else 1, i, float(i % 4)) for i in range(500)], "query_id long, chunk_id long, score double")
    window = {q: sorted((-s, c) for a, c, s in rows.collect() if a == q) for q in (None, 1)}
    got = sorted((r.query_id or 0, r["rank"], r.chunk_id) for r in ranked(rows.repartition(5), "score", "chunk_id").collect())
    assert got == sorted((q or 0, n, c) for q, own in window.items() for n, (_, c) in enumerate(own, 1))
    assert ranked(rows.limit(0), "score", "chunk_id").count() == 0


@pytest.mark.parametrize("method", answering.METHODS)
def test_answers(spark, chunks, index, method):
    vectors = vector.embed(chunks.select("chunk_id", F.col("content").alias("text")), vector.HashingEmbedder(16)).select("chunk_id", "embedding")
    questions = vector.embed(ask(spark, "where is the invoice", "presence socket").withColumn("text", F.col("query_text")), vector.HashingEmbedder(16)).drop("text", "n_tokens")
    rows, found = answering.answer(answering.Retriever(chunks, index, vectors), questions, answering.Request(method, 2, "code"))
    rows = rows.orderBy("query_id").collect()
    assert all(r.valid and r.cited == ["S1"] and 1 <= r.n_sources <= 2 for r in rows)
    if method == "bm25":
        assert "src/unrelated.py" in rows[0].answer
    none, _ = answering.answer(answering.Retriever(chunks, index, vectors), questions, answering.Request(method, 2, "docs"))
    assert all(r.answer is None and not r.valid and r.n_sources == 0 for r in none.collect())


def test_requests():
    assert answering.Request("reranked", 6, "code").candidates == 50
    assert answering.Request("bm25", 6, "code").candidates == 60
    for bad in ({"method": "x"}, {"scope": "x"}, {"k": 0}):
        with pytest.raises(ValueError):
            answering.Request(**bad)


PYTHON = b"import os\n\nclass A:\n    def __init__(self):\n        pass\n\n    @staticmethod\n    async def run():\n        def inner(): pass\n        return inner\n\nclass B:\n    x = 1\n\ndef helper():\n    return '\xc3\xa9'\n"
SCRIPT = b"// class Fake {\nconst n = 1;\nexport function go(a: number) {\n  return `}`;\n}\nexport class Worker {\n  private q = {};\n  constructor(x) { this.x = x; }\n  async retryJob(job) { if (job) { return 1; } }\n}\nconst build = async (x) => { return x; };\nlist.map(y => y);\ninterface Shape { a: number }\nenum Color { Red }\ntype Id = { a: string };\n"
PLUS = b"#include <x>\n#define F(x) {\nenum Kind { A };\nclass Worker {\npublic:\n  Worker() { n = 0; }\n  int retry(int k) { while (k) { k--; } return k; }\n  int n;\n};\nstruct Plain { int a; };\nint add(int a, int b) {\n  return a + b;\n}\n"


def units(grammar, source):
    return [(u.kind, u.symbol, u.parent) for u in structure.units_of(grammar, source)[0]]


def test_units():
    assert units("python", PYTHON) == [("constructor", "__init__", "A"), ("method", "run", "A"), ("class", "B", None), ("function", "helper", None)]
    assert units("typescript", SCRIPT) == [("function", "go", None), ("constructor", "constructor", "Worker"), ("method", "retryJob", "Worker"), ("function", "build", None), ("interface", "Shape", None), ("enum", "Color", None), ("type", "Id", None)]
    assert units("cpp", PLUS) == [("enum", "Kind", None), ("constructor", "Worker", "Worker"), ("method", "retry", "Worker"), ("class", "Plain", None), ("function", "add", None)]
    assert units("c", b"int add(int a) { return a; }\n") == [("function", "add", None)]


@pytest.mark.parametrize("grammar,source", [("python", PYTHON), ("typescript", SCRIPT), ("cpp", PLUS), ("python", b"def broken(:\n"), ("python", b""), ("javascript", b"}{")])
def test_chunks_cover_the_source(grammar, source):
    rows = structure.chunk_source(grammar, source, 80, 10, 200)
    found = sorted(source.decode().find(r[7]) for r in rows)
    assert found[0] >= 0
    text = "".join(r[7] for r in rows)
    assert all(w in text for w in source.decode().split())


def test_chunk_ids_and_files(spark):
    content = "def run():\n    return 1"
    files = spark.createDataFrame([("Repo", "abc", "main.py", "Python", ".py", content), ("Repo", "abc", "a.txt", "Text", ".txt", ""), ("Repo", "abc", "big.py", "Python", ".py", "def f():\n" + "    x = 1\n" * 7)], "repository string, commit_hash string, file_path string, language string, extension string, text string")
    rows = chunking.chunk_files(files, chunking.ChunkSettings(80, 10, 3)).orderBy("file_path", "start_line").collect()
    by = {r.file_path: r for r in rows}
    assert by["main.py"].chunk_id == "23f5b36a17748af89ccab83dab7415d08d2181e2f44f134eb3e4351a1735a0a8"
    assert (by["a.txt"].content, by["a.txt"].start_line, by["a.txt"].parser_status) == ("", 1, "fallback_unsupported_language")
    big = [r for r in rows if r.file_path == "big.py"]
    assert [(r.part_index, r.part_count, r.symbol_name) for r in big] == [(1, 3, "f"), (2, 3, "f"), (3, 3, "f")]
    again = chunking.chunk_files(files, chunking.ChunkSettings(80, 10, 3))
    assert chunking.difference(spark.createDataFrame(rows, chunking.CHUNK), again).isEmpty()
    assert {(r.language, r.n_chunks, r.n_structural, r.n_fallback) for r in chunking.counts(again).collect()} == {("Python", 4, 4, 0), ("Text", 1, 0, 1)}


def test_files_of_scores_follow_the_complete_ranking(spark):
    rows = [(1, c, s, f) for c, s, f in [(1, 0.5, "a"), (2, 0.5, "b"), (3, 0.9, "c"), (4, 0.1, "a"), (5, 0.9 + 1e-14, "a")]] + [(2, 1, 0.2, "b")]
    scores = spark.createDataFrame(rows, "query_id long, chunk_id long, score double, file_path string")
    whole = evaluation.files(fusion.ranked(scores, "score", "chunk_id"))
    found = evaluation.files_of_scores(scores)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect())) == [(1, "a", 2), (1, "b", 3), (1, "c", 1), (2, "b", 1)]
    assert evaluation.files_of_scores(scores.limit(0)).isEmpty()


def test_deep_nesting_and_stray_braces():
    nested = b"class A {\npublic:\n  void run() { if (x) { y(); } }\n  struct B { int get() { return 1; } };\n};\n"
    assert units("cpp", nested) == [("method", "run", "A"), ("method", "get", "B")]
    assert structure.units_of("javascript", b"function f() { return 1; }\n}")[1] and structure.units_of("c", b"{")[1]
    inner = b"class A:\n    def run(self):\n        class B:\n            def go(self): pass\n"
    assert units("python", inner) == [("method", "run", "A"), ("class", "B", "A")]

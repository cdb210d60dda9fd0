import pytest

from lodeseek.operators import fusion, hybrid_index, vector, vector_index
from lodeseek.operators.chunking import chunk_files
from lodeseek.plans.answering import Retriever
from lodeseek.plans.snapshots import Incompatible, IndexInfo, store, stored

COLUMNS = "repository string, commit_hash string, file_path string, language string, extension string, text string"
EMBEDDER = vector.HashingEmbedder(16)


def made(spark, commit="c1", n=30):
    words = ["alpha", "beta", "gamma", "delta", "handle", "read", "write"]
    files = [("repo", commit, f"src/f{i}.txt", "Text", ".txt", " ".join(words[(i * k) % 7] for k in range(1, 5 + i % 4)) + f" x{i}\n") for i in range(n)]
    return chunk_files(spark.createDataFrame(files, COLUMNS)).cache()


@pytest.fixture(scope="module")
def stores(spark, tmp_path_factory):
    chunks, at = made(spark), str(tmp_path_factory.mktemp("hybrid"))
    hybrid_index.build(chunks, f"{at}/lexical")
    vector_index.build(chunks, EMBEDDER, f"{at}/vectors")
    return chunks, at


def questions(spark):
    return spark.createDataFrame([(1, "alpha gamma x3"), (2, "write the delta"), (3, "nothing of it")], "query_id long, query_text string")


def test_search_is_the_fusion_of_both_complete_rankings(spark, stores):
    _, at = stores
    both = hybrid_index.open_both(spark, f"{at}/lexical", f"{at}/vectors", IndexInfo(repository="repo", commit_hash="c1"))
    asked = questions(spark)
    first, second = vector.search(both.vectors.vectors, vector.embed(asked, EMBEDDER, "query_text"), None), both.lexical.search(asked, None)
    for k in (1, 4, None):
        want = fusion.fuse(first, second, k).collect()
        assert sorted(map(str, both.search(asked, EMBEDDER, k).collect())) == sorted(map(str, want))


def test_what_was_made_otherwise_is_refused(spark, stores, tmp_path):
    _, at = stores
    both = hybrid_index.open_both(spark, f"{at}/lexical", f"{at}/vectors")
    with pytest.raises(Incompatible):
        both.search(questions(spark), vector.HashingEmbedder(8))
    with pytest.raises(ValueError):
        both.search(spark.createDataFrame([(1, "...")], "query_id long, query_text string"), EMBEDDER)
    for other in (IndexInfo(commit_hash="c2"), IndexInfo(repository="another"), IndexInfo(n_chunks=3)):
        with pytest.raises(Incompatible):
            hybrid_index.load(spark, f"{at}/lexical", other)
    with pytest.raises(Incompatible):
        hybrid_index.load(spark, f"{at}/lexical", k1=1.2)
    with pytest.raises(ValueError):
        hybrid_index.build(made(spark), str(tmp_path / "none"), b=2.0)
    for chunks in (made(spark, "c2"), made(spark, n=20)):
        later = hybrid_index.build(chunks, str(tmp_path / f"later{chunks.count()}{chunks.first().commit_hash}"))
        with pytest.raises(Incompatible):
            hybrid_index.HybridIndex(later, both.vectors)


def test_parameters_reach_the_scores(spark, stores, tmp_path):
    chunks, at = stores
    own = hybrid_index.build(chunks, str(tmp_path / "own"), k1=0.5, b=0.0)
    assert own.info.settings != stored(spark, f"{at}/lexical").settings
    both = hybrid_index.HybridIndex(own, vector_index.load(spark, f"{at}/vectors"))
    want = {(r.query_id, r.chunk_id): r.score for r in own.index.search(questions(spark), None, 0.5, 0.0).collect()}
    rows = [r for r in both.search(questions(spark), EMBEDDER, 5).collect() if r.bm25_rank]
    assert rows and all(r.bm25_raw_score == pytest.approx(want[r.query_id, r.chunk_id]) for r in rows)


def test_an_index_of_another_size_than_its_info(spark, stores, tmp_path):
    chunks, _ = stores
    path = str(tmp_path / "size")
    info = hybrid_index.build(chunks, path).info
    store(spark, IndexInfo(info.repository, info.commit_hash, info.n_chunks + 1, info.corpus, info.settings), path)
    with pytest.raises(Incompatible):
        hybrid_index.load(spark, path)


def test_retriever_over_stored_indexes(spark, stores):
    chunks, at = stores
    both = hybrid_index.open_both(spark, f"{at}/lexical", f"{at}/vectors")
    asked = vector.embed(questions(spark), EMBEDDER, "query_text")
    found = Retriever.over(chunks, both).retrieve(asked, "hybrid", 3)
    assert found.groupBy("query_id").count().where("count = 3").count() == 3

import dataclasses

import pytest

from lodeseek.functions.text import lexical_text
from lodeseek.operators import lexical, vector, vector_index
from lodeseek.operators.chunking import chunk_files
from lodeseek.plans.answering import Retriever
from lodeseek.plans.snapshots import Incompatible, IndexInfo, compared, describe


@pytest.fixture(scope="module")
def chunks(spark):
    files = [("repo", "c1", f"src/f{i}.txt", "Text", ".txt", f"alpha beta{i}\ngamma{i} delta\n") for i in range(6)]
    return chunk_files(spark.createDataFrame(files, "repository string, commit_hash string, file_path string, language string, extension string, text string"))


def test_vector_index(spark, chunks, tmp_path):
    path, embedder = str(tmp_path / "v"), vector.HashingEmbedder(16)
    index = vector_index.build(chunks, embedder, path)
    queries = spark.createDataFrame([(1, "alpha beta3")], "query_id long, query_text string")
    assert index.search(queries, embedder, 2).count() == 2
    with pytest.raises(Incompatible):
        index.search(queries, vector.HashingEmbedder(8))
    assert vector_index.load(spark, path, IndexInfo(repository="repo", commit_hash="c1")).info == index.info
    with pytest.raises(Incompatible):
        vector_index.load(spark, path, IndexInfo(commit_hash="c2"))
    part = spark.createDataFrame(index.vectors.limit(2).collect(), index.vectors.schema)
    part.write.mode("overwrite").parquet(f"{path}/vectors")
    with pytest.raises(ValueError):
        vector_index.load(spark, path)


def test_lexical_index_is_computed_again(spark, chunks, tmp_path):
    path = str(tmp_path / "l")
    lexical.build(chunks.select("chunk_id", lexical_text().alias("text")), path)
    assert lexical.validated(spark, path).terms.count() > 0
    rows = spark.createDataFrame(spark.read.parquet(f"{path}/terms").limit(3).collect(), "term string, df long, idf double")
    rows.write.mode("overwrite").parquet(f"{path}/terms")
    with pytest.raises(ValueError):
        lexical.validated(spark, path)


def test_indexes_of_two_snapshots_are_not_fused(chunks):
    info = describe(chunks, "x")
    other = dataclasses.replace(info, commit_hash="c2")
    with pytest.raises(Incompatible):
        Retriever(chunks, index_info=info, embeddings_info=other).retrieve(chunks, "hybrid", 5)


def test_snapshots_are_compared(chunks):
    fewer = chunks.where("file_path <> 'src/f0.txt'")
    assert [tuple(r) for r in compared(chunks, chunks).collect()] == [("repo", True, True, True)]
    assert [tuple(r) for r in compared(chunks, fewer).collect()] == [("repo", False, False, False)]
    assert [tuple(r) for r in compared(chunks, chunks.limit(0)).collect()] == [("repo", False, False, False)]

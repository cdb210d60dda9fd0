"""Block-bounded search against the search that scores every posting."""

import random

import pytest
from pyspark.sql import Observation

from lodeseek.operators import blocks, lexical


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    r = random.Random(1)
    rare = [f"rare{i}" for i in range(300)]
    rows = [(i, " ".join(["the"] * r.randrange(1, 9) + r.choices(["of", "and", "lamp", "tree", "house"], k=r.randrange(60)) + r.choices(rare, k=2))) for i in range(3000)]
    rows += [(3000 + i, rows[5][1]) for i in range(40)] + [(4000, ""), (4001, None)]
    path = str(tmp_path_factory.mktemp("blocks") / "index")
    lexical.build(spark.createDataFrame(rows, "chunk_id long, text string"), path)
    return blocks.build(spark, path), path


def rows_of(df):
    return sorted(map(tuple, df.select("query_id", "rank", "chunk_id", "score").collect()))


ASKED = [(1, "rare7 the"), (2, "the"), (3, "lamp tree house rare1 rare2"), (4, "nowhere"), (5, "the of and"), (6, "rare9 rare9 rare9")]


@pytest.mark.parametrize("k,k1,b", [(1, 1.5, 0.75), (5, 1.5, 0.75), (10, 0.5, 0.0), (10, 2.0, 1.0), (300, 1.5, 0.75), (5000, 1.5, 0.75)])
def test_equal_to_the_full_search(spark, built, k, k1, b):
    index, path = built
    queries = spark.createDataFrame(ASKED, "query_id long, query_text string")
    assert rows_of(index.search(queries, k, k1, b)) == rows_of(lexical.load(spark, path).search(queries, k, k1, b))


def test_bounds_hold(spark, built):
    index, _ = built
    queries = spark.createDataFrame(ASKED, "query_id long, query_text string")
    bounds = index.bounds(queries)
    whole = index.scores(queries, bounds)
    places = index.blocks.selectExpr("slice", "explode(postings.chunk_id) AS chunk_id").distinct()
    assert whole.join(places, "chunk_id").join(bounds, ["query_id", "slice"]).where("score > bound").count() == 0


def test_blocks_are_skipped_and_counted(spark, built):
    index, _ = built
    watch = Observation("blocks")
    index.search(spark.createDataFrame(ASKED[:1], "query_id long, query_text string"), 5, watch=watch).collect()
    seen = watch.get
    assert seen["n_postings"] > 3000 and seen["scored_postings"] < seen["n_postings"] / 2
    assert seen["scored_blocks"] < seen["n_blocks"] / 2 and 0 < seen["scored_slices"] < seen["n_slices"]


def test_headers_are_read_without_postings(spark, built):
    index, _ = built
    plan = index.bounds(spark.createDataFrame(ASKED, "query_id long, query_text string"))._jdf.queryExecution().executedPlan().toString()
    assert "max_tf" in plan and "postings:array" not in plan


def test_checks(spark, built):
    index, path = built
    found = blocks.differences(index).first()
    assert found.n_other_headers == 0 and found.n_postings == lexical.load(spark, path).postings.count()
    for text, k in (("-", 5), ("the", 0)):
        with pytest.raises(ValueError):
            index.search(spark.createDataFrame([(1, text)], "query_id long, query_text string"), k)


def test_empty_corpus(spark, tmp_path):
    path = str(tmp_path / "none")
    lexical.build(spark.createDataFrame([], "chunk_id long, text string"), path)
    assert blocks.build(spark, path).search(spark.createDataFrame(ASKED, "query_id long, query_text string"), 5).count() == 0


def test_slices_are_made_and_met_without_a_shuffle(spark, built):
    """Every document is in one slice, of like length, and open slices are scanned where they are read."""
    index, path = built
    own = index.blocks.selectExpr("slice", "size(postings) AS n", "array_max(postings.dl) AS most", "array_min(postings.dl) AS least", "inline(postings)")
    assert own.count() == own.select("chunk_id").distinct().count() == lexical.load(spark, path).documents.count()
    assert own.where(f"n > {blocks.SLICE}").count() == 0 and own.where("most <= 2 * least + 1").count() > own.count() / 2
    queries = spark.createDataFrame(ASKED, "query_id long, query_text string")
    heads = index.scanned(queries, index.bounds(queries)).heads(5)
    plan = heads._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and heads.count() <= 5 * len(ASKED) * 64


def test_other_heads_are_counted(spark, built, tmp_path):
    index, path = built
    changed = index.blocks.selectExpr("slice", "terms", "n", "transform(max_tf, (x, i) -> IF(i = 0, x + 1, x)) AS max_tf", "min_dl", "postings")
    changed.write.parquet(str(tmp_path / "blocks"))
    other = blocks.BlockIndex(spark.read.parquet(str(tmp_path / "blocks")), lexical.load(spark, path))
    assert blocks.differences(other).first().n_other_headers == index.blocks.where("terms IS NOT NULL").count()

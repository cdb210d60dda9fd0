"""Scores made where rows are read: first k, places and best of groups against complete rankings, and what is shuffled for them."""

import pytest
from pyspark.sql import functions as F

from lodeseek.functions import text as T
from lodeseek.functions import vectors as V
from lodeseek.functions.ranking import ranked
from lodeseek.operators import blocks, evaluation, lexical, vector

ODD = ["", "  ", "fooBar HTTPServer2go x_y-z", "Ñandú caféBar é", "a__b a-_c 12ab34CD", "ABCdef ABC9 XYZ\x00q", "İstanbul K ſ Straße", "𝒜b 😀c"]
COMMON = [f"common word{i % 7} {'rare' * (i % 3)} number{i % 11}" for i in range(1500)]
ASKED = "query_id long, query_text string"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [(f"c{i:05}", t, None if i % 13 == 0 else f"s{i % 5}") for i, t in enumerate([*ODD, None, *COMMON])]
    return lexical.build(spark.createDataFrame(rows, "chunk_id string, text string, file_path string"), str(tmp_path_factory.mktemp("scan")))


def asked(spark):
    return spark.createDataFrame([(0, "common word3"), (1, "rare number4 number4"), (2, "nowhere"), (3, "caf")], ASKED)


def exchanges(rows):
    return rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") + rows._jdf.queryExecution().executedPlan().toString().count("Exchange rangepartitioning")


def test_counts_are_those_of_the_tokens(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], "chunk_id long, text string")
    found = {(r.chunk_id, r.term): (r.tf, r.dl) for r in lexical.postings_of(lexical.counted(rows)).collect()}
    t = F.explode(T.tokens(F.coalesce("text", F.lit("")))).alias("term")
    own = rows.select("chunk_id", F.size(T.tokens(F.coalesce("text", F.lit("")))).alias("dl"), t).groupBy("chunk_id", "term", "dl").count()
    assert found == {(r.chunk_id, r.term): (r["count"], r.dl) for r in own.collect()}
    assert exchanges(lexical.counted(rows.repartition(20)).select("chunk_id")) <= 1 and exchanges(lexical.postings_of(lexical.counted(rows))) == 0


def by_rows(index, queries, k1=lexical.K1, b=lexical.B):
    """Scores as a join of postings and terms, with every part and every sum a row of Spark's."""
    wanted = lexical.query_terms(queries).join(index.terms, "term")
    length = 1 - b + b * F.col("dl") / F.col("avg_length")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * length)
    return lexical.added(index.postings.join(wanted, "term").crossJoin(index.stats.select("avg_length")).select("query_id", "chunk_id", part.alias("part")))


@pytest.mark.parametrize("k1, b", [(1.5, 0.75), (0.5, 0.0), (2.0, 1.0)])
def test_scores_and_heads(spark, index, k1, b):
    whole = by_rows(index, asked(spark), k1, b)
    scan = index.scanned(asked(spark), k1, b)
    assert sorted(map(tuple, scan.every().collect())) == sorted(map(tuple, whole.collect()))
    full = {(r.query_id, r["rank"]): r.chunk_id for r in ranked(whole, "score", "chunk_id", k=9).collect()}
    heads = scan.heads(9)
    assert {(r.query_id, r["rank"]): r.chunk_id for r in ranked(heads, "score", "chunk_id", k=9).collect()} == full
    assert exchanges(heads) == 0 and heads.count() <= 9 * 4 * index.documents.rdd.getNumPartitions() < whole.count()


def test_places(spark, index):
    scan = index.scanned(asked(spark))
    full = ranked(scan.every(), "score", "chunk_id")
    some = full.where("rank % 17 = 3").select("query_id", "chunk_id", "score")
    assert sorted(map(tuple, scan.places(some).collect())) == sorted(map(tuple, full.where("rank % 17 = 3").select("query_id", "chunk_id", "score", "rank").collect()))


def test_best_of_groups(spark, index):
    scan = index.scanned(asked(spark))
    whole = scan.every().join(index.documents.select("chunk_id", "file_path"), "chunk_id")
    assert sorted(map(str, evaluation.files_of_scores(scan.best("file_path")).collect())) == sorted(map(str, evaluation.files_of_scores(whole).collect()))


def test_vectors_are_multiplied_in_blocks(spark):
    """Copies, two dimensions, vectors without a direction; products are those of V.dot to the last bit."""
    vectors = [(i, [float((i * 7 + j * j) % 23 - 11) for j in range(3 if i % 9 == 0 else 16)]) for i in range(1200)] + [(2000 + i, [1.0] * 16) for i in range(700)] + [(5000, [0.0] * 16), (5001, None)]
    rows = spark.createDataFrame(vectors, "chunk_id long, embedding array<float>")
    queries = rows.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    unit = vector.unit_vectors(rows)
    pairs = unit.crossJoin(vector.unit_vectors(queries).select("query_id", F.col("embedding").alias("asked"))).where("size(embedding) = size(asked)")
    whole = pairs.select("query_id", "chunk_id", V.dot(F.col("embedding"), F.col("asked")).alias("score"))
    assert sorted(map(tuple, vector.scores(rows, queries).collect())) == sorted(map(tuple, whole.collect()))
    full = ranked(whole, "score", "chunk_id")
    for block in (2048, 3):
        found = vector.search(rows, queries, 10, block)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, full.where("rank <= 10").select("query_id", "rank", "chunk_id", "score").collect()))
        some = full.where("rank % 29 = 5").select("query_id", "chunk_id", "score", "rank")
        assert sorted(map(tuple, vector.scanned(rows, queries, block).places(some.drop("rank")).collect())) == sorted(map(tuple, some.collect()))
    heads = vector.scanned(rows, queries).heads(10)
    assert exchanges(heads) == 0 and "CartesianProduct" not in heads._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_not_shuffled_to_meet_terms(spark, index, tmp_path):
    lexical.build(spark.createDataFrame(list(enumerate(COMMON)), "chunk_id long, text string"), str(tmp_path))
    own = blocks.build(spark, str(tmp_path))
    assert blocks.differences(own).first().n_other_headers == 0
    plan = own.bounds(asked(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(term" not in plan


def test_runs_are_taken_apart_as_identifiers(spark):
    """Runs without an identifier, at the edges of slices and of texts, and many texts at once."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["-", "_ -- a", "-a-", "a_-b", "x--y_z1", "é-é", " ", "A1-b2_C", *ODD] * 70)], "chunk_id long, text string").coalesce(1)
    found = lexical.counted(rows).selectExpr("chunk_id", "dl", "coalesce(array_join(array_sort(split(terms, ' ')), ' '), '') AS t", "size(tf) AS n").collect()
    t = T.tokens(F.col("text"))
    own = rows.select("chunk_id", F.size(t).alias("dl"), F.array_join(F.array_sort(F.array_distinct(t)), " ").alias("t"), F.size(F.array_distinct(t)).alias("n")).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, own))


def test_frequencies_are_counted_without_postings(spark, index):
    own = lexical.frequencies(index.documents)
    assert sorted(map(tuple, own.collect())) == sorted((r.term, r["count"]) for r in index.postings.groupBy("term").count().collect())
    assert "Generate" not in own._jdf.queryExecution().executedPlan().toString()


def test_queries_with_their_own_settings_share_a_scan(spark, index):
    grid = [(0.5, 0.0), (1.2, 0.5), (2.0, 1.0)]
    both = spark.createDataFrame([(10 * i + q, t, k1, b) for i, (k1, b) in enumerate(grid) for q, t in enumerate(("common word3", "rare number4 number4"))], f"{ASKED}, k1 double, b double")
    found = sorted(map(tuple, index.search(both, 7).collect()))
    each = [(10 * i + r.query_id, r["rank"], r.chunk_id, r.score) for i, (k1, b) in enumerate(grid) for r in index.search(asked(spark).where("query_id < 2"), 7, k1, b).collect()]
    assert found == sorted(each)
    assert index.scanned(both).heads(7)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    with pytest.raises(ValueError):
        index.search(both.withColumn("b", F.lit(2.0)), 7)

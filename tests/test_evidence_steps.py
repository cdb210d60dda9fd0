"""Evidence of many answers: turns that stand twice, answers that share evidence, and what is read for ranks and sources."""

import os

import duckdb
import pytest

from lodeseek import queries as core
from lodeseek.operators import evidence, lexical

NAMES = "documents benchmark conversations labels".split()


@pytest.fixture(scope="module")
def twice(spark, tmp_path_factory):
    """The smallest tables with a third of all turns twice."""
    at = str(tmp_path_factory.mktemp("twice"))
    for t in NAMES:
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        if t == "conversations":
            rows = rows.unionByName(rows.where("conv_id % 3 = 0"))
        rows.coalesce(1).write.parquet(f"{at}/{t}.parquet")
    return at


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["cited_evidence", "citation_validate", "answer_sources"])
def test_turns_that_stand_twice(spark, twice, name):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(twice, t)}.parquet/*.parquet')")
    theirs = con.execute(core.ORACLE_SQL[name])
    names = [c[0] for c in theirs.description]
    mine = core.QUERIES[name](spark, twice).select(*names).collect()
    assert sorted(str(tuple(r)) for r in mine) == sorted(map(str, theirs.fetchall()))


def test_answers_share_evidence(spark):
    found = spark.createDataFrame([(7, "S1", "a"), (7, "S2", "b"), (8, "S1", "c")], "topic long, source_id string, chunk_id string")
    answers = spark.createDataFrame([("x", 7, "[S2] [S1]"), ("y", 7, "[S3]"), ("z", 8, "[S1]"), ("w", 9, "[S1]")], "query_id string, topic long, answer string")
    rows = evidence.validated(answers, found, "topic")
    assert {r.query_id: (r.unknown, r.valid) for r in rows.collect()} == {"x": ([], True), "y": (["S3"], False), "z": ([], True), "w": (["S1"], False)}
    assert sorted((r.query_id, r.place, r.chunk_id) for r in evidence.cited_evidence(rows, found, "topic").collect()) == [("x", 1, "b"), ("x", 2, "a"), ("z", 1, "c")]


def test_answers_are_not_shuffled(spark):
    assert "hashpartitioning(query_id" not in plan(core.citation_validate(spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("name", ["scope_filter_docs", "scope_filter_all", "evidence_ids"])
def test_no_text_is_read_for_ranks_and_paths(spark, name):
    assert "text:string" not in plan(core.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_contents_are_not_carried_to_the_evidence(spark):
    assert {"content", "end_line"}.isdisjoint(core.found(spark, "/root/testdata/sf0.001").columns)


@pytest.mark.parametrize("name", ["scope_filter_docs", "scope_filter_all"])
def test_paths_come_with_the_scan(spark, name):
    own = plan(core.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "Join" not in own and "WindowGroupLimit" in own


@pytest.mark.parametrize("k", [3, None])
def test_columns_that_a_search_carries(spark, tmp_path, k):
    rows = [(i, "alpha beta" if i % 2 else "alpha gamma gamma", None if i == 4 else f"p{i}") for i in range(9)]
    index = lexical.build(spark.createDataFrame(rows, "chunk_id long, text string, file_path string"), str(tmp_path / "index"))
    asked = spark.createDataFrame([(0, "gamma"), (1, "alpha beta")], "query_id long, query_text string")
    found = index.search(asked, k, carry=("file_path",)).collect()
    assert {r.chunk_id: r.file_path for r in found if r.query_id == 0} == {i: rows[i][2] for i in (0, 2, 4, 6, 8)[:k]}
    assert sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in found) == sorted(map(tuple, index.search(asked, k).collect()))


@pytest.mark.parametrize("conversations", [[3, 43, 7], []])
def test_only_items_of_answers_are_searched_for(spark, twice, tmp_path, conversations):
    for t in NAMES:
        rows = spark.read.parquet(f"{twice}/{t}.parquet")
        (rows.where(rows.conv_id.isin(conversations)) if t == "conversations" else rows).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    _, own = core._validated(spark, str(tmp_path))
    assert {r.item for r in own.collect()} == {x % 40 for x in conversations}

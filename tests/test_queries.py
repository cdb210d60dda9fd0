"""Every query that has SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from lodeseek import queries as core

SMALLEST = entry.SMALLEST
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALLEST}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(core.ORACLE_SQL))
def test_as_sql(spark, db, name):
    mine = core.QUERIES[name](spark, SMALLEST)
    theirs = db.execute(core.ORACLE_SQL[name])
    names = [c[0] for c in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    rows = sorted(map(str, (tuple(r) for r in mine.select(*names).collect())))
    assert rows == sorted(map(str, theirs.fetchall()))


def test_structural_units(spark):
    found = core.structural_units(spark, SMALLEST)
    turns = spark.read.parquet(f"{SMALLEST}/conversations.parquet").where("text IS NOT NULL").count()
    assert found.where("parser_status = 'parsed' AND chunk_type = 'function'").count() == turns


def test_dry_run_answers(spark):
    rows = core.qa_dry_run(spark, SMALLEST).collect()
    assert len(rows) == 40 and all(r.valid and r.cited == "S1" and r.n_sources == 5 for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

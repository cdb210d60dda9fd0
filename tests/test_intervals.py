"""Containment of intervals, links and flags of citations, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodeseek import queries
from lodeseek.operators import evidence, intervals

SCHEMA = "file_path string, id long, start long, end long"


def brute(boxes, spans):
    out = []
    for f, i, s, e in spans:
        around = [(be - bs, bs, bi, be) for bf, bi, bs, be in boxes if bf == f and None not in (s, e, bs, be) and bs <= s and be >= e and (bs, be) != (s, e)]
        best = min(around, default=(None,) * 4)
        out.append((f, i, s, e, best[2], best[1], best[3]))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    made = []
    for i in range(900):
        start, size = r.randrange(3000), int(r.paretovariate(0.5)) % 2500
        made.append((r.choice(("hot", "hot", "hot", "a", "b")), i, start, start + size))
    made += [("hot", 2000, 0, 1 << 40), ("hot", 2001, 0, 0), ("hot", 2002, 1 << 40, 1 << 40), ("a", 2003, 7, 7), ("b", 2004, None, 9), ("b", 2005, 3, None), (None, 2006, 1, 2), ("c", 2007, 5, 9), ("c", 2008, 5, 9)]
    return made


def test_narrowest(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = intervals.narrowest(df, df)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, brute(rows, rows)))
    inside = {r.id for r in intervals.inside_any(df, df).collect()}
    assert inside == {x[1] for x in brute(rows, rows) if x[4] is not None}


def test_no_python_and_no_cross_join(spark):
    boxes, spans = queries.spans_of(spark, "/root/testdata/sf0.001")
    plan = intervals.narrowest(boxes, spans, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_empty(spark, rows):
    df, none = spark.createDataFrame(rows[:5], SCHEMA), spark.createDataFrame([], SCHEMA)
    assert intervals.narrowest(none, df).where("container_id IS NULL").count() == 5
    assert intervals.narrowest(df, none).count() == 0


CASES = [
    "", None, "plain [S1] and [S0] and [S12]", "`[S1]` [S2]", "```\n[S1]\n``` [S2] `x`[S3]", "`open [S1]", "text `open [S1]", "`a``[S1]", "``[S1]``", "```[S1]", "[S1]```py\n`q` [S2]```[S3]",
    "`line\n[S1]`", "[s1] [S] [S1", "é`[S1]`é[S1]", "\\[S1] $1 [S1]$", "[S1]" * 500, "`" * 3001 + "[S1]",
]


def test_links(spark):
    def linked(text):
        parts = re.split("(```[\\s\\S]*?```|`[^`\\n]+`)", text)
        return "".join(p if p.startswith("`") else re.sub(r"\[(S[0-9]+)\]", r"[\1](#source-\1)", p) for p in parts)

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "i int, t string").select("i", evidence.linked(F.col("t")).alias("x")).collect()
    assert {r.i: r.x for r in rows} == {i: None if t is None else linked(t) for i, t in enumerate(CASES)}


def test_flags(spark):
    found = spark.createDataFrame([(q, f"S{i}") for q in (1, 2, 3) for i in (1, 2)], "query_id long, source_id string")
    answers = evidence.validated(spark.createDataFrame([(1, "see [S2] and [S2] and [S9]"), (2, "none")], "query_id long, answer string"), found)
    assert {(r.query_id, r.source_id): r.is_cited for r in evidence.with_cited(found, answers).collect()} == {(q, f"S{i}"): (q, i) == (1, 2) for q in (1, 2, 3) for i in (1, 2)}

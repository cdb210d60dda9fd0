import hashlib
import random
import re

import pytest

from lodeseek.llm import fill_middle, queries

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    r = random.Random(5)
    around = [" ".join(["ab"] * k) + "x" * j for k in (41, 42, 43, 85) for j in range(4)]
    edges = ["a" * k + t for k in range(122, 130) for t in ("<P>", "<S", "< P>", "é<M>", "🙂z", "<<S>>")]
    mixed = ["".join(r.choices("abPSM<>é中🙂\n \x00", k=r.randrange(400))) for _ in range(400)]
    return ["", None, "x", "<P>", "<P", "P>", "<", "a" * 5000, "é" * 3000, "🙂" * 1000, "Straße <p> ", "words and words " * 40_000, *around, *edges, *mixed]


@pytest.fixture(scope="module")
def rows():
    return [*enumerate(texts()), (7, "a second row of seven"), (7, "a second row of seven"), (None, "no id"), (None, None)]


def test_as_brute_force(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], "doc_id long, text string, form string, output string, `a.b` int").repartition(3)
    found = fill_middle.fill_in_middle(docs)
    back = fill_middle.restored(found.output, found.form).alias("back")
    made = found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", back).collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in made))) == sorted(map(repr, (brute(d, t) for d, t in rows)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.back) for r in made) == sorted((d is None, d or 0, t or "") for d, t in rows)
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_every_cut_of_a_text():
    """Cuts after each number of units, in texts whose units and sentinels cross the borders of lanes."""
    import numpy as np

    for text in ("ab c" * 100, "é" * 200, "z" * 300 + "é" + "z" * 300, "🙂<a>" * 70):
        data, units = text.encode(), UNIT.findall(text)
        scan = fill_middle.Scan([b"before", data, b""])
        assert scan.n.tolist() == [1, len(units), 0]
        after = np.arange(len(units) + 1)
        ends = scan.cuts(np.ones(len(after), np.int64), after)
        assert ends.tolist() == [len("".join(units[:k]).encode()) for k in after]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    found = fill_middle.fill_in_middle(docs)
    assert found.count() == 0 and dict(found.dtypes)["doc_id"] == "int"


def test_texts_that_are_no_utf8(spark):
    """Bytes that continue nothing belong to what stands before them; the bytes come back as they were."""
    docs = spark.sql("SELECT id AS doc_id, cast(unhex('80416280FF3C503E') AS string) AS text FROM range(4)")
    found = fill_middle.fill_in_middle(docs)
    assert {r.x for r in found.selectExpr("hex(output) AS x").collect()} == {"80416280FF3C503E"}


def test_query_as_sql(spark):
    import duckdb

    from __spark_entry__ import SMALLEST

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALLEST}/documents.parquet')")
    mine = queries.op11_fill_in_middle(spark, SMALLEST)
    theirs = con.execute(queries.ORACLE_SQL["op11_fill_in_middle"])
    assert [c[0] for c in theirs.description] == mine.columns
    assert sorted(map(repr, (tuple(r) for r in mine.collect()))) == sorted(map(repr, theirs.fetchall()))

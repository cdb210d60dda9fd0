"""Column names with dots, blanks and backticks pass every stage."""

import corpus_pipeline
from lodeseek.llm import mixing, simhash

NAMES = ["doc_id", "text", "a.b", "two words", "q`t", "text.x", "0"]


def test_every_stage(spark, tmp_path):
    say = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(6)]
    rows = [(i, t, i, f"c{i}", i * 2, "t", 0) for i, t in enumerate([*say, say[0], say[1] + "\n" + say[2], None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, c int, d string, e int, f string, g int").toDF(*NAMES)
    spark.createDataFrame([(i, int(i == 3), 1) for i in range(9)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("x", say[5])], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == NAMES, name
        got = docs.collect()
        assert all(x["a.b"] == x.doc_id and x["two words"] == f"c{x.doc_id}" and x["q`t"] == 2 * x.doc_id for x in got), name
        docs = spark.createDataFrame(got, docs.schema)
    assert {0, 1, 2} <= {x.doc_id for x in got} and 5 not in {x.doc_id for x in got}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {x.doc_id for x in packed.collect()} == {x.doc_id for x in got}
    assert simhash.keep_first(docs).columns == NAMES
    first = mixing.emit(docs.withColumn("source", docs.doc_id.cast("string"))).first()
    assert first is None or first.row["a.b"] == first.row.doc_id

"""Extra columns of documents with names that the line stage uses itself."""

import corpus_pipeline


def test_line_stage_takes_any_column(spark):
    docs = [(1, "one two three four\nfive six seven eight", 39, 7, "a"), (2, "one two three four\nnine ten eleven twelve", 41, 8, "b"), (3, None, 0, 9, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_chars long, n_removed int, row string")
    got = corpus_pipeline.cut_lines(spark, frame, "")
    assert got.dtypes == frame.dtypes
    want = [docs[0], (2, "nine ten eleven twelve", 22, 8, "b"), docs[2]]
    assert sorted(map(tuple, got.collect())) == want

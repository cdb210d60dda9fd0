"""What a task holds at once of long slices."""

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodeseek.operators import blocks, lexical
from lodeseek.sources import tables

DOCUMENTS, WORDS = 900, 1000


@pytest.fixture(scope="module")
def long(spark, tmp_path_factory):
    """Documents of many different words, read in one task."""
    path = str(tmp_path_factory.mktemp("long") / "index")
    word = lambda x: F.translate(F.lower(F.hex(F.xxhash64("id", x))), "0123456789", "ghijklmnop")
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(WORDS)), word), " ")
    lexical.build(spark.range(0, DOCUMENTS, 1, 1).select(F.col("id").alias("chunk_id"), text.alias("text")), path)
    return blocks.build(spark, path), path


def test_row_groups_stay_small(long):
    """Spark decodes a row group of slices at once, so it is not as large as a file."""
    groups = [m.row_group(i) for f in glob.glob(f"{long[1]}/blocks/*.parquet") for m in [pq.ParquetFile(f).metadata] for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == -(-DOCUMENTS // blocks.SLICE)
    assert sum(g.total_byte_size for g in groups) > 24 << 20 > max(g.total_byte_size for g in groups)


def test_heads_of_many_postings(spark, long, tmp_path):
    """Slices that take several portions are all held against their documents."""
    index, _ = long
    found = blocks.differences(index).first()
    assert (found.n_terms, found.n_postings, found.n_blocks, found.n_other_headers) == (DOCUMENTS * WORDS, DOCUMENTS * WORDS, DOCUMENTS * WORDS, 0)
    for name, changed, count in (("n", "transform(n, (x, i) -> IF(i < 3, x + 1, x)) AS n", 3), ("terms", "concat(terms, 'x') AS terms", 2)):
        rows = index.blocks.selectExpr(*(changed if c == name else c for c in index.blocks.columns))
        rows.write.parquet(str(tmp_path / name))
        other = blocks.BlockIndex(spark.read.parquet(str(tmp_path / name)), index.index)
        assert blocks.differences(other).first().n_other_headers == count * index.blocks.count()


def test_portions():
    n = blocks._AT_ONCE
    lengths, starts = np.array([1, n, 0, n // 2, n // 2, 1, 0, 0, 2 * n, 5]), np.array([0, 2, 4, 6, 7, 8, 9])
    assert [*blocks._portions(lengths, starts)] == [(0, 1), (1, 2), (2, 5), (5, 6), (6, 7)]
    assert [*blocks._portions(lengths[:0], starts[:0])] == []


def test_batches_are_short_inside_alone(spark):
    sizes = lambda: [r.n for r in spark.range(0, 50, 1, 1).mapInArrow(lambda x: (b.from_pydict({"n": [b.num_rows]}) for b in x), "n long").collect()]
    with tables.batches_of(spark, 20):
        assert sizes() == [20, 20, 10]
        with tables.batches_of(spark, 30):
            assert sizes() == [20, 20, 10]
    assert sizes() == [50]

"""Artifacts are published whole: commit, abort, equal bytes, and what readers see."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from lodeseek.operators.chunking import chunk_files
from lodeseek.plans.snapshots import Incompatible
from lodeseek.sources import artifacts
from lodeseek.sources.repository import Snapshot

SNAPSHOT = Snapshot("repo", "/somewhere/repo", "local", "/somewhere/repo", "c1", "main")
SETTINGS = {"k1": 1.5, "b": 0.75, "reranker": "overlap", "naïve": "ß"}


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(f"src/f{i}.txt", ".txt", "Text", i, None if i % 4 else "binary_content", f"alpha {i}\nß   line\n" * (i + 1)) for i in range(40)]
    return spark.createDataFrame(rows, "relative_path string, extension string, language string, size_bytes long, reason string, text string")


@pytest.fixture(scope="module")
def chunks(judged):
    files = judged.where("reason IS NULL").withColumnRenamed("relative_path", "file_path")
    return chunk_files(files.select(F.lit("repo").alias("repository"), F.lit("c1").alias("commit_hash"), "file_path", "language", "extension", "text"))


def bytes_below(path):
    out = {}
    for top, _, names in os.walk(path):
        for n in names:
            with open(f"{top}/{n}", "rb") as f:
                out[os.path.relpath(f"{top}/{n}", path)] = hashlib.sha256(f.read()).hexdigest()
    return {k: v for k, v in out.items() if not k.endswith(".crc")}


def test_round_trip(spark, chunks, judged, tmp_path):
    made = artifacts.publish(chunks, judged, str(tmp_path / "a"), SNAPSHOT, SETTINGS, parts=5)
    assert (made.n_rows("chunks"), made.n_rows("files"), made.n_rows("skipped")) == (chunks.count(), 30, 10)
    assert made.snapshot["commit_hash"] == "c1" and made.settings == SETTINGS and made.created.endswith("Z")
    back = artifacts.read(spark, made, "chunks")
    assert back.select(*chunks.columns).exceptAll(chunks).count() == 0 == chunks.exceptAll(back.select(*chunks.columns)).count()
    assert {r.relative_path: r.reason for r in artifacts.read(spark, made, "skipped").collect()} == {f"src/f{i}.txt": "binary_content" for i in range(0, 40, 4)}
    assert artifacts.damaged(spark, made).count() == 0
    name = made.parts[0]["name"]
    with open(tmp_path / "a" / "versions" / made.version / name, "a") as f:
        f.write("more")
    assert [r.name for r in artifacts.damaged(spark, made).collect()] == [name]


def test_equal_input_gives_equal_bytes(chunks, judged, tmp_path):
    for name, c, j in (("a", chunks, judged), ("b", chunks.repartition(7), judged.repartition(3))):
        artifacts.publish(c, j, str(tmp_path / name), SNAPSHOT, SETTINGS, created="2020-01-01T00:00:00Z", parts=4)
    assert bytes_below(tmp_path / "a") == bytes_below(tmp_path / "b")
    before = bytes_below(tmp_path / "a")
    artifacts.publish(chunks, judged, str(tmp_path / "a"), SNAPSHOT, SETTINGS, parts=4)
    assert bytes_below(tmp_path / "a") == before and not os.listdir(tmp_path / "a" / "staging")


def test_a_failed_write_leaves_the_old_artifact(spark, chunks, judged, tmp_path):
    path = str(tmp_path / "a")
    made = artifacts.publish(chunks, judged, path, SNAPSHOT, SETTINGS, parts=4)
    before = bytes_below(path)
    broken = chunks.withColumn("content", F.when(F.col("file_path") == "src/f13.txt", F.raise_error(F.lit("no"))).otherwise(F.col("content")))
    with pytest.raises(Exception):
        artifacts.publish(broken, judged, path, SNAPSHOT, SETTINGS, parts=4)
    assert artifacts.current(path) == made and bytes_below(path) == before


def test_a_reader_keeps_its_version(spark, chunks, judged, tmp_path):
    path = str(tmp_path / "a")
    first = artifacts.publish(chunks, judged, path, SNAPSHOT, SETTINGS, parts=3)
    fewer = chunks.where("file_path <> 'src/f1.txt'")
    second = artifacts.publish(fewer, judged.where("relative_path <> 'src/f1.txt'"), path, SNAPSHOT, SETTINGS, parts=3)
    assert first.version != second.version == artifacts.current(path).version
    assert artifacts.read(spark, first, "chunks").count() == chunks.count() > artifacts.read(spark, second, "chunks").count()


def test_staleness_and_absence(spark, chunks, judged, tmp_path):
    with pytest.raises(FileNotFoundError):
        artifacts.current(str(tmp_path / "none"))
    made = artifacts.publish(chunks.limit(0), judged.limit(0), str(tmp_path / "empty"), SNAPSHOT, SETTINGS)
    assert made.parts == [] and artifacts.read(spark, made, "chunks").count() == 0
    artifacts.check_current(made, SNAPSHOT)
    for other in (Snapshot("repo", "", "local", "", "c2", "main"), Snapshot("other", "", "local", "", "c1", None)):
        with pytest.raises(Incompatible):
            artifacts.check_current(made, other)

"""Folders, skip reasons, snapshots of repositories, tables and streams."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from lodeseek.operators import chunking
from lodeseek.sources import policy, repository, tables
from lodeseek.streaming import incremental


@pytest.fixture()
def folder(tmp_path):
    files = {
        "src/main.py": b"def a():\n    return 1\n", "node_modules/x.js": b"x", ".git/config": b"y", "image.png": b"z", "encoded.py": b"\xff\xfe", "bin.py": b"a\0b", "large.py": b"x" * 900,
        "__init__.py": b"", ".eslintrc.json": b"{}", "sub/_p.py": b"p = 1\n", "Dockerfile": b"FROM x", "data/manifests/m.json": b"{}",
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    os.symlink(tmp_path / "src/main.py", tmp_path / "link.py")
    return str(tmp_path)


def test_folder(spark, folder):
    rows = repository.judged(repository.read_folder(spark, folder, 800), 800)
    taken = {r.relative_path: r.language for r in repository.accepted(rows).collect()}
    assert taken == {"src/main.py": "Python", "__init__.py": "Python", ".eslintrc.json": "JSON", "sub/_p.py": "Python", "Dockerfile": "Dockerfile"}
    left = {r.relative_path: r.reason for r in repository.skipped(rows).collect()}
    assert left == {"image.png": "unsupported_extension", "encoded.py": "not_utf8", "bin.py": "binary_content", "large.py": "exceeds_size_limit:800", "link.py": "symbolic_link"}
    one = tables.manifest(rows).first()
    assert (one.n_accepted, one.n_skipped) == (5, 5)


def test_policy_columns(spark):
    df = spark.createDataFrame([(p,) for p in ("a/Build/x.py", "data/manifests/x.json", "makefile", "x/build.py", "a/b/.github/cache/x.md", "n.weird")], "p string")
    rows = df.select(policy.is_left_out(F.col("p")), policy.language(F.col("p")), policy.extension(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [(True, "Python", ".py"), (True, "JSON", ".json"), (False, "Makefile", ""), (False, "Python", ".py"), (False, "Markdown", ".md"), (False, None, None)]


def test_snapshot(folder, tmp_path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@x", *a], cwd=folder, check=True, capture_output=True)
    assert repository.snapshot(folder).commit_hash is None
    (tmp_path / ".git/config").unlink()
    git("init", "-b", "main")
    git("add", "src")
    git("commit", "-m", "x")
    own = repository.snapshot(folder)
    assert len(own.commit_hash) == 40 and own.branch == "main"
    assert repository.snapshot(f"{folder}/src").commit_hash is None


@pytest.mark.parametrize("address,found", [("https://github.com/Own/repo.git", ("Own", "repo", "https://github.com/Own/repo.git")), ("http://www.github.com/a/b/", ("a", "b", "https://github.com/a/b.git"))])
def test_remote(address, found):
    assert repository.remote_identity(address) == found


@pytest.mark.parametrize("address", ["https://example.com/a/b", "https://github.com/a", "ssh://github.com/a/b", "https://github.com/a/.git"])
def test_remote_refused(address):
    with pytest.raises(ValueError):
        repository.remote_identity(address)


def test_chunk_tables(spark, folder, tmp_path):
    made = chunking.chunk_files(repository.files_of(spark, folder))
    tables.write_chunks(made, str(tmp_path / "p"))
    tables.export_chunks(made.withColumn("content", F.concat("content", F.lit("\u2028\u0085x"))), str(tmp_path / "j"))
    assert chunking.difference(tables.read_chunks(spark, str(tmp_path / "p")), made).isEmpty()
    back = tables.import_chunks(spark, str(tmp_path / "j"))
    assert back.count() == made.count() and back.where(~F.col("content").endswith("\u2028\u0085x")).isEmpty()


def test_stream(spark, tmp_path):
    schema = "repository string, commit_hash string, file_path string, language string, extension string, text string"
    row = lambda name, text: [("r", None, name, "Python", ".py", text)]

    def run():
        files = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        incremental.chunk_stream(files, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return tables.read_chunks(spark, str(tmp_path / "out"))

    spark.createDataFrame(row("a.py", "def f():\n    pass\n"), schema).write.mode("append").json(str(tmp_path / "in"))
    assert run().count() == 1
    spark.createDataFrame(row("a.py", "def f():\n    pass\n") + row("b.py", "x = 1\n"), schema).write.mode("append").json(str(tmp_path / "in"))
    assert {r.file_path for r in run().collect()} == {"a.py", "b.py"} and run().count() == 2

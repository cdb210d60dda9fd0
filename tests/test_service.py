"""Typed errors before a repository is asked, outcomes of questions, and counters of the run that answers them."""

import subprocess

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lodeseek.functions.text import lexical_text
from lodeseek.operators import lexical
from lodeseek.operators.chunking import chunk_files
from lodeseek.plans import answering, service
from lodeseek.sources import artifacts, repository

SETTINGS = {"k1": 1.5}


@pytest.fixture()
def folder(tmp_path):
    at = tmp_path / "project"
    at.mkdir()
    (at / "a.md").write_text("alpha beta\n")
    git = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@x", *a], cwd=at, check=True, capture_output=True)
    git("init", "-b", "main")
    git("add", ".")
    git("commit", "-m", "x")
    return str(at), git


def refused(code, *how):
    with pytest.raises(service.RequestError) as e:
        service.opened(*how)
    assert (e.value.code, e.value.status) == (code, service.STATUS[code]) and e.value.body()["code"] == code


def test_checks_before_a_repository_is_asked(spark, folder, tmp_path):
    at, git = folder
    path = str(tmp_path / "artifact")
    refused("repository_not_found", str(tmp_path / "none"), path)
    refused("repository_not_indexed", at, path)
    files = repository.judged(repository.read_folder(spark, at))
    artifacts.publish(chunk_files(repository.files_of(spark, at)), files, path, repository.snapshot(at), SETTINGS, parts=2)
    made = service.opened(at, path, SETTINGS)
    assert made.n_rows("chunks") == 1 and artifacts.read(spark, made, "chunks").first().content == "alpha beta\n"
    refused("incompatible_artifacts", at, path, {"k1": 2.0})
    (tmp_path / "other").mkdir()
    refused("incompatible_artifacts", str(tmp_path / "other"), path)
    git("commit", "--allow-empty", "-m", "y")
    refused("stale_artifacts", at, path)
    (tmp_path / "copies" / "project").mkdir(parents=True)
    refused("git_repository_required", str(tmp_path / "copies" / "project"), path)
    (tmp_path / "artifact" / "CURRENT").write_text("unknown\n")
    refused("repository_not_indexed", at, path)


def test_outcomes_and_counters(spark, tmp_path):
    rows = [("repo", "c", f"f{i}.md", "Markdown", ".md", f"alpha word{i}") for i in range(4)]
    chunks = chunk_files(spark.createDataFrame(rows, "repository string, commit_hash string, file_path string, language string, extension string, text string"))
    index = lexical.build(chunks.select("chunk_id", lexical_text().alias("text")), str(tmp_path / "i"))
    questions = spark.createDataFrame([(1, "word1"), (2, "alpha"), (3, "nothing like it")], "query_id long, query_text string")
    watch = Observation("answers")
    answers, _ = answering.answer(answering.Retriever(chunks, index), questions, answering.Request("bm25", 2), watch=watch)
    found = {r.query_id: (r.code, r.status) for r in service.outcomes(answers).collect()}
    assert found == {1: ("ok", 200), 2: ("ok", 200), 3: ("no_evidence", 404)}
    assert watch.get == {"n_questions": 3, "n_sources": 4, "n_without_evidence": 1, "n_answered": 2, "n_valid": 2}
    failed = service.outcomes(answers.withColumn("answer", F.lit(None).cast("string")))
    assert {r.query_id: r.code for r in failed.collect()} == {1: "generation_failed", 2: "generation_failed", 3: "no_evidence"}

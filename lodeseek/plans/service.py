"""What a caller is told: typed errors with a code and an HTTP status, checks before a repository is asked, and the outcome of each question."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.plans.snapshots import Incompatible
from lodeseek.sources import artifacts, repository

#: The status of each code.
STATUS = {
    "invalid_request": 422, "repository_not_found": 404, "repository_not_indexed": 409, "incompatible_artifacts": 409, "git_repository_required": 422, "stale_artifacts": 409,
    "no_evidence": 404, "provider_key_missing": 503, "generation_output_limit": 422, "generation_failed": 502,
}


class RequestError(ValueError):
    """A request that cannot be answered."""

    def __init__(self, code: str, detail: str):
        super().__init__(detail)
        self.code, self.status, self.detail = code, STATUS[code], detail

    def body(self) -> dict:
        return {"code": self.code, "detail": self.detail}


def opened(folder: str, path: str, settings: dict | None = None) -> artifacts.Manifest:
    """The artifact at path for the repository in folder, if it is of this repository as it is now, and made with these settings."""
    if not os.path.isdir(folder):
        raise RequestError("repository_not_found", "there is no such folder")
    try:
        manifest = artifacts.current(path)
    except FileNotFoundError as e:
        raise RequestError("repository_not_indexed", "nothing is published for this repository yet") from e
    except (ValueError, KeyError) as e:
        raise RequestError("incompatible_artifacts", "what is published cannot be read; publish it again") from e
    now = repository.snapshot(folder)
    if manifest.snapshot["name"] != now.name or settings is not None and manifest.settings != settings:
        raise RequestError("incompatible_artifacts", "what is published is of another repository or other settings")
    if manifest.snapshot["commit_hash"] is not None and now.commit_hash is None:
        raise RequestError("git_repository_required", "the folder is not the git repository that was published")
    try:
        artifacts.check_current(manifest, now)
    except Incompatible as e:
        raise RequestError("stale_artifacts", "the repository is at another commit; publish it again") from e
    return manifest


def outcomes(answers: DataFrame, dry_run: bool = False) -> DataFrame:
    """answers with code and status of each question: no_evidence where nothing was found, generation_failed where no text came of it, else ok and 200."""
    code = F.when(F.col("n_sources") == 0, "no_evidence").when(F.col("answer").isNull() & F.lit(not dry_run), "generation_failed").otherwise("ok")
    return answers.withColumn("code", code).withColumn("status", status_of(F.col("code")))


def status_of(code: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair]), code), F.lit(200))

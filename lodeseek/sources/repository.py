"""A folder of source files as a table, and what snapshot of a repository it is.

Spark's own file source leaves out names that begin with a dot or an underscore, so folders are listed here.
The driver opens the uppermost folders only, until it has found enough subtrees; a task lists and reads one subtree, or one
share of the files of a folder that the driver opened. No list of files ever reaches the driver. Folders that are left out are never
entered, nor are subtrees that no wanted path lies in, and files that a filter excludes are not opened.
"""

from __future__ import annotations

import os
import re
import subprocess
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith,
)

from lodeseek.sources import policy

SCHEMA = "relative_path string, size_bytes long, is_symlink boolean, content binary, error string, folder string, suffix string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
Entry = tuple[str, int, bool, str | None]


@dataclass
class Wanted:
    """What the filters on a listing leave: each test takes the values of its column; folders are prefixes that every path has one of."""

    tests: list[tuple[str, Callable]] = field(default_factory=list)
    folders: list[tuple[str, ...]] = field(default_factory=list)

    def take(self, f: Filter) -> bool:
        """Whether the filter is one that listing can decide, and if so, keep it. Nothing is null in the columns that count here."""
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if column not in ("relative_path", "folder", "suffix", "size_bytes"):
            return False
        tests = {
            EqualTo: lambda x: x == f.value, In: lambda x: x in f.value, GreaterThan: lambda x: x > f.value, GreaterThanOrEqual: lambda x: x >= f.value, LessThan: lambda x: x < f.value,
            LessThanOrEqual: lambda x: x <= f.value, IsNotNull: lambda x: True, StringStartsWith: lambda x: x.startswith(f.value), StringEndsWith: lambda x: x.endswith(f.value),
        }
        if type(f) not in tests:
            return False
        self.tests.append((column, tests[type(f)]))
        if column in ("relative_path", "folder") and isinstance(f, (EqualTo, In, StringStartsWith)):
            self.folders.append(tuple(f.value) if isinstance(f, In) else (f.value,))
        return True

    def has(self, entry: Entry) -> bool:
        values = {"relative_path": entry[0], "folder": _folder(entry[0]), "suffix": _suffix(entry[0]), "size_bytes": entry[1]}
        return all(test(values[column]) for column, test in self.tests)

    def may_hold(self, folder: str) -> bool:
        """Whether a wanted path can lie in the folder or below it."""
        inside = f"{folder}/"
        return all(any(inside.startswith(x) or x.startswith(inside) or x == folder for x in either) for either in self.folders)


def _folder(path: str) -> str:
    return path.rpartition("/")[0]


def _suffix(path: str) -> str:
    return os.path.splitext(path)[1].lower()


def _opened(root: str, at: str) -> tuple[list[str], list[str], Entry | None]:
    """(folders, other names, error) of one folder: folders that are entered only."""
    folders, names = [], []
    try:
        with os.scandir(f"{root}/{at}") as found:
            for e in found:
                path = f"{at}/{e.name}" if at else e.name
                if not e.is_dir(follow_symlinks=False):
                    if not (e.is_symlink() and e.is_dir()):
                        names.append(path)
                elif e.name.lower() not in policy.LEFT_OUT and path.lower() not in policy.LEFT_OUT_PATHS:
                    folders.append(path)
    except OSError as e:
        return [], [], (at or ".", 0, False, f"directory {type(e).__name__}")
    return sorted(folders), sorted(names), None


@dataclass
class Subtree(InputPartition):
    """A folder with all below it, or one of several shares of its own files."""

    folder: str
    deep: bool = True
    share: int = 0
    shares: int = 1


class _Reader(DataSourceReader):
    def __init__(self, root: str, max_bytes: int, subtrees: int, per_task: int, contents: bool = True):
        self.root, self.max_bytes, self.subtrees, self.per_task, self.contents = root, max_bytes, subtrees, per_task, contents
        self.wanted = Wanted()

    def partitions(self) -> list[InputPartition]:
        """Opens folders from the root on, breadth first, until there are enough; names of files are counted and forgotten."""
        waiting, found = deque([""]), []
        while waiting and len(waiting) + len(found) < self.subtrees:
            at = waiting.popleft()
            folders, names, _ = _opened(self.root, at)
            waiting.extend(f for f in folders if self.wanted.may_hold(f))
            shares = max(1, -(-len(names) // self.per_task))
            found.extend(Subtree(at, False, i, shares) for i in range(shares))
        return found + [Subtree(at) for at in waiting]

    def _listed(self, part: Subtree) -> Iterator[Entry]:
        waiting = [part.folder]
        while waiting:
            folders, names, error = _opened(self.root, waiting.pop())
            if error and not part.share:
                yield error
            if part.deep:
                waiting.extend(f for f in folders if self.wanted.may_hold(f))
            for path in names:
                if zlib.crc32(path.encode(errors="surrogateescape")) % part.shares == part.share:
                    full = f"{self.root}/{path}"
                    try:
                        yield path, os.lstat(full).st_size, os.path.islink(full), None
                    except OSError as e:
                        yield path, 0, False, type(e).__name__

    def read(self, part: Subtree) -> Iterator[tuple]:
        for entry in filter(self.wanted.has, self._listed(part)):
            path, size, link, error = entry
            content = None
            known = os.path.basename(path).lower() in policy.NAMED or _suffix(path) in policy.LANGUAGES
            if self.contents and known and not link and not error and size <= self.max_bytes:  # others are never opened
                try:
                    with open(f"{self.root}/{path}", "rb") as f:
                        content = f.read()
                except OSError as e:
                    error = type(e).__name__
            yield path, size, link, content, error, _folder(path), _suffix(path)


class _FilteringReader(_Reader):
    """Spark rejects a reader that takes filters while PUSHDOWN is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.wanted.take(f)]


class RepositorySource(DataSource):
    """spark.read.format("repository").option("path", folder).load(); with PUSHDOWN set, option pushFilters=true decides filters in the listing."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        number = lambda name, default: int(self.options.get(name, default))
        kind = _FilteringReader if self.options.get("pushfilters", "false").lower() == "true" else _Reader
        return kind(self.options["path"].rstrip("/") or "/", number("maxbytes", policy.MAX_BYTES), number("subtrees", 256), number("filespertask", 256), self.options.get("contents", "true").lower() == "true")


def read_folder(spark: SparkSession, folder: str, max_bytes: int = policy.MAX_BYTES, subtrees: int = 256, contents: bool = True) -> DataFrame:
    """All files below a folder that every executor sees, with the columns of SCHEMA; without contents, no file is opened.

    With the session's PUSHDOWN set, conditions on relative_path, folder, suffix and size_bytes are decided while folders are listed.
    """
    if not os.path.isdir(folder):
        raise FileNotFoundError(folder)
    spark.dataSource.register(RepositorySource)
    options = {"path": folder, "maxBytes": max_bytes, "subtrees": subtrees, "contents": contents, "pushFilters": spark.conf.get(PUSHDOWN, "false")}
    return spark.read.format("repository").options(**options).load()


def judged(raw: DataFrame, max_bytes: int = policy.MAX_BYTES) -> DataFrame:
    """raw files with reason (null: taken), extension and language."""
    path = F.col("relative_path")
    below = F.when(F.col("error").startswith("directory "), F.concat(F.lit("unreadable_directory: "), F.substring("error", 11, 99)))
    reason = F.coalesce(below, policy.skip_reason(path, F.col("size_bytes"), F.col("content"), F.col("is_symlink"), F.col("error"), max_bytes))
    rows = raw.where(~policy.is_left_out(path))
    return rows.withColumns({"reason": reason, "extension": policy.extension(path), "language": policy.language(path)})


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("reason IS NULL").select("relative_path", "extension", "language", "size_bytes", F.col("content").cast("string").alias("text"))


def skipped(rows: DataFrame) -> DataFrame:
    return rows.where("reason IS NOT NULL").select("relative_path", "reason")


@dataclass(frozen=True)
class Snapshot:
    name: str
    source: str
    source_type: str
    local_path: str
    commit_hash: str | None
    branch: str | None


def _git(folder: str, *what: str) -> str | None:
    try:
        done = subprocess.run(["git", *what], cwd=folder, capture_output=True, text=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() or None if done.returncode == 0 else None


def snapshot(folder: str, source: str | None = None) -> Snapshot:
    """What a folder holds; commit and branch are null unless it is itself the root of a git repository."""
    full = os.path.realpath(folder)
    root = _git(full, "rev-parse", "--show-toplevel")
    own = root is not None and os.path.realpath(root) == full
    kind = "local" if source is None else "github"
    return Snapshot(os.path.basename(full), source or folder, kind, full, _git(full, "rev-parse", "HEAD") if own else None, _git(full, "symbolic-ref", "--short", "HEAD") if own else None)


def remote_identity(source: str) -> tuple[str, str, str]:
    """(owner, repository, clone address) of a public GitHub address; anything else is an error."""
    parsed = urlparse(source)
    parts = [p for p in parsed.path.split("/") if p]
    if parsed.scheme not in ("http", "https") or parsed.hostname not in ("github.com", "www.github.com") or len(parts) != 2:
        raise ValueError("the source must be an HTTP(S) address of one GitHub repository")
    owner, name = parts[0], re.sub(r"\.git$", "", parts[1], flags=re.IGNORECASE)
    if not name:
        raise ValueError("the source names no repository")
    return owner, name, f"https://github.com/{owner}/{name}.git"


def files_of(spark: SparkSession, folder: str, max_bytes: int = policy.MAX_BYTES) -> DataFrame:
    """The accepted files of a folder, ready for chunk_files()."""
    own = snapshot(folder)
    rows = accepted(judged(read_folder(spark, folder, max_bytes), max_bytes)).withColumnRenamed("relative_path", "file_path")
    return rows.select(F.lit(own.name).alias("repository"), F.lit(own.commit_hash).cast("string").alias("commit_hash"), "file_path", "language", "extension", "text")

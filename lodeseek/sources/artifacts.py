"""Chunks, file lists and metadata published together, or not at all.

An artifact is a folder of versions and a file CURRENT that names one of them. Tasks write JSON lines to a staging
folder; the commit moves what the tasks that count have written into a version named by its contents, writes the manifest
and then replaces CURRENT. A write that fails removes its staging folder and leaves CURRENT as it was. Rows
are dealt by a hash into a stated number of parts and sorted there, so equal input gives equal bytes on any cluster.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lodeseek.operators.chunking import CHUNK, COLUMNS
from lodeseek.plans.snapshots import Incompatible, settings_fingerprint
from lodeseek.sources.repository import Snapshot

LINE = "kind string, line string"
FILE = "relative_path string, extension string, language string, size_bytes long"
SKIPPED = "relative_path string, reason string"
SCHEMAS = {"chunks": CHUNK, "files": FILE, "skipped": SKIPPED}
PARTS = 64


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _put(fs: pafs.FileSystem, path: str, text: str) -> None:
    """A whole file or none: written beside it and moved over it."""
    beside = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(beside) as out:
        out.write(text.encode())
    fs.move(beside, path)


def _json(value) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n"


@dataclass
class Part(WriterCommitMessage):
    """A file that a task wrote: where it is staged, and what it holds."""

    kind: str
    number: int
    staged: str
    n_rows: int
    n_bytes: int
    sha256: str


@dataclass
class Written(WriterCommitMessage):
    parts: list[Part]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, about: dict, created: str):
        self.path, self.about, self.created, self.staging = path.rstrip("/"), about, created, f"staging/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file for each kind in the task's rows. Names hold the attempt, so a task that runs twice harms nothing."""
        fs, root = _opened(self.path)
        task, parts, open_ = TaskContext.get(), [], None
        fs.create_dir(f"{root}/{self.staging}")
        try:
            for batch in iterator:
                for kind, line in zip(batch.column("kind").to_pylist(), batch.column("line").to_pylist()):
                    if not parts or parts[-1].kind != kind:
                        if open_:
                            open_.close()
                        name = f"{self.staging}/{kind}-{task.partitionId():05}-{task.taskAttemptId()}"
                        parts.append(Part(kind, task.partitionId(), name, 0, 0, hashlib.sha256()))
                        open_ = fs.open_output_stream(f"{root}/{name}")
                    data = line.encode() + b"\n"
                    open_.write(data)
                    parts[-1].n_rows += 1
                    parts[-1].n_bytes += len(data)
                    parts[-1].sha256.update(data)
        finally:
            if open_:
                open_.close()
        for part in parts:
            part.sha256 = part.sha256.hexdigest()
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _opened(self.path)
        parts = sorted((p for m in messages if m for p in m.parts), key=lambda p: (p.kind, p.number))
        kept = [{"kind": p.kind, "name": f"{p.kind}/part-{p.number:05}.jsonl", "n_rows": p.n_rows, "n_bytes": p.n_bytes, "sha256": p.sha256} for p in parts]
        contents = {**self.about, "parts": kept}
        version = settings_fingerprint("artifact-1", json.dumps(contents, ensure_ascii=False, sort_keys=True))
        at = f"{root}/versions/{version}"
        if fs.get_file_info(f"{at}/manifest.json").type == pafs.FileType.NotFound:  # else these contents are there already
            for p, k in zip(parts, kept):
                fs.create_dir(f"{at}/{p.kind}")
                fs.move(f"{root}/{p.staged}", f"{at}/{k['name']}")
            fs.create_dir(at)
            _put(fs, f"{at}/manifest.json", _json({**contents, "created": self.created}))
        _put(fs, f"{root}/CURRENT", version + "\n")
        self._clear(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_opened(self.path))

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/{self.staging}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.staging}")


class ArtifactSink(DataSource):
    """rows(kind, line).write.format("artifact").option("path", ...).option("about", json).mode("append").save()"""

    @classmethod
    def name(cls) -> str:
        return "artifact"

    def schema(self) -> str:
        return LINE

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], json.loads(self.options["about"]), self.options["created"])


@dataclass(frozen=True)
class Manifest:
    """What CURRENT names: the version, its snapshot and settings, when it was made, and its parts."""

    path: str
    version: str
    snapshot: dict
    settings: dict
    created: str
    parts: list[dict]

    def n_rows(self, kind: str) -> int:
        return sum(p["n_rows"] for p in self.parts if p["kind"] == kind)


def _lines(kind: str, rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    line = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return rows.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), line.alias("line"))


def publish(chunks: DataFrame, files: DataFrame, path: str, snapshot: Snapshot, settings: dict, created: str | None = None, parts: int = PARTS) -> Manifest:
    """Make chunks, judged files(relative_path, extension, language, size_bytes, reason) and settings the current version at path.

    path is a folder or an address that driver and executors share. settings hold what fixes the chunks and the rankings made from
    them. Equal contents are one version, with the time of its first write; with `created` given, all bytes are equal.
    """
    spark = chunks.sparkSession
    spark.dataSource.register(ArtifactSink)
    taken, left = files.where("reason IS NULL"), files.where("reason IS NOT NULL")
    names = lambda schema: [c.split()[0] for c in schema.split(", ")]
    rows = _lines("chunks", chunks, list(COLUMNS), "file_path").unionByName(_lines("files", taken, names(FILE), "relative_path")).unionByName(_lines("skipped", left, names(SKIPPED), "relative_path"))
    # A file's rows are in one part, which holds a share of all files; lines are a total order.
    dealt = rows.repartition(parts, F.xxhash64("key")).sortWithinPartitions("kind", "key", "line").select("kind", "line")
    about = {"snapshot": {k: v for k, v in asdict(snapshot).items() if k != "local_path"}, "settings": settings}
    now = created or datetime.now(timezone.utc).isoformat(timespec="seconds").replace("+00:00", "Z")
    dealt.write.format("artifact").option("path", path).option("about", json.dumps(about)).option("created", now).mode("append").save()
    return current(path)


def current(path: str) -> Manifest:
    fs, root = _opened(path.rstrip("/"))
    if fs.get_file_info(f"{root}/CURRENT").type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"{path} holds no published artifact")
    version = fs.open_input_stream(f"{root}/CURRENT").read().decode().strip()
    told = json.loads(fs.open_input_stream(f"{root}/versions/{version}/manifest.json").read())
    return Manifest(path.rstrip("/"), version, told["snapshot"], told["settings"], told["created"], told["parts"])


def read(spark: SparkSession, manifest: Manifest, kind: str) -> DataFrame:
    """The rows of a kind ("chunks", "files", "skipped") of one version, whatever has been published since."""
    if not manifest.n_rows(kind):
        return spark.createDataFrame([], SCHEMAS[kind])
    return spark.read.schema(SCHEMAS[kind]).option("lineSep", "\n").json(f"{manifest.path}/versions/{manifest.version}/{kind}")


def check_current(manifest: Manifest, snapshot: Snapshot) -> None:
    """Raise if the artifact is of another repository or commit than the snapshot."""
    for name in ("name", "commit_hash"):
        if manifest.snapshot[name] != getattr(snapshot, name):
            raise Incompatible(f"{name}: the artifact is of {manifest.snapshot[name]}, the repository is at {getattr(snapshot, name)}")


def damaged(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """(name, n_bytes): parts of the manifest that are not there any more with the bytes that were written. Tasks read one file at a time."""
    told = spark.createDataFrame([(p["name"], p["n_bytes"], p["sha256"]) for p in manifest.parts], "name string, n_bytes long, sha256 string")
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(f"{manifest.path}/versions/{manifest.version}")
    found = there.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("found"))
    return told.join(found, "name", "left").where(~F.col("sha256").eqNullSafe(F.col("found"))).select("name", "n_bytes")

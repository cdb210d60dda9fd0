"""The repository source: subtrees as tasks, and filters that are decided while folders are listed."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from lodeseek.sources import policy, repository


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("many")
    for a in range(6):
        for b in range(4):
            at = root / f"part{a}" / "deep" / f"sub{b}"
            at.mkdir(parents=True)
            for i in range(7):
                (at / f"f{i}.{('py', 'md', 'bin')[i % 3]}").write_bytes(b"x" * (10 * i + a))
    (root / "flat").mkdir()
    for i in range(100):
        (root / "flat" / f"n{i}.js").write_text(str(i))
    (root / "part0" / "node_modules" / "m").mkdir(parents=True)
    (root / "part0" / "node_modules" / "m" / "x.js").write_text("x")
    os.symlink(root / "flat", root / "linked")
    os.symlink(root / "flat" / "n1.js", root / "one.js")
    return str(root)


def walked(folder):
    """Every file by os.walk, with the rules of the source."""
    out = {}
    for top, folders, names in os.walk(folder):
        folders[:] = [d for d in folders if d not in policy.LEFT_OUT and not os.path.islink(f"{top}/{d}")]
        for n in names:
            full = f"{top}/{n}"
            out[os.path.relpath(full, folder)] = (os.lstat(full).st_size, os.path.islink(full))
    return out


@pytest.mark.parametrize("subtrees", [1, 2, 9, 1000])
def test_every_file_once(spark, folder, subtrees):
    rows = repository.read_folder(spark, folder, subtrees=subtrees).collect()
    assert {r.relative_path: (r.size_bytes, r.is_symlink) for r in rows} == walked(folder)
    assert len(rows) == len(walked(folder))
    known = [r for r in rows if r.suffix in policy.LANGUAGES and not r.is_symlink]
    assert all(len(r.content) == r.size_bytes for r in known) and all(r.content is None for r in rows if r.suffix == ".bin")


def reader(folder, *filters, subtrees=9, per_task=30):
    own = repository._FilteringReader(folder, 1000, subtrees, per_task)
    return own, list(own.pushFilters(list(filters)))


def test_partitions_are_subtrees_not_files(folder):
    parts = reader(folder)[0].partitions()
    assert {type(p) for p in parts} == {repository.Subtree} and 9 <= len(parts) < 20
    flat = [p for p in reader(folder, subtrees=1000)[0].partitions() if p.folder == "flat"]
    assert [(p.share, p.shares) for p in flat] == [(i, 4) for i in range(4)]


@pytest.mark.parametrize("f,test", [
    (EqualTo(("suffix",), ".py"), lambda p, n: p.endswith(".py")), (In(("suffix",), (".md", ".js")), lambda p, n: p.endswith((".md", ".js"))), (LessThanOrEqual(("size_bytes",), 30), lambda p, n: n <= 30),
    (GreaterThan(("size_bytes",), 30), lambda p, n: n > 30), (StringStartsWith(("relative_path",), "part3/de"), lambda p, n: p.startswith("part3/de")), (StringEndsWith(("relative_path",), "1.md"), lambda p, n: p.endswith("1.md")),
    (EqualTo(("folder",), "part2/deep/sub1"), lambda p, n: os.path.dirname(p) == "part2/deep/sub1"), (In(("folder",), ("flat", "")), lambda p, n: os.path.dirname(p) in ("flat", "")),
])
def test_filters_are_decided_in_the_listing(folder, f, test):
    own, left = reader(folder, f)
    assert left == []
    found = [row[0] for part in own.partitions() for row in own.read(part)]
    assert sorted(found) == sorted(p for p, (n, _) in walked(folder).items() if test(p, n))


def test_other_folders_are_not_opened(folder):
    own, _ = reader(folder, StringStartsWith(("relative_path",), "part3/"), subtrees=1000)
    assert {p.folder for p in own.partitions()} == {"", "part3", "part3/deep", *(f"part3/deep/sub{b}" for b in range(4))}


def test_other_filters_stay_with_spark(folder):
    f = StringContains(("relative_path",), "x")
    assert reader(folder, f)[1] == [f] and reader(folder, EqualTo(("error",), "x"))[1]


def test_plan_shows_the_filters(spark, folder):
    before = spark.conf.get(repository.PUSHDOWN)
    spark.conf.set(repository.PUSHDOWN, "true")
    try:
        rows = repository.read_folder(spark, folder).where((F.col("suffix") == ".py") & F.col("folder").startswith("part1/") & (F.col("size_bytes") > 5))
        found = {r.relative_path for r in rows.select("relative_path").collect()}
        plan = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set(repository.PUSHDOWN, before)
    assert found == {p for p, (n, _) in walked(folder).items() if p.startswith("part1/") and p.endswith(".py") and n > 5}
    pushed = plan.split("PushedFilters: ", 1)[1].splitlines()[0]
    assert all(x in pushed for x in ("EqualTo(suffix,.py)", "StringStartsWith(folder,part1/)", "GreaterThan(size_bytes,5)")) and "Filter (" not in plan


def test_names_without_contents(spark, folder):
    rows = repository.read_folder(spark, folder, contents=False).collect()
    assert {r.relative_path for r in rows} == set(walked(folder)) and all(r.content is None for r in rows)


def test_a_folder_that_cannot_be_read(spark, tmp_path, monkeypatch):
    (tmp_path / "closed").mkdir()
    (tmp_path / "a.py").write_text("1")
    own = repository._Reader(str(tmp_path), 1000, 9, 30)
    real = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: (_ for _ in ()).throw(PermissionError()) if str(p).endswith("closed") else real(p))
    rows = [r for part in own.partitions() for r in own.read(part)]
    assert sorted((r[0], r[4]) for r in rows) == [("a.py", None), ("closed", "directory PermissionError")]

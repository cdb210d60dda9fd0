"""Structural chunks by joins and windows against the walk of one file."""

import random

import pytest

from lodeseek.operators import structure, units

SOURCES = [
    "", "x = 1\n", "def broken(:\n  pass\n", "def a():\n    return 1\n\n\n\nclass B:\n    x = 1\n\n    def __init__(self):\n        def inner():\n            pass\n\n    async def m(self): pass\ny = 2",
    "class Empty: pass\n\nclass Outer:\n    class Inner:\n        def f(self): pass\n    class Bare:\n        z = 1\n", "if True:\n    def late(): pass\nelse:\n    class C:\n        if 1:\n            def deep(self): pass\n",
    "# ümläut 🙂\ndef ß():\n    '''é\n    '''\n\n\n# end 🙂", "def one(): pass; x = 2\r\ndef two(): pass\r\n\r\nclass K:\r    def f(self): return 1\r", "def f():\n    class L:\n        def g(self): pass\n    return L\n",
    "def long():\n" + "".join(f"    x{i} = {i}\n" for i in range(30)) + "\n" + "".join(f"y{i} = {i}\n" for i in range(40)), "@deco\ndef d(): pass\n\n@deco\nclass E: pass\n", "\n\n  \n", "a = 1\n" * 50,
]


def made(r, depth=0):
    pad = "    " * depth
    out = []
    for _ in range(r.randrange(1, 4)):
        kind = r.choice(("class", "def", "if", "x", "gap"))
        name = r.choice(("a", "b", "__init__", "é"))
        if kind in ("class", "def") and depth < 4:
            head = f"class {name}:" if kind == "class" else f"def {name}(self):"
            out += [pad + head, *made(r, depth + 1)]
        elif kind == "if" and depth < 4:
            out += [pad + "if 1:", *made(r, depth + 1)]
        elif kind == "gap":
            out += ["", pad + "z = 'ü🙂'", ""]
        else:
            out.append(pad + "y = 1")
    return out


@pytest.fixture(scope="module")
def sources():
    r = random.Random(6)
    return SOURCES + ["\n".join(made(r)) + r.choice(("", "\n")) for _ in range(150)]


def test_parts(spark, sources):
    rows = [("r", None if i % 2 else "c", f"f{i}.py", "Python", t) for i, t in enumerate(sources)]
    files = spark.createDataFrame(rows, "repository string, commit_hash string, file_path string, language string, text string").repartition(4)
    got = units.python_parts(files, 12, 3, 9).select("file_path", *units.PART).collect()
    want = [(f"f{i}.py", *p) for i, t in enumerate(sources) for p in structure.chunk_source("python", t.encode(), 12, 3, 9)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_no_files(spark):
    files = spark.createDataFrame([], "repository string, commit_hash string, file_path string, language string, text string")
    assert units.python_parts(files, 80, 10, 200).count() == 0

"""Column functions on small inputs."""

import pytest
from pyspark.sql import functions as F

from lodeseek.functions import text as T
from lodeseek.functions import vectors as V


def values(spark, column, *inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_tokens(spark):
    cases = {
        "handleConnection": "handleconnection handle connection", "PresenceService": "presenceservice presence service", "register_socket": "register_socket register socket",
        "retry-job": "retry-job retry job", "JWTAuthGuard": "jwtauthguard jwt auth guard", "MiXeD": "mixed mi xe d", "...///": "", "": "",
        "retry2Job(value); status=404": "retry2job retry 2 job value status 404", "é naïve Été": "na ve t", "__init__ --x--": "init x",
        "HTTP2Server_v3-rc1 ABC9d aB1C": "http2server_v3-rc1 http 2 server v 3 rc 1 abc9d abc 9 d ab1c a b 1 c",
    }
    assert [" ".join(x) for x in values(spark, T.tokens, *cases)] == list(cases.values())
    assert values(spark, T.tokens, None) == [None]


def test_lines_keep_their_ends(spark):
    found = values(spark, T.lines, "", "a", "a\n", "a\r\nb\rc\n\nd", "a\u2028b\x0bc\n")
    assert found == [[""], ["a"], ["a\n"], ["a\r\n", "b\r", "c\n", "\n", "d"], ["a\u2028b\x0bc\n"]]


@pytest.mark.parametrize("n,spans", [(1, [(1, 1)]), (80, [(1, 80)]), (81, [(1, 80), (71, 81)]), (150, [(1, 80), (71, 150)]), (151, [(1, 80), (71, 150), (141, 151)])])
def test_windows(spark, n, spans):
    text = "".join(f"line {i}\n" for i in range(n))
    (found,) = values(spark, lambda x: T.windows(T.lines(x), 80, 10), text)
    assert [(w.start_line, w.end_line) for w in found] == spans
    assert [w.part_index for w in found] == ([None] if n <= 80 else list(range(1, len(spans) + 1)))
    own = text.splitlines(keepends=True)
    assert all(w.content == "".join(own[w.start_line - 1 : w.end_line]) for w in found)


def test_windows_refuse_an_overlap_of_their_length():
    with pytest.raises(ValueError):
        T.windows(F.col("x"), 10, 10)


def test_suffix(spark):
    paths = ["a/b.PY", ".md", "a.", "..md", "x.tar.gz", "dir.d/name", "a/.eslintrc.json"]
    assert values(spark, T.suffix, *paths) == [".py", "", "", ".md", ".gz", "", ".json"]


def test_absolute_paths(spark):
    assert values(spark, T.is_absolute, "/a", "C:\\a", "c:/a", "\\\\host", "a/b") == [True] * 4 + [False]


def test_slug(spark):
    assert values(spark, T.slug, "My Repo!", "--a.b--", "é", "x_y") == ["my-repo", "a.b", "repository", "x_y"]


def test_json_strings(spark):
    assert values(spark, T.json_string, 'a"b\n]', None, "é/") == ['"a\\"b\\n]"', "null", '"é/"']


def test_unit_vectors(spark):
    found = values(spark, V.normalised, [3.0, 4.0], [0.0, 0.0], [float("nan"), 1.0], [None, 1.0], None, kind="array<double>")
    assert found == [[0.6, 0.8], None, None, None, None]

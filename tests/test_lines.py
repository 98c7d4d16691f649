"""Line operators on small vectors."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import lines as L


def table(spark, lines):
    return spark.createDataFrame([(1, i, x) for i, x in enumerate(lines, 1)], "k long, n long, line string")


def out(df):
    return [r.line for r in df.orderBy("n").collect()]


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "c string").select(f(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize(("text", "lines"), [("a\nb\n", ["a", "b"]), ("a\r\nb", ["a", "b"]), ("", []), (None, []), ("a\n\n", ["a", ""]), ("\n", [""])])
def test_line_split(spark, text, lines):
    assert one(spark, text, X.lines) == lines


def test_dedup(spark):
    assert out(L.dedup(table(spark, ["x"] * 5), "k", 3)) == ["x  [×5]"]
    assert out(L.dedup(table(spark, ["x"] * 2), "k", 3)) == ["x", "x"]
    assert out(L.dedup(table(spark, ["x"] * 3), "k", 3)) == ["x  [×3]"]
    assert out(L.dedup(table(spark, ["b", "a", "c"]), "k", 2)) == ["b", "a", "c"]
    assert out(L.dedup(table(spark, []), "k", 2)) == []


def test_group_by_dir(spark):
    rows = [f"modified: src/components/Comp{i}.tsx" for i in range(6)]
    assert out(L.group_by_dir(table(spark, rows), "k", 4)) == ["modified:src/components/  6 modified  [grouped]"]
    assert len(out(L.group_by_dir(table(spark, [*rows[:5], "modified: README.md"]), "k", 4))) == 2


def test_truncate(spark):
    rows = [str(i) for i in range(100)]
    head = out(L.truncate(table(spark, rows), "k", 20))
    assert len(head) == 21 and head[-1] == "[... 80 lines truncated]"
    tail = out(L.truncate(table(spark, rows), "k", 20, tail=True))
    assert tail[0] == "[... 80 lines truncated]" and tail[1] == "80" and len(tail) == 21
    assert out(L.truncate(table(spark, rows[:10]), "k", 20)) == rows[:10]


@pytest.mark.parametrize(
    ("line", "left"),
    [
        ("\x1b[32mmodified\x1b[0m: src/main.rs", ["modified: src/main.rs"]), ("⠋ loading", []), ("[===>  ] 30%", []), ("hint: use it", []), ("npm warn deprecated x", []), ("100%", []), ("100% done", ["100% done"]),
        ("[2026-03-22T14:23:01Z] INFO server started", ["INFO server started"]), ("    at x (node_modules/a/b.js:1)", []), ("    at app (src/a.js:1)", ["    at app (src/a.js:1)"]), ("[x] y", ["[x] y"]), ("  ", []),
    ],
)
def test_clean(spark, line, left):
    assert out(L.clean(table(spark, [line]))) == left


def test_grep_collapse(spark):
    rows = [f"src/a.rs:{i}:x" for i in range(6)]
    assert out(L.collapse_hits(table(spark, [*rows, "other"]), "k")) == ["src/a.rs: 6 matches [collapsed]", "other"]
    assert out(L.collapse_hits(table(spark, rows[:3]), "k")) == rows[:3]


def test_terraform_and_helm(spark):
    rows = ["Refreshing state... [id=1]", "+ resource x", "Plan: 1 to add", "noise"]
    assert out(L.run_rule(table(spark, rows), "k", L.rule_for("data_tool", "terraform plan"))) == ["+ resource x", "Plan: 1 to add"]
    assert out(L.run_rule(table(spark, ["NAMESPACE: x", "pod/a"]), "k", L.rule_for("data_tool", "helm list"))) == ["pod/a"]


@pytest.mark.parametrize(
    ("cmd", "handler"),
    [
        ("git log", "git"), ("FOO=1 npx playwright test", "playwright"), ("cargo test", "test_runner"), ("cargo build", "package_mgr"), ("bunx vitest", "test_runner"), ("/usr/bin/rg x", "text_proc"),
        ("next build", "next_build"), ("next lint", "generic"), ("vite build", "build"), ("", "generic"), ("terraform plan", "data_tool"),
    ],
)
def test_dispatch(spark, cmd, handler):
    assert one(spark, cmd, L.handler_of) == handler


@pytest.mark.parametrize(("line", "shape"), [("42abc123", "NHEX"), ("abc123def", "HEX"), ("a12", "aN"), ("Error in /tmp/foo line 7", "error in PATH line N"), ("", "")])
def test_normalize_error(spark, line, shape):
    assert one(spark, line, X.normalize_error) == shape


@pytest.mark.parametrize(("text", "h"), [("", "cbf29ce484222325"), ("a", "af63dc4c8601ec8c"), ("foobar", "85944171f73967e8")])
def test_fnv(spark, text, h):
    from tidemark.operators.similarity import fnv1a_long

    assert one(spark, text, X.fnv1a) == h and one(spark, text, fnv1a_long) == h


def test_trigrams_and_jaccard(spark):
    assert one(spark, "a b", X.trigrams) == []
    assert one(spark, "a  b\tc", X.trigrams) == ["a b c"]
    row = spark.createDataFrame([(["a", "b"], ["b", "c"], [])], "a array<string>, b array<string>, e array<string>")
    got = row.select(X.jaccard(F.col("a"), F.col("a")), X.jaccard(F.col("a"), F.col("b")), X.jaccard(F.col("a"), F.col("e"))).first()
    assert got[0] == 1.0 and abs(got[1] - 1 / 3) < 1e-6 and got[2] == 0.0


def test_paths(spark):
    text = "see src/auth.ts:42, (lib/x.py) https://a.b/c.d //x.y/z noext/file src/auth.ts:42"
    assert one(spark, text, X.paths) == ["src/auth.ts:42", "lib/x.py"]
    many = " ".join(f"a/b{i}.py" for i in range(150))
    assert len(one(spark, many, X.paths)) == 100

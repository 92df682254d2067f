import random

import pytest
from pyspark.sql import functions as F

import reference_model as M
from codewhiff import corpus
from codewhiff.operators import diff, filters
from codewhiff.operators.scan import COLUMNS, files_scanned, find, ordered, scan, scan_content
from codewhiff.plans.config import Config

SCHEMA = "file string, content string"
PIECES = ["} catch (e) {", "catch {", "try {", "} catch (e) {}", "} catch (e) { x() }", "catch (e) { } }", "} } catch (e) { x } }", "  console.log(e)", "console.error('}')", "// TODO fix", "  // note", "// ignore catch (e) {", "// catch {", "", "  ", "}", "{", "{ {", "} }", "a('{', \"}\")", "b(\"it's {\")", "\\{ '\\'{'",
          "`{`", "function f(a) {", "const g = async (x) => {", "let h = y => {", "run(a: B): C {", "if (a) {", "async (x): T => {", "function () {", "});", "throw e", "console.log(1) } catch (e) {"]
PY = ["except:", "except ValueError:", "  except A as b:  # why", "    except:", "except (A):", "except A: pass", "  except A, B: pass # x", "pass", "  pass", "    pass", "\tpass", "      pass  # x", "    # note", "# note", "", "   ", "x = 1", "    raise", "class A(Protocol):", "  class Bc(x.Protocol, D):", "class C(Generic[T], Protocol) :", "class D( Protocol):", "use(A)", "# Bc", "__all__ = ['A', \"C\"]", "__all__: list = ['A']", "C_x", "D"]


def model(rows):
    return sorted((f, *x) for f, c in rows for x in M.find(f, c))


def engine(df):
    return sorted((r.file, r.rule, r.line, r["column"], r.message) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_random_files(spark, seed):
    r, rows = random.Random(seed), []
    for i in range(150):
        n = r.choice([1, 3, 8, 20, 60, 200])
        rows.append((f"{i}.ts", "\n".join(r.choice(PIECES) for _ in range(n))))
        rows.append((f"{i}.py", "\n".join(r.choice(PY) for _ in range(n // 2))))
    assert engine(find(spark.createDataFrame(rows, SCHEMA))) == model(rows)


def test_long_functions(spark):
    rows = []
    for n in (78, 79, 80, 81, 200):
        rows.append((f"{n}.js", "function f() {\n" + "a()\n" * n + "}\n"))
        rows.append((f"b{n}.js", "} function f() {\n" + "a()\n" * n + "}\n}"))
        rows.append((f"c{n}.js", "function f() {\n" + "a({'}': 1})\n" * n))
    assert engine(find(spark.createDataFrame(rows, SCHEMA))) == model(rows)


def test_corpus_against_the_model(spark):
    files = corpus.files(spark, "/root/testdata/sf0.001")
    rows = [(r.file, r.content) for r in files.collect()]
    assert engine(find(files)) == model(rows)


def test_files_that_do_not_count(spark):
    rows = [("a.js", "eval(x)"), ("b.js", "eval(x)\0"), ("c.js", "eval(x)" + " " * 1_000_000), ("d.js", "eval(x)" + " " * 999_993), ("e.js", None), (None, "eval(x)"), ("f.js", ""), ("g.txt", "eval(x)")]
    files = spark.createDataFrame(rows, SCHEMA).withColumn("text", F.lit(1)).withColumn("lines", F.lit(2)).withColumn("mask", F.lit(3))
    assert sorted(r.file for r in scan(files).collect()) == ["a.js", "d.js"]
    assert sorted(r.file for r in scan_content(files).collect()) == ["a.js", "b.js", "c.js", "d.js"]
    assert files_scanned(files.where("file is not null")).first()[0] == 4
    assert scan(files.limit(0)).collect() == [] and files_scanned(files.limit(0)).first()[0] == 0
    assert tuple(scan(files).columns) == COLUMNS


def test_repeated_rows_are_scanned_each(spark):
    files = spark.createDataFrame([("a.js", "eval(x)")] * 3, SCHEMA)
    assert scan(files).count() == 3


def test_order(spark):
    files = spark.createDataFrame([(f, "eval(x); console.log(y)\neval(z)") for f in ("B.ts", "_x.ts", "a.ts", "A/z.ts", "b.ts")], SCHEMA)
    got = [(r.file, r.line, r.rule) for r in ordered(find(files)).collect()]
    assert [f for f, n, r in got if n == 2] == ["_x.ts", "a.ts", "A/z.ts", "b.ts", "B.ts"]
    assert got[:3] == [("_x.ts", 1, "no-eval"), ("_x.ts", 1, "no-console-pollution"), ("_x.ts", 2, "no-eval")]


def test_settings(spark):
    files = spark.createDataFrame([("a.ts", "eval(x)\nlet a: any")], SCHEMA)

    def run(**rules):
        return sorted((r.rule, r.severity) for r in scan(files, Config({k.replace("_", "-"): v for k, v in rules.items()})).collect())

    assert run() == [("no-eval", "error"), ("no-ts-any", "warn")]
    assert run(no_eval="off") == [("no-ts-any", "warn")]
    assert run(no_eval="info", no_ts_any="loud") == [("no-eval", "info"), ("no-ts-any", "warn")]
    assert run(no_eval="off", no_ts_any="off") == []


def test_no_rule_at_all(spark):
    files = spark.createDataFrame([("a.ts", "eval(x)")], SCHEMA)
    from codewhiff.plans.rules import RULES

    assert scan(files, Config({r.id: "off" for r in RULES})).collect() == []


def test_changed_lines(spark):
    files = spark.createDataFrame([("a.ts", "eval(x)\neval(y)\ntry {} catch (e) {\n}"), ("b.ts", "eval(x)")], SCHEMA)
    changed = spark.createDataFrame([("a.ts", 2), ("a.ts", 2), ("a.ts", 4), ("c.ts", 1)], "file string, line int")
    assert [(r.file, r.line) for r in scan(files, changed=changed).collect()] == [("a.ts", 2)]
    assert files_scanned(files, changed).first()[0] == 1
    assert scan(files, changed=changed.limit(0)).collect() == []


def test_one_narrow_stage(spark):
    """No exchange, no Python and one scan of the source."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("concat(doc_id, '.ts') as file", "text as content")
    plan = scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert plan.count("FileScan") == 1 and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    lines = plan[: plan.index("Generate posexplode")].rsplit("\n", 1)[0]
    assert "content" not in lines and "lines#" not in lines  # a line's row doesn't hold its file


def test_small_tables_are_spread(spark):
    from codewhiff import runtime

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert runtime.spread(docs).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert runtime.spread(docs, below=0) is docs


DIFFS = [
    "diff --git a/x b/x\nindex 1..2\n--- a/x\n+++ b/x\n@@ -10,2 +10,3 @@ f\n a\n b\n+c\n",
    "--- a/a\n+++ b/a\n@@ -1 +1,2 @@\n a\n+b\ndiff --git a/b b/b\n+++ b/b\n@@ -5,0 +6 @@\n+x\n",
    "+++ b/a\n@@ -1,2 +3,2 @@\n+a\n-b\n b\n@@ -9 +20,3 @@\n c\n d\n+e\n\\ No newline at end of file\n+f",
    '+++ "b/with \\"q\\ttab\\\\n"\n@@ -1 +1 @@\n+x\n+++ b/sp ace.ts\tdate\n@@ -1 +1 @@\n+y\n+++ "\n+z',
    "+++ b/a\n@@ -1 +2 @@\n+x\ndiff --git a/b b/b\n--- a/b\n+++ /dev/null\n@@ -1 +0,0 @@\n-y\n+lost\nBinary files differ\n",
    "+++ b/a\n+before a hunk\n@@ -1 +1 @@\n++++ looks like a header\n+++ c\n+lost", "", "no diff at all\n+x", "+++ \n+a", "+++ b/\n@@ -1 +1 @@\n+a", "+++ noprefix\n+a",
]


def test_diffs(spark):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(DIFFS)] + [(99, None)], "diff_id int, diff string").withColumn("n", F.lit(1)).withColumn("t", F.lit(1))
    got = {(r.diff_id, r.file, r.line) for r in diff.parse_diff(df).collect()}
    assert got == {(i, *x) for i, d in enumerate(DIFFS) for x in M.changed(d)}
    assert diff.parse_diff(df.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(2))
def test_random_diffs(spark, seed):
    r = random.Random(seed)
    parts = ["diff --git a/q b/q", "+++ b/one", "+++ a/two\tx", "+++ /dev/null", '+++ "b/th\\tree"', "--- a/z", "index 1..2", "@@ -1,3 +7,9 @@ x", "@@ -1 +40 @@", "@@ bad @@", "+a", "+", "-b", " c", "", "\\ No newline"]
    texts = ["\n".join(r.choice(parts) for _ in range(r.randrange(1, 40))) for _ in range(300)]
    got = {(x.diff_id, x.file, x.line) for x in diff.parse_diff(spark.createDataFrame(list(enumerate(texts)), "diff_id int, diff string")).collect()}
    assert got == {(i, *x) for i, d in enumerate(texts) for x in M.changed(d)}


def test_reroot(spark):
    df = spark.createDataFrame([("src/a.ts", 1), ("b.ts", 2), ("src2/c.ts", 3)], "file string, line int")

    def run(repo, at):
        return sorted((r.file, r.line) for r in diff.reroot(df, repo, at).collect())

    assert run("/r", "/r/src") == [("a.ts", 1)]
    assert run("/r", "/r") == [("b.ts", 2), ("src/a.ts", 1), ("src2/c.ts", 3)]
    assert run("/r/x", "/r") == [("x/b.ts", 2), ("x/src/a.ts", 1), ("x/src2/c.ts", 3)]


GLOBS = [
    ("node_modules", "node_modules/a/b.js", True), ("node_modules", "x/node_modules/b.js", False), ("*.min.js", "a.min.js", True), ("*.min.js", "x/a.min.js", False), ("**/*.min.js", "x/y/a.min.js", True),
    ("**/*.min.js", "a.min.js", True), ("a/**", "a/b/c.js", True), ("{x,y}/*.ts", "y/a.ts", True), ("f?.js", "f1.js", True), ("f?.js", "f12.js", False), ("[ab].js", "b.js", True), ("[!ab].js", "b.js", False), ("a.b", "axb", False), ("dist", "distant/a.js", False),
]


@pytest.mark.parametrize("glob, path, ignored", GLOBS)
def test_globs(spark, glob, path, ignored):
    import re

    assert bool(re.match(filters.ignored_regex((glob,)).replace(r"\z", r"\Z"), path)) == ignored
    assert bool(re.match(filters.ignored_regex(("node_modules",), anywhere=True).replace(r"\z", r"\Z"), "x/node_modules/b.js"))


def test_wanted_files(spark):
    names = ["a.ts", "dist/b.ts", "x/dist/b.ts", ".h/c.ts", "d/.e.ts", "f.txt", "g.min.js", "__init__.py"]
    files = spark.createDataFrame([(n, "") for n in names], SCHEMA)
    assert sorted(r.file for r in filters.wanted_files(files).collect()) == ["__init__.py", "a.ts", "x/dist/b.ts"]
    assert sorted(r.file for r in filters.wanted_files(files, anywhere=True).collect()) == ["__init__.py", "a.ts"]


def test_plans_of_changes(spark):
    """A diff is read without an exchange, and once for a scan; files that aren't listed leave before the scan."""
    sf = "/root/testdata/sf0.001"

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "Exchange" not in plan(diff.changed_lines(spark.createDataFrame([(1, "x")], "diff_id int, diff string")))
    listed = plan(filters.in_files(corpus.files(spark, sf), spark.createDataFrame([("src/f0.ts",)], "file string")))
    assert "LeftSemi" in listed
    changed = spark.createDataFrame([("a.ts", 2), ("a.ts", 3)], "file string, line int")
    texts = spark.createDataFrame([("a.ts", "x\neval(a)\ny\neval(b)"), ("b.ts", "eval(c)")], "file string, content string")
    out = scan(texts, changed=changed)
    assert [(r.file, r.line) for r in out.collect()] == [("a.ts", 2)]


def test_package_root():
    import codewhiff

    assert all(hasattr(codewhiff, name) for name in codewhiff.__all__) and len(codewhiff.RULES) == 35


def test_command_line_version(capsys):
    import pytest

    import codewhiff
    from codewhiff import cli

    with pytest.raises(SystemExit) as end:
        cli.main(["--version"])
    assert end.value.code == 0 and capsys.readouterr().out.strip() == codewhiff.__version__

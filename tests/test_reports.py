import json

import pytest

from codewhiff.operators import filters, reports
from codewhiff.plans.rules import SEVERITIES

SCHEMA = "rule string, severity string, category string, file string, line int, column int, message string, snippet string"
ROWS = [
    ("no-eval", "error", "security", "b.ts", 3, 5, "one|two", "eval(x)"),
    ("no-eval", "error", "security", "b.ts", 1, 1, "50% a:b,c\nd\re", "eval(y)"),
    ("no-ts-any", "warn", "ai-tell", "a,b:c.ts", 1234, 56789, "m", "x: any"),
    ("no-ai-todo", "info", "code-quality", "c|d.py", 7, 1, "m", "# todo"),
    ("no-god-function", "warn", "code-quality", "b.ts", 9, 1, "Function 'f' has 91 lines, more than 80; divide it.", "f"),
]


@pytest.fixture(scope="module")
def found(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def scanned(spark):
    return spark.createDataFrame([(10,)], "files_scanned long")


def texts(df):
    return [r.text for r in df.collect()]


def test_summary_has_zeros(found):
    assert tuple(reports.summary(found).first()) == (2, 2, 1)
    assert tuple(reports.summary(found.limit(0)).first()) == (0, 0, 0)


def test_min_severity(found):
    assert [filters.at_least(found, s).count() for s in (*SEVERITIES, "strange")] == [2, 4, 5, 4]
    assert {(r.severity, r.r) for r in found.select("severity", filters.rank(found.severity).alias("r")).collect()} == {("error", 0), ("warn", 1), ("info", 2)}


def test_groups(found, scanned):
    by = {r.file: r for r in reports.by_file(found).collect()}
    assert [x.line for x in by["b.ts"].list] == [1, 3, 9] and by["b.ts"].findings == 3
    assert tuple(reports.file_rates(found, scanned).first()) == (10, 3, 5, 0.5, 0.3)
    assert reports.file_rates(found.limit(0), scanned.selectExpr("0L as files_scanned")).first().per_file is None
    pivot = {r.rule: r for r in reports.rule_by_extension(found).collect()}
    assert pivot["no-eval"].ts == 2 and pivot["no-ai-todo"].py == 1 and pivot["no-ai-todo"].ts == 0
    assert [(r.rule, r.findings) for r in reports.top_rules(found, 2).collect()] == [("no-eval", 2), ("no-ai-todo", 1)]
    assert [tuple(r) for r in reports.longest_functions(found).collect()] == [("b.ts", 9, "f", 91)]
    assert reports.rollup(found).where("category is null and severity is null").first().findings == 5
    assert reports.hot_lines(found, 1).count() == 4


def test_quiet(found):
    assert texts(reports.quiet_line(found, "info")) == ["5 problems: 2 errors, 2 warnings, 1 info"]
    assert texts(reports.quiet_line(found.where("rule = 'no-ts-any'"))) == ["1 problems: 1 warnings"]
    assert texts(reports.quiet_line(found.limit(0))) == ["No issues found."]


def test_pretty(found, scanned):
    lines = texts(reports.pretty_lines(found.where("rule = 'no-ts-any'")))
    assert lines == ["    1234:56789 warn   no-ts-any                    m"]
    assert texts(reports.pretty_total(found, scanned)) == ["4 problems (2 errors, 2 warnings)\n2 files with issues out of 10 scanned (0ms)"]
    assert texts(reports.pretty_total(found.where("line = 1234"), scanned, duration="1.2s")) == ["1 problem (1 warning)\n1 file with issues out of 10 scanned (1.2s)"]
    assert texts(reports.pretty_total(found.limit(0), scanned)) == ["No issues found.\n10 files scanned (0ms)"]
    assert [reports.duration(x) for x in (0, 999.4, 1000, 12345)] == ["0ms", "999ms", "1.0s", "12.3s"]


def test_json(found, scanned):
    one = json.loads(reports.json_report(found, scanned, "error", 5).first().json)
    assert [f["line"] for f in one["findings"]] == [1, 3] and one["summary"] == {"error": 2, "warn": 0, "info": 0}
    assert one["filesScanned"] == 10 and one["duration"] == 5
    assert json.loads(reports.json_report(found.limit(0), scanned).first().json)["findings"] == []
    assert {json.loads(r.json)["rule"] for r in reports.json_rows(found).collect()} == {r[0] for r in ROWS}


def test_annotations(found):
    got = {(r.rule, r.line): r.text for r in reports.annotations(found).collect()}
    assert got["no-eval", 1] == "::error file=b.ts,line=1,title=codewhiff: no-eval::50%25 a:b,c%0Ad%0De"
    assert got["no-ts-any", 1234].startswith("::warning file=a%2Cb%3Ac.ts,line=1234,")
    assert got["no-ai-todo", 7].startswith("::notice ")


def test_markdown(found):
    got = {(r.rule, r.line): r.text for r in reports.markdown_rows(found).collect()}
    assert got["no-eval", 3] == "| `b.ts` | 3 | `no-eval` | error | one\\|two |"
    assert got["no-ai-todo", 7].startswith("| `c\\|d.py` | 7 |") and "\n" not in got["no-eval", 1]
    assert sorted((r.ord, r.text) for r in reports.markdown_totals(found).collect()) == [(0, "| Error | 2 |"), (1, "| Warn | 2 |"), (2, "| Info | 1 |")]


def test_agent_text(found):
    assert "b.ts:3:5 [error] no-eval: one|two\n  > eval(x)" in texts(reports.agent_text(found))


def test_gate(found):
    no_errors = found.where("severity <> 'error'")
    assert [reports.gate(no_errors, s).first().failed for s in ("error", "warn", "info", "none")] == [False, True, True, False]
    assert reports.gate(found.limit(0), "info").first().failed is False and reports.gate(found, "none").first().failed is False
    with pytest.raises(ValueError):
        reports.gate(found, "all")
    assert reports.exit_code(found).first().code == 1 and reports.exit_code(no_errors).first().code == 0


def test_in_files(spark, found):
    listed = spark.createDataFrame([("b.ts",), ("b.ts",), ("z",)], "file string")
    assert filters.in_files(found, listed).count() == 3 and filters.in_files(found, listed.limit(0)).count() == 0

"""Aggregations over findings, and findings as rows of text.

A report of one row is an aggregate without keys, so that it says something for an empty table too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.rules import RULES, SEVERITIES
from .filters import at_least


def _counted(severity: str) -> Column:
    return F.count(F.when(F.col("severity") == severity, 1))


def summary(findings: DataFrame) -> DataFrame:
    """``(error, warn, info)``: one row, zeros included."""
    return findings.agg(*[_counted(s).alias(s) for s in SEVERITIES])


def by(findings: DataFrame, *cols: str) -> DataFrame:
    """Findings and files with any, for each value of ``cols``."""
    return findings.groupBy(*cols).agg(F.count("*").alias("findings"), F.count_distinct("file").alias("files"))


def by_file(findings: DataFrame) -> DataFrame:
    """``(file, findings, list)``: each file's findings as a list in their order."""
    entry = F.struct("line", "column", "severity", "rule")
    return findings.groupBy("file").agg(F.count("*").alias("findings"), F.sort_array(F.collect_list(entry)).alias("list"))


def file_rates(findings: DataFrame, scanned: DataFrame) -> DataFrame:
    """``(files_scanned, files_with_issues, findings, per_file, hit_rate)`` from the findings and a row with ``files_scanned``."""
    total = findings.agg(F.count("*").alias("findings"), F.count_distinct("file").alias("files_with_issues"))
    both = total.crossJoin(scanned)  # one row each
    n = F.nullif("files_scanned", F.lit(0))
    return both.select("files_scanned", "files_with_issues", "findings", F.round(F.col("findings") / n, 4).alias("per_file"), F.round(F.col("files_with_issues") / n, 4).alias("hit_rate"))


def rule_by_extension(findings: DataFrame, extensions: tuple[str, ...] = ("cjs", "js", "jsx", "mjs", "py", "ts", "tsx")) -> DataFrame:
    """Findings of each rule, a column for each extension. The values are given, so that no job looks for them."""
    ext = F.substring_index("file", ".", -1)
    return findings.withColumn("ext", ext).groupBy("rule").agg(*[F.count(F.when(F.col("ext") == e, 1)).alias(e) for e in extensions])


def rollup(findings: DataFrame) -> DataFrame:
    """Findings by category and severity, with subtotals; null stands for all."""
    return findings.rollup("category", "severity").agg(F.count("*").alias("findings"))


def top_rules(findings: DataFrame, n: int = 5) -> DataFrame:
    return findings.groupBy("rule").agg(F.count("*").alias("findings")).orderBy(F.desc("findings"), "rule").limit(n)


def longest_functions(findings: DataFrame, n: int = 10) -> DataFrame:
    """The longest functions that were reported, by the length in their message."""
    size = F.regexp_extract("message", r"has (\d+) lines", 1).cast("int")
    name = F.regexp_extract("message", "'(.*)'", 1)
    return findings.where("rule = 'no-god-function'").select("file", "line", name.alias("name"), size.alias("lines")).orderBy(F.desc("lines"), "file", "line").limit(n)


def numbered(findings: DataFrame) -> DataFrame:
    """``(file, nth, line, rule)``: each file's findings in the order of a report, by line and the catalogue's order, numbered from 1."""
    ids = F.array(*[F.lit(r.id) for r in RULES])
    order = Window.partitionBy("file").orderBy("line", F.array_position(ids, F.col("rule")), "column", "message")
    return findings.select("file", F.row_number().over(order).alias("nth"), "line", "rule")


def json_rows(findings: DataFrame) -> DataFrame:
    """``(json)``: a JSON object for each finding."""
    return findings.select(F.to_json(F.struct("rule", "severity", "category", "file", "line", "column", "message", "snippet")).alias("json"))


def json_report(findings: DataFrame, scanned: DataFrame, min_severity: str = "warn", duration_ms: float = 0) -> DataFrame:
    """``(json)``: one object with the findings shown, in order, files scanned, duration, and the summary of those shown."""
    shown = at_least(findings, min_severity)
    entry = F.struct("file", "line", "rule", "severity", "category", "column", "message", "snippet")
    one = shown.agg(F.sort_array(F.collect_list(entry)).alias("findings"), F.struct(*[_counted(s).alias(s) for s in SEVERITIES]).alias("summary")).crossJoin(scanned)
    return one.select(F.to_json(F.struct("findings", F.col("files_scanned").alias("filesScanned"), F.lit(duration_ms).alias("duration"), "summary")).alias("json"))


def padded(text: Column, width: int) -> Column:
    """Filled up with spaces, never cut."""
    return F.rpad(text, F.greatest(F.lit(width), F.length(text)), F.lit(" "))


def pretty_lines(findings: DataFrame) -> DataFrame:
    """``(file, line, column, rule, text)``: the text of each finding below its file's name."""
    text = F.concat(F.lit("    "), padded(F.concat_ws(":", "line", "column"), 8), F.lit(" "), padded(F.col("severity"), 5), F.lit("  "), padded(F.col("rule"), 28), F.lit(" "), F.col("message"))
    return findings.select("file", "line", "column", "rule", text.alias("text"))


def _plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" " + word), F.when(n == 1, "").otherwise("s"))


def pretty_total(findings: DataFrame, scanned: DataFrame, min_severity: str = "warn", duration: str = "0ms") -> DataFrame:
    """``(text)``: the last lines of the report for people."""
    shown = at_least(findings, min_severity)
    one = shown.agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"), *[_counted(s).alias(s) for s in SEVERITIES]).crossJoin(scanned)
    parts = F.concat_ws(", ", F.when(F.col("error") > 0, _plural(F.col("error"), "error")), F.when(F.col("warn") > 0, _plural(F.col("warn"), "warning")), F.when(F.col("info") > 0, F.concat(F.col("info"), F.lit(" info"))))
    some = F.concat(_plural(F.col("n"), "problem"), F.lit(" ("), parts, F.lit(")\n"), _plural(F.col("files"), "file"), F.lit(" with issues out of "), F.col("files_scanned"), F.lit(f" scanned ({duration})"))
    none = F.concat(F.lit("No issues found.\n"), F.col("files_scanned"), F.lit(f" files scanned ({duration})"))
    return one.select(F.when(F.col("n") == 0, none).otherwise(some).alias("text"))


def duration(ms: float) -> str:
    """Milliseconds below a second, else seconds with one digit."""
    return f"{int(ms + 0.5)}ms" if ms < 1000 else f"{ms / 1000:.1f}s"


def quiet_line(findings: DataFrame, min_severity: str = "warn") -> DataFrame:
    """``(text)``: one line with the counts that aren't 0, always in the plural."""
    one = at_least(findings, min_severity).agg(F.count("*").alias("n"), *[_counted(s).alias(s) for s in SEVERITIES])
    parts = F.concat_ws(", ", *[F.when(F.col(c) > 0, F.concat(F.col(c), F.lit(f" {word}"))) for c, word in zip(SEVERITIES, ("errors", "warnings", "info"))])
    return one.select(F.when(F.col("n") == 0, "No issues found.").otherwise(F.concat(F.col("n"), F.lit(" problems: "), parts)).alias("text"))


def agent_text(findings: DataFrame) -> DataFrame:
    """``(file, line, column, rule, text)``: a finding and its line, as tools for agents show it."""
    text = F.concat(F.concat_ws(":", "file", "line", "column"), F.lit(" ["), F.col("severity"), F.lit("] "), F.col("rule"), F.lit(": "), F.col("message"), F.lit("\n  > "), F.col("snippet"))
    return findings.select("file", "line", "column", "rule", text.alias("text"))


def _escaped(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


_DATA = (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"))


def annotations(findings: DataFrame, title: str = "codewhiff") -> DataFrame:
    """``(file, line, rule, text)``: workflow commands that annotate lines."""
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warn", "warning").otherwise("notice")
    prop = (*_DATA, (":", "%3A"), (",", "%2C"))
    text = F.concat(F.lit("::"), level, F.lit(" file="), _escaped(F.col("file"), prop), F.lit(",line="), F.col("line"), F.lit(f",title={title}: "), _escaped(F.col("rule"), prop), F.lit("::"), _escaped(F.col("message"), _DATA))
    return findings.select("file", "line", "rule", text.alias("text"))


def markdown_rows(findings: DataFrame) -> DataFrame:
    """``(file, line, rule, text)``: rows of a table, with bars escaped and line ends as spaces."""

    def cell(c: Column) -> Column:
        return F.replace(c, F.lit("|"), F.lit("\\|"))

    text = F.concat(F.lit("| `"), cell(F.col("file")), F.lit("` | "), F.col("line"), F.lit(" | `"), cell(F.col("rule")), F.lit("` | "), F.col("severity"), F.lit(" | "), cell(F.replace(F.col("message"), F.lit("\n"), F.lit(" "))), F.lit(" |"))
    return findings.select("file", "line", "rule", text.alias("text"))


def markdown_totals(findings: DataFrame) -> DataFrame:
    """``(ord, text)``: a row for each severity that occurs."""
    named = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(s.capitalize()).alias("name"), F.col(s).alias("n")) for i, s in enumerate(SEVERITIES)])
    return summary(findings).select(F.explode(named).alias("s")).where("s.n > 0").select("s.ord", F.concat(F.lit("| "), F.col("s.name"), F.lit(" | "), F.col("s.n"), F.lit(" |")).alias("text"))


def gate(findings: DataFrame, fail_on: str = "error") -> DataFrame:
    """``(failed)``: whether findings of ``fail_on`` and above exist; "none" never fails."""
    if fail_on not in (*SEVERITIES, "none"):
        raise ValueError(f"fail_on must be one of {', '.join(SEVERITIES)}, none; not {fail_on}")
    levels = () if fail_on == "none" else SEVERITIES[: SEVERITIES.index(fail_on) + 1]
    return findings.agg((F.count(F.when(F.col("severity").isin(*levels), 1)) > 0 if levels else F.count("*") < 0).alias("failed"))


def exit_code(findings: DataFrame) -> DataFrame:
    """``(code)``: 1 if there is an error among all findings, else 0."""
    return findings.agg(F.when(_counted("error") > 0, 1).otherwise(0).alias("code"))


def hot_lines(findings: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` files with most findings of each rule, with their rank."""
    counts = findings.groupBy("rule", "file").agg(F.count("*").alias("findings"))
    place = F.row_number().over(Window.partitionBy("rule").orderBy(F.desc("findings"), "file"))
    return counts.withColumn("place", place).where(F.col("place") <= n)

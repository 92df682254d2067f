"""The registered queries over the test tables, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import corpus, oracle, runtime
from .operators import diff, filters, reports
from .operators.scan import COLUMNS, files_scanned, scan, scan_content
from .plans import rules as R
from .plans.config import Config

Query = Callable[[SparkSession, str], DataFrame]

OVERRIDE = Config({"no-eval": "info", "no-step-comments": "error", "no-ts-any": "loud", "no-py-print": "off"})
OFF = Config({r.id: "off" for r in R.RULES if r.category in ("ai-tell", "security")})
IGNORE = Config(ignore=("dist", "src/vendor", "*.min.js", "lib/*7.py"), include=("**/*.{ts,tsx,py}", "lib/*.js"))


def _texts(spark: SparkSession, sf_dir: str, table: str, name: str, text: str, ext: str) -> DataFrame:
    runtime.tune(spark)
    rows = runtime.spread(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(name, text)).where(F.col(name).isNotNull())
    return rows.select(F.concat(F.col(name).cast("string"), F.lit(f".{ext}")).alias("file"), F.col(text).alias("content"))


def _over(report: Callable[[DataFrame], DataFrame], config: Config = Config()) -> Query:
    return lambda spark, sf_dir: report(scan(corpus.files(spark, sf_dir), config))


def _rated(report: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = corpus.files(spark, sf_dir)
        return report(scan(files), files_scanned(files))

    return run


def _by_file(found: DataFrame) -> DataFrame:
    return reports.by_file(found).select("file", "findings", F.array_join(F.transform("list", lambda x: F.concat_ws(":", x.line, x["column"], x.rule)), " ").alias("list"))


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.parse_diff(corpus.diffs(spark, sf_dir))


def _diff_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(corpus.files(spark, sf_dir), changed=diff.changed_lines(corpus.diffs(spark, sf_dir)))


def _pull_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.read.parquet(f"{sf_dir}/labels.parquet").select(corpus.name_of(F.col("doc_id")).alias("file"))
    return scan(filters.in_files(corpus.files(spark, sf_dir), listed))


def _odd_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with a NUL in every fifth file and too many bytes in every seventh."""
    number = F.regexp_extract("file", r"f(\d+)\.", 1).cast("long")
    content = F.concat("content", F.when(number % 5 == 0, F.lit("\0")).otherwise(F.lit("")), F.when(number % 7 == 0, F.repeat(F.lit("x"), 1_000_000)).otherwise(F.lit("")))
    return corpus.files(spark, sf_dir).drop("size").withColumn("content", content)


def _rerooted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.reroot(_changed(spark, sf_dir).select("file", "line"), "/repo", "/repo/src")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {f"rule_{r.id.replace('-', '_')}": _over(lambda found: found, Config().only(r.id)) for r in R.RULES}
    return out | {
        "findings_all": _over(lambda found: found),
        "findings_documents": lambda s, d: scan_content(_texts(s, d, "documents", "doc_id", "text", "py")),
        "findings_pages": lambda s, d: scan_content(_texts(s, d, "pages", "page_id", "html", "jsx")),
        "summary_by_severity": _over(reports.summary),
        "summary_by_category": _over(lambda found: reports.by(found, "category")),
        "summary_by_rule": _over(lambda found: reports.by(found, "rule", "severity")),
        "summary_rollup": _over(reports.rollup),
        "findings_by_file": _over(_by_file),
        "files_with_issues": _rated(reports.file_rates),
        "rule_ext_pivot": _over(reports.rule_by_extension),
        "topk_rules": _over(reports.top_rules),
        "topk_god_functions": _over(reports.longest_functions),
        "topk_files_by_rule": _over(reports.hot_lines),
        "severity_override": _over(lambda found: reports.by(found, "rule", "severity"), OVERRIDE),
        "rules_off": _over(lambda found: reports.by(found, "rule"), OFF),
        "min_severity": _over(lambda found: filters.at_least(found, "error")),
        "ignore_globs": lambda s, d: scan(filters.wanted_files(corpus.files(s, d), IGNORE), IGNORE),
        "size_nul_filter": lambda s, d: files_scanned(_odd_files(s, d)),
        "findings_sorted": _over(reports.numbered),
        "diff_parse": _changed,
        "diff_scan": _diff_scan,
        "diff_reroot": _rerooted,
        "changed_files_only": _pull_request,
        "quiet_line": _over(reports.quiet_line),
        "pretty_lines": _over(lambda found: reports.pretty_lines(filters.at_least(found))),
        "pretty_total": _rated(reports.pretty_total),
        "json_rows": _over(reports.json_rows),
        "agent_text": _over(reports.agent_text),
        "annotations": _over(reports.annotations),
        "markdown_rows": _over(reports.markdown_rows),
        "markdown_totals": _over(reports.markdown_totals),
        "ci_gate": _over(lambda found: reports.gate(found, "warn")),
        "exit_code": _over(reports.exit_code),
        "rule_catalogue": lambda s, d: R.rules_df(s).withColumn("languages", F.array_join("languages", ",")),
    }


def oracle_sql() -> dict[str, str]:
    C, whole = oracle.COLUMNS, oracle.findings()
    counts = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in R.SEVERITIES)
    shown = f"shown AS (SELECT * FROM findings WHERE severity IN ('error', 'warn'))"
    parts = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ', ')"
    plural = lambda n, w: f"CASE WHEN {n} > 0 THEN {n} || ' {w}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END END"
    exts = ", ".join(f"count(*) FILTER (regexp_extract(file, '[^.]*$') = '{e}') AS {e}" for e in sorted({x for r in R.RULES for x in r.languages}))
    out = {f"rule_{r.id.replace('-', '_')}": f"{oracle.findings(Config().only(r.id))} SELECT {C} FROM findings" for r in R.RULES}
    escape = "replace(replace(replace({}, '%', '%25'), chr(13), '%0D'), chr(10), '%0A')"
    prop = lambda c: f"replace(replace({escape.format(c)}, ':', '%3A'), ',', '%2C')"
    values = ", ".join("(" + ", ".join([str(r.ord), *(oracle.lit(x) for x in (r.id, r.id[0].upper() + r.id[1:].replace("-", " "), r.severity, r.category, ",".join(r.languages), r.description)), *("NULL::VARCHAR" if x is None else oracle.lit(x) for x in (r.pattern, r.anti, r.excl))]) + ")" for r in R.RULES)
    changed = oracle.diff_lines(whole)
    return out | {
        "findings_all": f"{whole} SELECT {C} FROM findings",
        "findings_documents": f"{oracle.findings(files=oracle.table_files('documents', 'doc_id', 'text', 'py'))} SELECT {C} FROM findings",
        "findings_pages": f"{oracle.findings(files=oracle.table_files('pages', 'page_id', 'html', 'jsx'))} SELECT {C} FROM findings",
        "summary_by_severity": f"{whole} SELECT {counts} FROM findings",
        "summary_by_category": f"{whole} SELECT category, count(*) AS findings, count(DISTINCT file) AS files FROM findings GROUP BY ALL",
        "summary_by_rule": f"{whole} SELECT rule, severity, count(*) AS findings, count(DISTINCT file) AS files FROM findings GROUP BY ALL",
        "summary_rollup": f"{whole} SELECT category, severity, count(*) AS findings FROM findings GROUP BY ROLLUP (category, severity)",
        "findings_by_file": f"""{whole} SELECT file, count(*) AS findings, string_agg(line || ':' || "column" || ':' || rule, ' ' ORDER BY line, "column", severity, rule) AS list FROM findings GROUP BY file""",
        "files_with_issues": f"{whole} SELECT n AS files_scanned, count(DISTINCT file) AS files_with_issues, count(*) AS findings, round(count(*) / n, 4) AS per_file, round(count(DISTINCT file) / n, 4) AS hit_rate FROM findings, (SELECT count(*) AS n FROM readable) GROUP BY n",
        "rule_ext_pivot": f"{whole} SELECT rule, {exts} FROM findings GROUP BY rule",
        "topk_rules": f"{whole} SELECT rule, count(*) AS findings FROM findings GROUP BY rule ORDER BY findings DESC, rule LIMIT 5",
        "topk_god_functions": f"{oracle.findings(Config().only('no-god-function'))} SELECT file, line, regexp_extract(message, '''(.*)''', 1) AS name, regexp_extract(message, 'has (\\d+) lines', 1)::INT AS lines FROM findings ORDER BY lines DESC, file, line LIMIT 10",
        "topk_files_by_rule": f"{whole} SELECT * FROM (SELECT rule, file, count(*) AS findings, (row_number() OVER (PARTITION BY rule ORDER BY count(*) DESC, file))::INT AS place FROM findings GROUP BY rule, file) WHERE place <= 3",
        "severity_override": f"{oracle.findings(OVERRIDE)} SELECT rule, severity, count(*) AS findings, count(DISTINCT file) AS files FROM findings GROUP BY ALL",
        "rules_off": f"{oracle.findings(OFF)} SELECT rule, count(*) AS findings, count(DISTINCT file) AS files FROM findings GROUP BY ALL",
        "min_severity": f"{whole} SELECT {C} FROM findings WHERE severity = 'error'",
        "ignore_globs": f"{whole} SELECT {C} FROM findings WHERE (regexp_matches(file, '\\.(ts|tsx|py)$') OR regexp_matches(file, '^lib/[^/]*\\.js$')) AND NOT starts_with(file, 'dist/') AND NOT starts_with(file, 'src/vendor/') AND NOT regexp_matches(file, '^lib/[^/]*7\\.py$')",
        "size_nul_filter": f"WITH {oracle.corpus_files()} SELECT count(*) AS files_scanned FROM (SELECT strlen(content) AS n, regexp_extract(file, 'f(\\d+)\\.', 1)::BIGINT AS k FROM files) WHERE k % 5 <> 0 AND n + CASE WHEN k % 7 = 0 THEN 1000000 ELSE 0 END <= 1000000",
        "findings_sorted": f"""{whole} SELECT file, (row_number() OVER (PARTITION BY file ORDER BY line, rule_ord, "column", message))::INT AS nth, line, rule FROM findings""",
        "diff_parse": f"WITH {oracle.diff_lines(oracle.corpus_files())} SELECT diff_id, file, line FROM changed",
        "diff_scan": f"{changed} SELECT {C} FROM findings f WHERE (file, line) IN (SELECT (file, line) FROM changed)",
        "diff_reroot": f"WITH {oracle.diff_lines(oracle.corpus_files())} SELECT substr(file, 5) AS file, line FROM changed WHERE starts_with(file, 'src/')",
        "changed_files_only": f"{whole} SELECT {C} FROM findings WHERE regexp_extract(file, 'f(\\d+)\\.', 1)::BIGINT IN (SELECT doc_id FROM labels)",
        "quiet_line": f"{whole}, {shown} SELECT CASE WHEN count(*) = 0 THEN 'No issues found.' ELSE count(*) || ' problems: ' || {parts.format(', '.join(f'''CASE WHEN count(*) FILTER (severity = '{s}') > 0 THEN count(*) FILTER (severity = '{s}') || ' {w}' END''' for s, w in (('error', 'errors'), ('warn', 'warnings'))))} END AS text FROM shown",
        "pretty_lines": f"""{whole}, {shown} SELECT file, line, "column", rule, '    ' || format('{{:<8}} {{:<5}}  {{:<28}} {{}}', line || ':' || "column", severity, rule, message) AS text FROM shown""",
        "pretty_total": f"{whole}, {shown}, one AS (SELECT count(*) AS n, count(DISTINCT file) AS files, {counts} FROM shown), scanned AS (SELECT count(*) AS k FROM readable) SELECT {plural('n', 'problem')} || ' (' || {parts.format(plural('error', 'error') + ', ' + plural('warn', 'warning'))} || ')' || chr(10) || {plural('files', 'file')} || ' with issues out of ' || k || ' scanned (0ms)' AS text FROM one, scanned",
        "json_rows": f"""{whole} SELECT to_json({{'rule': rule, 'severity': severity, 'category': category, 'file': file, 'line': line, 'column': "column", 'message': message, 'snippet': snippet}})::VARCHAR AS json FROM findings""",
        "agent_text": f"""{whole} SELECT file, line, "column", rule, file || ':' || line || ':' || "column" || ' [' || severity || '] ' || rule || ': ' || message || chr(10) || '  > ' || snippet AS text FROM findings""",
        "annotations": f"{whole} SELECT file, line, rule, '::' || CASE severity WHEN 'error' THEN 'error' WHEN 'warn' THEN 'warning' ELSE 'notice' END || ' file=' || {prop('file')} || ',line=' || line || ',title=codewhiff: ' || {prop('rule')} || '::' || {escape.format('message')} AS text FROM findings",
        "markdown_rows": f"{whole} SELECT file, line, rule, '| `' || replace(file, '|', '\\|') || '` | ' || line || ' | `' || replace(rule, '|', '\\|') || '` | ' || severity || ' | ' || replace(replace(message, chr(10), ' '), '|', '\\|') || ' |' AS text FROM findings",
        "markdown_totals": f"{whole} SELECT (CASE severity WHEN 'error' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END)::INT AS ord, '| ' || upper(severity[1]) || severity[2:] || ' | ' || count(*) || ' |' AS text FROM findings GROUP BY severity",
        "ci_gate": f"{whole} SELECT count(*) FILTER (severity IN ('error', 'warn')) > 0 AS failed FROM findings",
        "exit_code": f"{whole} SELECT CASE WHEN count(*) FILTER (severity = 'error') > 0 THEN 1 ELSE 0 END::INT AS code FROM findings",
        "rule_catalogue": f"SELECT * FROM (VALUES {values}) t(rule_ord, rule, name, severity, category, languages, description, pattern, \"anti\", excl)",
    }

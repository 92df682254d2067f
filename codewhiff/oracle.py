"""DuckDB SQL for the queries, written with windows and joins and so independent of the engine's own plans."""

from __future__ import annotations

from collections.abc import Iterable

from . import corpus
from .functions.text import render
from .operators import detectors as D
from .operators.diff import HUNK
from .plans import rules as R
from .plans.config import Config


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str, ignore_case: bool = False) -> str:
    return lit(render(pattern, ignore_case, "re2"))


def in_(values: Iterable[str]) -> str:
    return "(" + ", ".join(map(lit, values)) + ")"


def has(t: str, pattern: str, ignore_case: bool = False) -> str:
    return f"regexp_matches({t}, {rx(pattern, ignore_case)})"


def at(t: str, pattern: str, ignore_case: bool = False) -> str:
    return f"(length(regexp_extract({t}, {lit('(?s)^(.*?)(?:' + render(pattern, ignore_case, 're2') + ')')}, 1)) + 1)::INT"


def strip(t: str) -> str:
    return f"regexp_replace({t}, {rx(r'^\s+|\s+$')}, '', 'g')"


def braces(t: str) -> str:
    strings = r"""(?s)"[^"]*(?:"|\z)|'[^']*(?:'|\z)|`[^`]*(?:`|\z)"""
    bare = f"regexp_replace(regexp_replace({t}, '(?s)\\\\.', '', 'g'), {lit(strings)}, '', 'g')"
    return f"(len(replace({bare}, '}}', '')) - len(replace({bare}, '{{', '')))"


def brace_at(t: str) -> str:
    return f"regexp_extract({t}, '(?s)catch[^{{]*(\\{{.*)', 1)"


def indent(t: str) -> str:
    return f"len(regexp_extract({t}, {rx(r'^\s*')}))"


def corpus_files() -> str:
    rows = ", ".join(f"({i}, {lit(ext)}, {lit(body)})" for i, (ext, body) in enumerate(corpus.SNIPPETS))
    return f"""snippet(k, ext, body) AS (VALUES {rows}),
    files AS (SELECT ['src', 'lib', 'dist', 'src/vendor'][(doc_id % 4 + 1)::INT] || '/f' || doc_id || '.' || ext AS file, ext, body || chr(10) || coalesce(text, '') AS content
      FROM documents JOIN snippet ON doc_id % {len(corpus.SNIPPETS)} = k WHERE doc_id IS NOT NULL)"""


def table_files(table: str, name: str, text: str, ext: str) -> str:
    return f"files AS (SELECT {name} || '.{ext}' AS file, '{ext}' AS ext, {text} AS content FROM {table} WHERE {name} IS NOT NULL)"


READABLE = "readable AS (SELECT * FROM files WHERE content IS NOT NULL AND strlen(content) <= 1000000 AND instr(content, chr(0)) = 0)"
LINES = "lines AS (SELECT file, ext, unnest(ts) AS t, generate_subscripts(ts, 1)::INT AS line FROM (SELECT file, ext, string_split(content, chr(10)) AS ts FROM readable))"

FACTS = f"""facts AS (SELECT *, sum(delta) OVER (PARTITION BY file ORDER BY line) AS p, max(line) OVER (PARTITION BY file) AS last
      FROM (SELECT file, line, t, {braces("t")} AS delta FROM lines WHERE ext IN {in_(R.JS)}))"""

CATCHES = f"""catches AS (SELECT f.*, {at("t", "catch")} AS col, {braces(brace_at("t"))} AS d0 FROM facts f WHERE {has("t", D.CATCH)}),
    blocks AS (SELECT c.file, c.line, c.col, c.t, c.d0, CASE WHEN c.d0 <= 0 THEN c.line ELSE coalesce(min(b.line), any_value(c.last)) END AS e
      FROM catches c LEFT JOIN facts b ON b.file = c.file AND b.line > c.line AND c.d0 + b.p - c.p <= 0 GROUP BY c.file, c.line, c.col, c.t, c.d0),
    bodies AS (SELECT k.file, k.line, k.col, k.t, k.d0, b.t AS bt, {strip("b.t")} AS bare FROM blocks k LEFT JOIN facts b ON b.file = k.file AND b.line > k.line AND b.line <= k.e)"""

TODO = has("bare", D.CATCH_TODO, True)
REAL = f"bare NOT IN ('', '}}') AND NOT {TODO}"
LOGS = has("bt", D.CONSOLE)

DETECTED = {
    "no-empty-catch": (("facts", "catches"), f"""SELECT file, line, col, CASE WHEN NOT {has("t", D.CATCH_EMPTY)} AND coalesce(bool_or({TODO}), false) THEN {lit(R.TODO_CATCH)} END AS message
      FROM bodies WHERE d0 <> 0 OR {has("t", D.CATCH_EMPTY)} GROUP BY file, line, col, t HAVING {has("t", D.CATCH_EMPTY)} OR NOT coalesce(bool_or({REAL}), false)"""),
    "no-console-error-only": (("facts", "catches"), f"""SELECT file, line, col, NULL AS message FROM bodies WHERE d0 > 0 GROUP BY file, line, col
        HAVING coalesce(bool_or({LOGS} AND bare NOT IN ('', '{{', '}}')), false) AND NOT coalesce(bool_or(bare NOT IN ('', '{{', '}}') AND NOT {LOGS} AND NOT {has("bt", r"^\s*//")}), false)
      UNION ALL SELECT file, line, col, NULL FROM catches WHERE d0 = 0 AND {has(strip(f"regexp_extract({brace_at('t')}, '(?s)^\\{{(.*)\\}}', 1)"), D.CONSOLE)}"""),
    "no-deep-nesting": ((), f"""SELECT file, line, 1 AS col, 'Nesting depth ' || depth || '; return early or extract functions.' AS message FROM (
        SELECT *, row_number() OVER (PARTITION BY file, island, depth ORDER BY line) AS nth FROM (
          SELECT *, sum((depth < {R.DEEPEST})::INT) OVER (PARTITION BY file ORDER BY line) AS island FROM (
            SELECT file, line, (sum(len(replace(t, '}}', '')) - len(replace(t, '{{', ''))) OVER (PARTITION BY file ORDER BY line))::INT AS depth FROM lines WHERE ext IN {in_(R.JS)})))
      WHERE depth >= {R.DEEPEST} AND nth = 1"""),
    "no-god-function": (("facts",), f"""SELECT file, line, 1 AS col, 'Function ''' || name || ''' has ' || n || ' lines, more than 80; divide it.' AS message FROM (
        SELECT a.file, a.line, a.name, coalesce(min(b.line), a.line) - a.line + 1 AS n FROM (
          SELECT *, p - delta AS p0, coalesce(nullif(regexp_extract(t, {rx(D.HEADER)}, 1), ''), nullif(regexp_extract(t, {rx(D.HEADER)}, 2), ''), regexp_extract(t, {rx(D.HEADER)}, 3)) AS name
          FROM facts WHERE {has("t", D.HEADER)} AND contains(regexp_extract(t, {lit("(?s)" + render(D.HEADER, engine="re2") + ".*")}), '{{')) a
        LEFT JOIN facts b ON b.file = a.file AND b.p = a.p0 AND b.line >= a.line WHERE a.name NOT IN {in_(R.KEYWORDS)} GROUP BY a.file, a.line, a.name) WHERE n > {R.LONGEST}"""),
    "no-unused-protocol": ((), f"""SELECT c.file, c.line, {at("c.t", "class")} AS col, 'Protocol ''' || c.name || ''' isn''t used in this file.' AS message FROM (
        SELECT file, line, t, regexp_extract(t, {rx(D.PROTOCOL)}, 1) AS name FROM lines WHERE ext = 'py' AND {has("t", D.PROTOCOL)}) c
      JOIN readable r USING (file) WHERE NOT list_contains(regexp_extract_all(regexp_extract(r.content, {rx(D.EXPORTED)}, 1), '[''"]([^''"]+)[''"]', 1), c.name)
        AND NOT EXISTS (SELECT 1 FROM lines o WHERE o.file = c.file AND o.line <> c.line AND list_contains(regexp_extract_all(o.t, '\\w+'), c.name))"""),
    "no-pass-except": ((), f"""SELECT file, line, {at("t", "except")} AS col, NULL AS message FROM lines WHERE ext = 'py' AND {has("t", D.EXCEPT)} AND {has("t", D.EXCEPT_PASS)}
      UNION ALL SELECT file, line, col, NULL FROM (
        SELECT x.file, x.line, x.col, x.e, b.t AS bt FROM (
          SELECT a.file, a.line, a.col, coalesce(min(b.line), 2147483647) AS e FROM (
            SELECT file, line, {at("t", "except")} AS col, {indent("t")} AS ind FROM lines WHERE ext = 'py' AND {has("t", D.EXCEPT)} AND NOT {has("t", D.EXCEPT_PASS)} AND {has("t", D.EXCEPT_OPEN)}) a
          LEFT JOIN lines b ON b.file = a.file AND b.line > a.line AND {strip("b.t")} <> '' AND {indent("b.t")} <= a.ind GROUP BY a.file, a.line, a.col) x
        JOIN lines b ON b.file = x.file AND b.line > x.line AND b.line < x.e AND {strip("b.t")} <> '')
      GROUP BY file, line, col HAVING bool_or({strip("bt")} = 'pass') AND NOT bool_or({strip("bt")} <> 'pass' AND NOT starts_with({strip("bt")}, '#'))"""),
}


def findings(config: Config = Config(), files: str | None = None) -> str:
    """CTEs up to ``findings(rule, severity, category, file, line, column, message, snippet, rule_ord)``."""
    parts, needed = [], set()
    for r in config.active():
        if r.pattern:
            cond = f"ext IN {in_(r.languages)} AND {has('t', r.pattern, r.ignore_case)}"
            if r.anti:
                cond += f" AND NOT {has('t', r.anti, r.anti_ignore_case)}"
            if r.excl:
                cond += f" AND NOT {has('t', r.excl)}"
            parts.append(f"SELECT {r.ord} AS o, file, line, {at('t', r.pattern, r.ignore_case)} AS col, NULL::VARCHAR AS message FROM lines WHERE {cond}")
        else:
            use, body = DETECTED[r.id]
            needed |= set(use)
            parts.append(f"SELECT {r.ord} AS o, file, line, col, message FROM ({body})")
    rows = ", ".join(f"({r.ord}, {lit(r.id)}, {lit(config.severity(r))}, {lit(r.category)}, {lit(r.message)})" for r in R.RULES)
    ctes = [files or corpus_files(), READABLE, LINES]
    ctes += [FACTS] if needed else []
    ctes += [CATCHES] if "catches" in needed else []
    ctes.append(f"rules(o, rule, severity, category, text) AS (VALUES {rows})")
    ctes.append("found AS (" + "\n    UNION ALL ".join(parts) + ")")
    ctes.append(f"""findings AS (SELECT rule, severity, category, file, line, col::INT AS "column", coalesce(message, text) AS message, {strip("t")} AS snippet, o AS rule_ord
      FROM found JOIN rules USING (o) JOIN lines USING (file, line))""")
    return "WITH " + ",\n    ".join(ctes)


COLUMNS = 'rule, severity, category, file, line, "column", message, snippet'


def diff_lines(files: str) -> str:
    """CTEs from ``diffs(diff_id, diff)`` on to ``changed(diff_id, file, line)``."""
    path = r"""CASE WHEN starts_with(rest, '"') THEN CASE WHEN regexp_matches(rest, '(?s)^".*"') THEN
          replace(replace(replace(regexp_replace(regexp_extract(rest, '(?s)^"(.*)"', 1), '^[ab]/', ''), '\t', chr(9)), '\n', chr(10)), '\\', '\') END
        WHEN regexp_matches(rest, '^[ab]/') THEN regexp_extract(rest, '(?s)^[ab]/([^\t]*)', 1) END"""
    return f"""{files},
    diffs AS (SELECT file AS diff_id, 'diff --git a/' || file || ' b/' || file || chr(10) || 'index 1..2 100644' || chr(10) || '--- a/' || file || chr(10) || '+++ b/' || file || chr(10) || '@@ -1,2 +1,3 @@ x' || chr(10)
      || ' keep' || chr(10) || '-gone' || chr(10) || '+' || replace(content, chr(10), chr(10) || '+') || array_to_string(['', '\\ No newline at end of file', '@@ -9 +40,2 @@', '+far', ' same', '+end', 'diff --git a/x b/x', '+++ /dev/null', '@@ -1 +1 @@', '+lost', ''], chr(10)) AS diff FROM files),
    dl AS (SELECT diff_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS n FROM (SELECT diff_id, string_split(diff, chr(10)) AS ts FROM diffs)),
    kinds AS (SELECT *, substr(t, 5) AS rest, CASE WHEN starts_with(t, 'diff ') THEN 'reset' WHEN starts_with(t, '+++ ') THEN 'file'
      WHEN starts_with(t, '--- ') OR starts_with(t, 'index ') OR starts_with(t, '\\ ') THEN 'skip' WHEN regexp_matches(t, {lit(HUNK)}) THEN 'hunk' ELSE 'body' END AS kind FROM dl),
    blocks_ AS (SELECT *, sum((kind IN ('reset', 'file'))::INT) OVER w AS b, sum((kind = 'hunk')::INT) OVER w AS h FROM kinds WINDOW w AS (PARTITION BY diff_id ORDER BY n)),
    paths AS (SELECT diff_id, b, nullif(CASE WHEN kind = 'file' THEN {path} END, '') AS file FROM blocks_ WHERE kind IN ('reset', 'file')),
    starts AS (SELECT diff_id, h, regexp_extract(t, {lit(HUNK)}, 1)::BIGINT AS s FROM blocks_ WHERE kind = 'hunk'),
    steps AS (SELECT diff_id, p.file, x.n, x.t, h, s, CASE WHEN kind = 'body' AND p.file IS NOT NULL AND NOT starts_with(x.t, '-') THEN 1 ELSE 0 END AS inc, kind
      FROM blocks_ x LEFT JOIN paths p USING (diff_id, b) LEFT JOIN starts USING (diff_id, h)),
    changed AS (SELECT DISTINCT diff_id, file, line FROM (SELECT *, (coalesce(s, 0) + coalesce(sum(inc) OVER (PARTITION BY diff_id, h ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS line FROM steps)
      WHERE kind = 'body' AND file IS NOT NULL AND starts_with(t, '+'))""".replace("'\\\\ ", "'\\ ")

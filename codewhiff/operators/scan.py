"""The scan: files in, findings out, in one narrow stage.

Each file is one row. Its lines are exploded once; every line rule is a term of one bit mask, so that a line is read once whatever the number of
rules; the detectors' findings travel with the file's first line. Nothing is exchanged before the order of the result is asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import rules as R
from ..plans.config import Config
from .detectors import DETECT, OUT, struct_of

MAX_BYTES = 1_000_000
COLUMNS = ("rule", "severity", "category", "file", "line", "column", "message", "snippet")


def readable(files: DataFrame) -> DataFrame:
    """Files of a tree that count: of a million bytes at most and without a NUL. ``size`` is used where there is such a column."""
    size = F.col("size") if "size" in files.columns else F.octet_length("content")
    return files.where(F.col("content").isNotNull() & (size <= MAX_BYTES) & (F.instr("content", "\0") == 0))


def _guard(text: Column, guards: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(g) for g in guards])


def _hit(text: Column, rule: R.Rule) -> Column:
    """Whether a line that has one of the rule's guards breaks it."""
    cond = T.matches(text, rule.pattern, rule.ignore_case)
    if rule.needs:
        cond = T.matches(text, rule.needs, rule.ignore_case) & cond
    if rule.anti:
        cond &= ~T.matches(text, rule.anti, rule.anti_ignore_case)
    if rule.excl:
        cond &= ~T.matches(text, rule.excl)
    return cond


def _mask(ext: Column, text: Column, rules: list[R.Rule]) -> Column:
    """One bit for each rule that the line breaks. Rules for the same languages share a test of the extension, and those with the same guards
    a search for these, so that most lines meet no regular expression."""
    none = F.lit(0).cast("long")
    groups: dict[tuple[str, ...], dict[tuple[str, ...], list[R.Rule]]] = {}
    for r in rules:
        groups.setdefault(r.languages, {}).setdefault(r.guards, []).append(r)

    def every(terms: list[Column]) -> Column:
        return reduce(lambda a, b: a.bitwiseOR(b), terms)

    of_language = []
    for langs, by_guard in groups.items():
        guarded = [F.when(_guard(text, guards), every([F.when(_hit(text, r), F.lit(1 << r.ord).cast("long")).otherwise(none) for r in members])).otherwise(none) for guards, members in by_guard.items()]
        of_language.append(F.when(ext.isin(*langs), every(guarded)).otherwise(none))
    return every(of_language)


def find(files: DataFrame, config: Config = Config(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Findings of all ``files(file, content)``, unordered, with ``rule_ord`` and the columns of the file to ``keep``.

    Other columns are ignored. Files without a name or content give nothing; repeated rows are scanned each. Extensions that no
    rule is for give nothing.
    """
    active = config.active()
    lines_on, detectors = [r for r in active if r.pattern], [r for r in active if not r.pattern]
    langs = sorted({x for r in active for x in r.languages})
    named = files.where(F.col("file").isNotNull() & F.col("content").isNotNull()).select("file", T.extension(F.col("file")).alias("ext"), "content", F.struct(F.lit(0).alias("_"), *keep).alias("kept")).where(F.col("ext").isin(*langs))
    split = named.select("file", "ext", "kept", "content", T.lines_of(F.col("content")).alias("lines"))
    found = []
    for r in detectors:
        one = F.when(F.col("ext").isin(*r.languages), DETECT[r.id](F.col("lines"), F.col("content")))
        one = F.coalesce(one, F.array().cast(OUT))
        found.append(_of_file(one, r))
    multi = F.concat(*found) if found else F.array().cast(T.EMPTY)
    # before the lines are exploded: a line's row must not carry its whole file along
    detected = split.select("file", "ext", "kept", "lines", multi.alias("multi"))
    exploded = detected.select("file", "ext", "kept", "multi", F.posexplode("lines").alias("pos", "text"))
    mask = _mask(F.col("ext"), F.col("text"), lines_on) if lines_on else F.lit(0).cast("long")
    lines = exploded.select("file", "kept", "pos", "text", mask.alias("mask"), "multi")
    lines = lines.where((F.col("mask") != 0) | ((F.col("pos") == 0) & (F.size("multi") > 0)))

    # the mask is named often here, so that the optimizer keeps it as a column
    ords = F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << r.ord)) != 0, F.lit(r.ord)) for r in lines_on]).cast("array<int>"))
    column = F.lit(0)
    for r in lines_on:
        column = F.when(F.col("o") == r.ord, T.position(F.col("text"), r.pattern, r.ignore_case)).otherwise(column)
    on_lines = F.transform(ords, lambda o: struct_of(ord=o, line=F.col("pos") + 1, column=F.lit(0), message=F.lit(None).cast("string"), snippet=F.lit(None).cast("string")))
    every = lines.select("file", "kept", "text", F.explode(F.concat(on_lines.cast(T.EMPTY), F.when(F.col("pos") == 0, F.col("multi")).otherwise(F.array().cast(T.EMPTY)))).alias("f"))
    flat = every.select("file", "kept", "text", F.col("f.ord").alias("o"), F.col("f.line").alias("line"), F.col("f.column").alias("c"), F.col("f.message").alias("m"), F.col("f.snippet").alias("s"))

    def of(values: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("o") + 1)

    return flat.select(
        of([r.id for r in R.RULES]).alias("rule"), of([config.severity(r) for r in R.RULES]).alias("severity"), of([r.category for r in R.RULES]).alias("category"),
        "file", "line", F.when(F.col("m").isNull(), column).otherwise(F.col("c")).cast("int").alias("column"),
        F.coalesce(F.col("m"), of([r.message for r in R.RULES])).alias("message"), F.coalesce(F.col("s"), T.strip(F.col("text"))).alias("snippet"), F.col("o").alias("rule_ord"), *[F.col("kept")[k].alias(k) for k in keep])


def _of_file(found: Column, rule: R.Rule) -> Column:
    """A detector's findings, with its rule and the line that each begins at."""
    return F.transform(found, lambda m: struct_of(ord=F.lit(rule.ord), line=m.line, column=m["column"], message=m.message, snippet=T.strip(F.element_at(F.col("lines"), m.line))))


def ordered(findings: DataFrame) -> DataFrame:
    """By file in dictionary order, line, and the catalogue's order: one range exchange of the findings."""
    return findings.orderBy(F.collate("file", "UNICODE"), "file", "line", "rule_ord")


def scan_content(files: DataFrame, config: Config = Config()) -> DataFrame:
    """Findings of texts as they are given: no limit of size, no test for binary content."""
    return find(files, config).select(*COLUMNS)


def scan(files: DataFrame, config: Config = Config(), changed: DataFrame | None = None) -> DataFrame:
    """Findings of the readable ``files``; with ``changed(file, line)`` only those on changed lines.

    Unchanged files leave before anything is split. Detectors see whole files; their findings count by their first line. What changed is
    exchanged once, as the lines of each file, and read by both joins.
    """
    files = readable(files)
    if changed is None:
        return find(files, config).select(*COLUMNS)
    # both sides ask for the lines, so that they are the same exchange
    lines = changed.groupBy("file").agg(F.collect_set("line").alias("lines_")).where(F.size("lines_") > 0)
    out = find(files.join(lines, "file", "left_semi"), config)
    return out.join(lines, "file").where(F.array_contains("lines_", F.col("line"))).select(*COLUMNS)


def files_scanned(files: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """``(files_scanned)``: how many files count."""
    files = readable(files)
    if changed is not None:
        files = files.join(changed.select("file").distinct(), "file", "left_semi")
    return files.agg(F.count("*").alias("files_scanned"))

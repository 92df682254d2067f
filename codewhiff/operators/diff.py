"""Changed lines from unified diffs."""

from __future__ import annotations

import os.path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_COUNT = r"(?:,[0-9]+)?"
HUNK = "^@@ -[0-9]+" + _COUNT + " [+]([0-9]+)" + _COUNT + " @@"


def header_path(line):
    """The path in a ``+++`` line: quoted, or after a/ or b/ up to a tab; null for anything else."""
    rest = F.substr(line, F.lit(5))
    inner = F.regexp_extract(rest, r'(?s)^"(.*)"', 1)
    plain = F.regexp_replace(inner, "^[ab]/", "")
    for escaped, char in ((r"\t", "\t"), (r"\n", "\n"), ("\\\\", "\\")):
        plain = F.replace(plain, F.lit(escaped), F.lit(char))
    quoted = F.when(rest.rlike(r'(?s)^".*"'), plain)
    return F.when(rest.startswith('"'), quoted).when(rest.rlike("^[ab]/"), F.regexp_extract(rest, r"(?s)^[ab]/([^\t]*)", 1))


def changed_lines(diffs: DataFrame, id_col: str = "diff_id", text_col: str = "diff") -> DataFrame:
    """``(diff_id, file, line)``: the added lines of each diff, by their numbers in the new file, in one narrow stage without an exchange.

    A diff is split into sections, each of which begins with a header or a hunk's line; a fold over these carries the file that was last named and the
    next line's number. In a section, the lines that are in the new file are numbered on from there. Null texts give nothing;
    lines that are named more than once come as often.
    """
    marks = r"\n(?=diff |[+][+][+] |" + HUNK[1:] + ")"
    place = "struct<path:string,line:bigint,text:string>"
    start = F.struct(F.lit(None).cast("string").alias("path"), F.lit(0).cast("long").alias("line"), F.array().cast(f"array<{place}>").alias("out"))

    def step(state, section):
        head = F.substring_index(section, "\n", 1)
        is_file, is_hunk = head.startswith("+++ "), head.rlike(HUNK)
        named = header_path(head)
        path = F.when(is_file, F.when(named != "", named)).when(~head.startswith("diff "), state.path)
        line = F.when(is_hunk & ~is_file, F.regexp_extract(head, HUNK, 1).cast("long")).otherwise(state.line)
        here = F.struct(path.alias("path"), line.alias("line"), section.alias("text"))
        return F.struct(
            path.alias("path"), (line + F.when(path.isNotNull(), F.size(_in_new_file(section))).otherwise(0)).alias("line"),
            F.when(path.isNotNull(), F.concat(state.out, F.array(here))).otherwise(state.out).alias("out"),
        )

    sections = F.aggregate(F.split(text_col, marks, -1), start, step, lambda state: state.out)
    each = diffs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("diff_id"), F.explode(sections).alias("section"))
    lines = each.select("diff_id", F.col("section.path").alias("file"), F.col("section.line").alias("start"), F.posexplode(_in_new_file(F.col("section.text"))).alias("n", "t"))
    return lines.where(F.startswith("t", F.lit("+"))).select("diff_id", "file", (F.col("start") + F.col("n")).cast("int").alias("line"))


def _in_new_file(section):
    """The lines after a section's first, without removed ones and remarks; the first counts if it is no header."""
    lines = F.split(section, "\n", -1)
    head = F.substring_index(section, "\n", 1)
    body = F.when(head.rlike(HUNK) | head.startswith("diff ") | head.startswith("+++ "), F.slice(lines, 2, F.size(lines))).otherwise(lines)
    return F.filter(body, lambda t: ~(t.startswith("-") | t.startswith("index ") | t.startswith("\\ ")))


def parse_diff(diffs: DataFrame, id_col: str = "diff_id", text_col: str = "diff") -> DataFrame:
    """``(diff_id, file, line)``, distinct: the rows of :func:`changed_lines`, once each."""
    return changed_lines(diffs, id_col, text_col).distinct()


def reroot(changed: DataFrame, repo_root: str, scan_root: str) -> DataFrame:
    """``changed`` with paths below ``repo_root`` given from ``scan_root`` on; files outside that leave."""
    base = os.path.relpath(os.path.abspath(scan_root), os.path.abspath(repo_root))
    if base == ".":
        return changed
    if base.split("/")[0] == "..":
        extra = os.path.relpath(os.path.abspath(repo_root), os.path.abspath(scan_root))
        return changed.withColumn("file", F.concat(F.lit(extra + "/"), "file"))
    return changed.where(F.startswith("file", F.lit(base + "/"))).withColumn("file", F.substr("file", F.lit(len(base) + 2)))

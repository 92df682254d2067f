"""Filters over files and findings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.config import Config
from ..plans.rules import SEVERITIES


def glob_regex(glob: str) -> str:
    """A glob as a regular expression for a whole path: ``*`` and ``?`` stay within a name, ``**`` spans folders, braces list choices."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "[" and "]" in glob[i:]:
            j = glob.index("]", i)
            out, i = out + "[" + glob[i + 1 : j].replace("!", "^", 1) + "]", j
        else:
            out += re.escape(c)
        i += 1
    return out


def ignored_regex(globs: tuple[str, ...], anywhere: bool = False) -> str:
    """Matches paths that, or folders of which, a glob names. Globs hold from the root on, or with ``anywhere`` at any depth."""
    return ("^(?:.*/)?" if anywhere else "^") + "(?:" + "|".join(map(glob_regex, globs)) + r")(?:/.*)?\z"


def is_wanted(path: Column, config: Config, anywhere: bool = False) -> Column:
    """Included, not ignored, and neither hidden nor in a hidden folder."""
    included = path.rlike("^(?:" + "|".join(map(glob_regex, config.include)) + r")\z")
    wanted = included & ~path.rlike(r"(?:^|/)\.")
    return wanted & ~path.rlike(ignored_regex(config.ignore, anywhere)) if config.ignore else wanted


def wanted_files(files: DataFrame, config: Config = Config(), anywhere: bool = False) -> DataFrame:
    return files.where(is_wanted(F.col("file"), config, anywhere))


def rank(severity: Column) -> Column:
    """0 for error, 1 for warn, 2 for info."""
    return (F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1).cast("int")


def at_least(findings: DataFrame, severity: str = "warn") -> DataFrame:
    """Findings of a severity and above; an unknown one means warn."""
    severity = severity if severity in SEVERITIES else "warn"
    return findings.where(F.col("severity").isin(*SEVERITIES[: SEVERITIES.index(severity) + 1]))


def in_files(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings in the listed files, by exact name."""
    return findings.join(files.select("file").distinct(), "file", "left_semi").select(*findings.columns)

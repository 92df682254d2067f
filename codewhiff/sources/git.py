"""Changed lines from a working tree."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

from ..operators.diff import parse_diff, reroot

MOST = 10 << 20


def git_root(folder: str) -> str:
    return subprocess.run(["git", "rev-parse", "--show-toplevel"], cwd=folder, capture_output=True, text=True, check=True).stdout.strip()


def git_diff(spark: SparkSession, folder: str, staged: bool = False) -> DataFrame:
    """``(file, line)`` of lines that are changed, or staged, below ``folder``, with paths from there on. Files that git doesn't track aren't
    there."""
    done = subprocess.run(["git", "diff", *(["--cached"] if staged else []), "-U0"], cwd=folder, capture_output=True)
    if done.returncode:
        error = done.stderr.decode(errors="replace")
        raise RuntimeError("changed lines need a git repository" if "ot a git repository" in error else error)
    if len(done.stdout) > MOST:
        raise RuntimeError("the diff is larger than 10 MiB")
    root = git_root(folder)
    text = spark.createDataFrame([(0, done.stdout.decode("utf-8", errors="replace"))], "diff_id int, diff string")
    return reroot(parse_diff(text).select("file", "line"), root, folder)

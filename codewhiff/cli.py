"""The command line, and the functions that tools for agents call."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators import filters, reports
from .operators.diff import parse_diff
from .operators.scan import COLUMNS, files_scanned, find, scan, scan_content
from .plans.config import Config
from .sources import git, settings, tree


def scan_path(spark: SparkSession, path: str, config: Config = Config(), changed: DataFrame | None = None) -> DataFrame:
    """Findings below a folder, or in one file."""
    return scan(_files(spark, path, config), config, changed)


def _files(spark: SparkSession, path: str, config: Config) -> DataFrame:
    if os.path.isfile(path):
        folder, name = os.path.split(os.path.abspath(path))
        return tree.read_tree(spark, folder, Config(config.rules, config.ignore, (name,)))
    return tree.read_tree(spark, path, config)


def scan_paths(spark: SparkSession, paths: list[str], config: Config = Config()) -> DataFrame:
    """Findings of files, by their whole names, and folders; paths that overlap count each time. A missing path is itself a finding."""
    parts = []
    for p in paths:
        at = os.path.abspath(p)
        if not os.path.exists(at):
            row = ("missing-path", "error", "code-quality", p, 0, 0, f"Path does not exist: {p}", "")
            parts.append(spark.createDataFrame([row], find(_none(spark)).select(*COLUMNS).schema))
        elif os.path.isfile(at):
            with open(at, encoding="utf-8", errors="replace", newline="") as f:
                parts.append(scan_content(spark.createDataFrame([(at, f.read())], "file string, content string"), config))
        else:
            parts.append(scan_path(spark, at, config))
    return reduce(DataFrame.unionByName, parts) if parts else scan_content(_none(spark), config)


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "file string, content string")


def scan_diff(spark: SparkSession, diff: str, root: str, config: Config = Config()) -> DataFrame:
    """Findings below ``root`` on the lines that a diff adds; the diff's paths are taken from ``root`` on."""
    changed = parse_diff(spark.createDataFrame([(0, diff)], "diff_id int, diff string")).select("file", "line")
    names = [r.file for r in changed.select("file").distinct().collect()]  # as many as the diff has files
    return scan(tree.read_tree(spark, root, config, only=names), config, changed)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: no errors found; 1: errors found; 2: the scan was impossible."""
    args = argparse.ArgumentParser(prog="codewhiff", description="Finds code smells.")
    args.add_argument("--version", action="version", version=__version__)
    args.add_argument("path", nargs="?", default=".")
    args.add_argument("-c", "--config")
    args.add_argument("--json", action="store_true")
    args.add_argument("--ignore", nargs="+", default=[])
    args.add_argument("--severity", default="warn")
    args.add_argument("-q", "--quiet", action="store_true")
    args.add_argument("-d", "--diff", action="store_true")
    args.add_argument("--staged", action="store_true")
    given = args.parse_args(argv)
    if not os.path.exists(given.path):
        print(f"Error: path {given.path!r} does not exist.", file=sys.stderr)
        return 2
    config = settings.with_ignored(settings.load_config(given.config), *given.ignore)
    spark = spark or SparkSession.builder.appName("codewhiff").getOrCreate()
    folder = given.path if os.path.isdir(given.path) else os.path.dirname(os.path.abspath(given.path))
    began = time.monotonic()
    changed = None
    try:
        if given.diff or given.staged:
            changed = git.git_diff(spark, folder, given.staged).persist()
            if changed.isEmpty():
                print('{"findings":[],"filesScanned":0,"duration":0,"summary":{"error":0,"warn":0,"info":0}}' if given.json else "\n  No changed files to scan.\n")
                return 0
        files = _files(spark, given.path, config)
        found = scan(files, config, changed).persist()
        n = files_scanned(files, changed)
        shown = filters.at_least(found, given.severity)
        count = found.count()
        took = (time.monotonic() - began) * 1000
        if given.json:
            print(json.dumps(json.loads(reports.json_report(found, n, given.severity, round(took)).first().json), indent=2, ensure_ascii=False))
        elif given.quiet:
            print(reports.quiet_line(found, given.severity).first().text)
        else:
            last = None
            for r in reports.pretty_lines(shown).orderBy(F.collate("file", "UNICODE"), "file", "line", "column").toLocalIterator() if count else ():
                if r.file != last:
                    print(f"\n  {r.file}")
                    last = r.file
                print(r.text)
            print("\n" + reports.pretty_total(found, n, given.severity, reports.duration(took)).first().text)
        return reports.exit_code(found).first().code
    except RuntimeError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 2


def run() -> None:
    """The console script."""
    sys.exit(main())


if __name__ == "__main__":
    run()

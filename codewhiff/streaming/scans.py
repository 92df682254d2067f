"""Scans of streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import find, readable, scan
from ..plans.config import Config


def scan_stream(files: DataFrame, config: Config = Config()) -> DataFrame:
    """Findings of a stream of ``(file, content)`` rows. A scan keeps no state between files, so it is the same plan as for a table."""
    return scan(files, config)


def counts_by_window(files: DataFrame, time_col: str, config: Config = Config(), window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Findings by severity and window of ``time_col``; files that are more than ``late`` behind are dropped, and a window's state with them."""
    found = find(readable(files.withWatermark(time_col, late)), config, keep=(time_col,))
    return found.groupBy(F.window(time_col, window).alias("w"), "severity").agg(F.count("*").alias("findings"))

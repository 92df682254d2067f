"""Code-smell analytics over source files as Spark DataFrames."""

__version__ = "0.2.0"

from .operators.diff import parse_diff, reroot
from .operators.filters import at_least, in_files, wanted_files
from .operators.scan import ordered, scan, scan_content
from .plans.config import Config
from .plans.rules import RULES, rules_df
from .sources.settings import load_config
from .sources.tree import read_tree

__all__ = ["RULES", "Config", "at_least", "in_files", "load_config", "ordered", "parse_diff", "read_tree", "reroot", "rules_df", "scan", "scan_content", "wanted_files"]

"""Source trees as a Spark data source."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.filters import glob_regex, ignored_regex
from ..operators.scan import MAX_BYTES
from ..plans.config import Config

SCHEMA = "file string, size bigint, content string"


class Batch(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.include = options.get("include", "")
        self.ignore = options.get("ignore", "")
        self.only = options.get("only")
        self.batch = int(options.get("batchBytes", 8 << 20))

    def partitions(self) -> list[Batch]:
        """Batches of about equal bytes; hidden files and folders, and links to folders, are passed by. Ignored folders aren't entered."""
        include, ignore = re.compile(f"(?:{self.include})\\Z", re.S), re.compile(self.ignore, re.S) if self.ignore else None
        only = set(self.only.split("\0")) if self.only is not None else None
        batches, held, size = [], [], 0
        for folder, dirs, files in os.walk(self.root):
            base = os.path.relpath(folder, self.root)
            base = "" if base == "." else base + "/"
            dirs[:] = sorted(d for d in dirs if d[0] != "." and not os.path.islink(f"{folder}/{d}") and not (ignore and ignore.match(base + d)))
            for name in sorted(files):
                path = base + name
                if name[0] == "." or not include.match(path) or ignore and ignore.match(path) or only is not None and path not in only:
                    continue
                try:
                    full = f"{folder}/{name}"
                    n = os.stat(full).st_size
                except OSError:
                    continue
                if n > MAX_BYTES or os.path.islink(full) and not os.path.isfile(full):
                    continue
                held.append(path)
                size += n + 512
                if size >= self.batch:
                    batches.append(Batch(held))
                    held, size = [], 0
        return [*batches, Batch(held)] if held or not batches else batches

    def read(self, partition: Batch) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                with open(f"{self.root}/{path}", "rb") as f:
                    raw = f.read()
            except OSError:
                continue  # unreadable files don't count
            if b"\0" not in raw:
                yield path, len(raw), raw.decode("utf-8", errors="replace")


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "codetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, path: str, config: Config = Config(), only: list[str] | None = None, anywhere: bool = False) -> DataFrame:
    """``(file, size, content)`` of the wanted files below ``path``, each once; ``only`` lists the files to look at, so that others aren't read."""
    from .. import runtime

    runtime.ship(spark)
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("codetree").option("include", "|".join(map(glob_regex, config.include)))
    if config.ignore:
        reader = reader.option("ignore", ignored_regex(config.ignore, anywhere).replace(r"\z", r"\Z"))
    if only is not None:
        reader = reader.option("only", "\0".join(only))
    return reader.load(os.path.abspath(path))

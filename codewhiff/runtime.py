"""Making this package importable in Python workers, and settings for its plans."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's code to the workers, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="pyfiles-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def tune(spark: SparkSession) -> None:
    """A line is tested in one generated method. Above 8,000 bytes the JVM would interpret it, so beyond that Spark is to split it."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def spread(df: DataFrame, below: int = 256 << 20) -> DataFrame:
    """A table of an estimated size ``below`` this, which may be one split, over all cores. Larger tables have splits enough and aren't exchanged."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < below else df

"""What operators with Python work inside tasks share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Give executors this package where their Python path does not have it already; Spark serves the archive to them."""
    known = [os.path.realpath(p) for p in (*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()) if p]
    if spark.sparkContext.master.startswith("local[") or os.path.realpath(PACKAGE.parent) in known or getattr(spark.sparkContext, "_groundwork_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="ship-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in PACKAGE.rglob("*.py"):
            z.write(p, p.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(target))
    spark.sparkContext._groundwork_shipped = True


def slices(batches, rows: int = 256):
    """Cut Arrow batches into pieces of bounded row counts."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)

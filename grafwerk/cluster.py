"""What a session's cluster needs: this package in its Python workers, and tables that outlive executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_shipped: set[str] = set()


ROWS_A_BATCH = "2000"  # of texts of some KB; the default of 10,000 makes batches that a worker holds several times over


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's files, once; Spark takes it to every executor, present and future.

    Where the session has Spark's default for rows in an Arrow batch, it gets ROWS_A_BATCH.
    """
    context = spark.sparkContext
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch, "10000") == "10000":
        spark.conf.set(batch, ROWS_A_BATCH)
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="grafwerk-"), "grafwerk.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a temporary one of our own only where it is unset."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="grafwerk-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return "file://" + _own["dir"]


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: ends its lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

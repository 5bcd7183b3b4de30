"""Makes the package importable where tasks run."""

from __future__ import annotations

import functools
import hashlib
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch between the JVM and Python, where the session has Spark's default of 64 MB: batches stand in both at once, for each core.
BATCH, DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def ship(spark: SparkSession) -> None:
    """Hands the package's modules to the tasks of the session's context, once. Spark copies them to each executor, so that none need be installed there. Bounds the session's Arrow batches."""
    if spark.conf.get(BATCH, DEFAULT) == DEFAULT:
        spark.conf.set(BATCH, BATCH_BYTES)
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    files = {f"{root.name}/{p.relative_to(root)}": p.read_bytes() for p in sorted(root.rglob("*.py"))}
    name = hashlib.sha256(repr(files).encode()).hexdigest()[:12]
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="tessera-package-")), f"tessera-{name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for inside, content in files.items():
            out.writestr(inside, content)
    context.addPyFile(path)
    context._tessera_shipped = True


def shipped(f):
    """A query or stage, whose first argument is the session, that ships the package before it runs."""

    @functools.wraps(f)
    def run(spark: SparkSession, *args, **more):
        ship(spark)
        return f(spark, *args, **more)

    return run


def ships(f):
    """An operator that starts Python workers: ships the package to the session of its first argument, a DataFrame."""

    @functools.wraps(f)
    def run(df: DataFrame, *args, **more):
        ship(df.sparkSession)
        return f(df, *args, **more)

    return run

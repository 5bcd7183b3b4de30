"""Choices about execution: session defaults, lineage, size limits of what tasks hold."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of points that one task compares with as many others.
BLOCK = 2048
#: Constants in an expression plan; beyond, assignment runs on Arrow batches with matrix products.
EXPRESSION_CONSTANTS = 2048

SESSION = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Adds the settings that the operators are designed for to a session's builder."""
    for key, value in SESSION.items():
        builder = builder.config(key, value)
    return builder


def checkpoint_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session's context, set from spark.checkpoint.dir if it has none yet.

    Without either, a temporary folder is made if the master is local (tests); a cluster has to name a shared one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder, which survives lost executors, and returns it without its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is made in this context drops its shuffles' files when an action on it ends, instead of when the driver happens to collect its garbage: for frames that only their checkpoint reads."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def uses_expressions(clusters: int, dimensions: int) -> bool:
    """Whether assignment to so many centers is planned as JVM expressions rather than on Arrow batches."""
    return clusters * dimensions <= EXPRESSION_CONSTANTS

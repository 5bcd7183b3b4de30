"""Helpers shared by the corpus operators: reading tables, cutting lineage, Arrow batches in bounded slices."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import plans
from tessera.plans.shipping import ships

#: Java and Python regular expressions for a run of anything but ASCII white space, and for the white space itself.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: A key is hot in a join if more than one in so many rows has it.
HOT = 10_000

#: Bytes of text that an Arrow operator handles at a time; longer single texts are handled alone.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session. Where none is given, a temporary one is made if the master is local; a cluster must name one."""
    return plans.checkpoint_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder of the session and returns it without its lineage."""
    return plans.cut_lineage(df)


@contextlib.contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A path in the shared checkpoint folder for a table, which is removed at the end."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(of, True)


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo divisor. A null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))) % divisor


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about size bytes of text (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def without(df: DataFrame, ids: DataFrame, column: str, broadcast: int = 1_000_000) -> DataFrame:
    """The rows of df whose id (column) isn't among ids (one column of that name, no nulls). Null ids stay. The ids are broadcast if there are at most broadcast of them, and joined otherwise."""
    ids = cut(ids.distinct())
    return df.join(F.broadcast(ids) if ids.count() <= broadcast else ids, column, "left_anti")


def join_hot(left: DataFrame, right: DataFrame, key: str, total: int, least: int = 0) -> DataFrame:
    """The inner join of left with right, whose keys are unique and whose column rows says how many rows of left have the key, of total in all.

    Keys with more than total / HOT rows (rounded up to a power of 2, so that the plan's code serves other totals too), and more
    than least, are joined by a broadcast: there are less than HOT of them. The others are joined by a shuffle, in which
    none is hot. The column rows goes.
    """
    if total <= least:
        return left.join(right.drop("rows"), key)
    bound = F.lit(max(least, 1 << (total // HOT).bit_length())).cast("long")
    hot = F.broadcast(right.filter(F.col("rows") > bound).drop("rows"))
    rest = right.filter(F.col("rows") <= bound).drop("rows")
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(rest, key))


def tidy() -> None:
    """Gives memory that a task has freed back to the system: workers stay for the next tasks and stages, beside the JVM's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform.startswith("linux") else None
    if trim is not None:
        trim(0)


@ships
def map_text(df: DataFrame, keep: list[str], text: str, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, size: int = SLICE_BYTES) -> DataFrame:
    """Applies f to slices of the columns keep and text."""

    def run(batches):
        for batch in slices(batches, text, size):
            yield f(batch)
        tidy()

    return df.select(*keep, *([] if text in keep else [text])).mapInArrow(run, schema)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is computed once: as the variable of a lambda it can't be inlined where it is used."""
    return F.transform(F.array(value), f)[0]

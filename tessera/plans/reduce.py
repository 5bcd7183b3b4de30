"""Sums of vectors that tasks have made, without a group of them in one place."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tessera.plans.shipping import ships

#: Beyond so many cores the vectors are added up in two levels, the first in FAN parts for each key.
CORES, FAN = 256, 32


@ships
def sum_vectors(df: DataFrame, dtype: str = "<f8", total: str = "<f8") -> DataFrame:
    """k, v of the sums by k of vectors v (binary, of numbers of type dtype; the sums are of type total). A task holds one vector for each of its keys."""

    def adder(dtype):
        def run(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, v in zip(batch["k"].to_pylist(), batch["v"]):
                    one = np.frombuffer(v.as_buffer(), dtype)
                    if k in sums:
                        sums[k] += one
                    else:
                        sums[k] = one.astype(total)
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["k", "v"])

        return run

    df = df.select(F.col("k").cast("long").alias("k"), "v")
    if df.sparkSession.sparkContext.defaultParallelism > CORES:
        df = df.repartition("k", F.spark_partition_id() % FAN).mapInArrow(adder(dtype), "k long, v binary")
        dtype = total
    return df.repartition("k").mapInArrow(adder(dtype), "k long, v binary")

"""Stage artifacts and result documents, written and read back."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tessera.plans.shipping import ships

#: Layouts of struct-of-arrays binary files: name and type of each array, which follow each other.
TREE_EDGES = (("u", "<i4"), ("v", "<i4"), ("w2", "<f8"))
LINKAGE = (("left", "<i4"), ("right", "<i4"), ("dist", "<f8"), ("size", "<i4"))


def write_samples(points: DataFrame, path: str, dtype: str = "float32") -> None:
    """Points as Parquet, vectors in the type that is asked for, in parallel."""
    kind = {"float32": "array<float>", "float64": "array<double>"}[dtype]
    points.select("id", F.col("x").cast(kind).alias("x")).write.mode("overwrite").parquet(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """id, x (array of double). Only the columns asked for are read; nothing is read before an action."""
    return spark.read.parquet(path).select("id", F.col("x").cast("array<double>").alias("x"))


def write_stage(df: DataFrame, folder: str, stage: str) -> None:
    """Distances, core distances, tree edges or merges of one stage as Parquet, for the stage after it."""
    df.write.mode("overwrite").parquet(f"{folder}/{stage}")


def read_stage(spark: SparkSession, folder: str, stage: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{stage}")


def write_arrays(table: pd.DataFrame, path: str, layout) -> None:
    """A small table as one binary file: each column's values in a row, column after column."""
    with Path(path).open("wb") as out:
        for name, kind in layout:
            out.write(table[name].to_numpy().astype(kind).tobytes())


def read_arrays(path: str, layout) -> pd.DataFrame:
    """The table of such a file; a size that isn't a whole number of rows raises."""
    raw = Path(path).read_bytes()
    width = sum(np.dtype(kind).itemsize for _, kind in layout)
    if len(raw) % width:
        raise ValueError(f"{path} has {len(raw)} bytes, which isn't a whole number of rows of {width}")
    n, at, found = len(raw) // width, 0, {}
    for name, kind in layout:
        found[name] = np.frombuffer(raw, kind, n, at)
        at += n * np.dtype(kind).itemsize
    return pd.DataFrame(found)


@ships
def write_matrix(points: DataFrame, path: str, dtype: str = "float32") -> None:
    """Points in the order of id as headerless row-major numbers, a file for each range of ids: part names sort as ids do.

    Tasks write, so path must be a folder that all executors and the driver share; if the driver doesn't see just what they wrote, this raises."""
    Path(path).mkdir(parents=True, exist_ok=True)

    def save(batches):
        first, chunks = None, []
        for batch in batches:
            if batch.num_rows:
                first = batch["id"][0].as_py() if first is None else first
                chunks.append(np.stack(batch["x"].to_pylist()).astype(dtype).tobytes())
        if chunks:
            with Path(path, f"part-{first:020d}").open("wb") as out:
                out.writelines(chunks)
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, chunks))], pa.int64())], names=["bytes"])

    written = points.select("id", "x").repartitionByRange("id").sortWithinPartitions("id").mapInArrow(save, "bytes long").agg(F.sum("bytes")).first()[0]
    if sum(part.stat().st_size for part in Path(path).glob("part-*")) != (written or 0):
        raise ValueError(f"{path} doesn't hold just the parts that were written: it must be empty before, and shared by all executors")


def lloyd_metrics(result) -> dict:
    """The metrics document of a k-means result."""
    return {"schema_version": 1, "phase": "lloyd", "language": "spark", "algorithm_iterations": result.iterations, "inertia": result.inertia, "cluster_counts": result.counts.tolist(), "cluster_inertia": result.cluster_inertia.tolist(), "centroids": result.centers.tolist()}


def gmm_metrics(result) -> dict:
    """The metrics document of a mixture; covariances have the rank of their type."""
    m = result.mixture
    return {"schema_version": 1, "phase": "gmm", "language": "spark", "covariance_type": m.covariance, "algorithm_iterations": result.iterations, "lower_bound": result.lower_bounds[-1] if result.lower_bounds else None, "lower_bounds": result.lower_bounds, "weights": m.weights.tolist(), "means": m.means.tolist(), "covariances": None if m.covariances is None else m.covariances.tolist()}


def hdbscan_metrics(stage: str, n: int, min_samples: int, summaries: dict[str, dict], **more) -> dict:
    """The metrics document of a density stage: fingerprints of its value vectors in place of the vectors."""
    return {"schema_version": 1, "phase": "hdbscan", "language": "spark", "stage": stage, "dtype": "float64", "n_samples": n, "min_samples": min_samples, **more, **summaries}


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document a row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """Exclusions, compile records or counters: a small table in one JSON lines file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def nested_summary(facts: DataFrame, levels: list[str], values: list[str]) -> DataFrame:
    """Flat facts as one JSON document a config: arrays of structs nest in the order of levels, the first of which is the row."""
    made = facts
    inner = F.struct(*values)
    for depth in range(len(levels) - 1, 0, -1):
        keys = levels[: depth + 1]
        made = made.groupBy(*keys).agg(F.array_sort(F.collect_list(inner)).alias("_inner"))
        inner = F.struct(F.col(levels[depth]), F.col("_inner").alias("entries"))
    made = made.groupBy(levels[0]).agg(F.array_sort(F.collect_list(inner)).alias("entries"))
    return made.select(levels[0], F.to_json(F.struct(levels[0], "entries")).alias("document"))

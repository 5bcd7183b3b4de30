"""Sample sources. Every reader gives rows (id BIGINT, x ARRAY<DOUBLE>) but where it says otherwise."""

from __future__ import annotations

import hashlib
import io
import math
import re
import shutil
import urllib.request
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import checked, doubles


def _uniform(seed: int, *keys) -> F.Column:
    """A number in (0, 1) from a hash, so that it depends on the row alone and on no partition."""
    return (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)


def blobs(spark: SparkSession, n: int, d: int, k: int, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """Points about k centers in a box of side 2 * 10 sqrt(10 / d) (k / 10)^(1 / d), with unit variance; made in the JVM, in parallel. Also has the center's number as k."""
    box = 10 * math.sqrt(10 / d) * (k / 10) ** (1 / d)
    centers = np.random.default_rng(seed).uniform(-box, box, (k, d))
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    label = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(k)).cast("int")
    normal = lambda i: F.sqrt(-2 * F.log(_uniform(seed + 2, F.col("id"), F.lit(i)))) * F.cos(2 * math.pi * _uniform(seed + 3, F.col("id"), F.lit(i)))
    table = F.array(*(F.array(*(F.lit(float(v)) for v in c)) for c in centers))
    made = rows.withColumn("k", label).withColumn("_c", F.element_at(table, F.col("k") + 1))
    return made.select("id", F.array(*(F.get("_c", F.lit(i)) + normal(i) for i in range(d))).alias("x"), "k")


def from_vectors(df: DataFrame, id_col: str, vector: str, dimensions: int | None = None) -> DataFrame:
    """A table with a vector column; bad vectors raise when they are read."""
    return checked(df.select(F.col(id_col).alias("id"), doubles(vector).alias("x")), "x", dimensions)


def from_columns(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """A table with one scalar column for each dimension, in the order given."""
    return checked(df.select(F.col(id_col).alias("id"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x")), "x", len(columns))


def raw_binary(spark: SparkSession, path: str, d: int, n: int | None = None, dtype: str = "float32", rows: int = 65_536) -> DataFrame:
    """Headerless row-major numbers: fixed-length records, read in parallel. A file whose size isn't a whole number of rows, or not n rows, raises.

    id is the number of the row in one file; for a folder it tells rows apart, but isn't their order.
    """
    size = np.dtype(dtype).itemsize * d
    length = spark.read.format("binaryFile").load(path).select(F.sum("length")).first()[0]
    if length is None or length % size or (n is not None and length != n * size):
        raise ValueError(f"{path} has {length} bytes, which isn't {n if n is not None else 'a whole number of'} rows of {size}")
    records = spark.sparkContext.binaryRecords(path, size).zipWithIndex()

    def unpack(part):
        for record, i in part:
            yield i, np.frombuffer(record, dtype).astype(float).tolist()

    return checked(spark.createDataFrame(records.mapPartitions(unpack), "id long, x array<double>"), "x", d)


def numpy_file(spark: SparkSession, path: str, d: int | None = None) -> DataFrame:
    """A .npy file, or an .npz file with exactly one array; pickled objects are refused. A file is read by one task."""

    def load(batches):
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                found = np.load(io.BytesIO(content), allow_pickle=False)
                if hasattr(found, "files"):
                    if len(found.files) != 1:
                        raise ValueError(f"{name} holds {len(found.files)} arrays")
                    found = found[found.files[0]]
                if found.ndim != 2 or not np.issubdtype(found.dtype, np.number):
                    raise ValueError(f"{name} isn't a numeric matrix")
                for a in range(0, len(found), 10_000):
                    part = found[a : a + 10_000].astype(float)
                    yield pa.RecordBatch.from_arrays([pa.array(range(a, a + len(part)), pa.int64()), pa.array(list(part), pa.list_(pa.float64()))], names=["id", "x"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return checked(files.mapInArrow(load, "id long, x array<double>"), "x", d)


def download_name(url: str, dataset: str) -> str:
    """Name of the cached copy: dataset, a hash of the address, and the address's own name made safe."""
    own = re.sub(r"[^A-Za-z0-9._-]+", "_", Path(urlparse(url).path).name).strip("._")
    digest = hashlib.sha256(url.encode()).hexdigest()[:12]
    return f"{dataset}_{digest}_{own}" if own else f"{dataset}_{digest}.download"


def download(url: str, folder: str, dataset: str) -> str:
    """Path of the cached copy, fetched if it isn't there. It appears under its name only when complete. The folder must be one that all nodes see."""
    target = Path(folder).expanduser() / download_name(url, dataset)
    target.parent.mkdir(parents=True, exist_ok=True)
    if not target.exists():
        partial = target.with_name(target.name + ".partial")
        try:
            with urllib.request.urlopen(url) as source, partial.open("wb") as out:
                shutil.copyfileobj(source, out)
            partial.replace(target)
        finally:
            partial.unlink(missing_ok=True)
    return str(target)


def _matrix(spark: SparkSession, rows) -> DataFrame:
    rows = np.asarray(rows, float)
    batch = pa.table({"id": pa.array(range(len(rows)), pa.int64()), "x": pa.array(list(rows), pa.list_(pa.float64()))})
    return checked(spark.createDataFrame(batch), "x")


def openml(spark: SparkSession, data_id: int | None = None, name: str | None = None, version: int | str | None = None) -> DataFrame:
    """A dataset of OpenML by id, else by name (and version). Needs scikit-learn and a network."""
    if data_id is None and not name:
        raise ValueError("an id or a name is needed")
    from sklearn.datasets import fetch_openml

    how = {"data_id": data_id} if data_id is not None else {"name": name} | ({"version": int(version) if str(version).isdigit() else version} if version is not None else {})
    return _matrix(spark, fetch_openml(as_frame=False, **how).data)


def uci(spark: SparkSession, dataset_id: int, columns: list[str] | None = None) -> DataFrame:
    """A dataset of the UCI repository by id, all features or the columns named. Needs ucimlrepo and a network."""
    from ucimlrepo import fetch_ucirepo

    features = fetch_ucirepo(id=dataset_id).data.features
    return _matrix(spark, features[columns] if columns else features)


def hugging_face(spark: SparkSession, repo: str, split: str, vector: str | None = None, columns: list[str] | None = None, config: str | None = None) -> DataFrame:
    """A dataset of the Hugging Face hub: one vector column, or scalar columns. Needs datasets and a network."""
    if not vector and not columns:
        raise ValueError("a vector column or scalar columns are needed")
    from datasets import load_dataset

    found = load_dataset(*([repo, config] if config else [repo]), split=split)
    return _matrix(spark, found[vector] if vector else np.stack([found[c] for c in columns], 1))


def non_synthetic(df: DataFrame, column: str = "dataset") -> DataFrame:
    """Rows of real datasets."""
    return df.filter(F.col(column) != "blobs")

"""Timing documents, names of result files, metrics and profiler counters as flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IDENTITY = ["dataset", "dimensions", "samples", "clusters", "phase_key", "stage_key", "variant_key", "language_key", "params_key"]

TIMING = "benchmarks array<struct<runs: array<struct<metadata: struct<timing_process_index: int, timing_process_json: string, timing_process_pyperf_run_index: int>, values: array<double>>>>>"
LLOYD = "schema_version int, phase string, language string, algorithm_iterations int, inertia double, cluster_counts array<bigint>, cluster_inertia array<double>, centroids array<array<double>>"
GMM = "schema_version int, phase string, language string, covariance_type string, algorithm_iterations int, lower_bound double, lower_bounds array<double>, weights array<double>, means array<array<double>>, covariances string"
_SUMMARY = "struct<value_count: bigint, finite_count: bigint, nan_count: bigint, pos_inf_count: bigint, neg_inf_count: bigint, sum: double, sum_abs: double, sum_squares: double, weighted_sum: double, min: double, max: double, fnv1a64_float64: string, probes: array<struct<index: bigint, value: double>>>"
HDBSCAN = f"schema_version int, phase string, language string, stage string, n_samples bigint, min_samples int, diagonal_max_abs double, symmetry_max_abs double, noise_count bigint, cluster_count bigint, summary {_SUMMARY}, core_distance_summary {_SUMMARY}, label_summary {_SUMMARY}, probability_summary {_SUMMARY}"
METRICS = {"lloyd": LLOYD, "gmm": GMM, "hdbscan": HDBSCAN}

# fixed values: the parts of a result file's name
_TOKEN = "[A-Za-z0-9][A-Za-z0-9_-]*"
_CONFIG = rf"(?:({_TOKEN})_)?(\d+)D_(\d+)N_(\d+)K"
TIMING_NAME = rf"^(soa|pp|lloyd|hdbscan)_({_TOKEN}?)_({_TOKEN}?)_(cpp|py)_{_CONFIG}\.json$"
GMM_TIMING_NAME = rf"^gmm_({_TOKEN}?)_({_TOKEN}?)_({_TOKEN})_(cpp|py)_{_CONFIG}\.json$"
METRICS_NAME = rf"^(lloyd|hdbscan)_({_TOKEN}?)_metrics_({_TOKEN}?)_(cpp|py)_{_CONFIG}\.json$"
GMM_METRICS_NAME = rf"^gmm_({_TOKEN}?)_metrics_({_TOKEN}?)_({_TOKEN})_(cpp|py)_{_CONFIG}\.json$"


def identity(name: Column, metrics: bool = False) -> Column:
    """struct of the IDENTITY columns from a file's name, null if it isn't one of a result. Metrics files aren't timing files."""
    common, gmm = (METRICS_NAME, GMM_METRICS_NAME) if metrics else (TIMING_NAME, GMM_TIMING_NAME)
    number = lambda p, g: F.regexp_extract(name, p, g).cast("int")

    def made(p, phase, stage, variant, language, params, config):
        dataset = F.regexp_extract(name, p, config)
        return F.struct(
            F.when(dataset == "", "blobs").otherwise(dataset).alias("dataset"),
            *(number(p, config + 1 + i).alias(c) for i, c in enumerate(("dimensions", "samples", "clusters"))),
            phase.alias("phase_key"),
            F.regexp_extract(name, p, stage).alias("stage_key"),
            F.regexp_extract(name, p, variant).alias("variant_key"),
            F.regexp_extract(name, p, language).alias("language_key"),
            params.alias("params_key"),
        )

    plain = made(common, F.regexp_extract(name, common, 1), 2, 3, 4, F.lit("default"), 5)
    mixture = made(gmm, F.lit("gmm"), 1, 2, 4, F.regexp_extract(name, gmm, 3), 5)
    other = F.rlike(name, F.lit(METRICS_NAME)) | F.rlike(name, F.lit(GMM_METRICS_NAME)) if not metrics else F.lit(False)
    return F.when(other, None).when(F.rlike(name, F.lit(common)), plain).when(F.rlike(name, F.lit(gmm)), mixture)


def timing_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each timing value: IDENTITY, source_json, benchmark, run, process and value indices, time_s. Files with other names are skipped. Runs without a process index are a process each."""
    raw = spark.read.schema(TIMING).option("multiLine", True).json(path).select(F.col("_metadata.file_name").alias("source_json"), "benchmarks")
    named = raw.withColumn("id", identity(F.col("source_json"))).filter("id IS NOT NULL")
    runs = named.select("id", "source_json", F.posexplode("benchmarks").alias("benchmark_index", "b")).select("id", "source_json", "benchmark_index", F.posexplode("b.runs").alias("run_index", "r"))
    values = runs.select("id", "source_json", "benchmark_index", "run_index", F.coalesce("r.metadata.timing_process_index", "run_index").alias("timing_process_index"), F.posexplode("r.values").alias("timing_value_index", "time_s"))
    return values.select("id.*", "source_json", "benchmark_index", "run_index", "timing_process_index", "timing_value_index", "time_s")


def merged_timings(parts: list[DataFrame]) -> DataFrame:
    """Timing records of several processes as one table, with the number of each part as its process."""
    made = None
    for i, part in enumerate(parts):
        part = part.withColumn("timing_process_index", F.lit(i))
        made = part if made is None else made.unionByName(part)
    if made is None:
        raise ValueError("no parts to merge")
    return made


def metrics_records(spark: SparkSession, path: str, phase: str) -> DataFrame:
    """Metrics documents of a phase with their IDENTITY. A wrong version, phase, language, stage or type raises."""
    raw = spark.read.schema(METRICS[phase]).option("multiLine", True).json(path).withColumn("id", identity(F.col("_metadata.file_name"), metrics=True)).filter(F.col("id").isNotNull() & (F.col("id.phase_key") == phase))
    good = (F.col("schema_version") == 1) & (F.col("phase") == phase) & (F.col("language") == F.col("id.language_key"))
    if phase == "gmm":
        good &= F.col("covariance_type") == F.col("id.params_key")
    if phase == "hdbscan":
        good &= F.col("stage") == F.col("id.stage_key")
    else:
        good &= F.col("algorithm_iterations").isNotNull()
    checked = F.when(good, F.col("schema_version")).otherwise(F.raise_error(F.lit(f"a {phase} metrics document doesn't fit its name")))
    return raw.withColumn("schema_version", checked).select("id.*", *(c for c in raw.columns if c != "id"))


#: Events of a profiler's output that must be there.
EVENTS = ("Ir", "I1mr", "ILmr", "Dr", "D1mr", "DLmr", "Dw", "D1mw", "DLmw")


def profile_counters(spark: SparkSession, path: str) -> DataFrame:
    """source and one column for each of EVENTS: the names of the events line with the numbers of the totals line, or else of the summary line. A file that lacks one raises."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), "value")
    words = lambda name: F.array_remove(F.split(F.regexp_extract("value", rf"(?m)^\s*{name}:[ \t]*(.*?)\s*$", 1), r"\s+"), "")
    totals = F.when(F.size(words("totals")) > 0, words("totals")).otherwise(words("summary"))
    named = lines.select("source", words("events").alias("e"), totals.alias("t"))
    same = F.when((F.size("e") == F.size("t")) & (F.size("e") > 0), F.map_from_arrays("e", F.transform("t", lambda x: x.cast("long")))).otherwise(F.raise_error(F.lit("events and totals don't fit")))
    found = named.select("source", same.alias("m"))
    there = lambda e: F.coalesce(F.try_element_at("m", F.lit(e)), F.raise_error(F.lit(f"no event {e}")).cast("long")).alias(e)
    return found.select("source", *(there(e) for e in EVENTS))

"""Joins of result tables. Sizes decide how they run: nothing is broadcast by hint without a check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import null_safe_key, ratio_or_infinity, ratio_or_nan


def on_equal(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of the keys, null with null."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def normalised(df: DataFrame, keys: list[str], defaults: dict[str, str] | None = None) -> DataFrame:
    """Keys as text in which null is '' (or a default of the column), so that it matches."""
    return df.withColumns({k: null_safe_key(F.col(k), (defaults or {}).get(k, "")) for k in keys})


def distinct_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct()


def assert_unique(df: DataFrame, keys: list[str], message: str) -> DataFrame:
    """df, which raises when it is read if two rows share a key. Needs the rows of a key in one place: for dimension tables."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*df.columns)).alias("_row"))
    return counted.select(F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(F.lit(message))).alias("_row")).select("_row.*")


def point_sets(left: DataFrame, right: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Keys in both, only in left, only in right."""
    a, b = distinct_keys(left, keys), distinct_keys(right, keys)
    on = on_equal(a, b, keys)
    return {"common": a.join(b, on, "left_semi"), "left_only": a.join(b, on, "left_anti"), "right_only": b.join(a, on_equal(b, a, keys), "left_anti")}


def compared(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], how: str = "inner", suffixes: tuple[str, str] = ("_baseline", "_candidate")) -> DataFrame:
    """keys, and each value of both sides."""
    a = left.select(*keys, *(F.col(v).alias(f"{v}{suffixes[0]}") for v in values))
    b = right.select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col(v).alias(f"{v}{suffixes[1]}") for v in values))
    joined = a.join(b, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), how)
    side = [F.coalesce(k, f"_{k}").alias(k) if how in ("outer", "full", "right") else F.col(k) for k in keys]
    return joined.select(*side, *(f"{v}{s}" for v in values for s in suffixes))


def speedup_comparison(left: DataFrame, right: DataFrame, keys: list[str], value: str = "speedup") -> DataFrame:
    """Matched points with ratio (candidate to baseline; not a number over 0) and delta_pct."""
    made = compared(left, right, keys, [value])
    ratio = ratio_or_nan(F.col(f"{value}_candidate"), F.col(f"{value}_baseline"))
    return made.withColumn("ratio", ratio).withColumn("delta_pct", 100 * (F.col("ratio") - 1))


def outer_delta(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Points of either side with the difference candidate - baseline; a side that isn't there counts as 0."""
    made = compared(left, right, keys, [value], "outer")
    return made.withColumn("delta", F.coalesce(f"{value}_candidate", F.lit(0)) - F.coalesce(f"{value}_baseline", F.lit(0)))


def retention(df: DataFrame, base: Column, groups: list[str], value: str = "speedup") -> DataFrame:
    """Each value in percent of its group's base row. Two base rows in a group, or none, raise."""
    bases = assert_unique(df.filter(base).select(*groups, F.col(value).alias("base_value")), groups, "a group has two base rows")
    right = bases.select(*(F.col(g).alias(f"_{g}") for g in groups), "base_value")
    joined = df.join(right, reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups)), "left").drop(*(f"_{g}" for g in groups))
    found = F.when(F.col("base_value").isNull(), F.raise_error(F.lit("a group has no base row")).cast("double")).otherwise(F.col("base_value"))
    return joined.withColumn("base_value", found).withColumn("retention_pct", F.try_divide(F.col(value), F.col("base_value")) * 100)


def with_required(df: DataFrame, other: DataFrame, keys: list[str], column: str) -> DataFrame:
    """df with a column of other, which must have a row for each key; a missing one raises."""
    right = other.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(column), F.lit(True).alias("_there"))
    joined = df.join(right, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), "left")
    kind = other.schema[column].dataType
    value = F.when(F.col("_there"), F.col(column)).otherwise(F.raise_error(F.lit(f"no {column} for a key")).cast(kind))
    return joined.withColumn(column, value).drop("_there", *(f"_{k}" for k in keys))


def with_iterations(timings: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Timing records with algorithm_iterations of their metrics, and time by iteration."""
    return with_required(timings, metrics, keys, "algorithm_iterations").withColumn("time_per_iteration_s", F.col("time_s") / F.col("algorithm_iterations"))


def against_references(df: DataFrame, keys: list[str], candidate: Column, reference: Column, values: list[str], reference_key: str = "reference_key") -> DataFrame:
    """Each candidate with every reference of its key."""
    refs = df.filter(reference).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(reference_key), *(F.col(v).alias(f"{v}_reference") for v in values))
    mine = df.filter(candidate).drop(reference_key)
    return mine.join(refs, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))).drop(*(f"_{k}" for k in keys))


def fixed_cost_equivalents(fixed: DataFrame, algorithm: DataFrame, keys: list[str], fixed_time: str, iteration_time: str) -> DataFrame:
    """Each fixed cost, its duplicates collapsed to their median, against every row of the algorithm with its keys: how many iterations it is worth."""
    once = fixed.groupBy(*keys, "phase_key").agg(F.median(fixed_time).alias(fixed_time)).withColumnRenamed("phase_key", "fixed_phase")
    return algorithm.join(once, keys).withColumn("equivalent_iterations", F.try_divide(fixed_time, iteration_time))


def numeric_comparison(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Matched rows with the difference <column>_delta of every numeric column that both have."""
    numeric = ("int", "bigint", "float", "double", "smallint", "tinyint")
    shared = [c for c, k in left.dtypes if k in numeric and c not in keys and dict(right.dtypes).get(c) in numeric]
    made = compared(left, right, keys, shared)
    return made.withColumns({f"{c}_delta": F.col(f"{c}_candidate") - F.col(f"{c}_baseline") for c in shared})


def counter_comparison(left: DataFrame, right: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Matched points with <counter>_ratio (0 over 0 is 0, more over 0 infinite) and <counter>_delta_pct."""
    made = compared(left, right, keys, counters)
    made = made.withColumns({f"{c}_ratio": ratio_or_infinity(F.col(f"{c}_candidate"), F.col(f"{c}_baseline")) for c in counters})
    return made.withColumns({f"{c}_delta_pct": 100 * (F.col(f"{c}_ratio") - 1) for c in counters})


def attached(configs: DataFrame, facts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Configs with the array of their facts; a config is made for facts that have none."""
    grouped = facts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*(c for c in facts.columns if c not in keys)))).alias(name))
    right = grouped.select(*(F.col(k).alias(f"_{k}") for k in keys), name)
    joined = configs.join(right, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), "outer")
    return joined.select(*(F.coalesce(k, f"_{k}").alias(k) for k in keys), *(c for c in configs.columns if c not in keys), name)

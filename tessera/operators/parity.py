"""Checks of one result against another within tolerances, and of repeats against each other."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import either_pressure, pressure, relative_difference_pct, worst_check

#: Tolerances of the three comparisons and of repeats.
LLOYD = {"inertia_diff_pct": 1e-6, "iteration_diff": 0}
GMM = {"lower_bound_diff": 1e-4, "weights_max_abs": 1e-4, "means_max_abs": 1e-3, "covariances_max_rel": 1e-2, "iteration_diff": 0}
HDBSCAN = {"scalar_abs": 1e-3, "scalar_rel": 1e-5, "probe_max_abs": 1e-4}
REPEAT = {"rel": 1e-10, "abs": 1e-8}
REPEAT_SUMS = {"rel": 1e-7, "abs": 1e-6}
SCALARS = ("sum", "sum_abs", "sum_squares", "weighted_sum", "min", "max")
COUNTS = ("value_count", "finite_count", "nan_count", "pos_inf_count", "neg_inf_count")


def within(value: Column, tolerance: float) -> Column:
    """Whether a difference is there, finite and at most the tolerance."""
    return F.coalesce(value.isNotNull() & ~F.isnan(value) & (value <= tolerance), F.lit(False))


def judged(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Adds status (PASS or FAIL) and failures (the names of the failed checks, in order)."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items())))
    return df.withColumn("failures", failed).withColumn("status", F.when(F.size("failures") == 0, "PASS").otherwise("FAIL"))


def lloyd(df: DataFrame) -> DataFrame:
    """Rows with inertia and iterations of both sides (_candidate, _reference): inertia_diff_pct, iteration_diff, failures, status, pressure, worst."""
    df = df.withColumns({"inertia_diff_pct": relative_difference_pct(F.col("inertia_candidate"), F.col("inertia_reference")), "iteration_diff": F.abs(F.col("iterations_candidate") - F.col("iterations_reference"))})
    df = judged(df, {name: within(F.col(name).cast("double"), limit) for name, limit in LLOYD.items()})
    worst = worst_check({"inertia": pressure(F.col("inertia_diff_pct"), F.lit(LLOYD["inertia_diff_pct"])), "iterations": F.col("iteration_diff")})
    return df.withColumn("_w", worst).withColumns({"pressure": F.col("_w.pressure"), "worst": F.col("_w.check")}).drop("_w")


def array_max_abs(a: Column, b: Column) -> Column:
    """The greatest difference of two arrays; null if their lengths differ or one is null, 0 if both are empty."""
    away = F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    return F.when(F.size(a) == F.size(b), F.coalesce(away, F.lit(0.0)))


def array_max_rel(a: Column, b: Column) -> Column:
    """The same by the magnitude of b, which is the smallest step of a double at least."""
    away = F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y) / F.greatest(F.abs(y), F.lit(float(np.finfo(float).eps)))))
    return F.when(F.size(a) == F.size(b), F.coalesce(away, F.lit(0.0)))


def gmm(df: DataFrame) -> DataFrame:
    """Rows with lower_bound, weights, means and covariances (arrays, flat), iterations of both sides."""
    side = lambda c: (F.col(f"{c}_candidate"), F.col(f"{c}_reference"))
    a, b = side("lower_bound")
    differences = {"lower_bound_diff": F.abs(a - b), "weights_max_abs": array_max_abs(*side("weights")), "means_max_abs": array_max_abs(*side("means")), "covariances_max_rel": array_max_rel(*side("covariances"))}
    df = df.withColumns({**differences, "iteration_diff": F.abs(F.col("iterations_candidate") - F.col("iterations_reference")).cast("double")})
    df = judged(df, {name: within(F.col(name), limit) for name, limit in GMM.items()})
    short = dict(zip(differences, ("lower_bound", "weights", "means", "covariances")))
    worst = worst_check({**{short[name]: pressure(F.col(name), F.lit(GMM[name])) for name in differences}, "iterations": F.col("iteration_diff")})
    return df.withColumn("_w", worst).withColumns({"pressure": F.col("_w.pressure"), "worst": F.col("_w.check")}).drop("_w")


def summary_checks(candidate: Column, reference: Column) -> dict[str, Column]:
    """Checks of two fingerprints (structs): equal counts; scalars within the absolute or the relative tolerance; probes at the same places, close enough."""
    absolute = F.array_max(F.array(*(F.abs(candidate[s] - reference[s]) for s in SCALARS)))
    relative = F.array_max(F.array(*(F.abs(candidate[s] - reference[s]) / F.greatest(F.abs(candidate[s]), F.abs(reference[s]), F.lit(1.0)) for s in SCALARS)))
    counts = F.lit(True)
    for c in COUNTS:
        counts &= candidate[c].eqNullSafe(reference[c])
    places = F.transform(candidate["probes"], lambda p: p["index"]).eqNullSafe(F.transform(reference["probes"], lambda p: p["index"]))
    away = F.when(places, array_max_abs(F.transform(candidate["probes"], lambda p: p["value"]), F.transform(reference["probes"], lambda p: p["value"])))
    return {"counts": counts, "scalars": within(absolute, HDBSCAN["scalar_abs"]) | within(relative, HDBSCAN["scalar_rel"]), "probes": within(away, HDBSCAN["probe_max_abs"])}


def summary_pressures(candidate: Column, reference: Column) -> dict[str, Column]:
    """How much of their tolerances two fingerprints use: scalars (which pass on either tolerance) and probes."""
    absolute = F.array_max(F.array(*(F.abs(candidate[s] - reference[s]) for s in SCALARS)))
    relative = F.array_max(F.array(*(F.abs(candidate[s] - reference[s]) / F.greatest(F.abs(candidate[s]), F.abs(reference[s]), F.lit(1.0)) for s in SCALARS)))
    away = array_max_abs(F.transform(candidate["probes"], lambda p: p["value"]), F.transform(reference["probes"], lambda p: p["value"]))
    return {"scalars": either_pressure(pressure(absolute, F.lit(HDBSCAN["scalar_abs"])), pressure(relative, F.lit(HDBSCAN["scalar_rel"]))), "probes": pressure(away, F.lit(HDBSCAN["probe_max_abs"]))}


def hdbscan(df: DataFrame) -> DataFrame:
    """Rows of one comparison (stage; metrics documents as structs candidate and reference): failures, status, and for the stage full pressure and worst. Which fingerprints count depends on the stage."""
    c, r = F.col("candidate"), F.col("reference")
    checks = summary_checks(c["summary"], r["summary"])
    distance, labelled = F.col("stage") == "distance", F.col("stage").isin("select", "full")
    checks |= {f"core_distance_{n}": ~distance | x for n, x in summary_checks(c["core_distance_summary"], r["core_distance_summary"]).items()}
    checks |= {n: ~labelled | (c[n].isNotNull() & (c[n] == r[n])) for n in ("noise_count", "cluster_count")}
    for part in ("label", "probability"):
        checks |= {f"{part}_{n}": ~labelled | x for n, x in summary_checks(c[f"{part}_summary"], r[f"{part}_summary"]).items()}
    used = {f"{prefix}{n}": x for prefix in ("", "label_", "probability_") for n, x in summary_pressures(c[f"{prefix}summary"], r[f"{prefix}summary"]).items()}
    used |= {n: F.when(c[n] == r[n], 0.0).when(c[n] != r[n], 1.0) for n in ("noise_count", "cluster_count")}
    worst = F.when(F.col("stage") == "full", worst_check(used))
    return judged(df, checks).withColumn("_w", worst).withColumns({"pressure": F.col("_w.pressure"), "worst": F.col("_w.check")}).drop("_w")


def close(a: float, b: float, tolerance: dict[str, float]) -> bool:
    return math.isclose(a, b, rel_tol=tolerance["rel"], abs_tol=tolerance["abs"]) or (math.isnan(a) and math.isnan(b))


def repeat_differences(first: dict, other: dict, path: str = "") -> list[str]:
    """Where a repeat's metrics document differs from the first: numbers within the tolerances of repeats (sums of fingerprints within their own), all else, hashes included, equal."""
    if isinstance(first, dict) and isinstance(other, dict):
        found = [f"{path}/{k}: only one has it" for k in sorted(first.keys() ^ other.keys())]
        return found + [d for k in sorted(first.keys() & other.keys()) for d in repeat_differences(first[k], other[k], f"{path}/{k}")]
    if isinstance(first, list) and isinstance(other, list):
        if len(first) != len(other):
            return [f"{path}: lengths {len(first)} and {len(other)}"]
        return [d for i, (a, b) in enumerate(zip(first, other)) for d in repeat_differences(a, b, f"{path}[{i}]")]
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if number(first) and number(other) and (isinstance(first, float) or isinstance(other, float)):
        tolerance = REPEAT_SUMS if path.rsplit("/", 1)[-1] in SCALARS else REPEAT
        return [] if close(float(first), float(other), tolerance) else [f"{path}: {first} and {other}"]
    return [] if first == other else [f"{path}: {first} and {other}"]

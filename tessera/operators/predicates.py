"""Filters and derived columns of benchmark tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import PRIMARY_REFERENCE, rate

AXES = ("dimensions", "samples", "clusters")


def where(df: DataFrame, **values) -> DataFrame:
    """Rows whose columns equal a value, or are in a list of values; None doesn't filter, a column that isn't there raises."""
    for column, value in values.items():
        if value is None:
            continue
        if column not in df.columns:
            raise KeyError(f"no column {column!r}")
        df = df.filter(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set, frozenset)) else F.col(column) == value)
    return df


def primary_references(df: DataFrame, phase: str = "phase_key", reference: str = "reference_key", overrides: dict[str, str] | None = None) -> DataFrame:
    """Rows without a reference, and those with their phase's primary one ('reference' for phases that name none)."""
    known = PRIMARY_REFERENCE | (overrides or {})
    primary = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), F.col(phase)), F.lit("reference"))
    return df.filter((F.coalesce(reference, F.lit("")) == "") | (F.col(reference) == primary))


def rule_matches(rules: dict[str, str], cases: dict[str, str]) -> Column:
    """The condition of a join of cases with rules. rules and cases name columns: of a rule, selector arrays by column of a case (null selects all) and bounds min_<axis>, max_<axis> (null doesn't bind)."""
    tests = []
    for key, column in cases.items():
        if key in rules:
            tests.append(F.col(rules[key]).isNull() | F.array_contains(rules[key], F.col(column)))
        if f"min_{key}" in rules:
            tests.append(F.col(rules[f"min_{key}"]).isNull() | (F.col(column) >= F.col(rules[f"min_{key}"])))
        if f"max_{key}" in rules:
            tests.append(F.col(rules[f"max_{key}"]).isNull() | (F.col(column) <= F.col(rules[f"max_{key}"])))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def excluded(cases: DataFrame, rules: DataFrame, columns: tuple[str, ...] = ("phase_key", "stage_key", "dataset", *AXES), broadcast: int = 10_000) -> DataFrame:
    """Every case that rules match, with reason (the distinct reasons in rule order, joined by ' ; ') and matched_rules (array of rule_index, reason).

    rules: rule_index, reason, and any of a selector array for each of columns and min_ / max_ of the axes; a blank reason raises.
    Profiler rules have selectors for more columns. Rules are broadcast if there are at most broadcast of them. Cases that are
    equal in columns are one case.
    """
    checked = rules.withColumn("reason", F.when(F.trim(F.coalesce("reason", F.lit(""))) == "", F.raise_error(F.lit("a rule needs a reason")).cast("string")).otherwise(F.col("reason")))
    named = {k: f"_r_{k}" for k in rules.columns if k not in ("rule_index", "reason")}
    checked = checked.select("rule_index", "reason", *(F.col(k).alias(v) for k, v in named.items()))
    small = rules.count() <= broadcast
    joined = cases.join(F.broadcast(checked) if small else checked, rule_matches(named, {c: c for c in columns}))
    matched = joined.groupBy(*columns).agg(F.array_sort(F.collect_set(F.struct("rule_index", "reason"))).alias("matched_rules"))
    reasons = F.array_join(F.array_distinct(F.transform("matched_rules", lambda r: r["reason"])), " ; ")
    return matched.withColumn("reason", reasons)


def without_excluded(cases: DataFrame, rules: DataFrame, columns: tuple[str, ...] = ("phase_key", "stage_key", "dataset", *AXES)) -> DataFrame:
    """Cases that no rule matches."""
    return cases.join(excluded(cases, rules, columns).select(*columns), list(columns), "left_anti")


def positive(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which all of the columns are above 0."""
    return df.filter(reduce(lambda a, b: a & b, (F.col(c) > 0 for c in columns)))


def changed(df: DataFrame, before: str, after: str) -> DataFrame:
    """Rows whose text differs between two columns; nulls are text of their own."""
    return df.filter(~F.coalesce(F.col(before).cast("string"), F.lit("None")).eqNullSafe(F.coalesce(F.col(after).cast("string"), F.lit("None"))))


#: Names of measures that a comparison leaves out.
LEFT_OUT = ("Threshold", "Py", r"C\+\+")


def relevant(df: DataFrame, name: str = "metric") -> DataFrame:
    return df.filter(~F.rlike(F.coalesce(name, F.lit("")), F.lit("|".join(LEFT_OUT))))


def complete(df: DataFrame, keys: list[str], column: str, required: list) -> DataFrame:
    """Rows whose key has every required value in column."""
    there = df.filter(F.col(column).isin(required)).groupBy(*keys).agg(F.count_distinct(column).alias("_n")).filter(F.col("_n") == len(set(required)))
    conditions = reduce(lambda a, b: a & b, (df[k].eqNullSafe(there[k]) for k in keys))
    return df.join(there, conditions, "left_semi")


SPREADS = {"iqr": ("p25", "p75"), "p25_p75": ("p25", "p75"), "p05_p95": ("p05", "p95"), "stddev": ("stddev",), "mad": ("mad",)}


def per_sample_times(df: DataFrame, prefix: str = "time_per_iteration_s", samples: str = "samples", center: str = "median", spread: str = "iqr", scale: float = 1000.0) -> DataFrame:
    """Adds per_sample, low (0 at least), high, lower_error, upper_error: a statistic of time by samples, with the spread of its runs."""
    if spread not in SPREADS:
        raise ValueError(f"spread is one of {sorted(SPREADS)}")
    of = lambda name: F.col(f"{prefix}_{name}") / F.col(samples) * scale
    ends = SPREADS[spread]
    df = df.withColumn("per_sample", of(center))
    low, high = (of(ends[0]), of(ends[1])) if len(ends) == 2 else (F.col("per_sample") - of(ends[0]), F.col("per_sample") + of(ends[0]))
    df = df.withColumns({"low": F.greatest(low, F.lit(0.0)), "high": high})
    return df.withColumns({"lower_error": F.col("per_sample") - F.col("low"), "upper_error": F.col("high") - F.col("per_sample")})


def interval_widths(df: DataFrame, point: str = "speedup", low: str = "ci_low", high: str = "ci_high") -> DataFrame:
    return df.withColumns({"lower_error": F.col(point) - F.col(low), "upper_error": F.col(high) - F.col(point), "width": F.col(high) - F.col(low)})


def milliseconds(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_ms": F.col(c) * 1000 for c in columns})


def cache_rates(df: DataFrame) -> DataFrame:
    """Sums and miss rates of profiler counters (sources.records.EVENTS); a rate over 0 is null."""
    sums = {"data_refs": F.col("Dr") + F.col("Dw"), "d1_misses": F.col("D1mr") + F.col("D1mw"), "ll_misses": F.col("DLmr") + F.col("DLmw")}
    df = df.withColumns(sums)
    of = lambda a, b: rate(F.col(a), F.col(b))
    return df.withColumns({"i1_miss_rate": of("I1mr", "Ir"), "il_miss_rate": of("ILmr", "Ir"), "d1_miss_rate": of("d1_misses", "data_refs"), "ll_miss_rate": of("ll_misses", "data_refs"), "d1_read_miss_rate": of("D1mr", "Dr"), "d1_write_miss_rate": of("D1mw", "Dw"), "ll_read_miss_rate": of("DLmr", "Dr"), "ll_write_miss_rate": of("DLmw", "Dw")})


def lower_observed_median(df: DataFrame, column: str) -> float | None:
    """The lower middle of the distinct finite values: always a value that is there."""
    finite = df.select(F.col(column).cast("double").alias("v")).filter(~F.isnan("v") & (F.abs("v") < float("inf"))).distinct()
    return finite.agg(F.percentile_disc("v", F.lit(0.5))).first()[0] if hasattr(F, "percentile_disc") else finite.selectExpr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v) AS m").first()[0]


def sweep(df: DataFrame, axis: str, value: str, groups: list[str], axes: tuple[str, ...] = AXES) -> DataFrame:
    """The median of value along one axis in each group, with the other axes at their lower observed medians."""
    for other in axes:
        if other != axis:
            at = lower_observed_median(df, other)
            if at is None:
                return df.limit(0).groupBy(*groups, axis).agg(F.median(value).alias(value))
            df = df.filter(F.col(other) == at)
    return df.groupBy(*groups, axis).agg(F.median(value).alias(value))


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")

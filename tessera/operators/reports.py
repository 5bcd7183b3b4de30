"""From the records of two runs to the comparison of their results: one summary a run, one report for two summaries.

Everything is a table until a caller asks for lines of text or documents. Tables of results are small beside the timing values,
which are aggregated before anything is joined to them, and only the keys of pairs are repeated.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import config_id
from tessera.operators import aggregates, joins, parity, predicates, sets
from tessera.plans import cut_lineage

CONFIG = ["dataset", "dimensions", "samples", "clusters"]
POINT = [*CONFIG, "phase_key", "stage_key", "params_key"]
VARIANT = [*POINT, "variant_key"]
MEASURED = [*VARIANT, "language_key"]
COMPARISON = [*VARIANT, "reference_key"]
#: Order of the keys in which gaps are reported; the grid starts at the configuration.
BRANCHES = ["phase_key", "stage_key", "variant_key", "params_key", "reference_key", *CONFIG]
COUNTER_BRANCHES = [k for k in BRANCHES if k != "reference_key"]
SPILL_BRANCHES = ["phase_key", "stage_key", "variant_key", "params_key", "cpp_case", "dimensions"]

#: The key of each side table when two runs are put together.
SIDE_KEYS = {
    "compile": ["dimensions", "phase_key", "stage_key", "variant_key", "cpp_case"],
    "counters": [*CONFIG, "stage_key", "cpp_case", "params_key"],
    "spills": ["cpp_case", "dimensions", "covariance_type"],
}
#: Phases whose algorithm has iterations; all others count as one.
ITERATIVE = ("lloyd", "gmm")
CANDIDATE, REFERENCE = "cpp", "py"


@dataclass(frozen=True)
class Summary:
    """A run's results. measured: MEASURED with statistics of its times; speedups: COMPARISON with a ratio and its interval; parity: COMPARISON with status, failures, pressure and worst. side: tables by the names of SIDE_KEYS; exclusions: what was left out on purpose."""

    measured: DataFrame
    speedups: DataFrame
    parity: DataFrame
    exclusions: DataFrame | None = None
    side: dict[str, DataFrame] = field(default_factory=dict)


def _beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys, null with null; the other columns of right must have names of their own."""
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(renamed, on, how).drop(*(f"_{k}" for k in keys))


def with_algorithm_iterations(timings: DataFrame, metrics: dict[str, DataFrame]) -> DataFrame:
    """Timing records with algorithm_iterations: those of their metrics in ITERATIVE phases, where a missing document raises; 1 in others."""
    given = [metrics[p].select(*MEASURED, F.col("algorithm_iterations").alias("_given")) for p in ITERATIVE if p in metrics]
    joined = _beside(timings, sets.concat(given), MEASURED, "left") if given else timings.withColumn("_given", F.lit(None).cast("int"))
    missing = F.raise_error(F.concat(F.lit("no metrics of "), "phase_key")).cast("int")
    count = F.when(F.col("phase_key").isin(*ITERATIVE), F.coalesce("_given", missing)).otherwise(1)
    return joined.withColumn("algorithm_iterations", count).drop("_given")


def measured(timings: DataFrame) -> DataFrame:
    """MEASURED, algorithm_iterations (two counts in a group raise), processes, values_per_process (array of process and n), the statistics of time_s, and those of the time by iteration (per_iteration_*), which are the same over a constant."""
    stats = aggregates.summary_stats(timings, MEASURED, "time_s")
    counts = aggregates.values_per_process(timings, MEASURED).withColumn("values_per_process", F.map_entries("counts")).drop("counts")
    once = timings.groupBy(*MEASURED).agg(aggregates.single_value("algorithm_iterations", "two counts of iterations for one benchmark").alias("algorithm_iterations"))
    made = _beside(_beside(stats, counts, MEASURED), once, MEASURED).withColumn("processes", F.size("values_per_process"))
    times = [c for c in stats.columns if c not in (*MEASURED, "n")]
    return made.withColumns({f"per_iteration_{c}": F.col(c) / F.col("algorithm_iterations") for c in times})


def pairs(keys: DataFrame) -> DataFrame:
    """COMPARISON: each candidate with every reference of its point. keys: MEASURED."""
    keys = keys.select(*MEASURED).distinct()
    theirs = keys.filter(F.col("language_key") == REFERENCE).select(*POINT, F.col("variant_key").alias("reference_key"))
    return _beside(keys.filter(F.col("language_key") == CANDIDATE).select(*VARIANT), theirs, POINT).select(*COMPARISON)


def speedups(timings: DataFrame, known: DataFrame, statistic: str = "median", iterations: int = aggregates.ITERATIONS, level: float = aggregates.LEVEL, seed: int = aggregates.SEED) -> DataFrame:
    """COMPARISON, speedup (time of the reference to that of the candidate), ci_low, ci_high, valid, the points of both sides, and the same by iteration (per_iteration_*). known: measured of the same timings."""
    found = pairs(known)
    gathered = aggregates.gathered_values(timings, MEASURED, "timing_process_index", "time_s")
    side = lambda language, name: gathered.filter(F.col("language_key") == language).drop("language_key").withColumnRenamed("_values", name)
    both = _beside(found, side(CANDIDATE, "_mine"), VARIANT)
    both = _beside(both, side(REFERENCE, "_theirs").withColumnRenamed("variant_key", "reference_key"), [*POINT, "reference_key"])
    made = aggregates.bootstrap_gathered(both, COMPARISON, statistic, iterations, level, seed)
    of = lambda language, keys, name: known.filter(F.col("language_key") == language).select(*keys, F.col("algorithm_iterations").alias(name))
    candidate = of(CANDIDATE, VARIANT, "candidate_iterations")
    reference = of(REFERENCE, [*POINT, F.col("variant_key").alias("reference_key")], "reference_iterations")
    total = _beside(_beside(made, candidate, VARIANT), reference, [*POINT, "reference_key"])
    numbers = ("point", "ci_low", "ci_high", "candidate_point", "reference_point")
    total = total.withColumns({f"_{c}": F.col(c) for c in numbers})
    scaled = aggregates.per_iteration(total, "candidate_iterations", "reference_iterations").withColumnsRenamed({c: f"per_iteration_{c}" for c in numbers})
    made = scaled.withColumnsRenamed({f"_{c}": c for c in numbers})
    return made.withColumnsRenamed({"point": "speedup", "per_iteration_point": "per_iteration_speedup"})


def _flat_numbers(text: Column) -> Column:
    """The numbers of a nested JSON array, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(-?(?:\d[\d.]*(?:[eE][-+]?\d+)?|Infinity)|NaN)"), F.lit(1)), lambda x: x.cast("double"))


_VALUES = {
    "lloyd": {"inertia": F.col, "iterations": lambda _: F.col("algorithm_iterations")},
    "gmm": {"lower_bound": F.col, "weights": F.col, "means": lambda c: F.flatten(c), "covariances": lambda c: _flat_numbers(F.col(c)), "iterations": lambda _: F.col("algorithm_iterations")},
}
_CHECKS = {"lloyd": parity.lloyd, "gmm": parity.gmm, "hdbscan": parity.hdbscan}


def parities(metrics: dict[str, DataFrame], keys: DataFrame) -> DataFrame:
    """COMPARISON, status, failures, pressure, worst (and the phase's differences) of each pair that has metrics on both sides. keys: MEASURED of what was timed."""
    found, made = pairs(keys), []
    for phase, df in metrics.items():
        if phase in _VALUES:
            values = {name: of(name) for name, of in _VALUES[phase].items()}
        else:
            values = {"document": F.struct(*(c for c in df.columns if c not in MEASURED))}
        side = lambda language, suffix, more: df.filter(F.col("language_key") == language).select(*more, *(c.alias(f"{n}_{suffix}") for n, c in values.items()))  # noqa: B023, E731
        mine = side(CANDIDATE, "candidate", VARIANT)
        theirs = side(REFERENCE, "reference", [*POINT, F.col("variant_key").alias("reference_key")])
        both = _beside(_beside(found.filter(F.col("phase_key") == phase), mine, VARIANT), theirs, [*POINT, "reference_key"])
        if phase not in _VALUES:
            both = both.withColumnsRenamed({"document_candidate": "candidate", "document_reference": "reference"}).withColumn("stage", F.col("stage_key"))
        judged = _CHECKS[phase](both)
        differences = [c for c in judged.columns if c.endswith(("_diff", "_diff_pct", "_max_abs", "_max_rel"))]
        made.append(judged.select(*COMPARISON, "status", "failures", "pressure", "worst", *(F.col(c).cast("double") for c in differences)))
    if not made:
        return found.filter(F.lit(False)).selectExpr(*COMPARISON, "'' AS status", "array('') AS failures", "0.0D AS pressure", "'' AS worst")
    return sets.concat(made)


def summarise(timings: DataFrame, metrics: dict[str, DataFrame], exclusions: DataFrame | None = None, side: dict[str, DataFrame] | None = None, **bootstrap) -> Summary:
    """The summary of a run's records: sources.records.timing_records, metrics_records by phase, and the tables that lie beside them. bootstrap: arguments of speedups.

    The three tables are written to the checkpoint folder: all that follows reads them several times, and they are small beside the records.
    Repeated values count as often as they are there. Without records all tables are empty; a null key is a key of its own.
    """
    timed = with_algorithm_iterations(timings, metrics)
    known = cut_lineage(measured(timed))
    return Summary(known, cut_lineage(speedups(timings, known, **bootstrap)), cut_lineage(parities(metrics, known)), exclusions, dict(side or {}))


def documents(summary: Summary) -> DataFrame:
    """A row for each configuration: config_id and a JSON document that holds its variants, comparisons, parity and exclusions."""
    facts = {"variants": summary.measured, "comparisons": summary.speedups, "parity": summary.parity}
    if summary.exclusions is not None:
        facts["exclusions"] = summary.exclusions
    made = summary.measured.select(*CONFIG).distinct()
    for name, df in facts.items():
        made = joins.attached(made, df, CONFIG, name)
    return made.select(config_id(*(F.col(c) for c in CONFIG)).alias("config_id"), F.to_json(F.struct(*CONFIG, *facts)).alias("document"))


def together(low: Summary, high: Summary) -> Summary:
    """Both runs as one: a whole point of high replaces that of low, and each side table merges by its own key. What a run measured isn't excluded."""
    merged = lambda a, b, keys: sets.priority_merge(a, b, keys, check=False)
    shared = {name: merged(low.side[name], high.side[name], SIDE_KEYS[name]) for name in low.side.keys() & high.side.keys()}
    side = {**low.side, **high.side, **shared}
    measured_both = merged(low.measured, high.measured, MEASURED)
    left, right = low.exclusions, high.exclusions
    if left is not None and right is not None:
        exclusions = sets.merge_exclusions(left, right, measured_both, [*CONFIG, "phase_key", "stage_key"])
    else:
        exclusions = left if right is None else right
    return Summary(measured_both, merged(low.speedups, high.speedups, COMPARISON), merged(low.parity, high.parity, COMPARISON), exclusions, side)


def references_by_phase(left: DataFrame, right: DataFrame, preferred: list[str] = ["reference", "sklearn_brute"]) -> dict[str, str]:  # noqa: B006
    """The reference by which each phase of either side is compared: its primary one if both have it, else the first preferred one that both have, else the first that both have; a phase without a common one keeps its primary."""
    sides = [{tuple(r) for r in df.select("phase_key", "reference_key").distinct().collect()} for df in (left, right)]
    made = {}
    for phase in {p for s in sides for p, _ in s if p is not None}:
        common = {r for p, r in sides[0] & sides[1] if p == phase and r}
        primary = predicates.PRIMARY_REFERENCE.get(phase, "reference")
        order = [primary, *preferred, *sorted(common)]
        made[phase] = next((r for r in order if r in common), primary)
    return made


@dataclass(frozen=True)
class Report:
    """A comparison of two summaries. points: entity with the number of points in common and on one side; speedups, parity, counters: matched points with ratios and differences; transitions: changes of status; missing: which side lacks what, as lines."""

    references: dict[str, str]
    points: DataFrame
    speedups: DataFrame
    speedup_groups: DataFrame
    parity: DataFrame
    transitions: DataFrame
    counters: DataFrame | None
    missing: list[tuple[str, str, str, int, int]]


GROUPINGS = [["phase_key"], ["phase_key", "stage_key"], ["phase_key", "stage_key", "variant_key"]]


def compared_speedups(left: DataFrame, right: DataFrame, references: dict[str, str]) -> DataFrame:
    """COMPARISON, speedup_baseline, speedup_candidate, ratio, delta_pct of the points that both tables of speedups have with their phase's reference."""
    chosen = [predicates.primary_references(df, overrides=references) for df in (left, right)]
    return joins.speedup_comparison(*chosen, COMPARISON)


def compared_parity(left: DataFrame, right: DataFrame, references: dict[str, str]) -> DataFrame:
    """COMPARISON, status, worst and pressure of both sides, transition, pressure_delta, and a delta of each shared difference."""
    a, b = (predicates.primary_references(df, overrides=references) for df in (left, right))
    shared = [c for c in a.columns if c in b.columns and c not in (*COMPARISON, "failures")]
    made = joins.compared(a, b, COMPARISON, shared)
    numbers = [c for c in shared if c not in ("status", "worst")]
    made = made.withColumns({f"{c}_delta": F.col(f"{c}_candidate") - F.col(f"{c}_baseline") for c in numbers})
    return made.withColumn("transition", F.concat_ws(" -> ", "status_baseline", "status_candidate"))


def point_counts(left: DataFrame, right: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """One row: entity, common, baseline_only, candidate_only."""
    a = left.select(*keys).distinct().withColumn("_a", F.lit(True))
    b = right.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct().withColumn("_b", F.lit(True))
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    both = a.join(b, on, "outer")
    return both.agg(F.lit(entity).alias("entity"), F.count_if(F.col("_a") & F.col("_b")).alias("common"), F.count_if(F.col("_b").isNull()).alias("baseline_only"), F.count_if(F.col("_a").isNull()).alias("candidate_only"))


def _gaps(left: DataFrame, right: DataFrame, keys: list[str], entity: str, grid_start: int) -> list[tuple[str, str, str, int, int]]:
    """Lines (entity, the side that lacks it, path, depth, points) of both directions."""
    return [(entity, side, *line) for side, a, b in (("candidate", left, right), ("baseline", right, left)) for line in sets.missing_summary(a, b, keys, grid_start)]


def report(left: Summary, right: Summary) -> Report:
    """The comparison of a baseline (left) and a candidate (right). Gaps in parity that are gaps in speedups too are told once."""
    references = references_by_phase(left.speedups, right.speedups)
    of = lambda name: tuple(predicates.primary_references(getattr(s, name), overrides=references) for s in (left, right))
    faster, agreed = of("speedups"), of("parity")
    entities = [("speedups", *faster, BRANCHES, BRANCHES.index("dataset")), ("parity", *agreed, BRANCHES, BRANCHES.index("dataset"))]
    for name, keys, grid in (("counters", COUNTER_BRANCHES, "dataset"), ("spills", SPILL_BRANCHES, "cpp_case")):
        if name in left.side and name in right.side:
            entities.append((name, left.side[name], right.side[name], keys, keys.index(grid)))
    lines: list[tuple[str, str, str, int, int]] = []
    for name, a, b, keys, grid_start in entities:
        told = {line[1:] for line in lines if line[0] == "speedups"} if name == "parity" else set()
        lines += [line for line in _gaps(a, b, keys, name, grid_start) if line[1:] not in told]
    matched, judged = compared_speedups(left.speedups, right.speedups, references), compared_parity(left.parity, right.parity, references)
    counters = None
    if "counters" in left.side and "counters" in right.side:
        events = [c for c in left.side["counters"].columns if c in right.side["counters"].columns and dict(left.side["counters"].dtypes)[c] in ("int", "bigint", "double") and c not in COUNTER_BRANCHES]
        counters = joins.counter_comparison(left.side["counters"], right.side["counters"], COUNTER_BRANCHES, events)
    return Report(
        references,
        sets.concat([point_counts(a, b, keys, name) for name, a, b, keys, _ in entities]),
        matched,
        aggregates.delta_summaries(matched, GROUPINGS, "delta_pct"),
        sets.by_pressure_change(judged, "pressure_delta", COMPARISON),
        aggregates.transitions(judged, ["phase_key"], "status_baseline", "status_candidate", unchanged=True),
        counters,
        lines,
    )

"""Summaries of runs and their comparison, on line items as timing values: line status F is one run, O another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import aggregates, predicates, reports, sets
from tessera.plans import cut_lineage
from tessera.queries.analytics import rounded
from tessera.queries.catalogue import Catalogue, table

query = Catalogue()

ITERATIONS = 100
IDENTITY = {
    "dataset": "CASE l_returnflag WHEN 'A' THEN 'blobs' WHEN 'R' THEN 'real' ELSE 'other' END",
    "dimensions": "CAST(l_suppkey % 5 AS INT)",
    "samples": "CAST(l_suppkey AS INT)",
    "clusters": "2",
    "phase_key": "CASE WHEN l_suppkey % 2 = 0 THEN 'lloyd' ELSE 'hdbscan' END",
    "stage_key": "'full'",
    "params_key": "'default'",
    "variant_key": "CASE l_linenumber WHEN 2 THEN 'static' WHEN 4 THEN 'dynamic' WHEN 6 THEN 'auto' WHEN 1 THEN 'reference' WHEN 5 THEN 'reference' ELSE 'sklearn_brute' END",
    "language_key": "CASE WHEN l_linenumber % 2 = 0 THEN 'cpp' ELSE 'py' END",
}
_COUNTED = "CASE WHEN phase_key = 'lloyd' THEN 1 + samples % 7 ELSE 1 END"

TIMED = f"""timed AS (SELECT {', '.join(f'{sql} AS {name}' for name, sql in IDENTITY.items())}, l_linestatus AS run, CAST(l_quantity % 3 AS INT) AS process, l_extendedprice AS time_s, l_quantity AS quantity FROM lineitem),
measured AS (SELECT run, {', '.join(reports.MEASURED)}, count(*) AS n, count(DISTINCT process) AS processes, {_COUNTED} AS algorithm_iterations, median(time_s) AS median, max(quantity) AS inertia FROM timed GROUP BY ALL),
pairs AS (SELECT c.run, {', '.join(f'c.{k}' for k in reports.VARIANT)}, r.variant_key AS reference_key, r.median / c.median AS speedup, c.median AS candidate_point, r.median AS reference_point,
abs(c.inertia - r.inertia) / greatest(c.inertia, r.inertia) * 100 AS inertia_diff_pct FROM measured c JOIN measured r ON c.run = r.run AND c.language_key = 'cpp' AND r.language_key = 'py' AND {' AND '.join(f'c.{k} = r.{k}' for k in reports.POINT)}),
chosen AS (SELECT * FROM pairs WHERE reference_key = CASE phase_key WHEN 'lloyd' THEN 'reference' ELSE 'sklearn_brute' END)"""


def _records(spark: SparkSession, sf_dir: str, status: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Timing records of a run, and its metrics by phase."""
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == status)
    timed = lines.selectExpr(*(f"{sql} AS {name}" for name, sql in IDENTITY.items()), "CAST(l_quantity % 3 AS INT) AS timing_process_index", "l_extendedprice AS time_s", "l_quantity")
    lloyd = timed.filter("phase_key = 'lloyd'").groupBy(*reports.MEASURED).agg(F.max("l_quantity").alias("inertia")).withColumn("algorithm_iterations", F.expr("1 + samples % 7"))
    return timed.drop("l_quantity"), {"lloyd": lloyd}


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.measured(reports.with_algorithm_iterations(*_records(spark, sf_dir, "F")))


def _speedups(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    timings, metrics = _records(spark, sf_dir, status)
    return reports.summarise(timings, metrics, iterations=ITERATIONS).speedups


def _parities(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    timings, metrics = _records(spark, sf_dir, status)
    return cut_lineage(reports.parities(metrics, timings))


@query(f"WITH {TIMED} SELECT {', '.join(reports.MEASURED)}, n, processes, algorithm_iterations, round(median, 6) AS median, round(median / algorithm_iterations, 6) AS per_iteration_median FROM measured WHERE run = 'F'")
def summary_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _measured(spark, sf_dir)
    return rounded(made.select(*reports.MEASURED, "n", "processes", "algorithm_iterations", "median", "per_iteration_median"), "median", "per_iteration_median")


@query(f"WITH {TIMED} SELECT {', '.join(reports.COMPARISON)}, round(speedup, 6) AS speedup, round(candidate_point, 6) AS candidate_point, round(reference_point, 6) AS reference_point, round(speedup, 6) AS per_iteration_speedup FROM pairs WHERE run = 'F'")
def summary_speedups(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ["speedup", "candidate_point", "reference_point", "per_iteration_speedup"]
    return rounded(_speedups(spark, sf_dir, "F").select(*reports.COMPARISON, *values), *values)


@query(f"WITH {TIMED} SELECT {', '.join(reports.COMPARISON)}, round(inertia_diff_pct, 6) AS inertia_diff_pct, CASE WHEN inertia_diff_pct <= 1e-6 THEN 'PASS' ELSE 'FAIL' END AS status FROM pairs WHERE run = 'F' AND phase_key = 'lloyd'")
def summary_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_parities(spark, sf_dir, "F").select(*reports.COMPARISON, "inertia_diff_pct", "status"), "inertia_diff_pct")


_BOTH = f"FROM (SELECT * FROM chosen WHERE run = 'F') a JOIN (SELECT * FROM chosen WHERE run = 'O') b ON {' AND '.join(f'a.{k} = b.{k}' for k in reports.COMPARISON)}"
_SIDES = "count(*) FILTER (WHERE f AND o) AS common, count(*) FILTER (WHERE f AND NOT o) AS baseline_only, count(*) FILTER (WHERE o AND NOT f) AS candidate_only"


@query(
    f"""WITH {TIMED}, keys AS (SELECT {', '.join(reports.COMPARISON)}, bool_or(run = 'F') AS f, bool_or(run = 'O') AS o FROM chosen GROUP BY ALL)
SELECT 'speedups' AS entity, {_SIDES} FROM keys UNION ALL SELECT 'parity', {_SIDES} FROM keys WHERE phase_key = 'lloyd'"""
)
def report_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [predicates.primary_references(reports.pairs(_records(spark, sf_dir, s)[0])) for s in ("F", "O")]
    judged = [predicates.primary_references(_parities(spark, sf_dir, s)) for s in ("F", "O")]
    return sets.concat([reports.point_counts(*pairs, reports.COMPARISON, "speedups"), reports.point_counts(*judged, reports.COMPARISON, "parity")])


@query(f"WITH {TIMED} SELECT {', '.join(f'a.{k}' for k in reports.COMPARISON)}, round(a.speedup, 6) AS speedup_baseline, round(b.speedup, 6) AS speedup_candidate, round(b.speedup / a.speedup, 6) AS ratio, round(100 * (b.speedup / a.speedup - 1), 4) AS delta_pct {_BOTH}")
def report_speedups(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = reports.compared_speedups(*(_speedups(spark, sf_dir, s) for s in ("F", "O")), {})
    return rounded(made, "speedup_baseline", "speedup_candidate", "ratio").withColumn("delta_pct", F.round("delta_pct", 4))


@query(
    f"""WITH {TIMED}, judged AS (SELECT CASE WHEN a.inertia_diff_pct <= 1e-6 THEN 'PASS' ELSE 'FAIL' END || ' -> ' || CASE WHEN b.inertia_diff_pct <= 1e-6 THEN 'PASS' ELSE 'FAIL' END AS transition {_BOTH} WHERE a.phase_key = 'lloyd')
SELECT 'lloyd' AS phase_key, transition, count(*) AS n FROM judged GROUP BY 2"""
)
def report_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = reports.compared_parity(*(_parities(spark, sf_dir, s) for s in ("F", "O")), {})
    return aggregates.transitions(judged, ["phase_key"], "status_baseline", "status_candidate", unchanged=True)


QUERIES, ORACLE_SQL = query.queries, query.sql

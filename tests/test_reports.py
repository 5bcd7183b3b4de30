"""Summaries of runs and reports from result files to lines."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates, reports
from tessera.sources import records


def write(folder, name, document):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps(document))


def timing(*processes):
    return {"benchmarks": [{"runs": [{"values": list(p)} for p in processes]}]}


def lloyd(language, inertia, iterations):
    return {"schema_version": 1, "phase": "lloyd", "language": language, "algorithm_iterations": iterations, "inertia": inertia, "cluster_counts": [1], "cluster_inertia": [inertia], "centroids": [[0.0]]}


def mixture(language, weight):
    return {"schema_version": 1, "phase": "gmm", "language": language, "covariance_type": "full", "algorithm_iterations": 2, "lower_bound": -1.0, "lower_bounds": [-1.0], "weights": [weight, 1 - weight], "means": [[0.0], [1.0]], "covariances": [[[1.0]], [[2.5e-1]]]}


def density(language, noise):
    some = aggregates.vector_summary(np.arange(20.0))
    return {"schema_version": 1, "phase": "hdbscan", "language": language, "stage": "full", "n_samples": 20, "min_samples": 5, "noise_count": noise, "cluster_count": 2, "summary": some, "label_summary": some, "probability_summary": some, "core_distance_summary": some}


def run(spark, folder, faster=1.0, weight=0.5, noise=1, more=False):
    config = "2D_40N_2K.json"
    write(folder, f"lloyd_full_static_cpp_{config}", timing([1.0 / faster, 3.0 / faster], [2.0 / faster]))
    write(folder, f"lloyd_full_reference_py_{config}", timing([8.0, 8.0], [8.0]))
    write(folder, f"lloyd_full_metrics_static_cpp_{config}", lloyd("cpp", 5.0, 4))
    write(folder, f"lloyd_full_metrics_reference_py_{config}", lloyd("py", 5.0, 8))
    write(folder, f"gmm_full_static_full_cpp_{config}", timing([2.0]))
    write(folder, f"gmm_full_reference_full_py_{config}", timing([6.0]))
    write(folder, f"gmm_full_metrics_static_full_cpp_{config}", mixture("cpp", weight))
    write(folder, f"gmm_full_metrics_reference_full_py_{config}", mixture("py", 0.5))
    for reference in ("sklearn_brute", "hdbscan_contrib"):
        write(folder, f"hdbscan_full_{reference}_py_{config}", timing([4.0]))
        write(folder, f"hdbscan_full_metrics_{reference}_py_{config}", density("py", 1))
    write(folder, f"hdbscan_full_static_cpp_{config}", timing([1.0]))
    write(folder, f"hdbscan_full_metrics_static_cpp_{config}", density("cpp", noise))
    if more:
        write(folder, "soa_full_static_cpp_3D_50N_2K.json", timing([1.0]))
        write(folder, "soa_full_reference_py_3D_50N_2K.json", timing([2.0]))
    timings = records.timing_records(spark, str(folder))
    return reports.summarise(timings, {p: records.metrics_records(spark, str(folder), p) for p in ("lloyd", "gmm", "hdbscan")}, iterations=50)


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("runs")
    return run(spark, folder / "a", more=True), run(spark, folder / "b", faster=2.0, weight=0.5 + 5e-3, noise=2)


def test_summary(runs):
    measured = {(r.phase_key, r.language_key, r.variant_key): r for r in runs[0].measured.collect()}
    mine = measured["lloyd", "cpp", "static"]
    assert (mine.n, mine.processes, mine.median, mine.algorithm_iterations, mine.per_iteration_median) == (3, 2, 2.0, 4, 0.5)
    assert [tuple(v) for v in mine.values_per_process] == [(0, 2), (1, 1)] and measured["soa", "cpp", "static"].algorithm_iterations == 1
    made = {(r.phase_key, r.reference_key): r for r in runs[0].speedups.collect()}
    assert made.keys() == {("lloyd", "reference"), ("gmm", "reference"), ("hdbscan", "sklearn_brute"), ("hdbscan", "hdbscan_contrib"), ("soa", "reference")}
    assert made["lloyd", "reference"].speedup == 4.0 and made["lloyd", "reference"].per_iteration_speedup == 2.0 and made["gmm", "reference"].speedup == 3.0
    judged = {(r.phase_key, r.reference_key): r for r in runs[0].parity.collect()}
    assert len(judged) == 4 and {k: r.failures for k, r in judged.items() if r.status != "PASS"} == {("lloyd", "reference"): ["iteration_diff"]}
    assert judged["lloyd", "reference"].worst == "iterations" and judged["hdbscan", "sklearn_brute"].pressure == 0
    other = {(r.phase_key, r.reference_key): r for r in runs[1].parity.collect()}
    assert other["gmm", "reference"].failures == ["weights_max_abs"] and other["gmm", "reference"].worst == "weights" and other["gmm", "reference"].pressure == pytest.approx(50)
    assert other["hdbscan", "hdbscan_contrib"].failures == ["noise_count"] and other["hdbscan", "hdbscan_contrib"].worst == "noise_count"


def test_report(runs):
    made = reports.report(*runs)
    assert made.references == {"lloyd": "reference", "gmm": "reference", "hdbscan": "sklearn_brute", "soa": "reference"}
    assert {(r.entity, r.common, r.baseline_only, r.candidate_only) for r in made.points.collect()} == {("speedups", 3, 1, 0), ("parity", 3, 0, 0)}
    assert {(r.phase_key, r.ratio, r.delta_pct) for r in made.speedups.collect()} == {("lloyd", 2.0, 100.0), ("gmm", 1.0, 0.0), ("hdbscan", 1.0, 0.0)}
    assert {(r.phase_key, r.n, r.median) for r in made.speedup_groups.filter("grouping = 0").collect()} == {("lloyd", 1, 100.0), ("gmm", 1, 0.0), ("hdbscan", 1, 0.0)}
    assert {(r.phase_key, r.transition) for r in made.transitions.collect()} == {("lloyd", "FAIL -> FAIL"), ("gmm", "PASS -> FAIL"), ("hdbscan", "PASS -> FAIL")}
    rows = made.parity.collect()
    assert [r.phase_key for r in rows] == ["gmm", "hdbscan", "lloyd"] and rows[0].weights_max_abs_delta == pytest.approx(5e-3)
    assert made.missing == [("speedups", "candidate", "phase_key=soa", 1, 1)] and made.counters is None


def test_gaps_are_told_once(spark, runs):
    none = reports.Summary(*(df.filter("phase_key = 'soa'") for df in (runs[0].measured, runs[0].speedups, runs[0].parity)))
    lines = reports.report(runs[0], none).missing
    assert len(lines) == 3 and {line[0] for line in lines} == {"speedups"}


def test_documents(spark, runs):
    key = ["dataset", "dimensions", "samples", "clusters"]
    left_out = spark.createDataFrame([("blobs", 9, 9, 9, "lloyd", "full", "too large")], "dataset string, dimensions int, samples int, clusters int, phase_key string, stage_key string, reason string")
    made = {r.config_id: json.loads(r.document) for r in reports.documents(reports.Summary(runs[0].measured, runs[0].speedups, runs[0].parity, left_out)).collect()}
    assert made.keys() == {"blobs_2D_40N_2K", "blobs_3D_50N_2K", "blobs_9D_9N_9K"}
    assert len(made["blobs_2D_40N_2K"]["variants"]) == 7 and len(made["blobs_2D_40N_2K"]["comparisons"]) == 4
    assert made["blobs_9D_9N_9K"]["exclusions"][0]["reason"] == "too large" and set(key) <= made["blobs_9D_9N_9K"].keys()


def test_together(spark, runs):
    """Whole points of high replace those of low; each side table has its own key."""
    compile_ = lambda *rows: spark.createDataFrame(rows, "dimensions int, phase_key string, stage_key string, variant_key string, cpp_case string, size long")
    spill = lambda *rows: spark.createDataFrame(rows, "cpp_case string, dimensions int, covariance_type string, spills int")
    count = lambda *rows: spark.createDataFrame(rows, "dataset string, dimensions int, samples int, clusters int, stage_key string, cpp_case string, params_key string, Ir long")
    low = reports.Summary(runs[0].measured, runs[0].speedups, runs[0].parity, None, {"compile": compile_((2, "lloyd", "full", "static", "a", 1), (2, "lloyd", "full", "static", "b", 2)), "spills": spill(("a", 2, None, 1), ("a", 2, "full", 2)), "counters": count(("blobs", 2, 3, 4, "full", "a", "default", 1))})
    high = reports.Summary(runs[1].measured, runs[1].speedups, runs[1].parity, None, {"compile": compile_((2, "lloyd", "full", "static", "b", 9)), "spills": spill(("a", 2, None, 7)), "counters": count(("blobs", 2, 3, 4, "full", "a", "diag", 5))})
    made = reports.together(low, high)
    assert made.measured.count() == 9 and {(r.phase_key, r.speedup) for r in made.speedups.filter("reference_key = 'reference'").collect()} == {("lloyd", 8.0), ("gmm", 3.0), ("soa", 2.0)}
    assert sorted((r.cpp_case, r["size"]) for r in made.side["compile"].collect()) == [("a", 1), ("b", 9)]
    assert sorted((r.covariance_type or "", r.spills) for r in made.side["spills"].collect()) == [("", 7), ("full", 2)]
    assert sorted((r.params_key, r.Ir) for r in made.side["counters"].collect()) == [("default", 1), ("diag", 5)]


def test_counters_in_a_report(spark, runs):
    keys = ", ".join(f"{k} {'int' if k in ('dimensions', 'samples', 'clusters') else 'string'}" for k in reports.COUNTER_BRANCHES)
    table = lambda *rows: spark.createDataFrame(rows, f"{keys}, Ir long")
    point = ("lloyd", "full", "static", "default", "blobs", 2, 40, 2)
    left, right = (reports.Summary(s.measured, s.speedups, s.parity, None, {"counters": t}) for s, t in zip(runs, (table((*point, 10), (*point[:5], 3, 40, 2, 1)), table((*point, 20)))))
    made = reports.report(left, right)
    assert [(r.Ir_ratio, r.Ir_delta_pct) for r in made.counters.collect()] == [(2.0, 100.0)]
    assert [line[:2] for line in made.missing] == [("speedups", "candidate"), ("counters", "candidate")]
    assert ("counters", 1, 1, 0) in {tuple(r) for r in made.points.collect()}


def test_iterations_must_be_known(spark, tmp_path):
    write(tmp_path, "lloyd_full_static_cpp_2D_40N_2K.json", timing([1.0]))
    timings = records.timing_records(spark, str(tmp_path))
    with pytest.raises(Exception, match="no metrics of lloyd"):
        reports.summarise(timings, {})
    with pytest.raises(Exception, match="no metrics of lloyd"):
        reports.summarise(timings, {"lloyd": records.metrics_records(spark, str(tmp_path), "lloyd")})


def test_no_records(spark):
    timings = spark.createDataFrame([], ", ".join(f"{k} {'int' if k in ('dimensions', 'samples', 'clusters') else 'string'}" for k in reports.MEASURED) + ", timing_process_index int, time_s double")
    made = reports.summarise(timings, {})
    assert made.measured.count() == made.speedups.count() == made.parity.count() == reports.documents(made).count() == 0
    assert reports.report(made, made).missing == [] and reports.report(made, made).points.agg(F.sum("common")).first()[0] == 0

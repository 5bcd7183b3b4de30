"""Edge cases and properties of functions, sources, joins, statistics, set operations, parity and regression."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import streaming
from tessera.functions import hashing, scalars, vectors
from tessera.operators import aggregates, joins, kmeans, parity, predicates, rectangles, regression, sets
from tessera.sources import artifacts, datasets, records


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


# functions


def test_ratios(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (1.0, 2.0), (None, 1.0), (1.0, None)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    made = df.select(scalars.ratio_or_infinity(a, b).alias("i"), scalars.ratio_or_nan(a, b).alias("n"), scalars.rate(a, b).alias("r")).collect()
    assert [r.i for r in made] == [0.0, math.inf, 0.5, None, None]
    assert [r.r for r in made] == [None, None, 0.5, None, None]
    assert math.isnan(made[0].n) and math.isnan(made[1].n) and made[2].n == 0.5


def test_worst_check(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 2.0), (None, None), (float("nan"), 0.5)], "a double, b double")
    made = df.select(scalars.worst_check({"first": F.col("a"), "second": F.col("b")}).alias("w")).collect()
    assert [(r.w.pressure, r.w.check) for r in made] == [(1.0, "first"), (2.0, "second"), (None, None), (0.5, "second")]


def test_levels(spark):
    df = spark.createDataFrame([(0.0,), (2.0,)], "d double")
    assert [r[0] for r in df.select(vectors.inverse_distance(F.col("d"))).collect()] == [math.inf, 0.5]
    made = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (1.0, 0.0), (math.inf, 5.0)], "l double, t double").select(vectors.membership(F.col("l"), F.col("t")).alias("m")).collect()
    assert [r.m for r in made] == [0.5, 1.0, 1.0, 1.0]
    assert spark.range(1).select(vectors.merge_distance(F.lit(-1e-18))).first()[0] == 0


def test_precision_of(spark):
    assert spark.range(1).select(vectors.precision_of(F.lit(4.0))).first()[0] == 0.25
    with pytest.raises(Exception, match="regularisation"):
        spark.range(1).select(vectors.precision_of(F.col("id") - 1.0)).collect()


def test_hashing():
    assert hashing.fnv1a(b"") == 14695981039346656037 and hashing.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert hashing.probe_indices(0) == [] and hashing.probe_indices(5) == [0, 1, 2, 3, 4]
    many = hashing.probe_indices(10_000)
    assert many[:32] == list(range(32)) and many[-32:] == list(range(9968, 10_000)) and 100 < len(many) <= 128
    assert hashing.child_seed(1, "a", 2) == hashing.child_seed(1, "a", 2) != hashing.child_seed(1, "a", 3)


def test_index_weights_in_the_jvm(spark):
    index = [0, 1, 2, 5, 1000, 2**31, 2**33 + 7, 2**40 + 12345]
    made = spark.createDataFrame([(i,) for i in index], "i long").select(aggregates._weight(F.col("i"))).collect()
    assert [r[0] for r in made] == pytest.approx(hashing.index_weights(np.array(index)).tolist(), abs=1e-15)


# sources


def test_blobs_do_not_depend_on_partitions(spark):
    one, many = (datasets.blobs(spark, 300, 3, 4, partitions=p).orderBy("id").collect() for p in (1, 7))
    assert one == many and len({r.k for r in one}) == 4
    x = np.array([r.x for r in datasets.blobs(spark, 4000, 2, 1).collect()])
    assert np.allclose(x.std(0), 1, atol=0.08)


def test_binary_and_numpy_files(spark, tmp_path):
    x = np.random.default_rng(0).random((37, 5)).astype(np.float32)
    (tmp_path / "a.bin").write_bytes(x.tobytes())
    assert np.allclose([r.x for r in datasets.raw_binary(spark, str(tmp_path / "a.bin"), 5, 37).orderBy("id").collect()], x)
    for d, n in ((4, None), (5, 36)):
        with pytest.raises(ValueError):
            datasets.raw_binary(spark, str(tmp_path / "a.bin"), d, n)
    np.save(tmp_path / "b.npy", x)
    np.savez(tmp_path / "c.npz", x)
    for name in ("b.npy", "c.npz"):
        assert np.allclose([r.x for r in datasets.numpy_file(spark, str(tmp_path / name), 5).orderBy("id").collect()], x)
    np.savez(tmp_path / "d.npz", x, x)
    np.save(tmp_path / "e.npy", np.array([{}], object), allow_pickle=True)
    np.save(tmp_path / "f.npy", np.array([[1.0, np.nan]]))
    for name in ("d.npz", "e.npy", "f.npy"):
        with pytest.raises(Exception):
            datasets.numpy_file(spark, str(tmp_path / name)).collect()


def test_download(tmp_path):
    (tmp_path / "x y.bin").write_bytes(b"abc")
    url = (tmp_path / "x y.bin").as_uri()
    path = datasets.download(url, str(tmp_path / "cache"), "set")
    assert path.split("/")[-1].startswith("set_") and path.endswith("_x_20y.bin") and open(path, "rb").read() == b"abc"
    (tmp_path / "x y.bin").unlink()
    assert datasets.download(url, str(tmp_path / "cache"), "set") == path


def test_stage_artifacts(spark, tmp_path):
    edges = pd.DataFrame({"u": [0, 1], "v": [1, 2], "w2": [0.5, 2.0]})
    artifacts.write_arrays(edges, str(tmp_path / "mst"), artifacts.TREE_EDGES)
    assert artifacts.read_arrays(str(tmp_path / "mst"), artifacts.TREE_EDGES).to_dict() == edges.to_dict()
    with pytest.raises(ValueError):
        artifacts.read_arrays(str(tmp_path / "mst"), artifacts.LINKAGE)
    points = datasets.blobs(spark, 50, 3, 2)
    artifacts.write_samples(points, str(tmp_path / "p"), "float64")
    assert values(artifacts.read_samples(spark, str(tmp_path / "p")), "id", "x") == values(points, "id", "x")
    artifacts.write_matrix(points, str(tmp_path / "m"), "float64")
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "m").iterdir()))
    assert np.allclose(np.frombuffer(raw).reshape(50, 3), [r.x for r in points.orderBy("id").collect()])
    artifacts.write_stage(points, str(tmp_path), "stage")
    assert artifacts.read_stage(spark, str(tmp_path), "stage").count() == 50


def test_documents(spark, tmp_path):
    made = kmeans.lloyd(datasets.blobs(spark, 40, 2, 2).select("id", "x"), [[0.0, 0.0], [5.0, 5.0]])
    name = "lloyd_full_metrics_static_spark_blobs_2D_40N_2K.json"
    document = artifacts.lloyd_metrics(made)
    assert json.loads(json.dumps(document))["cluster_counts"] == made.counts.tolist() and name
    facts = spark.createDataFrame([("c", "p", 1, 2.0), ("c", "q", 1, 3.0), ("d", "p", 1, 4.0)], "config string, phase string, run int, v double")
    nested = {r.config: json.loads(r.document) for r in artifacts.nested_summary(facts, ["config", "phase"], ["run", "v"]).collect()}
    assert nested["c"]["entries"] == [{"phase": "p", "entries": [{"run": 1, "v": 2.0}]}, {"phase": "q", "entries": [{"run": 1, "v": 3.0}]}]
    artifacts.write_json(facts, str(tmp_path / "j"))
    artifacts.write_manifest(facts, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.json(str(tmp_path / "m")).count() == 3


def test_timing_records(spark, tmp_path):
    timing = {"benchmarks": [{"runs": [{"values": [1.0, 2.0]}, {"metadata": {"timing_process_index": 7}, "values": [3.0]}, {"metadata": {}}]}]}
    for name in ("lloyd_full_static_cpp_real_set_2D_40N_2K.json", "gmm_full_dynamic_diag_py_3D_5N_1K.json", "summary.json", "lloyd_full_metrics_static_cpp_2D_40N_2K.json"):
        (tmp_path / name).write_text(json.dumps(timing))
    made = records.timing_records(spark, str(tmp_path))
    assert values(made.filter("phase_key = 'lloyd'"), "dataset", "samples", "run_index", "timing_process_index", "timing_value_index", "time_s") == [("real_set", 40, 0, 0, 0, 1.0), ("real_set", 40, 0, 0, 1, 2.0), ("real_set", 40, 1, 7, 0, 3.0)]
    assert values(made.filter("phase_key = 'gmm'").select("dataset", "params_key", "variant_key", "language_key").distinct(), "dataset", "params_key", "variant_key", "language_key") == [("blobs", "diag", "dynamic", "py")]
    assert made.count() == 6
    merged = records.merged_timings([made, made])
    assert merged.count() == 12 and values(merged.select("timing_process_index").distinct(), "timing_process_index") == [(0,), (1,)]
    with pytest.raises(ValueError):
        records.merged_timings([])


def test_metrics_records(spark, tmp_path):
    good = {"schema_version": 1, "phase": "lloyd", "language": "cpp", "algorithm_iterations": 3, "inertia": 1.5, "cluster_counts": [1], "cluster_inertia": [1.5], "centroids": [[0.0]]}
    (tmp_path / "lloyd_full_metrics_static_cpp_2D_40N_2K.json").write_text(json.dumps(good))
    assert records.metrics_records(spark, str(tmp_path), "lloyd").first().algorithm_iterations == 3
    (tmp_path / "lloyd_full_metrics_static_py_2D_40N_2K.json").write_text(json.dumps(good))
    with pytest.raises(Exception, match="doesn't fit"):
        records.metrics_records(spark, str(tmp_path), "lloyd").collect()


def test_profile_counters(spark, tmp_path):
    events = " ".join(records.EVENTS)
    (tmp_path / "a").write_text(f"x\nevents: {events} More\nsummary: {' '.join('1' * 10)}\ntotals: {' '.join(map(str, range(10)))}\n")
    (tmp_path / "b").write_text(f"events: {events}\nsummary: {' '.join(map(str, range(9)))}\n")
    made = {r.source: r for r in records.profile_counters(spark, str(tmp_path)).collect()}
    assert made["a"].Ir == 0 and made["a"].DLmw == 8 and made["b"].D1mr == 4
    rates = predicates.cache_rates(records.profile_counters(spark, str(tmp_path / "a"))).first()
    assert rates.i1_miss_rate is None and rates.d1_read_miss_rate == pytest.approx(4 / 3)
    (tmp_path / "c").write_text("events: Ir\ntotals: 1\n")
    with pytest.raises(Exception, match="no event"):
        records.profile_counters(spark, str(tmp_path)).collect()


# predicates and joins


def test_where(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, s string")
    assert values(predicates.where(df, s=["a", "b"], n=2), "n") == [(2,)]
    with pytest.raises(KeyError):
        predicates.where(df, t=1)


def test_exclusion_rules(spark):
    cases = spark.createDataFrame([("p", "full", "blobs", 5, 10, 2), ("q", "full", "real", 50, 10, 2)], "phase_key string, stage_key string, dataset string, dimensions int, samples int, clusters int")
    rules = spark.createDataFrame([(0, "b", ["p"], None), (1, "a", None, 5), (2, "b", None, None)], "rule_index int, reason string, phase_key array<string>, max_dimensions int")
    made = {r.phase_key: r for r in predicates.excluded(cases, rules).collect()}
    assert made["p"].reason == "b ; a" and [m.rule_index for m in made["p"].matched_rules] == [0, 1, 2] and made["q"].reason == "b"
    assert predicates.without_excluded(cases, rules).count() == 0
    with pytest.raises(Exception, match="reason"):
        predicates.excluded(cases, rules.withColumn("reason", F.lit(" "))).collect()


def test_null_keys_and_point_sets(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, s string")
    b = spark.createDataFrame([(1, None), (3, "x")], "k int, s string")
    made = joins.point_sets(a, b, ["k", "s"])
    assert values(made["common"], "k") == [(1,)] and values(made["left_only"], "k") == [(2,)] and values(made["right_only"], "k") == [(3,)]


def test_retention_needs_one_base(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0)], "g string, k int, speedup double")
    assert values(joins.retention(df, F.col("k") == 1, ["g"]), "k", "retention_pct") == [(1, 100.0), (2, 150.0)]
    for base in (F.col("k") == 9, F.col("k") < 9):
        with pytest.raises(Exception, match="base row"):
            joins.retention(df, base, ["g"]).collect()


def test_required_rows(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    with pytest.raises(Exception, match="no v"):
        joins.with_required(df, spark.createDataFrame([("a", 1)], "k string, v int"), ["k"], "v").collect()


def test_changed_and_complete(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), (None, "a"), (None, None)], "x string, y string")
    assert predicates.changed(df, "x", "y").count() == 2
    df = spark.createDataFrame([(None, "cpp"), (None, "py"), (1, "cpp"), (1, "cpp")], "k int, l string")
    assert values(predicates.complete(df, ["k"], "l", ["cpp", "py"]), "l") == [("cpp",), ("py",)]


def test_sweep_of_nothing(spark):
    df = spark.createDataFrame([], "p string, dimensions int, samples int, clusters int, v double")
    assert predicates.sweep(df, "samples", "v", ["p"]).count() == 0
    df = spark.createDataFrame([(v,) for v in (4.0, 1.0, 1.0, math.inf, math.nan, None, 2.0, 3.0)], "v double")
    assert predicates.lower_observed_median(df, "v") == 2.0


# statistics


def test_summary_of_few_values(spark):
    df = spark.createDataFrame([("one", 3.0), ("none", None), ("two", 1.0), ("two", 2.0), (None, 5.0)], "k string, v double")
    made = {r.k: r for r in aggregates.summary_stats(df, ["k"], "v").collect()}
    assert (made["one"].stddev, made["one"].mad, made["one"].p95) == (0.0, 0.0, 3.0)
    assert made["none"].n == 0 and made["none"].median is None and made["none"].stddev is None
    assert made["two"].median == 1.5 and made["two"].mad == 0.5 and made["two"].stddev == pytest.approx(np.std([1, 2], ddof=1))
    assert made[None].n == 1


def test_bootstrap():
    draw = np.random.default_rng(0)
    mine, theirs = ([draw.normal(m, 0.1, 8) for _ in range(8)] for m in (1, 5))
    made = aggregates.bootstrap_ratio(mine, theirs)
    assert made["ci_low"] <= made["point"] <= made["ci_high"] and made["point"] == pytest.approx(5, abs=0.3) and made["valid"] == 1000
    assert aggregates.bootstrap_ratio(mine, theirs) == made
    for bad in ({"iterations": 0}, {"level": 1.0}):
        with pytest.raises(ValueError):
            aggregates.bootstrap_ratio(mine, theirs, **bad)
    for sides in (([], theirs), ([np.zeros(3)], theirs), ([np.array([])], theirs)):
        with pytest.raises(ValueError):
            aggregates.bootstrap_ratio(*sides)


def test_single_value_raises(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="two"):
        df.groupBy("k").agg(aggregates.single_value("v", "two values")).collect()
    assert df.groupBy("k").agg(aggregates.one_or_mixed("v").alias("v")).first().v == "mixed"


def test_fingerprint_is_the_summary(spark):
    v = np.append(np.random.default_rng(0).standard_normal(500), [math.nan, math.inf, -math.inf])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, v double").repartition(5)
    made, want = aggregates.fingerprint(df, "i", "v").first().asDict(), aggregates.vector_summary(v)
    assert all(made[k] == pytest.approx(want[k]) for k in made if k != "hash")
    assert aggregates.fingerprint(df.coalesce(1), "i", "v").first().hash == made["hash"]
    empty = aggregates.vector_summary([])
    assert empty["value_count"] == 0 and math.isnan(empty["min"]) and empty["probes"] == []


def test_max_differences(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 2.0)], "i int, v double")
    made = aggregates.max_differences(a, a.withColumn("v", F.col("v") * 2), ["i"], "v").first()
    assert (made.max_abs, made.max_rel) == (2.0, 0.5)
    assert aggregates.max_differences(a, a.filter("i = 0"), ["i"], "v").first().max_abs is None
    assert aggregates.max_differences(a.limit(0), a.limit(0), ["i"], "v").first().max_abs == 0
    assert aggregates.symmetric_bound(a, "v") == 2.0 and aggregates.symmetric_bound(a.limit(0), "v") == 1.0


# set operations


def test_priority_merge_is_atomic(spark):
    low = spark.createDataFrame([(1, "l", None), (2, "l", 5)], "k int, s string, n int")
    high = spark.createDataFrame([(1, "h", None), (None, "h", 1)], "k int, s string, n int")
    assert values(sets.priority_merge(low, high, ["k"]), "k", "s", "n") == sorted([(1, "h", None), (2, "l", 5), (None, "h", 1)], key=repr)
    with pytest.raises(Exception, match="twice"):
        sets.priority_merge(low.union(low), high, ["k"]).collect()


@settings(max_examples=150, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 3), st.integers(0, 3), st.sampled_from("xyz")), max_size=30))
def test_cover_holds_exactly_the_points(points):
    boxes = rectangles.cover(points, ["a", "b", "c"])
    held = [(a, b, c) for x in boxes for a in x.values["a"] for b in x.values["b"] for c in x.values["c"]]
    assert len(held) == len(set(held)) and set(held) == points and sum(x.points for x in boxes) == len(points)


def test_cover_by_hand():
    l_shape = [(d, n) for d in (1, 2, 3) for n in (10, 20, 30) if d < 3 or n == 10]
    assert [x.values for x in rectangles.cover(l_shape, ["D", "N"])] == [{"D": (1, 2), "N": (10, 20, 30)}, {"D": (3,), "N": (10,)}]
    assert len(rectangles.cover([(d, n) for d in range(4) for n in range(5)], ["D", "N"])) == 1
    assert rectangles.ordered_values(["b", "10", 9, "a"]) == [9, "10", "a", "b"]


def test_missing_summary(spark):
    grid = [(p, d, n) for p in ("lloyd", "gmm") for d in (1, 2) for n in (10, 20)]
    left = spark.createDataFrame(grid, "phase string, d int, n int")
    made = sets.missing_summary(left, left.filter("phase = 'gmm' AND NOT n = 20"), ["phase", "d", "n"], 1)
    assert made == [("phase=lloyd", 1, 4), ("phase=gmm / d=1, 2 / n=20", 1, 2)]


# parity and regression


def test_lloyd_and_gmm_parity(spark):
    df = spark.createDataFrame([(1.0, 1.0, 3, 3), (1.0, 1.1, 3, 3), (None, 1.0, 3, 4)], "inertia_candidate double, inertia_reference double, iterations_candidate int, iterations_reference int")
    made = parity.lloyd(df).collect()
    assert [r.status for r in made] == ["PASS", "FAIL", "FAIL"] and made[2].failures == ["inertia_diff_pct", "iteration_diff"] and made[1].worst == "inertia"
    row = (1.0, 1.0, [0.5], [0.5], [1.0, 2.0], [1.0], [1.0], [1.005], 2, 2)
    names = ", ".join(f"{c}_{s} {'double' if c == 'lower_bound' else 'int' if c == 'iterations' else 'array<double>'}" for c in ("lower_bound", "weights", "means", "covariances", "iterations") for s in ("candidate", "reference"))
    made = parity.gmm(spark.createDataFrame([row], names)).first()
    assert made.failures == ["means_max_abs"] and made.worst == "covariances"


def test_hdbscan_parity(spark):
    x = np.arange(40.0)
    base = {"noise_count": 1, "cluster_count": 2} | {f"{p}summary": aggregates.vector_summary(x) for p in ("", "core_distance_", "label_", "probability_")}
    other = base | {"label_summary": aggregates.vector_summary(x + 1), "core_distance_summary": aggregates.vector_summary(x[:30])}
    kind = records._SUMMARY
    schema = f"struct<noise_count: bigint, cluster_count: bigint, summary: {kind}, core_distance_summary: {kind}, label_summary: {kind}, probability_summary: {kind}>"
    df = spark.createDataFrame([(s, a, b) for s in ("distance", "mst", "full") for a, b in ((base, base), (base, other))], f"stage string, candidate {schema}, reference {schema}")
    made = [(r.stage, r.status, r.failures) for r in parity.hdbscan(df).collect()]
    assert [m[1] for m in made] == ["PASS", "FAIL", "PASS", "PASS", "PASS", "FAIL"]
    assert made[1][2] == ["core_distance_counts", "core_distance_scalars", "core_distance_probes"] and made[5][2] == ["label_scalars", "label_probes"]


def test_repeats():
    first = {"a": 1.0, "s": {"sum": 1.0, "hash": "x"}, "l": [1, 2.0]}
    assert parity.repeat_differences(first, {"a": 1.0 + 1e-12, "s": {"sum": 1 + 5e-8, "hash": "x"}, "l": [1, 2.0]}) == []
    assert len(parity.repeat_differences(first, {"a": 1.1, "s": {"sum": 1.1, "hash": "y"}, "l": [1]})) == 4
    assert parity.repeat_differences(first, {"a": 1.0}) == ["/l: only one has it", "/s: only one has it"]


def test_timing_model_finds_the_law():
    draw = np.random.default_rng(0)
    d, n, k, i = draw.integers(1, 90, 400), draw.integers(100, 100_000, 400), draw.integers(2, 50, 400), draw.integers(1, 300, 400)
    rows = pd.DataFrame({"dimensions": d, "samples": n, "clusters": k, "algorithm_iterations": i, "time_s": 2e-3 + 1e-7 * n + 1e-8 * d * n * i + 2e-8 * n * k * i})
    model = regression.fit_rows(rows)
    assert model.metrics["log_r2"] > 0.999 and model.metrics["median_abs_error_pct"] < 1
    assert (model.setup >= 0).all() and (model.iteration >= 0).all() and model.removed
    assert np.allclose(model.predict(d, n, k, i) / 1000, rows["time_s"], rtol=0.05)


def test_timing_model_terms(spark):
    assert regression.exponents()[:4] == [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)] and len(regression.exponents()) == 27
    assert regression.term_name((2, 0, 1)) == "D^2 * K" and regression.term_name((0, 0, 0)) == "1"
    x = np.column_stack([np.ones(50), np.arange(50.0), 2 * np.arange(50.0) + 1e-9])
    assert regression.prune(x, [(0,), (1,), (2,)], {0}) == [0, 1]
    with pytest.raises(ValueError):
        regression.fit_models(spark.createDataFrame([], "g string, dimensions int, samples int, clusters int, algorithm_iterations int, time_s double"), ["g"])


# streaming


def test_stream_of_points(spark, tmp_path):
    rows = [(i, [float(i % 2 * 10), 0.0], f"2024-01-01 00:{i:02d}:00") for i in range(20)]
    table = spark.createDataFrame(rows, "id long, x array<double>, ts string").withColumn("ts", F.to_timestamp("ts"))
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    centers = [[0.0, 0.0], [10.0, 1.0]]
    for name, df, mode in (("scored", streaming.scored(stream, centers), "append"), ("drift", streaming.drift(stream, centers), "complete")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    assert values(spark.table("scored"), "id", "k") == [(i, i % 2) for i in sorted(range(20), key=lambda i: repr((i, i % 2)))]
    assert spark.table("drift").agg(F.sum("n")).first()[0] == 20 and {r.mean_d2 for r in spark.table("drift").filter("k = 1").collect()} == {1.0}


def test_cover_splits_by_priority():
    from tessera.operators.rectangles import cover

    points = [(a, b) for a in range(2) for b in range(2) if (a, b) != (1, 1)]
    first = cover(points, ["phase", "samples"])
    assert [r.path[0][0] for r in first] == ["samples"] * 2 and [list(r.values) for r in first] == [["phase", "samples"]] * 2
    assert [r.path[0][0] for r in cover(points, ["phase", "variant"])] == ["phase"] * 2
    assert [r.path[0][0] for r in cover(points, ["phase", "variant"], config=("variant",))] == ["variant"] * 2
    assert sorted(p for r in first for p in [(a, b) for a in r.values["phase"] for b in r.values["samples"]]) == sorted(points)
    assert cover([(1, 2), (1, 2)], ["a", "b"])[0].path == ()


def test_readers_of_services_by_stand_ins(spark, monkeypatch):
    """The calls that the three services' clients get, and what is made of their answers; no network."""
    import sys
    from types import ModuleType, SimpleNamespace

    calls = []

    def client(name, **functions):
        module = ModuleType(name)
        module.__dict__.update(functions)
        monkeypatch.setitem(sys.modules, name, module)

    rows = np.array([[1.0, 2.0], [3.0, 4.0]])
    client("sklearn")
    client("sklearn.datasets", fetch_openml=lambda **how: calls.append(how) or SimpleNamespace(data=rows))
    client("ucimlrepo", fetch_ucirepo=lambda id: SimpleNamespace(data=SimpleNamespace(features=pd.DataFrame(rows, columns=["a", "b"]))))
    client("datasets", load_dataset=lambda *name, split: calls.append((name, split)) or {"v": rows.tolist(), "a": [1, 3], "b": [2, 4]})
    want = [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
    assert values(datasets.openml(spark, 7), "id", "x") == values(datasets.openml(spark, name="n", version="2"), "id", "x") == values(datasets.openml(spark, name="n", version="active"), "id", "x") == want
    assert [{k: v for k, v in c.items() if k != "as_frame"} for c in calls] == [{"data_id": 7}, {"name": "n", "version": 2}, {"name": "n", "version": "active"}]
    assert values(datasets.uci(spark, 1), "id", "x") == want and values(datasets.uci(spark, 1, ["b"]), "id", "x") == [(0, [2.0]), (1, [4.0])]
    assert values(datasets.hugging_face(spark, "r", "train", vector="v"), "id", "x") == values(datasets.hugging_face(spark, "r", "test", columns=["a", "b"], config="c"), "id", "x") == want
    assert calls[3:] == [(("r",), "train"), (("r", "c"), "test")]
    for wrong in (lambda: datasets.openml(spark), lambda: datasets.hugging_face(spark, "r", "train")):
        with pytest.raises(ValueError):
            wrong()

"""Cases of a review: inputs on which results were wrong, or more than the limits hold."""

import math
import time
from pathlib import Path
from urllib.parse import urlparse

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates, hdbscan, regression
from tessera.queries import ORACLE_SQL, QUERIES


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")


def against_sql(spark, folder, name, table, select):
    """Rows of a query as text, and those of its SQL, on a table that select makes."""
    con = duckdb.connect()
    con.execute(f"COPY ({select}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    made = QUERIES[name](spark, str(folder))
    want = con.execute(ORACLE_SQL[name])
    assert made.columns == [d[0] for d in want.description]
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    return text(made.collect()), text(want.fetchall())


def test_abbreviations_round_by_the_exact_value(spark, tmp_path):
    keys = "VALUES (100500::BIGINT, 1::BIGINT), (101500, 1), (102500, 1), (150, 7), (99, 1), (7, 123), (-100500, 1), (-7, -123), (0, 0), (NULL, 12), (1, NULL), (250000, 1)"
    got, want = against_sql(spark, tmp_path, "abbreviations", "orders", f"SELECT * FROM ({keys}) t(o_orderkey, o_custkey)")
    assert got == want and ("100500", "1M") in got


def test_safe_ratios_keep_the_sign_of_zero(spark, tmp_path):
    values = "(VALUES (NULL::BIGINT), (-9), (-8), (-5), (-4), (-3), (-1), (0), (1), (2), (3), (7))"
    got, want = against_sql(spark, tmp_path, "safe_ratios", "lineitem", f"SELECT 1::BIGINT AS l_orderkey, 2 AS l_linenumber, a AS l_partkey, b AS l_suppkey FROM {values} p(a), {values} s(b)")
    assert got == want and any(r[2] == "-0.0" for r in got)


def copies(n=300, seed=5):
    """Points of a few clusters, far from the origin, with groups of equal ones."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 6)) * 0.1 + 1e4 + rng.integers(0, 4, n)[:, None] * 3.0
    x[:40], x[40:50] = x[0], x[40]
    return x


@pytest.mark.parametrize("block", [37, 1000])
def test_nearest_points_and_their_ties(spark, block):
    x = copies()
    d2 = ((x[:, None] - x) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    for r in hdbscan.nearest(frame(spark, x), 7, block).collect():
        want = np.lexsort((np.arange(len(x)), d2[r.id]))[:7]
        assert r.other == want.tolist() and np.allclose(r.d2, d2[r.id][want], atol=1e-12) and (r.id >= 40 or r.d2 == [0.0] * 7)
    few = hdbscan.nearest(frame(spark, x[:3]), 5, block).filter("id = 0").first()
    assert few.d2[2:] == [math.inf] * 3 and few.d2[:2] == [0.0, 0.0]


def test_third_smallest_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(hdbscan, "pairwise", None)
    assert QUERIES["third_smallest"](spark, "/root/testdata/sf0.001").count() == 500


def test_pairs_are_not_shuffled(spark):
    points = frame(spark, copies())
    core = hdbscan.core_distances(points, 5)
    for made in (hdbscan.pairwise(points, 64), hdbscan.pairwise(points, 64, core)):
        assert "Exchange hash" not in made._jdf.queryExecution().toString() and "SortMergeJoin" not in made._jdf.queryExecution().toString()
    want = {(r.i, r.j): r.w2 for r in hdbscan.mutual_reachability(hdbscan.pairwise(points, 64), core).collect()}
    assert {(r.i, r.j): r.w2 for r in hdbscan.pairwise(points, 64, core).collect()} == want and len(want) == 300 * 299 // 2


def test_reachability_packs_points_once(spark, monkeypatch):
    packs, real = [], hdbscan._packed
    monkeypatch.setattr(hdbscan, "_packed", lambda *a, **b: packs.append(1) or real(*a, **b))
    points = frame(spark, copies()).repartition(3).checkpoint()
    assert QUERIES["mutual_reachability"](spark, "/root/testdata/sf0.001").count() == 500 * 499 // 2 and len(packs) == 1
    want = {(r.i, r.j): r.w2 for r in hdbscan.pairwise(points, 64, hdbscan.core_distances(points, 5)).collect()}
    before = shuffled_bytes(spark)
    made = hdbscan.reachability(points, 5, 64)
    rows = made.collect()
    assert shuffled_bytes(spark) - before < 2 * copies().nbytes + 4096 and "SortMergeJoin" not in made._jdf.queryExecution().toString()
    assert len(rows) == len(want) and {(r.i, r.j): r.w2 for r in rows} == want


def test_a_task_has_one_pair_of_blocks(spark, tmp_path):
    frame(spark, copies()).write.parquet(f"{tmp_path}/points")  # a table of known size, small enough to be broadcast
    made = hdbscan.pairwise(spark.read.parquet(f"{tmp_path}/points"), 64)
    sizes = sorted(r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 5 * 6 // 2 and sum(sizes) == 300 * 299 // 2 and sizes[-1] < 300 * 299 // 2 / 8


def test_distances_round_as_in_sql():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.random(2000) * 10.0 ** rng.integers(-9, 12, 2000), np.arange(4000) / 2e6, (np.arange(64) * 2 + 1) / 2.0**7, [0.0, 5e-7, 4.9999999999999998e-7, 1e290, 1e303, 1.7e308, math.inf]])
    want = [r[0] for r in duckdb.execute("SELECT round(unnest(?::DOUBLE[]), 6)", [x.tolist()]).fetchall()]
    assert hdbscan._half_up(x, 6).tolist() == want


@pytest.mark.parametrize("neighbours", [1, 4, 12])
def test_tree_takes_few_passes_over_all_pairs(spark, monkeypatch, neighbours):
    passes, real = [], hdbscan._foreign
    monkeypatch.setattr(hdbscan, "_foreign", lambda *a: passes.append(1) or real(*a))
    monkeypatch.setattr(hdbscan, "NEIGHBOURS", neighbours)
    points = frame(spark, copies())
    core = hdbscan.core_distances(points, 4)
    grown, found = hdbscan.spanning_tree(points, core), hdbscan.spanning_tree(points, core, limit=1, block=64)
    assert np.allclose(sorted(grown["w2"]), sorted(found["w2"]), atol=1e-12) and len(found) == 299
    assert len(passes) <= (9 if neighbours < 4 else 4)
    core, near = hdbscan.core_and_neighbours(points, 4, limit=1, block=64)
    shared = hdbscan.spanning_tree(points, core, limit=1, block=64, near=near)
    assert np.allclose(sorted(shared["w2"]), sorted(grown["w2"]), atol=1e-12)


def shuffled_bytes(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_tree_shuffles_points_and_neighbours_once(spark, monkeypatch):
    packs, real = [], hdbscan._packed
    monkeypatch.setattr(hdbscan, "_packed", lambda *a: packs.append(1) or real(*a))
    x = np.random.default_rng(8).standard_normal((600, 64))
    points = frame(spark, x).repartition(3).checkpoint()
    before = shuffled_bytes(spark)
    core, near = hdbscan.core_and_neighbours(points, 5, limit=0, block=20)
    found = hdbscan.spanning_tree(points, core, limit=0, block=20, near=near)
    assert shuffled_bytes(spark) - before < 2 * x.nbytes and len(packs) == 1
    assert np.allclose(sorted(hdbscan.spanning_tree(points, core)["w2"]), sorted(found["w2"]))


def test_linkage_takes_less_disk_than_four_times_its_floats(spark):
    x = np.random.default_rng(9).standard_normal((1500, 64)).astype(np.float32)
    points = frame(spark, x).repartition(3).checkpoint()
    folder = Path(urlparse(spark.sparkContext._jsc.sc().getCheckpointDir().get()).path)
    kept = lambda: {p: p.stat().st_size for p in folder.rglob("part-*")}
    shuffled, before = shuffled_bytes(spark), kept()
    core, near = hdbscan.core_and_neighbours(points, 5, limit=0, block=250)
    made = hdbscan.single_linkage(hdbscan.spanning_tree(points, core, limit=0, block=250, near=near), np.arange(1500))
    assert shuffled_bytes(spark) - shuffled + sum(v for p, v in kept().items() if p not in before) < 4 * x.nbytes
    grown = hdbscan.single_linkage(hdbscan.spanning_tree(points, hdbscan.core_distances(points, 5)), np.arange(1500))
    assert np.array_equal(made["dist"], grown["dist"]) and made["size"].iloc[-1] == 1500


def test_linkage_leaves_no_shuffles_of_points(spark, monkeypatch):
    monkeypatch.setattr(hdbscan, "SOURCE_BYTES", 2**17)
    key, folders = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    left = lambda: {p: p.stat().st_size for d in folders for p in Path(d).rglob("shuffle_*.data")}
    points = frame(spark, np.random.default_rng(9).standard_normal((1500, 64))).repartition(3).checkpoint()
    before, setting = left(), spark.conf.get(key)
    core, near = hdbscan.core_and_neighbours(points, 5, limit=0, block=250)
    for _ in range(50):
        if (more := sum(v for p, v in left().items() if p not in before)) < 10_000:
            break
        time.sleep(0.2)
    assert more < 10_000 and spark.conf.get(key) == setting
    assert len(hdbscan.spanning_tree(points, core, limit=0, block=250, near=near)) == 1499


@pytest.mark.parametrize("block", [7, 200])
def test_points_are_packed_without_loss(spark, block):
    x = np.random.default_rng(4).standard_normal((90, 3)).astype(np.float32).astype(float)
    x[::3] += 2.0**-40
    x[5], x[7], x[11] = [1e300, -1e-300, 1.0], [-0.0, 0.0, 5e-324], [2.0**24 + 1, 1e-45, -1.5]
    points = frame(spark, x).repartition(4)
    rows = hdbscan._packed(points, block, 90).collect()
    found = {int(i): v.tobytes() for r in rows for i, v in zip(np.frombuffer(r.id, "<i8"), np.frombuffer(r.x, f"<f{r.w}").astype(float).reshape(-1, 3))}
    assert found == {i: v.tobytes() for i, v in enumerate(x)} and sum(len(r.id) // 8 for r in rows) == 90
    assert {r.w for r in hdbscan._packed(frame(spark, x[1::3][5:].astype(np.float32)), block, 25).collect()} == {4}
    with pytest.raises(Exception, match="another length"):
        hdbscan._packed(frame(spark, [[1.0, 2.0, 3.0], [1.0]]).coalesce(1), block, 2)


@pytest.mark.parametrize("held", [1, 2000, 128 << 20])
def test_neighbours_do_not_depend_on_what_a_task_holds(spark, monkeypatch, held):
    monkeypatch.setattr(hdbscan, "SOURCE_BYTES", held)
    test_nearest_points_and_their_ties(spark, 37)


@pytest.mark.parametrize(("few", "buckets"), [(0, 3), (5, 7), (50_000, 4096)])
def test_quantiles_without_all_values_in_one_task(spark, monkeypatch, few, buckets):
    monkeypatch.setattr(aggregates, "FEW", few)
    monkeypatch.setattr(aggregates, "BUCKETS", buckets)
    rng = np.random.default_rng(3)
    inf = math.inf
    for values in ([], [None], [2.0], [0.0, -0.0, 5.0], [math.nan, 1.0, inf], [-inf, inf, 3.0, None], [7.0] * 9 + [1e300, -1e300], rng.lognormal(0, 6, 101).tolist(), [1e308, -1e308, 0.0, 1.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        shares = [0.0, 0.25, 0.5, 0.9, 1.0]
        want = df.selectExpr(f"percentile(v, array({', '.join(map(str, shares))}))").first()[0]
        got = aggregates.quantiles(df, "v", shares)
        assert [str(x + 0.0) if x is not None else x for x in got] == [str(x + 0.0) for x in want or []] or want is None and got == [None] * 5


@pytest.mark.parametrize("statistic", ["median", "mean"])
def test_bootstrap_computes_each_kind_of_draw_once(monkeypatch, statistic):
    rng = np.random.default_rng(1)
    for a, b in ((1, 1), (3, 3), (2, 5), (17, 17)):
        sides = [[rng.random(rng.integers(1, 9)) + 0.5 for _ in range(n)] for n in (a, b)]
        f, draw = getattr(np, statistic), np.random.default_rng(8)
        of = lambda groups: f(np.concatenate([groups[i] for i in draw.integers(0, len(groups), len(groups))]))  # noqa: B023, E731
        ratios = []
        for _ in range(60):
            below = of(sides[0])
            ratios.append(of(sides[1]) / below)
        calls = []
        monkeypatch.setattr(aggregates.np, "concatenate", lambda x, real=np.concatenate: calls.append(1) or real(x))
        made = aggregates.bootstrap_ratio(*sides, statistic, 60, seed=8)
        monkeypatch.undo()
        assert len(calls) <= 8 and np.allclose([made["ci_low"], made["ci_high"]], np.percentile(ratios, [2.5, 97.5]), rtol=1e-12)


def test_timing_model_of_more_rows_than_the_driver_takes(spark):
    rng = np.random.default_rng(2)
    rows = [(int(d), int(n), int(k), int(i), float((1e-3 + 1e-9 * d * n * k * i) * rng.lognormal(0, 0.05))) for d, n, k, i in zip(rng.integers(1, 9, 900), rng.integers(100, 99_000, 900), rng.integers(1, 6, 900), rng.integers(1, 21, 900))]
    df = spark.createDataFrame(rows, "dimensions int, samples int, clusters int, algorithm_iterations int, time_s double")
    here, there = regression.fit_models(df, [])[()], regression.fit_models(df, [], limit=899)[()]
    assert here.removed == there.removed and there.metrics == pytest.approx(here.metrics, rel=1e-3)
    some = rng.integers(1, 9, 50), rng.integers(100, 99_000, 50), rng.integers(1, 6, 50), rng.integers(1, 21, 50)
    assert there.predict(*some) == pytest.approx(here.predict(*some), rel=1e-3)

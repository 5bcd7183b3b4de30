"""Clustering against plain numpy versions, invariants and hand-checked cases."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.operators import gmm, hdbscan, kmeans

SF = "/root/testdata/sf0.01"


def frame(spark, x, partitions=4):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>").repartition(partitions)


def blobs(n, d, k, seed=0, spread=1.0):
    draw = np.random.default_rng(seed)
    centers = draw.uniform(-10, 10, (k, d))
    return centers[np.arange(n) % k] + spread * draw.standard_normal((n, d))


def plain_lloyd(x, c, max_iter=300, tol=1e-4):
    tolerance, last, it, strict = tol * x.var(0).mean(), None, 0, False
    while it < max_iter:
        d2 = ((x[:, None] - c) ** 2).sum(2)
        k = d2.argmin(1)
        sums, n = np.array([x[k == i].sum(0) for i in range(len(c))]), np.bincount(k, minlength=len(c))
        own = d2[np.arange(len(x)), k]
        repaired = False
        if (n == 0).any() and own.max() > 0:
            repaired = True
            far = np.lexsort((np.arange(len(x)), -own))
            for i, p in zip(np.flatnonzero(n == 0), far):
                sums[k[p]] -= x[p]
                n[k[p]] -= 1
                sums[i], n[i] = x[p], 1
        moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        shift = ((moved - c) ** 2).sum()
        it += 1
        stop = last is not None and (k == last).all() and not repaired
        c, last = moved, k
        if stop:
            strict = True
            break
        if shift <= tolerance:
            break
    if not strict:
        last = ((x[:, None] - c) ** 2).sum(2).argmin(1)
    return c, last, it


@pytest.mark.parametrize(("n", "d", "k", "partitions"), [(200, 3, 4, 1), (201, 5, 7, 4), (60, 2, 60, 7), (50, 2, 1, 3)])
def test_lloyd(spark, n, d, k, partitions):
    x = blobs(n, d, max(2, k), spread=3.0)
    start = x[:k]
    made = kmeans.lloyd(frame(spark, x, partitions), start)
    c, labels, it = plain_lloyd(x, start)
    assert made.iterations == it and np.allclose(made.centers, c)
    got = {r.id: r.k for r in made.assigned.collect()}
    assert [got[i] for i in range(n)] == labels.tolist()
    assert made.inertia == pytest.approx(((x - c[labels]) ** 2).sum())
    assert all(b <= a + 1e-9 for a, b in itertools.pairwise(made.history))


def test_lloyd_on_arrow_batches(spark, monkeypatch):
    x = blobs(150, 4, 5, spread=2.0)
    points = frame(spark, x)
    want = kmeans.lloyd(points, x[:5])
    monkeypatch.setattr("tessera.plans.EXPRESSION_CONSTANTS", 1)
    made = kmeans.lloyd(points, x[:5])
    assert made.iterations == want.iterations and np.allclose(made.centers, want.centers) and made.inertia == pytest.approx(want.inertia)
    assert sorted((r.id, r.k) for r in made.assigned.collect()) == sorted((r.id, r.k) for r in want.assigned.collect())


def test_two_triples_and_a_tie(spark):
    x = np.array([[0, 0], [0, 1], [1, 0], [10, 10], [10, 11], [11, 10.0]])
    made = kmeans.lloyd(frame(spark, x), [[0, 0], [10, 10.0]])
    assert made.iterations == 2 and np.allclose(made.centers, [[1 / 3, 1 / 3], [31 / 3, 31 / 3]]) and made.counts.tolist() == [3, 3]
    tie = kmeans.assign(frame(spark, [[5.0]]), [[6.0], [4.0], [4.0]]).first()
    assert (tie.k, tie.d2) == (0, 1.0)
    assert kmeans.assign(frame(spark, [[5.0]]), [[6.0], [4.0]], expressions=False).first().k == 0


def test_repair_keeps_labels(spark):
    x = np.array([[0.0], [1.0], [2.0], [9.0]])
    made = kmeans.lloyd(frame(spark, x), [[0.0], [100.0], [200.0]], max_iter=1, tol=0)
    c, _, _ = plain_lloyd(x, np.array([[0.0], [100.0], [200.0]]), max_iter=1, tol=0)
    assert np.allclose(made.centers, c) and np.allclose(c, [[0.5], [9.0], [2.0]])
    same = kmeans.lloyd(frame(spark, [[1.0]] * 4), [[1.0], [1.0]])
    assert same.counts.tolist() == [4, 0] and same.inertia == 0


@pytest.mark.parametrize("k", [0, 5])
def test_wrong_cluster_counts(spark, k):
    with pytest.raises(ValueError):
        kmeans.lloyd(frame(spark, blobs(4, 2, 2)), np.zeros((k, 2)))


def test_plus_plus(spark):
    x = blobs(300, 2, 4, spread=0.1)
    for partitions in (1, 5):
        centers, ids = kmeans.greedy_plus_plus(frame(spark, x, partitions), 4, seed=3)
        assert np.allclose(centers, x[ids]) and len({i % 4 for i in ids}) == 4
    again, _ = kmeans.greedy_plus_plus(frame(spark, x, 5), 4, seed=3)
    assert np.allclose(again, centers)
    _, ids = kmeans.greedy_plus_plus(frame(spark, [[1.0, 1.0]] * 3), 3)
    assert len(ids) == 3


def test_prefix_sums(spark):
    w = np.random.default_rng(0).random(101)
    made = kmeans.prefix_sums(spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "id long, w double"), 5).orderBy("id").collect()
    assert np.allclose([r.upto for r in made], np.cumsum(w))


def plain_em(x, m, max_iter, tol, reg):
    bounds = []
    w, mu, prec = m.weights, m.means, m.precisions
    for _ in range(max_iter):
        now = gmm.Mixture(m.covariance, w, mu, prec)
        s = now.log_scores(x)
        top = s.max(1, keepdims=True)
        lse = top[:, 0] + np.log(np.exp(s - top).sum(1))
        r = np.exp(s - lse[:, None])
        bounds.append(lse.mean())
        nk = r.sum(0) + 10 * np.finfo(np.float32).eps
        mu = r.T @ x / nk[:, None]
        cov = []
        for i in range(len(nk)):
            diff = x - mu[i]
            full = (r[:, i, None] * diff).T @ diff / nk[i]
            cov.append(full + reg * np.eye(x.shape[1]) if m.covariance == "full" else np.diag(full) + reg if m.covariance == "diag" else np.diag(full).mean() + reg)
        cov = np.array(cov)
        w = nk / nk.sum()
        prec = np.linalg.inv(cov) if m.covariance == "full" else 1 / cov
        if len(bounds) > 1 and abs(bounds[-1] - bounds[-2]) < tol:
            break
    return w, mu, prec, bounds


@pytest.mark.parametrize("covariance", gmm.COVARIANCES)
@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_mixture(spark, covariance, offset):
    x = blobs(203, 3, 3, spread=1.5) + offset
    points = frame(spark, x)
    start = gmm.start_from_centers(points, x[:3], covariance)
    w, mu, prec, bounds = plain_em(x, start, 30, 1e-3, 1e-6)
    made = gmm.fit(points, start, 30)
    assert made.iterations == len(bounds) and np.allclose(made.lower_bounds, bounds, atol=1e-6)
    assert np.allclose(made.mixture.weights, w, atol=1e-6) and np.allclose(made.mixture.means, mu, rtol=1e-5, atol=1e-5) and np.allclose(made.mixture.precisions, prec, rtol=1e-3)
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(made.lower_bounds)) and made.mixture.weights.sum() == pytest.approx(1)
    r = gmm.predict(points, made.mixture).collect()
    assert all(sum(x.responsibilities) == pytest.approx(1) for x in r)


def test_mixture_edges(spark):
    points = frame(spark, blobs(20, 2, 2))
    start = gmm.start_from_centers(points, blobs(2, 2, 2), "diag")
    assert gmm.fit(points, start, 0).mixture is start
    with pytest.raises(ValueError):
        gmm.fit(points, start, -1)
    with pytest.raises(ValueError):
        gmm.start_from_centers(points, [[0.0, 0.0], [1e9, 1e9]], "diag")
    with pytest.raises(ValueError):
        gmm.Mixture("diag", np.array([1.0, 0.0]), np.zeros((2, 2)), np.ones((2, 2)))
    with pytest.raises(ValueError):
        gmm.precisions_of(np.array([[1.0, 0.0]]), "diag")
    with pytest.raises(ValueError):
        gmm.precisions_of(np.array([[[1.0, 2.0], [2.0, 1.0]]]), "full")


def test_diagonal_score_is_the_density(spark):
    x = blobs(5, 3, 2)
    m = gmm.Mixture("diag", np.array([0.3, 0.7]), blobs(2, 3, 2, 1), np.random.default_rng(0).random((2, 3)) + 0.5)
    scores = F.array(*(vectors.diagonal_score(F.col("x"), vectors.score_constant(m.weights[i], m.precisions[i], m.means[i], "diag"), m.means[i], m.precisions[i]) for i in range(2)))
    rows = frame(spark, x).select("id", scores.alias("s"), vectors.responsibilities(scores).alias("r"), vectors.log_sum_exp(scores).alias("l")).orderBy("id").collect()
    r, log_p = gmm.shares(m.log_scores(x))
    assert np.allclose([q.s for q in rows], m.log_scores(x)) and np.allclose([q.r for q in rows], r) and np.allclose([q.l for q in rows], log_p)


def plain_mst_weight(w):
    n, total, seen, best = len(w), [], {0}, dict(enumerate(w[0]))
    while len(seen) < n:
        v = min((i for i in range(n) if i not in seen), key=lambda i: best[i])
        total.append(best[v])
        seen.add(v)
        best = {i: min(best[i], w[v][i]) for i in range(n)}
    return sorted(total)


@pytest.mark.parametrize("block", [7, 1000])
def test_density_stages(spark, block):
    x = np.concatenate([blobs(41, 2, 3, spread=0.3), [[0.5, 0.5]] * 3])
    points = frame(spark, x)
    n = len(x)
    d2 = ((x[:, None] - x) ** 2).sum(2)
    pairs = {(r.i, r.j): r.d2 for r in hdbscan.pairwise(points, block).collect()}
    assert set(pairs) == {(i, j) for i in range(n) for j in range(i + 1, n)} and all(v == pytest.approx(d2[i, j]) for (i, j), v in pairs.items())
    core = hdbscan.core_distances(points, 4, block)
    want = np.sort(d2, 1)[:, 3]
    assert all(r.core2 == pytest.approx(want[r.id]) for r in core.collect())
    reach = np.maximum(np.maximum(d2, want[:, None]), want)
    got = {(r.i, r.j): r.w2 for r in hdbscan.mutual_reachability(hdbscan.pairwise(points, block), core).collect()}
    assert all(v == pytest.approx(reach[i, j]) for (i, j), v in got.items())
    weights = plain_mst_weight(reach)
    edges = hdbscan.spanning_tree(points, core)
    assert np.allclose(sorted(edges["w2"]), weights) and edges["u"].iloc[0] == 0 and (edges["u"].iloc[1:].to_numpy() == edges["v"].iloc[:-1].to_numpy()).all()
    assert np.allclose(sorted(hdbscan.spanning_tree(points, core, limit=1, block=block)["w2"]), weights)
    tree = hdbscan.single_linkage(edges, np.arange(n))
    assert len(tree) == n - 1 and tree["size"].iloc[-1] == n and (np.diff(tree["dist"]) >= 0).all()


@pytest.mark.parametrize(("n", "block"), [(2, 5), (90, 13)])
def test_both_ways_to_the_tree_give_the_same_rows(spark, n, block):
    points = frame(spark, blobs(n, 3, 4, seed=9))  # no equal weights: the core distance is that to the nearest neighbour
    core = hdbscan.core_distances(points, 2)
    grown, found = hdbscan.spanning_tree(points, core), hdbscan.spanning_tree(points, core, limit=1, block=block)
    assert grown[["u", "v"]].equals(found[["u", "v"]]) and np.allclose(grown["w2"], found["w2"])
    assert hdbscan.single_linkage(grown, np.arange(n))[["left", "right", "size"]].equals(hdbscan.single_linkage(found, np.arange(n))[["left", "right", "size"]])


def test_equal_weights_give_the_same_levels(spark):
    grid = [[float(a), float(b)] for a in range(6) for b in range(5)]
    points = frame(spark, grid)
    core = hdbscan.core_distances(points, 4)
    grown, found = (hdbscan.spanning_tree(points, core, limit=limit, block=7) for limit in (100, 1))
    assert sorted(grown["w2"]) == sorted(found["w2"]) and set(grown["v"]) == set(found["v"]) == set(range(1, 30))
    assert (found["u"].iloc[1:].to_numpy() == found["v"].iloc[:-1].to_numpy()).all()
    a, b = (hdbscan.single_linkage(t, np.arange(30)) for t in (grown, found))
    assert a["dist"].tolist() == b["dist"].tolist()


def test_density_clusters(spark):
    x = np.concatenate([blobs(60, 2, 3, seed=4, spread=0.2), [[50.0, 50.0]]])
    rows = {r.id: r for r in hdbscan.hdbscan(frame(spark, x), 5).collect()}
    groups = [{rows[i].label for i in range(60) if i % 3 == g} for g in range(3)]
    assert all(len(g - {-1}) == 1 for g in groups) and len(set.union(*groups) - {-1}) == 3 and rows[60].label == -1 and rows[60].probability == 0
    assert all(0 <= r.probability <= 1 for r in rows.values())
    far = {r.id: r.label for r in hdbscan.hdbscan(frame(spark, x), 5, limit=10).collect()}
    assert {(rows[i].label, far[i]) for i in rows if rows[i].label >= 0}.__len__() == 3


def test_density_edges(spark):
    x = blobs(12, 2, 2)
    for m in (1, 13):
        with pytest.raises(ValueError):
            hdbscan.core_distances(frame(spark, x), m)
    one = hdbscan.hdbscan(frame(spark, np.random.default_rng(1).standard_normal((12, 2))), 12).collect()
    assert all(r.label == -1 for r in one)  # the root is no cluster
    same = hdbscan.hdbscan(frame(spark, [[1.0, 1.0]] * 6 + [[9.0, 9.0]] * 6), 3).collect()
    assert all(not math.isnan(r.probability) for r in same)


def test_condense_by_hand():
    import pandas as pd

    # two pairs at distance 1, joined at 4, and a far point at 8
    tree = pd.DataFrame([(0, 1, 1.0, 2), (2, 3, 1.0, 2), (5, 6, 4.0, 4), (4, 7, 8.0, 5)], columns=["left", "right", "dist", "size"])
    points, clusters = hdbscan.condense(tree, 2)
    assert points == {4: (5, 1 / 8), 0: (6, 1.0), 1: (6, 1.0), 2: (7, 1.0), 3: (7, 1.0)}
    assert {c: (x.parent, x.birth, x.size, x.stability) for c, x in clusters.items()} == {5: (-1, 0.0, 5, 1 / 8 + 2 * 2 / 4), 6: (5, 0.25, 2, 1.5), 7: (5, 0.25, 2, 1.5)}
    labels, probabilities = hdbscan.label_points(tree, 2)
    assert labels.tolist() == [0, 0, 1, 1, -1] and probabilities.tolist() == [1, 1, 1, 1, 0]


def test_checked_vectors(spark):
    good = spark.createDataFrame([([1.0, 2.0],)], "x array<float>")
    assert vectors.checked(good, dimensions=2).first().x == [1.0, 2.0]
    for bad in ([1.0], [1.0, None], [1.0, float("nan")], [1.0, float("inf")], None):
        with pytest.raises(Exception):
            vectors.checked(spark.createDataFrame([(bad,)], "x array<double>"), dimensions=2).collect()

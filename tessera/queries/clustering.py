"""Clustering of the embeddings table. The starting centers are the vectors with vec_id below CLUSTERS."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import sq_distance
from tessera.operators import gmm, hdbscan, kmeans
from tessera.plans import cut_lineage
from tessera.queries.catalogue import Catalogue, table
from tessera.sources import datasets

CLUSTERS, MIN_SAMPLES, TOLERANCE, REG = 5, 5, 1e-4, 1e-6
query = Catalogue()


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.from_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def first_centers(found: DataFrame, count: int = CLUSTERS, start: int = 0) -> np.ndarray:
    """The vectors with the ids from start on: count rows."""
    return np.array([r.x for r in found.filter(F.col("id").between(start, start + count - 1)).orderBy("id").collect()])


def cells(found: DataFrame, vector: str, name: str, *keys: str) -> DataFrame:
    """One row for each dimension of a vector."""
    return found.select(*keys, F.posexplode(vector).alias("dim", name)).withColumns({"dim": F.col("dim").cast("long"), name: F.round(name, 6)})


def matrix_rows(spark: SparkSession, values: np.ndarray) -> DataFrame:
    """k, x of a small matrix."""
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(values)], "k long, x array<double>")


# SQL pieces: p holds the points, c the centers, near the assignment
P = "p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


def d2(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


def near(centers: str, name: str) -> str:
    """CTE name(id, x, k, d2): the nearest row of a CTE centers(k, x)."""
    return f"""{name} AS (SELECT id, x, k, d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, k) AS n FROM
  (SELECT p.id, p.x, c.k, {d2('p.x', 'c.x')} AS d2 FROM p, {centers} c)) WHERE n = 1)"""


def moved(assigned: str, name: str) -> str:
    """CTE name(k, x): the means of a CTE's clusters."""
    return f"""{name} AS (SELECT k, list(v ORDER BY dim) AS x FROM (SELECT k, dim, avg(v) AS v FROM
  (SELECT k, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS dim FROM {assigned}) GROUP BY k, dim) GROUP BY k)"""


C0 = f"c0 AS (SELECT id AS k, x FROM p WHERE id < {CLUSTERS})"
START = f"WITH {P}, {C0}, {near('c0', 'a1')}"


@query(f"{START} SELECT id AS vec_id, CAST(k AS BIGINT) AS k, round(d2, 6) AS d2 FROM a1")
def nearest_centroid_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = points(spark, sf_dir)
    return kmeans.assign(found, first_centers(found)).select(F.col("id").alias("vec_id"), F.col("k").cast("long").alias("k"), F.round("d2", 6).alias("d2"))


@query(f"{START} SELECT CAST(k AS BIGINT) AS k, count(*) AS n, round(sum(d2), 6) AS inertia FROM a1 GROUP BY k")
def cluster_inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = points(spark, sf_dir)
    centers = first_centers(found)
    return kmeans.cluster_stats(kmeans.assign(found, centers), centers.shape[1]).select(F.col("k").cast("long").alias("k"), "n", F.round("inertia", 6).alias("inertia"))


CELLS = "SELECT CAST(k AS BIGINT) AS k, CAST(generate_subscripts(x, 1) - 1 AS BIGINT) AS dim, round(unnest(x), 6) AS value FROM "


@query(f"{START}, {moved('a1', 'c1')} {CELLS} c1")
def centroid_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = points(spark, sf_dir)
    centers = first_centers(found)
    stats = kmeans.cluster_stats(kmeans.assign(found, centers), centers.shape[1])
    means = stats.select(F.col("k").cast("long").alias("k"), F.transform("sums", lambda s: s / F.col("n")).alias("x"))
    return cells(means, "x", "value", "k")


def _lloyd_sql(rounds: int) -> str:
    parts = [START, moved("a1", "c1")]
    for t in range(2, rounds + 1):
        parts += [near(f"c{t - 1}", f"a{t}"), moved(f"a{t}", f"c{t}")]
    return ", ".join(parts) + f" {CELLS} c{rounds}"


def _lloyd_rounds(rounds: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = points(spark, sf_dir)
        made = kmeans.lloyd(found, first_centers(found), rounds, 0.0)
        return cells(matrix_rows(spark, made.centers), "x", "value", "k")

    run.__name__ = f"lloyd_iter{rounds}"
    return query(_lloyd_sql(rounds))(run)


for _rounds in (1, 2, 3):
    _lloyd_rounds(_rounds)


@query(f"WITH {P} SELECT round({TOLERANCE} * avg(v), 9) AS tolerance FROM (SELECT dim, var_pop(v) AS v FROM (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM p) GROUP BY dim)")
def scaled_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = points(spark, sf_dir)
    return spark.createDataFrame([(round(kmeans.scaled_tolerance(found, first_centers(found, 1).shape[1], TOLERANCE), 9),)], "tolerance double")


@query(f"WITH {P} SELECT CAST(dim AS BIGINT) AS dim, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance FROM (SELECT unnest(x) AS v, generate_subscripts(x, 1) - 1 AS dim FROM p) GROUP BY dim")
def dimension_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = points(spark, sf_dir)
    _, mean, variance = kmeans.dimension_stats(found, first_centers(found, 1).shape[1])
    return spark.createDataFrame([(i, round(float(m), 6), round(float(v), 6)) for i, (m, v) in enumerate(zip(mean, variance))], "dim long, mean double, variance double")


@query(
    f"""WITH RECURSIVE {P}, cells AS (SELECT generate_subscripts(x, 1) AS d, unnest(x) AS v FROM p), bound AS (SELECT {TOLERANCE} * avg(var) AS tol FROM (SELECT var_pop(v) AS var FROM cells GROUP BY d)),
start AS (SELECT list(x ORDER BY id) AS xs FROM p), fit AS (SELECT 0 AS n, xs, list_slice(xs, 1, {CLUSTERS}) AS c, list_transform(xs, lambda x: CAST(-1 AS BIGINT)) AS ks, false AS done FROM start
UNION ALL SELECT n + 1, xs, moved, now, ks = now OR list_sum(list_transform(moved, lambda m, i: list_distance(m, c[i]) ** 2)) <= (SELECT tol FROM bound) FROM
  (SELECT *, list_transform(c, lambda o, k: list_transform(o, lambda z, d: list_avg(list_transform(list_filter(xs, lambda x, i: now[i] = k - 1), lambda x: x[d])))) AS moved FROM
    (SELECT *, list_transform(xs, lambda x: CAST(list_position(list_transform(c, lambda o: list_distance(x, o)), list_min(list_transform(c, lambda o: list_distance(x, o)))) - 1 AS BIGINT)) AS now FROM fit WHERE NOT done AND n < 300))),
last_ AS (SELECT * FROM fit WHERE done), ends AS (SELECT p.id, n, list_transform(c, lambda o: list_distance(x, o) ** 2) AS d2 FROM p, last_)
SELECT id AS vec_id, CAST(list_position(d2, list_min(d2)) - 1 AS INT) AS k, round(list_min(d2), 6) AS d2, CAST(n AS INT) AS iterations FROM ends"""
)
def lloyd_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = points(spark, sf_dir)
    made = kmeans.lloyd(found, first_centers(found))
    return made.assigned.select(F.col("id").alias("vec_id"), "k", F.round("d2", 6).alias("d2"), F.lit(made.iterations).alias("iterations"))


@query(f"{START} SELECT id AS vec_id, CAST(k AS BIGINT) AS k, round(d2, 6) AS d2 FROM a1 ORDER BY a1.d2 DESC, id LIMIT 7")
def empty_cluster_farthest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = points(spark, sf_dir)
    rows = kmeans.farthest(kmeans.assign(found, first_centers(found)), 7)
    return spark.createDataFrame([(i, k, round(d, 6)) for i, _, k, d in rows], "vec_id long, k long, d2 double")


@query(
    f"""WITH {P}, chosen AS (SELECT p.id, p.x, min({d2('p.x', 'c.x')}) AS d2 FROM p, p c WHERE c.id < 2 GROUP BY p.id, p.x)
SELECT c.id AS candidate, round(sum(least(chosen.d2, {d2('chosen.x', 'c.x')})), 6) AS cost FROM chosen, p c WHERE c.id BETWEEN 10 AND 14 GROUP BY c.id"""
)
def kmeanspp_candidate_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = points(spark, sf_dir)
    costs = kmeans.candidate_costs(found, first_centers(found, 2), first_centers(found, 5, 10))
    return spark.createDataFrame([(10 + i, round(float(c), 6)) for i, c in enumerate(costs)], "candidate long, cost double")


@query(f"WITH {P}, w AS (SELECT p.id, {d2('p.x', 'c.x')} AS w FROM p, p c WHERE c.id = 0) SELECT id AS vec_id, round(sum(w) OVER (ORDER BY id), 6) AS upto FROM w")
def kmeanspp_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = points(spark, sf_dir)
    weighted = kmeans.assign(found, first_centers(found, 1)).select("id", F.col("d2").alias("w"))
    return kmeans.prefix_sums(weighted).select(F.col("id").alias("vec_id"), F.round("upto", 6).alias("upto"))


@query()
def kmeanspp_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ids = kmeans.greedy_plus_plus(points(spark, sf_dir), CLUSTERS)
    return spark.createDataFrame(list(enumerate(ids)), "k long, vec_id long")


N0 = "n0 AS (SELECT k, count(*) AS n FROM a1 GROUP BY k)"
# moments about the given centers, by dimension
V0 = "v0 AS (SELECT k, dim, avg((v - m) * (v - m)) AS v FROM (SELECT a.k, unnest(a.x) AS v, unnest(c0.x) AS m, generate_subscripts(a.x, 1) - 1 AS dim FROM a1 a JOIN c0 ON a.k = c0.k) GROUP BY k, dim)"


@query(f"{START}, {N0} SELECT CAST(k AS BIGINT) AS k, round(n / (SELECT sum(n) FROM n0), 9) AS weight FROM n0")
def gmm_init_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = gmm.start_from_centers(found := points(spark, sf_dir), first_centers(found), "spherical", REG)
    return spark.createDataFrame([(i, round(float(w), 9)) for i, w in enumerate(made.weights)], "k long, weight double")


@query(f"{START}, {V0} SELECT CAST(k AS BIGINT) AS k, CAST(dim AS BIGINT) AS dim, round(1 / (v + {REG}), 6) AS value FROM v0")
def gmm_init_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = gmm.start_from_centers(found := points(spark, sf_dir), first_centers(found), "diag", REG)
    return cells(matrix_rows(spark, made.precisions), "x", "value", "k")


@query(f"{START}, {V0} SELECT CAST(k AS BIGINT) AS k, round(1 / (avg(v) + {REG}), 6) AS value FROM v0 GROUP BY k")
def gmm_init_spherical(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = gmm.start_from_centers(found := points(spark, sf_dir), first_centers(found), "spherical", REG)
    return spark.createDataFrame([(i, round(float(p), 6)) for i, p in enumerate(made.precisions)], "k long, value double")


@query(
    f"""{START}, u AS (SELECT a.k, a.id, unnest(a.x) - unnest(c0.x) AS v, generate_subscripts(a.x, 1) - 1 AS dim FROM a1 a JOIN c0 ON a.k = c0.k)
SELECT CAST(a.k AS BIGINT) AS k, CAST(a.dim AS BIGINT) AS i, CAST(b.dim AS BIGINT) AS j, round(avg(a.v * b.v) + CASE WHEN a.dim = b.dim THEN {REG} ELSE 0 END, 6) AS value
FROM u a JOIN u b ON a.id = b.id AND a.dim <= b.dim GROUP BY a.k, a.dim, b.dim"""
)
def gmm_init_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = gmm.start_from_centers(found := points(spark, sf_dir), first_centers(found), "full", REG)
    rows = spark.createDataFrame([(k, i, [float(v) for v in row]) for k, c in enumerate(made.covariances) for i, row in enumerate(c)], "k long, i long, x array<double>")
    return cells(rows, "x", "value", "k", "i").withColumnRenamed("dim", "j").filter("i <= j").select("k", "i", "j", "value")


# one expectation step of the diagonal start: scores s, responsibilities r
RESPONSIBILITIES = f"""{START}, {N0}, {V0},
const AS (SELECT v0.k, ln(any_value(n0.n) / (SELECT sum(n) FROM n0)) - 0.5 * sum(ln(v + {REG})) - 0.5 * count(*) * ln(2 * pi()) AS c, list(1 / (v + {REG}) ORDER BY dim) AS prec FROM v0 JOIN n0 ON v0.k = n0.k GROUP BY v0.k),
s AS (SELECT p.id, p.x, c0.k, const.c - 0.5 * list_sum(list_transform(range(1, len(p.x) + 1), lambda i: const.prec[i] * (p.x[i] - c0.x[i]) * (p.x[i] - c0.x[i]))) AS s FROM p, c0 JOIN const ON c0.k = const.k),
t AS (SELECT id, max(s) AS top FROM s GROUP BY id),
l AS (SELECT s.id, any_value(t.top) + ln(sum(exp(s - top))) AS l FROM s JOIN t ON s.id = t.id GROUP BY s.id),
r AS (SELECT s.id, s.x, s.k, exp(s.s - l.l) AS r, l.l FROM s JOIN l ON s.id = l.id)"""


@query(f"{RESPONSIBILITIES} SELECT id AS vec_id, CAST(k AS BIGINT) AS k, round(r, 6) AS responsibility, round(l, 6) AS log_p FROM r")
def gmm_estep_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = points(spark, sf_dir)
    made = gmm.predict(found, gmm.start_from_centers(found, first_centers(found), "diag", REG))
    return made.select(F.col("id").alias("vec_id"), F.posexplode("responsibilities").alias("k", "r"), "log_p").select("vec_id", F.col("k").cast("long").alias("k"), F.round("r", 6).alias("responsibility"), F.round("log_p", 6).alias("log_p"))


@query(
    f"""{RESPONSIBILITIES}, e AS (SELECT k, r, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS dim FROM r),
nk AS (SELECT k, sum(r) + 10 * 1.1920928955078125e-07 AS nk FROM r GROUP BY k),
m AS (SELECT e.k, dim, sum(r * v) / any_value(nk.nk) AS mean FROM e JOIN nk ON e.k = nk.k GROUP BY e.k, dim)
SELECT CAST(e.k AS BIGINT) AS k, CAST(e.dim AS BIGINT) AS dim, round(any_value(nk.nk) / (SELECT sum(nk) FROM nk), 6) AS weight, round(any_value(m.mean), 6) AS mean,
  round(sum(r * (v - mean) * (v - mean)) / any_value(nk.nk) + {REG}, 6) AS variance
FROM e JOIN m ON e.k = m.k AND e.dim = m.dim JOIN nk ON e.k = nk.k GROUP BY e.k, e.dim"""
)
def gmm_mstep_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = points(spark, sf_dir)
    m = gmm.fit(found, gmm.start_from_centers(found, first_centers(found), "diag", REG), 1, reg=REG).mixture
    rows = [(k, d, round(float(m.weights[k]), 6), round(float(m.means[k, d]), 6), round(float(m.covariances[k, d]), 6)) for k in range(len(m.weights)) for d in range(m.means.shape[1])]
    return spark.createDataFrame(rows, "k long, dim long, weight double, mean double, variance double")


def _gmm_fit(covariance: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = points(spark, sf_dir)
        made = gmm.fit(found, gmm.start_from_centers(found, first_centers(found), covariance, 1e-2), reg=1e-2)
        return gmm.predict(found, made.mixture).select(F.col("id").alias("vec_id"), "k", "log_p", F.lit(made.iterations).alias("iterations"))

    run.__name__ = f"gmm_fit_{covariance}"
    return query()(run)


for _covariance in gmm.COVARIANCES:
    _gmm_fit(_covariance)

D2 = f"pairs AS MATERIALIZED (SELECT a.id AS i, b.id AS j, {d2('a.x', 'b.x')} AS d2 FROM p a JOIN p b ON a.id < b.id)"
CORE = f"core AS MATERIALIZED (SELECT id, d2 AS core2 FROM (SELECT id, d2, row_number() OVER (PARTITION BY id ORDER BY d2) AS n FROM (SELECT i AS id, d2 FROM pairs UNION ALL SELECT j, d2 FROM pairs UNION ALL SELECT id, 0.0 FROM p)) WHERE n = {MIN_SAMPLES})"


@query(f"WITH {P}, {D2} SELECT i, j, round(d2, 6) AS d2 FROM pairs")
def pairwise_sq_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hdbscan.pairwise(points(spark, sf_dir), digits=6)


@query(f"WITH {P}, {D2}, {CORE} SELECT id AS vec_id, round(core2, 6) AS core2 FROM core")
def core_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hdbscan.core_distances(points(spark, sf_dir), MIN_SAMPLES).select(F.col("id").alias("vec_id"), F.round("core2", 6).alias("core2"))


@query(f"WITH {P}, {D2}, {CORE} SELECT i, j, round(greatest(d2, a.core2, b.core2), 6) AS w2 FROM pairs JOIN core a ON i = a.id JOIN core b ON j = b.id")
def mutual_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hdbscan.reachability(points(spark, sf_dir), MIN_SAMPLES, digits=6)


def _tree(spark: SparkSession, sf_dir: str) -> tuple[pd.DataFrame, np.ndarray]:
    found = points(spark, sf_dir)
    core, near = hdbscan.core_and_neighbours(found, MIN_SAMPLES)
    return hdbscan.spanning_tree(found, core, near=near), np.array(sorted(r.id for r in found.select("id").collect()))


@query(
    f"""WITH RECURSIVE {P}, {D2}, {CORE}, placed AS (SELECT id, row_number() OVER (ORDER BY id) AS pos FROM p), ids AS (SELECT list(id ORDER BY id) AS ids FROM p),
either AS (SELECT i, j, d2 FROM pairs UNION ALL SELECT j, i, d2 FROM pairs UNION ALL SELECT id, id, 0.0 FROM p),
reach AS MATERIALIZED (SELECT q.pos, list(greatest(d2, a.core2, b.core2) ORDER BY j) AS ws FROM either JOIN core a ON i = a.id JOIN core b ON j = b.id JOIN placed q ON i = q.id GROUP BY q.pos),
prim AS (SELECT 0 AS step, CAST(1 AS BIGINT) AS pos, CAST(1 AS BIGINT) AS former, 0.0::DOUBLE AS w2, list_transform(ids, lambda x: 'inf'::DOUBLE) AS best, list_transform(ids, lambda x: false) AS done FROM ids
UNION ALL SELECT step + 1, CAST(list_position(open_, list_min(open_)) AS BIGINT), pos, list_min(open_), best, done FROM
  (SELECT *, list_transform(best, lambda x, i: CASE WHEN done[i] THEN 'inf'::DOUBLE ELSE x END) AS open_ FROM
    (SELECT step, prim.pos, list_transform(best, lambda x, i: least(x, ws[i])) AS best, list_transform(done, lambda x, i: x OR i = prim.pos) AS done FROM prim JOIN reach ON reach.pos = prim.pos WHERE step < len(best) - 1)))
SELECT ids[former] AS u, ids[pos] AS v, round(w2, 6) AS w2, CAST(step - 1 AS BIGINT) AS step FROM prim, ids WHERE step > 0"""
)
def hdbscan_mst(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _ = _tree(spark, sf_dir)
    return spark.createDataFrame(edges.assign(step=range(len(edges)), w2=edges["w2"].round(6)), "u long, v long, w2 double, step long")


@query()
def hdbscan_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = hdbscan.single_linkage(*_tree(spark, sf_dir))
    return spark.createDataFrame(made.assign(row=range(len(made))), "left long, right long, dist double, size long, row long")


@query()
def hdbscan_condensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, clusters = hdbscan.condense(hdbscan.single_linkage(*_tree(spark, sf_dir)), MIN_SAMPLES)
    owner, label = hdbscan.select_clusters(clusters)
    return spark.createDataFrame([(c, x.parent, float(x.birth), x.size, float(x.stability), float(x.death), label.get(owner[c], -1)) for c, x in clusters.items()], "cluster long, parent long, birth double, size long, stability double, death double, label long")


@query()
def hdbscan_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hdbscan.hdbscan(points(spark, sf_dir), MIN_SAMPLES).withColumnRenamed("id", "vec_id")


@query()
def hdbscan_mst_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = points(spark, sf_dir)
    core, near = hdbscan.core_and_neighbours(found, MIN_SAMPLES, limit=0)
    edges = hdbscan.nearest_foreign_tree(found, core, near=near)
    return spark.createDataFrame(edges, "u long, v long, w2 double")


@query()
def synthetic_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.blobs(spark, 2000, 8, 10)


@query("SELECT c_custkey AS id, CAST(generate_subscripts(x, 1) - 1 AS BIGINT) AS dim, round(unnest(x), 6) AS value FROM (SELECT c_custkey, [c_acctbal, CAST(c_nationkey AS DOUBLE)] AS x FROM customer)")
def columns_to_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(datasets.from_columns(table(spark, sf_dir, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"]), "x", "value", "id")


@query(f"WITH {P}, {D2}, near AS (SELECT i AS id, j AS other, d2 FROM pairs UNION ALL SELECT j, i, d2 FROM pairs) SELECT id AS vec_id, other, round(d2, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS n FROM near) WHERE n = 3")
def third_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = hdbscan.nearest(points(spark, sf_dir), 3).filter("d2[2] < double('inf')")
    return near.select(F.col("id").alias("vec_id"), F.element_at("other", 3).alias("other"), F.round(F.element_at("d2", 3), 6).alias("d2"))


QUERIES, ORACLE_SQL = query.queries, query.sql

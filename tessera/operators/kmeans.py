"""k-means: assignment, Lloyd's iterations with repair of empty clusters, and greedy k-means++ seeding.

Points are rows (id BIGINT, x ARRAY<DOUBLE>). Centers are a small matrix on the driver, which goes to the tasks as constants.
Each iteration is one pass: partial sums by task, K rows back.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import nearest
from tessera.plans import cut_lineage, uses_expressions
from tessera.plans.shipping import ships


#: Rounds of seeding whose distances are cached one upon the other.
ROUNDS = 16


def matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    """The vectors of a batch as rows of a matrix."""
    column = batch[name]
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def sq_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """All squared distances by direct differences, one center at a time."""
    out = np.empty((len(x), len(centers)))
    for k, c in enumerate(centers):
        diff = x - c
        out[:, k] = np.einsum("ij,ij->i", diff, diff)
    return out


@ships
def assign(points: DataFrame, centers: np.ndarray, expressions: bool | None = None, before: np.ndarray | None = None) -> DataFrame:
    """id, x, k, d2: the nearest center (ties to the lowest k) and its squared distance; with before, changed as well: whether another of those centers was nearest.

    Small problems are planned as expressions inside the scan's stage, larger ones on Arrow batches.
    """
    centers = np.asarray(centers, float)
    if expressions if expressions is not None else uses_expressions(*centers.shape):
        found = points.select("id", "x", nearest(F.col("x"), centers).alias("n"))
        more = [] if before is None else [(nearest(F.col("x"), before)["k"] != F.col("n.k")).alias("changed")]
        return found.select("id", "x", F.col("n.k").alias("k"), F.col("n.d2").alias("d2"), *more)
    shared = points.sparkSession.sparkContext.broadcast((centers, before))

    def run(batches):
        centers, before = shared.value
        for batch in batches:
            x = matrix(batch) if batch.num_rows else np.zeros((0, centers.shape[1]))
            d2 = sq_distances(x, centers)
            k = d2.argmin(1)
            columns = [batch["id"], batch["x"], pa.array(k.astype(np.int32)), pa.array(d2[np.arange(len(k)), k])]
            if before is not None:
                columns.append(pa.array(sq_distances(x, before).argmin(1) != k))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "x", "k", "d2", "changed"][: len(columns)])

    return points.select("id", "x").mapInArrow(run, "id long, x array<double>, k int, d2 double" + (", changed boolean" if before is not None else ""))


def cluster_stats(assigned: DataFrame, dimensions: int) -> DataFrame:
    """k, n, inertia, sums (array), and changed (a count, if assigned has it): the aggregates of each cluster that has points. Sums combine on the map side."""
    sums = [F.sum(F.get("x", F.lit(d))).alias(f"s{d}") for d in range(dimensions)]
    more = [F.count_if("changed").alias("changed")] if "changed" in assigned.columns else []
    made = assigned.groupBy("k").agg(F.count("*").alias("n"), F.sum("d2").alias("inertia"), *more, *sums)
    return made.select("k", "n", "inertia", F.array(*(f"s{d}" for d in range(dimensions))).alias("sums"), *(["changed"] if more else []))


def iteration_stats(points: DataFrame, centers: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """k, n, inertia, changed, sums of each cluster that has points, in one pass: tasks assign, compare with the nearest of the centers before, and add up; K rows a task are shuffled."""
    shared, dimensions = points.sparkSession.sparkContext.broadcast((centers, before)), centers.shape[1]

    def run(batches):
        centers, before = shared.value
        every = np.arange(len(centers))
        n, inertia, changed, sums = np.zeros(len(centers), np.int64), np.zeros(len(centers)), np.zeros(len(centers), np.int64), np.zeros_like(centers)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch)
            d2 = sq_distances(x, centers)
            k = d2.argmin(1)
            n += np.bincount(k, minlength=len(every))
            inertia += np.bincount(k, d2[np.arange(len(k)), k], len(every))
            sums += (k == every[:, None]).astype(float) @ x
            moved = np.ones(len(k), bool) if before is None else sq_distances(x, before).argmin(1) != k
            changed += np.bincount(k[moved], minlength=len(every))
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(a[own]) for a in (every.astype(np.int32), n, inertia, changed)] + [pa.array(list(sums[own]), pa.list_(pa.float64()))], names=["k", "n", "inertia", "changed", "sums"])

    made = points.select("x").mapInArrow(run, "k int, n long, inertia double, changed long, sums array<double>")
    # as text, which is planned faster than as many columns
    made = made.groupBy("k").agg(*(F.expr(f"sum({c}) AS {c}") for c in ("n", "inertia", "changed")), *(F.expr(f"sum(sums[{d}]) AS s{d}") for d in range(dimensions)))
    return made.selectExpr("k", "n", "inertia", "changed", f"array({', '.join(f's{d}' for d in range(dimensions))}) AS sums")


def dimension_stats(points: DataFrame, dimensions: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and (population) variance of each dimension, in one pass."""
    aggregates = [F.expr(f"{f}(get(x, {d}))") for d in range(dimensions) for f in ("avg", "var_pop")]
    n, *row = points.agg(F.count("*"), *aggregates).first()
    return n, np.array(row[::2], float), np.array(row[1::2], float)


def scaled_tolerance(points: DataFrame, dimensions: int, tol: float) -> float:
    """tol times the mean variance of the dimensions."""
    return tol * float(dimension_stats(points, dimensions)[2].mean())


def farthest(assigned: DataFrame, count: int) -> list[tuple[int, np.ndarray, int, float]]:
    """The count points farthest from their own center, ties by id: (id, x, k, d2)."""
    rows = assigned.orderBy(F.desc("d2"), F.asc("id")).limit(count).collect()
    return [(r.id, np.array(r.x), r.k, r.d2) for r in rows]


def repair(sums: np.ndarray, counts: np.ndarray, assigned: DataFrame) -> bool:
    """Gives every empty cluster (ascending) one of the points farthest from their centers: moves the point's share of sum and count from its donor. Labels stay. Changes sums and counts; False if nothing was done (no empty cluster, or all distances are 0)."""
    empty = np.flatnonzero(counts == 0)
    if not len(empty):
        return False
    chosen = farthest(assigned, len(empty))
    if not chosen or chosen[0][3] == 0:
        return False
    for k, (_, x, donor, _) in zip(empty, chosen):
        sums[donor] -= x
        counts[donor] -= 1
        sums[k] = x
        counts[k] = 1
    return True


@dataclass
class LloydResult:
    """centers; assigned (id, x, k, d2 under the final centers); iterations; inertia; counts and inertia of each cluster."""

    centers: np.ndarray
    assigned: DataFrame
    iterations: int
    inertia: float
    counts: np.ndarray
    cluster_inertia: np.ndarray
    history: list[float]


def check_clusters(points: DataFrame, clusters: int) -> tuple[int, int]:
    """Number of points and dimensions; raises unless 1 <= clusters <= points."""
    first = points.select(F.size("x").alias("d")).first()
    n = points.count()
    if clusters < 1 or clusters > n:
        raise ValueError(f"{clusters} clusters of {n} points")
    return n, first.d


def update(centers: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Means of the clusters; one without points keeps its center."""
    moved = centers.copy()
    own = counts > 0
    moved[own] = sums[own] / counts[own, None]
    return moved


@ships
def lloyd(points: DataFrame, centers, max_iter: int = 300, tol: float = 1e-4) -> LloydResult:
    """Lloyd's iterations from given centers.

    An iteration assigns, repairs empty clusters and moves the centers. It was the last one if no label changed and nothing
    was repaired, or if the centers' squared shifts add up to at most the scaled tolerance; after the latter labels are made once more.
    The labels of the iteration before follow from its centers, so that none are stored, and an iteration is one pass.
    """
    centers = np.asarray(centers, float)
    _, dimensions = check_clusters(points, len(centers))
    points = points.select("id", "x").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        tolerance = scaled_tolerance(points, dimensions, tol)
        before, iterations, history = None, 0, []
        while iterations < max_iter:
            sums, counts, inertia, changed = np.zeros_like(centers), np.zeros(len(centers), int), 0.0, 0
            for r in sorted(iteration_stats(points, centers, before).collect()):
                sums[r.k], counts[r.k] = r.sums, r.n
                inertia += r.inertia
                changed += r.changed
            repaired = (counts == 0).any() and repair(sums, counts, assign(points, centers, expressions=False))
            moved = update(centers, sums, counts)
            shift = float(((moved - centers) ** 2).sum())
            before, centers = centers, moved
            iterations += 1
            history.append(inertia)
            if (changed == 0 and not repaired) or shift <= tolerance:
                break
        at_end = assign(points, centers, expressions=False)  # where no label changed, the centers have not either
        counts, own = np.zeros(len(centers), int), np.zeros(len(centers))
        for r in at_end.groupBy("k").agg(F.count("*").alias("n"), F.sum("d2").alias("inertia")).collect():
            counts[r.k], own[r.k] = r.n, r.inertia
        return LloydResult(centers, at_end, iterations, float(own.sum()), counts, own, history)
    finally:
        points.unpersist()


def prefix_sums(weighted: DataFrame, partitions: int | None = None) -> DataFrame:
    """id, w, upto: running sums of w in the order of id, in two levels: totals of range partitions give each its start. No task sorts more than one partition."""
    made = weighted.select("id", "w").repartitionByRange(partitions or weighted.sparkSession.sparkContext.defaultParallelism, "id").withColumn("_p", F.spark_partition_id())
    within = Window.partitionBy("_p").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    running = made.withColumn("_within", F.sum("w").over(within))
    totals = made.groupBy("_p").agg(F.sum("w").alias("_total"))
    before = totals.withColumn("_start", F.coalesce(F.sum("_total").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select("_p", "_start")
    return running.join(F.broadcast(before), "_p").select("id", "w", (F.col("_start") + F.col("_within")).alias("upto"))


@ships
def candidate_costs(points: DataFrame, chosen: np.ndarray | None, candidates: np.ndarray) -> np.ndarray:
    """For each candidate, the sum over all points of the squared distance to the nearest of it and the chosen centers, in one pass. If points has a column d2, that is the distance to the chosen ones."""
    shared = points.sparkSession.sparkContext.broadcast((chosen, candidates))
    known = "d2" in points.columns

    def run(batches):
        chosen, candidates = shared.value
        total = np.zeros(len(candidates))
        for batch in batches:
            x = matrix(batch)
            if len(x):
                d2 = sq_distances(x, candidates)
                if known:
                    d2 = np.minimum(d2, batch["d2"].to_numpy()[:, None])
                elif chosen is not None:
                    d2 = np.minimum(d2, sq_distances(x, chosen).min(1)[:, None])
                total += d2.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["c", "cost"])

    rows = points.select("x", *(["d2"] if known else [])).mapInArrow(run, "c int, cost double").groupBy("c").agg(F.sum("cost").alias("cost")).collect()
    out = np.zeros(len(candidates))
    for r in rows:
        out[r.c] = r.cost
    return out


def _nearer(points: DataFrame, center: np.ndarray) -> DataFrame:
    """id, x, d2: the least of d2 (if points has it) and the squared distance to one more center. Rows keep their partitions and order."""
    shared, known = points.sparkSession.sparkContext.broadcast(center[None]), "d2" in points.columns

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                d2 = sq_distances(matrix(batch), shared.value)[:, 0]
                yield pa.RecordBatch.from_arrays([batch["id"], batch["x"], pa.array(np.minimum(d2, batch["d2"].to_numpy()) if known else d2)], names=["id", "x", "d2"])

    return points.mapInArrow(run, "id long, x array<double>, d2 double")


def _drawn(points: DataFrame, at: np.ndarray) -> tuple[float, list[tuple[int, np.ndarray]]]:
    """The points whose running sum of squared distances d2, in the order of partitions and rows, first reaches a share of the total. points comes from the checkpoint folder, so that the order stays."""

    def weights(batch):
        return batch["d2"].to_numpy() if batch.num_rows else np.zeros(0)

    def totals(batches):
        part, total = -1, 0.0
        for batch in batches:
            if batch.num_rows:
                part = batch["_p"][0].as_py()
                total += float(weights(batch).sum())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total])], names=["p", "total"])

    numbered = points.withColumn("_p", F.spark_partition_id())
    rows = sorted((r.p, r.total) for r in numbered.select("_p", "d2").mapInArrow(totals, "p int, total double").collect() if r.p >= 0)
    starts = np.concatenate(([0.0], np.cumsum([t for _, t in rows])))
    whole = float(starts[-1])
    if whole <= 0:
        return 0.0, []
    wanted: dict[int, list[float]] = {}
    for share in at:
        i = min(int(np.searchsorted(starts[1:], share * whole, "left")), len(rows) - 1)
        wanted.setdefault(rows[i][0], []).append(share * whole - starts[i])

    def pick(batches):
        left = None
        done = 0.0
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            left = sorted(wanted[batch["_p"][0].as_py()]) if left is None else left
            upto = done + np.cumsum(weights(batch))
            found = []
            while left and upto[-1] >= left[0]:
                found.append(int(np.searchsorted(upto, left.pop(0), "left")))
            done, last = float(upto[-1]), batch.slice(batch.num_rows - 1, 1)
            yield batch.select(["id", "x"]).take(pa.array(found, pa.int64()))
        if left:  # rounding: the last point stands for what lies behind it
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([last["id"]] * len(left)), pa.concat_arrays([last["x"]] * len(left))], names=["id", "x"])

    found = numbered.filter(F.col("_p").isin(list(wanted))).select("_p", "id", "x", "d2").mapInArrow(pick, "id long, x array<double>").collect()
    return whole, [(r.id, np.array(r.x)) for r in found]


@ships
def greedy_plus_plus(points: DataFrame, clusters: int, trials: int = 0, seed: int = 42) -> tuple[np.ndarray, list[int]]:
    """Centers and their ids by greedy k-means++: the first uniform; then, of trials points drawn by squared distance, the one that lowers the cost most (the first of equal ones).

    trials 0 stands for 2 + floor(log clusters). Without any distance left, a point is drawn uniformly and may repeat. Each
    point carries its distance to the nearest center so far, which one more center can only lower, so that a round costs the
    same whatever their number. Every ROUNDS rounds the points are written anew.
    """
    n, _ = check_clusters(points, clusters)
    trials = trials or 2 + int(np.log(clusters))
    draw = np.random.default_rng(seed)
    points = cut_lineage(points.select("id", "x").repartitionByRange("id").sortWithinPartitions("id"))

    def uniform() -> tuple[int, np.ndarray]:
        sizes = sorted((r._p, r.n) for r in points.groupBy(F.spark_partition_id().alias("_p")).agg(F.count("*").alias("n")).collect())
        at = int(draw.integers(n))
        for p, size in sizes:
            if at < size:
                row = points.filter(F.spark_partition_id() == p).offset(at).limit(1).first()
                return row.id, np.array(row.x)
            at -= size
        raise RuntimeError("the points changed")

    first = uniform()
    ids, centers, held = [first[0]], [first[1]], None
    while len(centers) < clusters:
        away = _nearer(points if held is None else held, centers[-1])
        away = cut_lineage(away) if len(centers) % ROUNDS == 0 else away.persist(StorageLevel.MEMORY_AND_DISK)
        whole, found = _drawn(away, draw.random(trials))
        if held is not None:
            held.unpersist()
        held = away
        if whole <= 0:
            best = uniform()
        else:
            costs = candidate_costs(held, None, np.array([x for _, x in found]))
            best = found[int(costs.argmin())]
        ids.append(best[0])
        centers.append(best[1])
    if held is not None:
        held.unpersist()
    return np.array(centers), ids

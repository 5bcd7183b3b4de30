"""Gaussian mixtures by expectation maximisation, with spherical, diagonal or full covariance.

One pass an iteration: tasks add up responsibilities and the first and second moments about the components' present means,
which stay accurate far from the origin; K small rows come back, and the driver makes the new parameters.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.kmeans import assign, check_clusters, matrix
from tessera.plans.reduce import sum_vectors
from tessera.plans.shipping import ships

COVARIANCES = ("spherical", "diag", "full")
#: Added to each component's sum of responsibilities: ten times the distance from 1 to the next float32.
_RESERVE = 10 * float(np.finfo(np.float32).eps)


@dataclass(frozen=True)
class Mixture:
    """weights (K), means (K, D), precisions: (K), (K, D) or (K, D, D) by covariance."""

    covariance: str
    weights: np.ndarray
    means: np.ndarray
    precisions: np.ndarray
    covariances: np.ndarray | None = None

    def __post_init__(self) -> None:
        if self.covariance not in COVARIANCES:
            raise ValueError(f"covariance is one of {COVARIANCES}")
        if not len(self.weights) or (np.asarray(self.weights) <= 0).any():
            raise ValueError("weights must be positive")

    def log_scores(self, x: np.ndarray) -> np.ndarray:
        """log weight + log density, a row for each point."""
        k, d = self.means.shape
        out = np.empty((len(x), k))
        for i in range(k):
            diff, p = x - self.means[i], self.precisions[i]
            if self.covariance == "spherical":
                quadratic, log_det = p * np.einsum("ij,ij->i", diff, diff), d * np.log(p)
            elif self.covariance == "diag":
                quadratic, log_det = (diff * diff) @ p, np.log(p).sum()
            else:
                root = np.linalg.cholesky(p)
                turned = diff @ root
                quadratic, log_det = np.einsum("ij,ij->i", turned, turned), 2 * np.log(np.diag(root)).sum()
            out[:, i] = np.log(self.weights[i]) + 0.5 * (log_det - d * np.log(2 * np.pi) - quadratic)
        return out


def shares(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Responsibilities, and the log likelihood of each point."""
    top = scores.max(1, keepdims=True)
    p = np.exp(scores - top)
    whole = p.sum(1, keepdims=True)
    return p / whole, (top + np.log(whole))[:, 0]


def precisions_of(covariances: np.ndarray, covariance: str) -> np.ndarray:
    """Inverses; raises if a covariance isn't positive (definite)."""
    if covariance != "full":
        if not (covariances > 0).all():
            raise ValueError("covariance isn't positive: increase the regularisation")
        return 1 / covariances
    out = np.empty_like(covariances)
    for i, c in enumerate(covariances):
        if not symmetric(c):
            raise ValueError("covariance isn't symmetric")
        try:
            root = np.linalg.inv(np.linalg.cholesky(c))
        except np.linalg.LinAlgError:
            raise ValueError("covariance isn't positive definite: increase the regularisation") from None
        out[i] = root.T @ root
    return out


def symmetric(a: np.ndarray) -> bool:
    return bool((np.abs(a - a.T) <= 1e-8 + 1e-5 * np.minimum(np.abs(a), np.abs(a.T))).all())


@ships
def expectation(points: DataFrame, mixture: Mixture) -> tuple[int, float, np.ndarray, np.ndarray, np.ndarray]:
    """One pass: count, sum of log likelihoods, and for each component the sum of responsibilities and the first and second moments about its mean."""
    shared = points.sparkSession.sparkContext.broadcast(mixture)
    full = mixture.covariance == "full"

    def run(batches):
        m = shared.value
        k, d = m.means.shape
        n, likelihood, weight = 0, 0.0, np.zeros(k)
        first, second = np.zeros((k, d)), np.zeros((k, d, d) if full else (k, d))
        for batch in batches:
            x = matrix(batch)
            if not len(x):
                continue
            r, log_p = shares(m.log_scores(x))
            n += len(x)
            likelihood += float(log_p.sum())
            weight += r.sum(0)
            for i in range(k):
                diff = x - m.means[i]
                first[i] += r[:, i] @ diff
                second[i] += (diff * r[:, i : i + 1]).T @ diff if full else r[:, i] @ (diff * diff)
        if n:
            rows = [np.concatenate([[n if i == 0 else 0, likelihood if i == 0 else 0, weight[i]], first[i], second[i].ravel()]) for i in range(k)]
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["k", "v"])

    made = {r.k: np.frombuffer(r.v) for r in sum_vectors(points.select("x").mapInArrow(run, "k long, v binary")).collect()}
    k, d = mixture.means.shape
    moments = np.array([made[i] for i in range(k)])
    second = moments[:, 3 + d :]
    return int(moments[0, 0]), float(moments[0, 1]), moments[:, 2], moments[:, 3 : 3 + d], second.reshape(k, d, d) if full else second


def maximisation(mixture: Mixture, weight: np.ndarray, first: np.ndarray, second: np.ndarray, reg: float) -> Mixture:
    """New parameters from the moments about the old means."""
    nk = weight + _RESERVE
    means = (first + weight[:, None] * mixture.means) / nk[:, None]
    shift = means - mixture.means
    d = means.shape[1]
    if mixture.covariance == "full":
        cross = first[:, :, None] * shift[:, None, :]
        centred = second - cross - cross.transpose(0, 2, 1) + weight[:, None, None] * shift[:, :, None] * shift[:, None, :]
        covariances = centred / nk[:, None, None] + reg * np.eye(d)
    else:
        centred = (second - 2 * shift * first + weight[:, None] * shift * shift) / nk[:, None]
        covariances = centred + reg if mixture.covariance == "diag" else centred.mean(1) + reg
    return Mixture(mixture.covariance, nk / nk.sum(), means, precisions_of(covariances, mixture.covariance), covariances)


@dataclass
class FitResult:
    mixture: Mixture
    iterations: int
    lower_bounds: list[float]
    converged: bool


def fit(points: DataFrame, start: Mixture, max_iter: int = 100, tol: float = 1e-3, reg: float = 1e-6) -> FitResult:
    """Iterates until the mean log likelihood (under the parameters before the step) changes by less than tol. max_iter 0 returns the start; a negative one raises."""
    if max_iter < 0:
        raise ValueError("max_iter is negative")
    check_clusters(points, len(start.weights))
    points = points.select("x").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        mixture, bounds, converged = start, [], False
        while len(bounds) < max_iter and not converged:
            n, likelihood, *moments = expectation(points, mixture)
            mixture = maximisation(mixture, *moments, reg)
            bounds.append(likelihood / n)
            converged = len(bounds) > 1 and abs(bounds[-1] - bounds[-2]) < tol
        return FitResult(mixture, len(bounds), bounds, converged)
    finally:
        points.unpersist()


@ships
def predict(points: DataFrame, mixture: Mixture) -> DataFrame:
    """id, k (most probable component, ties to the lowest), responsibilities, log_p."""
    shared = points.sparkSession.sparkContext.broadcast(mixture)

    def run(batches):
        for batch in batches:
            x = matrix(batch)
            r, log_p = shares(shared.value.log_scores(x)) if len(x) else (np.zeros((0, 1)), np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(r.argmax(1).astype(np.int32)), pa.array(list(r), pa.list_(pa.float64())), pa.array(log_p)], names=["id", "k", "responsibilities", "log_p"])

    return points.select("id", "x").mapInArrow(run, "id long, k int, responsibilities array<double>, log_p double")


@ships
def start_from_centers(points: DataFrame, centers, covariance: str, reg: float = 1e-6) -> Mixture:
    """Weights, means and precisions from the points nearest to each center: shares n / N, the means as given, and covariances about them. A center without points raises."""
    centers = np.asarray(centers, float)
    k, d = centers.shape
    check_clusters(points, k)
    shared = points.sparkSession.sparkContext.broadcast(centers)
    full = covariance == "full"

    def run(batches):
        count, second = np.zeros(k), np.zeros((k, d, d) if full else (k, d))
        for batch in batches:
            x, label = matrix(batch), batch["k"].to_numpy()
            for i in range(k):
                diff = x[label == i] - shared.value[i] if len(x) else np.zeros((0, d))
                count[i] += len(diff)
                second[i] += diff.T @ diff if full else (diff * diff).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int64()), pa.array([np.append(c, s).tobytes() for c, s in zip(count, second)], pa.binary())], names=["k", "v"])

    made = {r.k: np.frombuffer(r.v) for r in sum_vectors(assign(points, centers).select("x", "k").mapInArrow(run, "k long, v binary")).collect()}
    moments = np.array([made[i] for i in range(k)])
    n, second = moments[:, 0], moments[:, 1:]
    if (n == 0).any():
        raise ValueError("a center has no points")
    if full:
        covariances = second.reshape(k, d, d) / n[:, None, None] + reg * np.eye(d)
    else:
        covariances = second / n[:, None] + reg if covariance == "diag" else second.mean(1) / n + reg
    return replace(Mixture(covariance, n / n.sum(), centers, precisions_of(covariances, covariance)), covariances=covariances)

"""A model of an iterative algorithm's time: setup and time by iteration, each a sum of products of dimensions, samples and clusters.

Up to a limit the rows come to the driver and numpy fits. Beyond, tasks reduce their rows to triangular factors and sums, which
have the same least squares, and the driver takes the same steps. Coefficients are positive, and the error that is minimised is
that of the logarithm.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.aggregates import quantiles
from tessera.operators.predicates import positive
from tessera.plans import cut_lineage
from tessera.plans.shipping import ship

#: Greatest power of a variable, variance inflation above which a term goes, unit of samples.
POWER, INFLATION, SAMPLES = 2, 100.0, 1000.0
FLOOR = 1e-12
NEEDED = ["dimensions", "samples", "clusters", "algorithm_iterations", "time_s"]
#: Rows of which a task makes the design at once.
PART = 16_384


def exponents(variables: int = 3, power: int = POWER) -> list[tuple[int, ...]]:
    """All exponents up to power, by total degree, then earlier variables first; the constant leads."""
    return sorted(itertools.product(range(power + 1), repeat=variables), key=lambda p: (sum(p), [-x for x in p]))


def term_name(powers: tuple[int, ...], names: tuple[str, ...] = ("D", "N", "K")) -> str:
    return " * ".join(n if p == 1 else f"{n}^{p}" for n, p in zip(names, powers) if p) or "1"


def inflation(x: np.ndarray) -> np.ndarray:
    """The variance inflation of each column by the others; not a number for constant columns."""
    spread = x.std(0)
    own = np.flatnonzero(spread > FLOOR)
    z = (x[:, own] - x[:, own].mean(0)) / spread[own]
    out = np.full(x.shape[1], np.nan)
    for j, column in enumerate(own):
        others = np.delete(z, j, 1)
        left = z[:, j] - (others @ np.linalg.lstsq(others, z[:, j], rcond=None)[0] if others.shape[1] else 0)
        r2 = np.clip(1 - (left @ left) / (z[:, j] @ z[:, j]), 0, 1 - FLOOR)
        out[column] = 1 / (1 - r2)
    return out


def prune(x: np.ndarray, powers: list[tuple[int, ...]], keep: set[int], limit: float = INFLATION, of=inflation) -> list[int]:
    """Columns that stay: while some has an inflation above limit, the most complex of those (degree, greatest power, inflation) goes; those in keep never do."""
    left = list(range(x.shape[1]))
    while True:
        found = of(x[:, left])
        bad = [(sum(powers[c]), max(powers[c]), v, powers[c], c) for c, v in zip(left, found) if v > limit and c not in keep]
        if not bad:
            return left
        left.remove(max(bad)[-1])


def non_negative(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least squares with coefficients of 0 at least: columns join a free set while they lower the error, and leave it when they would turn negative."""
    b, free = np.zeros(x.shape[1]), np.zeros(x.shape[1], bool)
    for _ in range(3 * x.shape[1]):
        slope = x.T @ (y - x @ b)
        slope[free] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= 1e-10 * max(1.0, float(np.abs(x.T @ y).max())):
            break
        free[j] = True
        while True:
            tried = np.zeros_like(b)
            tried[free] = np.linalg.lstsq(x[:, free], y, rcond=None)[0]
            low = free & (tried <= 0)
            if not low.any():
                b = tried
                break
            share = np.min(b[low] / np.maximum(b[low] - tried[low], FLOOR))
            b = b + share * (tried - b)
            free &= b > FLOOR
            b[~free] = 0
            if not free.any():
                break
    return b


def step_sums(z: np.ndarray, target: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sums of a Gauss-Newton step at b: a row of the slope, then the square of the jacobian, then the error in a row."""
    whole = z @ b
    jacobian, residual = z / whole[:, None], np.log(whole) - target
    return np.vstack([jacobian.T @ residual, jacobian.T @ jacobian, np.full(len(b), float(residual @ residual))])


def damped_steps(b: np.ndarray, sums, steps: int = 300) -> np.ndarray:
    """Damped Gauss-Newton steps from b that stay above a floor. sums: step_sums of all rows at some b."""
    at, damping = sums(b), 1e-3
    for _ in range(steps):
        slope, square, now = at[0], at[1:-1], float(at[-1, 0])
        free = (b > FLOOR) | (slope < 0)
        part = square[np.ix_(free, free)]
        step = np.zeros_like(b)
        step[free] = np.linalg.lstsq(part + damping * np.diag(np.maximum(np.diag(part), FLOOR)), -slope[free], rcond=None)[0]
        tried = np.maximum(b + step, FLOOR)
        new = sums(tried)
        got = float(new[-1, 0])
        if got < now:
            done = now - got < 1e-12 * max(now, FLOOR)
            b, at, damping = tried, new, max(damping / 3, 1e-12)
            if done:
                break
        else:
            damping *= 4
            if damping > 1e10:
                break
    return b


def fit_positive_log(x: np.ndarray, y: np.ndarray, steps: int = 300) -> np.ndarray:
    """Coefficients above 0 that minimise the squared difference of log(x @ b) and log(y): from the least relative error, by damped Gauss-Newton steps that stay above a floor."""
    scale = np.maximum(np.median(np.abs(x), axis=0), 1.0)
    z, target = x / scale, np.log(y)
    b = np.maximum(non_negative(z / y[:, None], np.ones(len(y))), FLOOR)
    return damped_steps(b, lambda b: step_sums(z, target, b), steps) / scale


@dataclass
class TimingModel:
    """Powers of the terms; their setup and iteration coefficients (0 for those that went); the terms that went; metrics."""

    powers: list[tuple[int, ...]]
    setup: np.ndarray
    iteration: np.ndarray
    removed: list[str]
    metrics: dict[str, float]

    def predict(self, d, n, k, iterations) -> np.ndarray:
        """Total milliseconds."""
        x = design(d, n, k, self.powers)
        return x @ self.setup + np.asarray(iterations, float) * (x @ self.iteration)


def design(d, n, k, powers: list[tuple[int, ...]]) -> np.ndarray:
    some = [(np.ones_like(v), v, v * v) for v in (np.asarray(d, float), np.asarray(n, float) / SAMPLES, np.asarray(k, float))]
    return np.column_stack([some[0][p] * some[1][q] * some[2][r] for p, q, r in powers])


def fit_rows(rows: pd.DataFrame) -> TimingModel:
    """rows: dimensions, samples, clusters, algorithm_iterations, time_s."""
    powers = exponents()
    base = design(rows["dimensions"], rows["samples"], rows["clusters"], powers)
    iterations, total = rows["algorithm_iterations"].to_numpy(float), rows["time_s"].to_numpy(float) * 1000
    x, both = np.column_stack([base, base * iterations[:, None]]), powers + powers
    left = prune(x, both, {0, len(powers)})
    b = np.zeros(x.shape[1])
    b[left] = fit_positive_log(x[:, left], total)
    removed = [("setup: " if c < len(powers) else "iteration: ") + term_name(both[c]) for c in range(len(both)) if c not in left]
    truth, made = total / iterations, (x @ b) / iterations
    off = np.abs(made / truth - 1) * 100
    log_t, log_p = np.log(truth), np.log(made)
    spread = float(((log_t - log_t.mean()) ** 2).sum())
    metrics = {"median_abs_error_pct": float(np.median(off)), "p90_abs_error_pct": float(np.percentile(off, 90)), "log_r2": 1 - float(((log_t - log_p) ** 2).sum()) / spread if spread else float("nan")}
    return TimingModel(powers, b[: len(powers)], b[len(powers) :], removed, metrics)


def _rows(batch) -> tuple[np.ndarray, np.ndarray]:
    """The design of both parts and the milliseconds, from columns as fit_rows has them."""
    d, n, k, iterations, time = (batch[c].to_numpy(zero_copy_only=False).astype(float) for c in NEEDED)
    base = design(d, n, k, exponents())
    return np.column_stack([base, base * iterations[:, None]]), time * 1000


def _reduced(rows: DataFrame, one, both) -> np.ndarray:
    """one(x, y) of parts of the rows, put together by both in each task and on the driver."""

    def f(batches):
        made = None
        for batch in batches:
            for s in range(0, batch.num_rows, PART):
                part = one(*_rows(batch.slice(s, PART)))
                made = part if made is None else both(made, part)
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array([made.tobytes()], pa.binary()), pa.array([made.shape[1]], pa.int32())], names=["v", "w"])

    parts = [np.frombuffer(r.v).reshape(-1, r.w) for r in rows.mapInArrow(f, "v binary, w int").toLocalIterator()]
    whole = parts[0]
    for part in parts[1:]:
        whole = both(whole, part)
    return whole


def fit_spread(rows: DataFrame, n: int) -> TimingModel:
    """fit_rows without the rows in one place: a pass for the terms that stay, one for the start, and one for each step. Columns are scaled by their root mean square instead of their median."""
    rows = cut_lineage(rows)
    powers = exponents()
    both = powers + powers
    triangle = lambda m: np.linalg.qr(m, mode="r")
    stacked = lambda a, b: triangle(np.vstack([a, b]))
    raw = _reduced(rows, lambda x, y: np.vstack([(x * x).sum(0), x.sum(0)]), lambda a, b: a + b)
    scale, middle = np.maximum(np.sqrt(raw[0] / n), 1.0), raw[1] / n
    centred = _reduced(rows, lambda x, y: triangle((x - middle) / scale), stacked)
    left = prune(centred, both, {0, len(powers)}, of=lambda m: _inflation_of_factor(m, n))
    scale = scale[left]
    start = _reduced(rows, lambda x, y: triangle(np.column_stack([x[:, left] / scale / y[:, None], np.ones(len(y))])), stacked)
    b = np.zeros(len(both))
    first = np.maximum(non_negative(start[:, :-1], start[:, -1]), FLOOR)
    b[left] = damped_steps(first, lambda b: _reduced(rows, lambda x, y: step_sums(x[:, left] / scale, np.log(y), b), lambda p, q: p + q)) / scale
    removed = [("setup: " if c < len(powers) else "iteration: ") + term_name(both[c]) for c in range(len(both)) if c not in left]
    model = TimingModel(powers, b[: len(powers)], b[len(powers) :], removed, {})
    truth, made = F.col("time_s") * 1000 / F.col("algorithm_iterations"), F.col("predicted_ms") / F.col("algorithm_iterations")
    judged = with_predictions(rows, model).select((F.abs(made / truth - 1) * 100).alias("e"), F.log(truth).alias("t"), F.pow(F.log(truth) - F.log(made), F.lit(2.0)).alias("r"))
    middle_off, high_off = quantiles(judged, "e", [0.5, 0.9])
    off, spread = judged.agg(F.sum("r"), F.var_pop("t") * F.count("*")).first()
    model.metrics.update({"median_abs_error_pct": middle_off, "p90_abs_error_pct": high_off, "log_r2": 1 - off / spread if spread else float("nan")})
    return model


def _inflation_of_factor(r: np.ndarray, n: int) -> np.ndarray:
    """inflation of centred columns from their triangular factor, whose columns have the same lengths and angles."""
    spread = np.sqrt((r * r).sum(0) / n)
    own = np.flatnonzero(spread > FLOOR)
    z, out = r[:, own] / spread[own], np.full(r.shape[1], np.nan)
    for j, column in enumerate(own):
        others = np.delete(z, j, 1)
        left = z[:, j] - (others @ np.linalg.lstsq(others, z[:, j], rcond=None)[0] if others.shape[1] else 0)
        out[column] = 1 / (1 - np.clip(1 - (left @ left) / (z[:, j] @ z[:, j]), 0, 1 - FLOOR))
    return out


def fit_models(df: DataFrame, groups: list[str], limit: int = 1_000_000) -> dict[tuple, TimingModel]:
    """A model for each group of the rows with positive values. Up to limit rows come to the driver; beyond, each group of more than limit is fitted where its rows are, one after the other."""
    rows = positive(df.select(*groups, *NEEDED), NEEDED)
    n = rows.count()
    if not n:
        raise ValueError("no rows to fit")
    if n > limit:
        ship(df.sparkSession)
        if not groups:
            return {(): fit_spread(rows.select(*(F.col(c).cast("double").alias(c) for c in NEEDED)), n)}
        made = {}
        for r in rows.groupBy(*groups).count().collect():
            same = F.lit(True)
            for g in groups:
                same &= F.col(g).eqNullSafe(F.lit(r[g]))
            made[tuple(r[g] for g in groups)] = fit_models(rows.filter(same), [], limit)[()]
        return made
    rows = rows.toPandas()
    if not groups:
        return {(): fit_rows(rows)}
    return {key if isinstance(key, tuple) else (key,): fit_rows(part) for key, part in rows.groupby(groups, dropna=False)}


def with_predictions(df: DataFrame, model: TimingModel) -> DataFrame:
    """df with predicted_ms, as an expression of the model's terms."""
    variables = (F.col("dimensions"), F.col("samples") / SAMPLES, F.col("clusters"))

    def term(p):
        out = F.lit(1.0)
        for v, e in zip(variables, p):
            for _ in range(e):
                out = out * v
        return out

    whole = F.lit(0.0)
    for p, a, b in zip(model.powers, model.setup, model.iteration):
        if a or b:
            whole = whole + term(p) * (F.lit(float(a)) + F.lit(float(b)) * F.col("algorithm_iterations"))
    return df.withColumn("predicted_ms", whole)

"""Column expressions on dense vectors (arrays of double). All stay in the JVM."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(x: Column | str) -> Column:
    """A vector column as array of double. Cast before subtracting: differences of floats lose half of the digits."""
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def literal(values) -> Column:
    """A constant vector, or a matrix as array of arrays."""
    values = np.asarray(values, float)
    if values.ndim == 1:
        return F.array(*(F.lit(float(v)) for v in values))
    return F.array(*(literal(v) for v in values))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def sq_distance(x: Column, y: Column) -> Column:
    """Squared Euclidean distance by direct differences: never below 0, and 0 for equal vectors."""
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def assignment_score(x: Column, center: Column) -> Column:
    """The squared distance without the square of x, which doesn't change the nearest center. It cancels where x is long; sq_distance is preferred."""
    return dot(center, center) - 2 * dot(x, center)


def nearest(x: Column, centers) -> Column:
    """struct(d2, k) of the nearest row of a constant matrix; of equal ones the lowest k."""
    return F.array_min(F.transform(literal(centers), lambda c, k: F.struct(sq_distance(x, c).alias("d2"), k.cast("int").alias("k"))))


def log_sum_exp(scores: Column) -> Column:
    top = F.array_max(scores)
    return top + F.log(total(F.transform(scores, lambda s: F.exp(s - top))))


def responsibilities(scores: Column) -> Column:
    """Shares of the exponentials of the scores; they add up to 1."""
    whole = log_sum_exp(scores)
    return F.transform(scores, lambda s: F.exp(s - whole))


def score_constant(weight: float, precisions, mean, covariance: str) -> float:
    """log weight + half the log determinant of the precision - half of D log 2 pi. The quadratic term is centred on the mean, so that no constant has to make up for it."""
    d = len(mean)
    if covariance == "spherical":
        log_det = d * math.log(precisions)
    elif covariance == "diag":
        log_det = float(np.sum(np.log(precisions)))
    else:
        log_det = 2 * float(np.sum(np.log(np.diag(np.linalg.cholesky(np.asarray(precisions, float))))))
    return math.log(weight) + 0.5 * log_det - 0.5 * d * math.log(2 * math.pi)


def diagonal_score(x: Column, constant: float, mean, precisions) -> Column:
    """The logarithm of weight times Gaussian density, for a diagonal precision."""
    centred = F.zip_with(x, literal(mean), lambda a, b: a - b)
    return F.lit(constant) - 0.5 * total(F.zip_with(centred, literal(precisions), lambda a, p: p * a * a))


def precision_of(covariance: Column) -> Column:
    """1 / covariance; raises unless it is positive."""
    return F.when(covariance > 0, 1 / covariance).otherwise(F.raise_error(F.lit("covariance isn't positive: increase the regularisation")))


def inverse_distance(d: Column) -> Column:
    """1 / d, infinite at 0."""
    return F.when(d > 0, 1 / d).otherwise(F.lit(float("inf")))


def membership(level: Column, top: Column) -> Column:
    """min(level, top) / top; 1 if top is 0 or the level is infinite."""
    return F.when((top == 0) | (level == float("inf")), 1.0).otherwise(F.least(level, top) / top)


def merge_distance(squared: Column) -> Column:
    return F.sqrt(F.greatest(squared, F.lit(0.0)))


def from_columns(df: DataFrame, columns: list[str], name: str = "x") -> DataFrame:
    """Scalar columns stacked into one vector column, in their order."""
    return df.withColumn(name, F.array(*(F.col(c).cast("double") for c in columns)))


def checked(df: DataFrame, vector: str = "x", dimensions: int | None = None) -> DataFrame:
    """df with its vector as array of double; reading a row whose vector is null, of another length, or not finite raises."""
    x = doubles(vector)
    size = F.lit(dimensions) if dimensions is not None else F.size(x)
    good = F.col(vector).isNotNull() & (F.size(x) == size) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.withColumn(vector, F.when(good, x).otherwise(F.raise_error(F.lit("a sample is null, of another length or not finite"))))

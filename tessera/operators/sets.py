"""Set operations on result tables: unions, priority merges, reshaping, and what is missing."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.rectangles import Rectangle, cover


def concat(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def duplicate_free(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """df, which raises when it is read if two rows share a key."""
    counted = Window.partitionBy(*keys)
    marked = df.withColumn("_n", F.count(F.lit(1)).over(counted))
    return marked.filter(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit(f"{what}: a key is there twice")).cast("boolean"))).drop("_n")


def priority_merge(low: DataFrame, high: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    """Rows of both; of two with one key the whole row of high stays. A key that is twice in one input raises."""
    if check:
        low, high = duplicate_free(low, keys, "low"), duplicate_free(high, keys, "high")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    taken = high.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    return low.join(taken, same, "left_anti").unionByName(high, allowMissingColumns=True)


def merge_exclusions(low: DataFrame, high: DataFrame, data: DataFrame, keys: list[str]) -> DataFrame:
    """Exclusions of both, high before low, without those for which there is data."""
    last = lambda df: df.dropDuplicates(keys)
    merged = priority_merge(last(low), last(high), keys, check=False)
    there = data.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    return merged.join(there, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), "left_anti")


def resolve_reference(left: DataFrame, right: DataFrame, column: str, preferred: list[str]) -> str:
    """The first preferred key that both have, else the first of those both have, else the first preferred."""
    common = {r[0] for r in left.select(column).filter(F.coalesce(column, F.lit("")) != "").distinct().intersect(right.select(column).distinct()).collect()}
    return next((k for k in preferred if k in common), min(common) if common else preferred[0])


def unreported(df: DataFrame, reported: DataFrame, signature: list[str]) -> DataFrame:
    """Rows whose signature isn't reported already."""
    right = reported.select(*(F.col(k).alias(f"_{k}") for k in signature)).distinct()
    return df.join(right, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in signature)), "left_anti")


def long_form(df: DataFrame, keys: list[str], values: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """One row for each key and value column."""
    return df.select(*keys, *(F.col(v).cast("double").alias(v) for v in values)).unpivot(keys, values, name, value)


def grid(df: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """Rows by one axis, a column for each of the stated values of another."""
    return df.groupBy(row).pivot(column, columns).agg(F.first(value))


def sweep_cases(axes: dict[str, DataFrame]) -> DataFrame:
    """Every combination of the values of small tables (one column each): the product is the result that is asked for."""
    return reduce(lambda a, b: a.crossJoin(b), (df.select(F.col(df.columns[0]).alias(name)).distinct() for name, df in axes.items()))


def ordered(df: DataFrame, columns: list[str], ranks: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows by those of the columns that are there; a column with ranks by its listed values, others after them."""
    order = []
    for c in columns:
        if c not in df.columns:
            continue
        if ranks and c in ranks:
            place = F.create_map(*(F.lit(x) for i, v in enumerate(ranks[c]) for x in (v, i)))
            order.append(F.coalesce(F.try_element_at(place, F.col(c)), F.lit(len(ranks[c]))))
        order.append(F.col(c))
    return df.orderBy(*order) if order else df


def numbers_first(column: str) -> list[F.Column]:
    """Order of mixed values: numbers by value, then text."""
    number = F.expr(f"try_cast(`{column}` AS double)")
    return [number.isNull(), number, F.col(column)]


def by_pressure_change(df: DataFrame, delta: str, keys: list[str]) -> DataFrame:
    """The greatest changes first: by magnitude, then value, then keys; nulls last."""
    return df.orderBy(F.desc_nulls_last(F.abs(F.col(delta))), F.desc_nulls_last(delta), *(F.asc_nulls_last(k) for k in keys))


def missing_branches(left: DataFrame, right: DataFrame, keys: list[str], grid_start: int) -> tuple[DataFrame, DataFrame]:
    """What left has and right lacks: (branches, points).

    branches: depth, path (array of the first depth keys), n, for keys whose prefix of fewer than grid_start + 1 columns is absent
    from right altogether, at the shortest such prefix. points: the other missing keys, which are gaps in a grid.
    """
    text = lambda df: df.select(*(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys)).distinct()
    a, b = text(left), text(right)
    missing = a.join(b, keys, "left_anti").withColumn("_depth", F.lit(None).cast("int"))
    for depth in range(1, grid_start + 1):
        prefix = keys[:depth]
        there = b.select(*prefix).distinct().withColumn("_there", F.lit(True))
        missing = missing.join(there, prefix, "left").withColumn("_depth", F.coalesce("_depth", F.when(F.col("_there").isNull(), F.lit(depth)))).drop("_there")
    path = F.slice(F.array(*keys), F.lit(1), F.col("_depth"))
    branches = missing.filter("_depth IS NOT NULL").groupBy(F.col("_depth").alias("depth"), path.alias("path")).agg(F.count("*").alias("n"))
    return branches, missing.filter("_depth IS NULL").select(*keys)


def missing_summary(left: DataFrame, right: DataFrame, keys: list[str], grid_start: int, limit: int = 100_000) -> list[tuple[str, int, int]]:
    """Lines (path, depth, points) for missing_branches: a branch each, then rectangles that cover the gaps of each context. The gaps of one comparison are few; more than limit raise."""
    branches, points = missing_branches(left, right, keys, grid_start)
    lines = [(" / ".join(f"{k}={v or '<empty>'}" for k, v in zip(keys, r.path)), r.depth, r.n) for r in branches.orderBy("depth", "path").collect()]
    rows = points.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} gaps: compare coarser keys")
    contexts: dict[tuple, list[tuple]] = {}
    for r in rows:
        contexts.setdefault(tuple(r)[:grid_start], []).append(tuple(r)[grid_start:])
    for context in sorted(contexts):
        for box in cover(contexts[context], keys[grid_start:]):
            shown = " / ".join([*(f"{k}={v or '<empty>'}" for k, v in zip(keys, context)), *(f"{k}={', '.join(map(str, v))}" for k, v in box.values.items())])
            lines.append((shown, grid_start, box.points))
    return lines


__all__ = ["Rectangle", "by_pressure_change", "concat", "cover", "duplicate_free", "grid", "long_form", "merge_exclusions", "missing_branches", "missing_summary", "numbers_first", "ordered", "priority_merge", "resolve_reference", "sweep_cases", "unreported"]

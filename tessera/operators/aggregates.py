"""Statistics of measurements."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import child_seed, fnv1a, index_weights, probe_indices
from tessera.functions.scalars import ratio_or_infinity
from tessera.plans.shipping import ships

#: The default bootstrap.
ITERATIONS, LEVEL, SEED = 1000, 0.95, 12345
#: Buckets in which quantiles counts a range of values, and values that it sorts on the driver.
BUCKETS, FEW = 4096, 50_000
QUANTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def summary_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, median, mean, stddev (of the sample; 0 for one value), mad, min, max and QUANTILES, exact. Nulls don't count; a group of nulls has n 0 and null statistics."""
    quantiles = F.percentile(value, F.array(*(F.lit(q) for q in (0.5, *QUANTILES.values()))))
    made = df.groupBy(*keys).agg(F.count(value).alias("n"), F.mean(value).alias("mean"), F.stddev_samp(value).alias("stddev"), F.min(value).alias("min"), F.max(value).alias("max"), quantiles.alias("_q"))
    right = made.select(*(F.col(k).alias(f"_{k}") for k in keys), F.get("_q", F.lit(0)).alias("_m"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    away = df.join(right, same).groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("_m"))).alias("mad")).select(*(F.col(k).alias(f"_{k}") for k in keys), "mad")
    joined = made.join(away, same, "left")
    spread = F.when(F.col("n") == 1, 0.0).otherwise(F.col("stddev")).alias("stddev")
    return joined.select(*keys, "n", F.get("_q", F.lit(0)).alias("median"), "mean", spread, "mad", "min", "max", *(F.get("_q", F.lit(i + 1)).alias(name) for i, name in enumerate(QUANTILES)))


def single_value(column: str, message: str) -> Column:
    """Aggregate: the one value that all rows of the group share; more than one raises."""
    return F.when(F.count_distinct(column) <= 1, F.first(column, ignorenulls=True)).otherwise(F.raise_error(F.lit(message)))


def one_or_mixed(column: str) -> Column:
    """Aggregate: the one value of the group as text, else 'mixed'. Keeps two values at most."""
    return F.when(F.min(column).eqNullSafe(F.max(column)), F.min(column).cast("string")).otherwise("mixed")


def values_per_process(df: DataFrame, keys: list[str], process: str = "timing_process_index") -> DataFrame:
    """keys, counts: a map from process to its number of values."""
    counted = df.groupBy(*keys, process).agg(F.count("*").alias("_n"))
    return counted.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(process, "_n")))).alias("counts"))


def _drawn_statistics(groups: list[np.ndarray], drawn: np.ndarray, statistic: str) -> np.ndarray:
    """The statistic of each draw of whole groups (a row of their numbers). Draws of the same groups are the same in any order, so that each kind is computed once, all of them from one sorted array."""
    g = len(groups)
    counts = (drawn[:, :, None] == np.arange(g)).sum(1)
    if g <= 15:
        _, first, kind = np.unique(counts @ (g + 1) ** np.arange(g), return_index=True, return_inverse=True)
    else:
        first = kind = np.arange(len(drawn))
    counts = counts[first]
    sizes = np.array([len(x) for x in groups])
    n = counts @ sizes
    if statistic == "mean":
        sums = np.array([x.sum() for x in groups])
        return (np.where(counts > 0, counts * sums, 0.0).sum(1) / n)[kind]
    values = np.concatenate(groups)
    order = np.argsort(values, kind="stable")
    values, of = values[order], np.repeat(np.arange(g), sizes)[order]
    upto = counts[:, of].cumsum(1)
    at = lambda rank: values[(upto <= rank[:, None]).sum(1)]
    low, high = at((n - 1) // 2), at(n // 2)
    made = np.where(low == high, low, (low + high) / 2)
    if np.isnan(values[-1]):
        made[counts[:, of[np.isnan(values)]].any(1)] = np.nan
    return made[kind]


def _between(values: np.ndarray, share: float) -> float:
    """A quantile of sorted values, linear between neighbours."""
    place = (len(values) - 1) * share
    i = int(place)
    a, b = values[i], values[min(i + 1, len(values) - 1)]
    return a + (b - a) * (place - i) if place - i < 0.5 else b - (b - a) * (1 - (place - i))


def bootstrap_ratio(candidate: list[np.ndarray], reference: list[np.ndarray], statistic: str = "median", iterations: int = ITERATIONS, level: float = LEVEL, seed: int = SEED) -> dict:
    """Ratio reference / candidate of a statistic, with a percentile interval from resampling whole processes of both sides."""
    if iterations <= 0 or not 0 < level < 1:
        raise ValueError("iterations must be positive, and the level between 0 and 1")
    if not candidate or not reference or any(len(g) == 0 for g in (*candidate, *reference)):
        raise ValueError("each side needs processes with values")
    f = {"median": np.median, "mean": np.mean}[statistic]
    mine, theirs = float(f(np.concatenate(candidate))), float(f(np.concatenate(reference)))
    if mine <= 0:
        raise ValueError("the candidate's statistic must be positive")
    draw = np.random.default_rng(seed)
    a, b = len(candidate), len(reference)
    if a == b:  # one call draws what calls by turns would
        drawn = draw.integers(0, a, (iterations, 2, a))
        below, above = drawn[:, 0], drawn[:, 1]
    else:
        below, above = (np.array(x) for x in zip(*((draw.integers(0, a, a), draw.integers(0, b, b)) for _ in range(iterations))))
    below, above = _drawn_statistics(candidate, below, statistic), _drawn_statistics(reference, above, statistic)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratios = np.where(below > 0, above / below, np.nan)
    ratios = np.sort(ratios[np.isfinite(ratios)])
    if not len(ratios):
        raise ValueError("no ratio is finite")
    low, high = (_between(ratios, share) for share in ((1 - level) / 2, (1 + level) / 2))
    return {"point": theirs / mine, "ci_low": float(low), "ci_high": float(high), "valid": len(ratios), "candidate_point": mine, "reference_point": theirs}


@ships
def bootstrap_ratios(df: DataFrame, keys: list[str], side: str, process: str, value: str, candidate: str, reference: str, statistic: str = "median", iterations: int = ITERATIONS, level: float = LEVEL, seed: int = SEED) -> DataFrame:
    """bootstrap_ratio for each key that has both sides. A key's timing values go to one task: they are a benchmark's repeats. Seeds follow from the key."""
    gathered = gathered_values(df, [*keys, side], process, value)
    of = lambda s, name: gathered.filter(F.col(side) == s).select(*(F.col(k).alias(f"{name}_{k}") for k in keys), F.col("_values").alias(name))
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"_mine_{k}").eqNullSafe(F.col(f"_theirs_{k}"))
    both = of(candidate, "_mine").join(of(reference, "_theirs"), on).select(*(F.col(f"_mine_{k}").alias(k) for k in keys), "_mine", "_theirs")
    return bootstrap_gathered(both, keys, statistic, iterations, level, seed)


def gathered_values(df: DataFrame, keys: list[str], process: str, value: str) -> DataFrame:
    """keys, _values: an array of (process, value) in order. Rows without a process don't count."""
    rows = df.filter(F.col(process).isNotNull()).select(*keys, F.struct(F.col(process).alias("p"), F.col(value).cast("double").alias("v")).alias("_r"))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list("_r")).alias("_values"))


@ships
def bootstrap_gathered(df: DataFrame, keys: list[str], statistic: str = "median", iterations: int = ITERATIONS, level: float = LEVEL, seed: int = SEED) -> DataFrame:
    """bootstrap_ratio of each row: keys, and _mine and _theirs as gathered_values makes them."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    numbers = ["point", "ci_low", "ci_high", "valid", "candidate_point", "reference_point"]

    def groups(column):
        """The values by process of each row, from flat arrays."""
        bounds, flat = column.offsets.to_numpy(), column.flatten()
        start, stop = bounds[0], bounds[-1]
        process, values = (column.values.field(c).slice(start, stop - start) for c in ("p", "v"))
        process = process.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        values = values.to_numpy(zero_copy_only=False).astype(float)
        assert len(flat) == len(values)
        cuts = np.flatnonzero(np.diff(process)) + 1
        for i, j in zip(bounds[:-1] - start, bounds[1:] - start):
            inner = cuts[np.searchsorted(cuts, i, "right") : np.searchsorted(cuts, j, "left")] - i
            yield np.split(values[i:j], inner)

    def f(batches):
        for batch in batches:
            names = batch.select(keys).to_pylist()
            made = [bootstrap_ratio(a, b, statistic, iterations, level, child_seed(seed, *(str(v) for v in row.values()))) for row, a, b in zip(names, groups(batch["_mine"]), groups(batch["_theirs"]))]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), *(pa.array([m[c] for m in made], pa.int64() if c == "valid" else pa.float64()) for c in numbers)], names=[*keys, *numbers])

    return df.select(*keys, "_mine", "_theirs").mapInArrow(f, f"{kinds}, point double, ci_low double, ci_high double, valid long, candidate_point double, reference_point double")


def per_iteration(ratios: DataFrame, candidate_iterations: str, reference_iterations: str) -> DataFrame:
    """The ratio of times by iteration: point and interval scaled, not drawn again. Counts that aren't positive raise."""
    good = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(F.raise_error(F.lit("iterations must be positive")).cast("int"))
    scale = good(candidate_iterations) / good(reference_iterations)
    return ratios.withColumns({c: F.col(c) * scale for c in ("point", "ci_low", "ci_high")} | {"candidate_point": F.col("candidate_point") / F.col(candidate_iterations), "reference_point": F.col("reference_point") / F.col(reference_iterations)})


def delta_summary(df: DataFrame, keys: list[str], delta: str, ratio: str | None = None) -> DataFrame:
    """keys, n, median, mean, min, max of a difference (and the median ratio)."""
    more = [F.median(ratio).alias("median_ratio")] if ratio else []
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *more, F.median(delta).alias("median"), F.mean(delta).alias("mean"), F.min(delta).alias("min"), F.max(delta).alias("max"))


def delta_summaries(df: DataFrame, groupings: list[list[str]], delta: str) -> DataFrame:
    """delta_summary of several groupings in one pass: their columns (null where not grouped), grouping (number in the list). Each row is read once and expanded by the groupings."""
    columns = list(dict.fromkeys(c for g in groupings for c in g))
    sets = [[F.col(c) for c in g] for g in groupings]
    bits = [sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in g) for g in groupings]
    if len(set(bits)) != len(bits):
        raise ValueError("two groupings are the same")
    made = df.groupingSets(sets, *columns).agg(F.grouping_id().alias("_g"), F.count("*").alias("n"), F.median(delta).alias("median"), F.mean(delta).alias("mean"), F.min(delta).alias("min"), F.max(delta).alias("max"))
    number = F.create_map(*(F.lit(x) for i, b in enumerate(bits) for x in (b, i)))
    return made.withColumn("grouping", F.element_at(number, F.col("_g").cast("int"))).drop("_g")


def transitions(df: DataFrame, keys: list[str], before: str, after: str, unchanged: bool = False) -> DataFrame:
    """Counts of 'before -> after' by keys."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    rows = df if unchanged else df.filter(text(before) != text(after))
    return rows.withColumn("transition", F.concat(text(before), F.lit(" -> "), text(after))).groupBy(*keys, "transition").agg(F.count("*").alias("n"))


def median_collapse(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row a key: the medians of its duplicates."""
    return df.groupBy(*keys).agg(*(F.median(v).alias(v) for v in values))


def symmetric_bound(df: DataFrame, value: str) -> float:
    """The greatest magnitude of the finite values; 1 if there is none above 0."""
    top = df.select(F.abs(F.col(value).cast("double")).alias("v")).filter(~F.isnan("v") & (F.col("v") < float("inf"))).agg(F.max("v")).first()[0]
    return float(top) if top else 1.0


def _weight(index: Column) -> Column:
    """functions.hashing.index_weights in the JVM. Signed 64-bit products wrap around only by parts, so that the bits needed are made from 32-bit halves."""
    low32 = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    add_high, add_low = 0x9E3779B9, 0x7F4A7C15
    low = low32(index) + F.lit(add_low)
    high = low32(F.shiftrightunsigned(index, 32) + F.lit(add_high) + F.shiftright(low, 32))
    low = low32(low)
    shifted_low = low32(F.shiftleft(high, 2).bitwiseOR(F.shiftright(low, 30)))
    x_low, x_high = low.bitwiseXOR(shifted_low), high.bitwiseXOR(F.shiftright(high, 30))
    m_high, m_low = 0xBF58476D, 0x1CE4E5B9
    # product of 64 bits: the low halves' product, and what carries into the upper half, in 16-bit steps that don't overflow
    part = lambda a, b: (low32(a) * F.lit(b & 0xFFFF), low32(a) * F.lit(b >> 16))
    p0, p1 = part(x_low, m_low)
    low_sum = p0 + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16)
    product_low = low32(low_sum)
    carry = F.shiftright(low_sum, 32) + F.shiftright(p1, 16)
    q0, q1 = part(x_low, m_high)
    r0, r1 = part(x_high, m_low)
    upper = low32(carry + low32(q0) + low32(F.shiftleft(q1.bitwiseAND(F.lit(0xFFFF)), 16)) + low32(r0) + low32(F.shiftleft(r1.bitwiseAND(F.lit(0xFFFF)), 16)))
    bits = F.shiftleft(upper.bitwiseAND(F.lit((1 << 11) - 1)), 21).bitwiseOR(F.shiftright(product_low, 11)).bitwiseAND(F.lit((1 << 21) - 1))
    return bits.cast("double") / float((1 << 21) - 1)


def fingerprint(df: DataFrame, index: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """Counts, sums and extremes of the values of a vector (index, value), an index-weighted sum, and a hash that doesn't depend on the order in which rows come: it replaces the sequential hash of a single task."""
    v = F.col(value).cast("double")
    infinite = float("inf")
    finite = ~F.isnan(v) & (F.abs(v) < infinite)
    of = lambda x: F.when(finite, x)
    aggregates = [
        F.count(v).alias("value_count"),
        F.count_if(finite).alias("finite_count"),
        F.count_if(F.isnan(v)).alias("nan_count"),
        F.count_if(v == infinite).alias("pos_inf_count"),
        F.count_if(v == -infinite).alias("neg_inf_count"),
        F.sum(of(v)).alias("sum"),
        F.sum(of(F.abs(v))).alias("sum_abs"),
        F.sum(of(v * v)).alias("sum_squares"),
        F.sum(of(v * _weight(F.col(index).cast("long")))).alias("weighted_sum"),
        F.min(of(v)).alias("min"),
        F.max(of(v)).alias("max"),
        F.bit_xor(F.xxhash64(F.col(index).cast("long"), v)).alias("hash"),
    ]
    return df.groupBy(*(keys or [])).agg(*aggregates)


def vector_summary(values: np.ndarray) -> dict:
    """The same summary of a vector on the driver, with the sequential FNV-1a hash and probes."""
    values = np.asarray(values, float)
    finite = values[np.isfinite(values)]
    weights = index_weights(np.arange(len(values)))[np.isfinite(values)]
    extreme = lambda f: float(f(finite)) if len(finite) else float("nan")
    return {
        "value_count": len(values),
        "finite_count": len(finite),
        "nan_count": int(np.isnan(values).sum()),
        "pos_inf_count": int(np.isposinf(values).sum()),
        "neg_inf_count": int(np.isneginf(values).sum()),
        "sum": float(finite.sum()),
        "sum_abs": float(np.abs(finite).sum()),
        "sum_squares": float((finite * finite).sum()),
        "weighted_sum": float((finite * weights).sum()),
        "min": extreme(np.min),
        "max": extreme(np.max),
        "fnv1a64_float64": f"0x{fnv1a(values.astype('<f8').tobytes()):x}",
        "probes": [{"index": i, "value": float(values[i])} for i in probe_indices(len(values))],
    }


def max_differences(left: DataFrame, right: DataFrame, index: list[str], value: str) -> DataFrame:
    """One row: max_abs and max_rel (of the right side's magnitude) difference of two tables of cells; null if their cells aren't the same, 0 if both are empty."""
    a = left.select(*index, F.col(value).cast("double").alias("_a"), F.lit(True).alias("_l"))
    b = right.select(*index, F.col(value).cast("double").alias("_b"), F.lit(True).alias("_r"))
    joined = a.join(b, index, "outer")
    away = F.abs(F.col("_a") - F.col("_b"))
    scale = F.greatest(F.abs("_b"), F.lit(float(np.finfo(float).eps)))
    same = F.count("*") == F.count_if(F.col("_l") & F.col("_r"))
    return joined.agg(F.when(same, F.coalesce(F.max(away), F.lit(0.0))).alias("max_abs"), F.when(same, F.coalesce(F.max(away / scale), F.lit(0.0))).alias("max_rel"))


def matrix_diagnostics(cells: DataFrame, i: str = "i", j: str = "j", value: str = "value") -> DataFrame:
    """One row: the greatest magnitude on the diagonal, and the greatest difference of a cell from its mirror."""
    pairs = cells.select(F.least(i, j).alias("p"), F.greatest(i, j).alias("q"), F.col(value).alias("v")).groupBy("p", "q").agg((F.max("v") - F.min("v")).alias("gap"), F.max(F.abs("v")).alias("top"))
    return pairs.agg(F.max(F.when(F.col("p") == F.col("q"), F.col("top"))).alias("diagonal_max_abs"), F.max(F.when(F.col("p") != F.col("q"), F.col("gap"))).alias("symmetry_max_abs"))


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles of a column as F.percentile gives them (linear between neighbours, NaN last, null without values), with the values in no single task: the ranges that hold the wanted ranks are counted by BUCKETS, until few enough values are left to sort on the driver."""
    infinite = float("inf")
    df = df.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    finite = F.abs("v") < infinite
    low, n, high, least, most = df.agg(F.count_if(F.col("v") == -infinite), F.count_if(finite), F.count_if(F.col("v") == infinite), F.min(F.when(finite, F.col("v"))), F.max(F.when(finite, F.col("v")))).first()
    total = df.count() if n + low + high == 0 else low + n + high + df.filter(F.isnan("v")).count()
    if not total:
        return [None] * len(shares)
    places = [(total - 1) * q for q in shares]
    wanted = {r for p in places for r in (int(np.floor(p)), int(np.ceil(p)))}
    known = {r: -infinite if r < low else infinite if r < low + n + high else float("nan") for r in wanted if not low <= r < low + n}
    ranges = {(least, most): (low, n)} if wanted - known.keys() else {}  # (smallest, greatest) value: rank of the first, number
    while ranges:
        narrow = {}
        for (lo, hi), (first, count) in ranges.items():
            inside = [r for r in wanted if first <= r < first + count]
            known |= {r: lo for r in inside if r == first or lo == hi} | {r: hi for r in inside if r == first + count - 1 or lo == hi}
            if inside := [r for r in inside if r not in known]:
                narrow[lo, hi] = (first, count)
        few = {k: v for k, v in narrow.items() if v[1] <= FEW}
        for (lo, hi), (first, _) in few.items():
            values = np.sort(np.array([r.v for r in df.filter(F.col("v").between(lo, hi)).collect()]))
            known |= {r: float(values[r - first]) for r in wanted if 0 <= r - first < len(values)}
        ranges, wide = {}, [k for k in narrow if k not in few]
        if wide:
            bucket = F.lit(None).cast("bigint")
            for i, (lo, hi) in enumerate(wide):
                half = 1.0 if np.isfinite(hi - lo) else 0.5
                at = F.floor((F.col("v") * half - lo * half) / (hi * half - lo * half) * BUCKETS)
                bucket = F.when(F.col("v").between(lo, hi), at + i * (BUCKETS + 1)).otherwise(bucket)
            parts = df.select("v", bucket.alias("b")).filter("b IS NOT NULL").groupBy("b").agg(F.min("v"), F.max("v"), F.count("*")).collect()
            starts = [narrow[k][0] for k in wide]
            for b, lo, hi, count in sorted(map(tuple, parts)):
                i = b // (BUCKETS + 1)
                if any(starts[i] <= r < starts[i] + count and r not in known for r in wanted):
                    ranges[lo, hi] = (starts[i], count)
                starts[i] += count
    between = lambda p: known[int(p)] if p == int(p) else (np.ceil(p) - p) * known[int(p)] + (p - np.floor(p)) * known[int(p) + 1]
    return [float(between(p)) if known[int(np.floor(p))] != known[int(np.ceil(p))] else known[int(p)] for p in places]


def error_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: median and 90th percentile of the absolute error in percent, and R squared of the logarithms."""
    error = F.abs(F.try_divide(F.col(predicted), F.col(truth)) - 1) * 100
    t, p = F.log(truth), F.log(predicted)
    base = df.select(error.alias("e"), t.alias("t"), ((t - p) * (t - p)).alias("r"))
    middle, high = quantiles(base, "e", [0.5, 0.9])
    return base.agg(F.lit(middle).cast("double").alias("median_abs_error_pct"), F.lit(high).cast("double").alias("p90_abs_error_pct"), (1 - F.try_divide(F.sum("r"), F.var_pop("t") * F.count("*"))).alias("log_r2"))


def roll_up(df: DataFrame, identity: list[str], keys: list[str]) -> DataFrame:
    """Counts by keys of the distinct records by identity."""
    return df.dropDuplicates(identity).groupBy(*keys).agg(F.count("*").alias("n"))


def indexed_to_base(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Each value by that of its key's lowest order (0 over 0 is 0, more over 0 infinite)."""
    first = F.first(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("base_value", first).withColumn("indexed", ratio_or_infinity(F.col(value), F.col("base_value")))

"""Scalar functions, filters, joins with references, parity and reports on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import joins, parity, predicates, regression, sets
from tessera.operators.rectangles import MOST_POINTS, cover
from tessera.queries.analytics import rounded
from tessera.queries.catalogue import Catalogue, table
from tessera.sources import datasets, records

query = Catalogue()


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return predicates.where(orders, o_orderstatus="F", o_orderpriority=["1-URGENT", "2-HIGH"], o_orderkey=None)


PHASE = "CASE l_returnflag WHEN 'A' THEN 'hdbscan' WHEN 'N' THEN 'lloyd' ELSE 'soa' END"
REFERENCE = "CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN 'reference' WHEN 2 THEN 'sklearn_brute' ELSE 'hdbscan_contrib' END"


def _phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{PHASE} AS phase_key", f"{REFERENCE} AS reference_key", "l_quantity")


PHASES = f"phases AS (SELECT l_orderkey, l_linenumber, {PHASE} AS phase_key, {REFERENCE} AS reference_key, l_quantity FROM lineitem)"


@query(f"WITH {PHASES} SELECT phase_key, reference_key, count(*) AS n FROM phases WHERE reference_key IS NULL OR reference_key = CASE phase_key WHEN 'hdbscan' THEN 'sklearn_brute' ELSE 'reference' END GROUP BY 1, 2")
def primary_reference_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.primary_references(_phases(spark, sf_dir)).groupBy("phase_key", "reference_key").agg(F.count("*").alias("n"))


@query(f"WITH {PHASES} SELECT a.phase_key, a.l_orderkey, a.l_quantity, b.reference_key, b.l_quantity AS l_quantity_reference FROM phases a JOIN phases b ON a.phase_key = b.phase_key AND a.l_orderkey = b.l_orderkey WHERE a.reference_key IS NULL AND b.reference_key IS NOT NULL")
def against_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = joins.against_references(_phases(spark, sf_dir), ["phase_key", "l_orderkey"], F.col("reference_key").isNull(), F.col("reference_key").isNotNull(), ["l_quantity"])
    return made.select("phase_key", "l_orderkey", "l_quantity", "reference_key", "l_quantity_reference")


@query("SELECT l_orderkey, l_linenumber, floor(l_extendedprice / (1 + p_size)) AS time_per_iteration_s FROM lineitem JOIN part ON l_partkey = p_partkey")
def timing_with_iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    timings = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("key"), F.col("l_extendedprice").alias("time_s"))
    metrics = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), (F.col("p_size") + 1).alias("algorithm_iterations"))
    made = joins.with_iterations(timings, metrics, ["key"])
    return made.select("l_orderkey", "l_linenumber", F.floor("time_per_iteration_s").cast("double").alias("time_per_iteration_s"))


@query(
    """SELECT l_orderkey, l_linenumber, fixed_phase, round(l_extendedprice, 6) AS l_extendedprice, round(cost / l_extendedprice, 6) AS equivalent_iterations FROM lineitem JOIN
(SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 'soa' ELSE 'pp' END AS fixed_phase, median(s_acctbal) AS cost FROM supplier GROUP BY 1, 2) ON l_suppkey = s_suppkey"""
)
def fixed_cost_equivalents(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS key", "CASE WHEN s_acctbal > 0 THEN 'soa' ELSE 'pp' END AS phase_key", "s_acctbal AS cost")
    algorithm = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS key", "l_orderkey", "l_linenumber", "l_extendedprice")
    made = joins.fixed_cost_equivalents(fixed, algorithm, ["key"], "cost", "l_extendedprice")
    return rounded(made.select("l_orderkey", "l_linenumber", "fixed_phase", "l_extendedprice", "equivalent_iterations"), "l_extendedprice", "equivalent_iterations")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    made = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.max("l_linenumber").alias("line"))
    return made.filter("l_linestatus = 'F'").drop("l_linestatus"), made.filter("l_linestatus = 'O'").drop("l_linestatus")


SIDES = "side AS (SELECT l_suppkey, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, max(l_linenumber) AS line FROM lineitem GROUP BY 1, 2)"


@query(
    f"""WITH {SIDES} SELECT a.l_suppkey, a.n AS n_baseline, b.n AS n_candidate, a.quantity AS quantity_baseline, b.quantity AS quantity_candidate, a.line AS line_baseline, b.line AS line_candidate,
b.n - a.n AS n_delta, b.quantity - a.quantity AS quantity_delta, b.line - a.line AS line_delta FROM side a JOIN side b ON a.l_suppkey = b.l_suppkey WHERE a.l_linestatus = 'F' AND b.l_linestatus = 'O'"""
)
def numeric_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.numeric_comparison(*_sides(spark, sf_dir), ["l_suppkey"])


@query(
    f"""WITH {SIDES} SELECT a.l_suppkey, a.n AS n_baseline, b.n AS n_candidate, a.line AS line_baseline, b.line AS line_candidate, round(b.n / a.n, 6) AS n_ratio, round(b.line / a.line, 6) AS line_ratio,
round(100 * (b.n / a.n - 1), 6) AS n_delta_pct, round(100 * (b.line / a.line - 1), 6) AS line_delta_pct FROM side a JOIN side b ON a.l_suppkey = b.l_suppkey WHERE a.l_linestatus = 'F' AND b.l_linestatus = 'O'"""
)
def counter_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = joins.counter_comparison(*_sides(spark, sf_dir), ["l_suppkey"], ["n", "line"])
    return rounded(made, "n_ratio", "line_ratio", "n_delta_pct", "line_delta_pct")


@query("SELECT coalesce(c.nation, s.nation) AS nation, c.rich, list_transform(s.suppliers, lambda x: x) AS suppliers FROM (SELECT c_nationkey AS nation, count(*) AS rich FROM customer WHERE c_nationkey < 20 GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS nation, list(s_suppkey ORDER BY s_suppkey) AS suppliers FROM supplier WHERE s_nationkey > 3 GROUP BY 1) s ON c.nation = s.nation")
def attached_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = table(spark, sf_dir, "customer").filter("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("rich"))
    facts = table(spark, sf_dir, "supplier").filter("s_nationkey > 3").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    return joins.attached(configs, facts, ["nation"], "suppliers").withColumn("suppliers", F.transform("suppliers", lambda x: x["s_suppkey"]))


@query("SELECT a.key, a.n AS n_baseline, b.n AS n_candidate FROM (SELECT CASE WHEN l_linenumber = 7 THEN '' ELSE CAST(l_linenumber AS VARCHAR) END AS key, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) a JOIN (SELECT CASE WHEN l_linenumber = 7 THEN '' ELSE CAST(l_linenumber AS VARCHAR) END AS key, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) b ON a.key = b.key")
def null_keys_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("key", F.when(F.col("l_linenumber") != 7, F.col("l_linenumber").cast("double")))
    side = lambda s: joins.normalised(lines.filter(F.col("l_linestatus") == s), ["key"]).groupBy("key").agg(F.count("*").alias("n"))
    return joins.compared(side("F"), side("O"), ["key"], ["n"])


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN b = 0 THEN CASE WHEN a = 0 THEN 0.0 ELSE CAST('inf' AS DOUBLE) END ELSE round(CAST(a AS DOUBLE) / b, 6) END AS first, CASE WHEN b = 0 THEN -1.0 ELSE round(CAST(a AS DOUBLE) / b, 6) END AS second,
round(CAST(a AS DOUBLE) / nullif(b, 0), 6) AS third, CASE WHEN a = b THEN 0.0 ELSE round(abs(a - b) / CAST(greatest(abs(a), abs(b)) AS DOUBLE) * 100, 6) END AS fourth, round(abs(a - b) / CAST(greatest(abs(a), abs(b), 1) AS DOUBLE) * 100, 6) AS fifth
FROM (SELECT l_orderkey, l_linenumber, l_partkey % 4 AS a, l_suppkey % 3 AS b FROM lineitem)"""
)
def safe_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_partkey") % 4, F.col("l_suppkey") % 3
    second = scalars.rounded(scalars.ratio_or_nan(a, b), 6)
    made = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", scalars.rounded(scalars.ratio_or_infinity(a, b), 6).alias("first"), F.when(F.isnan(second), -1.0).otherwise(second).alias("second"),
        scalars.rounded(scalars.rate(a, b), 6).alias("third"), F.round(scalars.relative_difference_pct(a, b), 6).alias("fourth"), F.round(scalars.relative_difference_pct(a, b, 1.0), 6).alias("fifth"),
    )
    return made


def _lloyd_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_extendedprice AS inertia_candidate", "l_extendedprice * (1 + CASE WHEN l_suppkey % 3 = 0 THEN 1e-9 ELSE 0 END) AS inertia_reference", "l_linenumber AS iterations_candidate", "l_linenumber + CAST(l_partkey % 7 = 0 AS INT) AS iterations_reference")


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS a, l_extendedprice * (1 + CASE WHEN l_suppkey % 3 = 0 THEN 1e-9 ELSE 0 END) AS b, CAST(l_partkey % 7 = 0 AS INT) AS d FROM lineitem),
p AS (SELECT *, CASE WHEN a = b THEN 0 ELSE abs(a - b) / greatest(abs(a), abs(b)) * 100 END AS pct FROM r)
SELECT l_orderkey, l_linenumber, round(pct, 10) AS pct, CASE WHEN pct <= 1e-6 AND d <= 0 THEN 'PASS' ELSE 'FAIL' END AS status, round(greatest(pct / 1e-6, d), 3) AS pressure, CASE WHEN pct / 1e-6 >= d THEN 'inertia' ELSE 'iterations' END AS worst FROM p"""
)
def parity_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = parity.lloyd(_lloyd_pairs(spark, sf_dir))
    return made.select("l_orderkey", "l_linenumber", F.round("inertia_diff_pct", 10).alias("pct"), "status", F.round("pressure", 3).alias("pressure"), "worst")


@query(
    """WITH r AS (SELECT o_orderkey, abs(o_totalprice / 1e6 * 3e-4) AS lb, 5e-5 * (o_custkey % 4) AS w, 4e-4 * (o_custkey % 3) AS m FROM orders)
SELECT o_orderkey, CASE WHEN lb <= 1e-4 AND w <= 1e-4 AND m <= 1e-3 THEN 'PASS' ELSE 'FAIL' END AS status, concat_ws(',', CASE WHEN lb > 1e-4 THEN 'lower_bound_diff' END, CASE WHEN w > 1e-4 THEN 'weights_max_abs' END, CASE WHEN m > 1e-3 THEN 'means_max_abs' END) AS failures FROM r"""
)
def parity_gmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_totalprice / 1e6 * 3e-4 AS lower_bound_candidate", "0D AS lower_bound_reference", "array(5e-5 * (o_custkey % 4), 0D) AS weights_candidate", "array(0D, 0D) AS weights_reference",
        "array(4e-4 * (o_custkey % 3)) AS means_candidate", "array(0D) AS means_reference", "array(1D) AS covariances_candidate", "array(1D) AS covariances_reference", "3 AS iterations_candidate", "3 AS iterations_reference",
    )
    return parity.gmm(rows).select("o_orderkey", "status", F.array_join("failures", ",").alias("failures"))


@query(
    """SELECT l_orderkey, l_linenumber, dataset || '_' || l_linenumber || 'D_' || l_suppkey || 'N_' || l_partkey || 'K' AS config, CASE phase WHEN 'lloyd' THEN 'Lloyd Algorithm' ELSE 'Other Phase' END AS name, 'phase=' || phase || ' / dataset=' || dataset AS path,
CASE WHEN l_linenumber * 10 > 50 OR l_linenumber * 10 > round(4 + greatest(0.0, 15.4205 - 0.89468 * ln(l_suppkey + 1)) * 1258.93 * pow(l_linenumber + 1, -4.0)) THEN 'dynamic' ELSE 'static' END AS variant
FROM (SELECT *, CASE WHEN l_linestatus = 'F' THEN 'blobs' ELSE 'real' END AS dataset, CASE WHEN l_returnflag = 'A' THEN 'lloyd' ELSE 'other_phase' END AS phase FROM lineitem)"""
)
def names_and_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumns({"dataset": F.when(F.col("l_linestatus") == "F", "blobs").otherwise("real"), "phase": F.when(F.col("l_returnflag") == "A", "lloyd").otherwise("other_phase")})
    d, n, k = F.col("l_linenumber") * 10, F.col("l_suppkey") + 1, F.col("l_linenumber") + 1
    return lines.select("l_orderkey", "l_linenumber", scalars.config_id(F.col("dataset"), F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")).alias("config"), scalars.display_name(F.col("phase"), scalars.PHASES).alias("name"), scalars.path_text(["phase", "dataset"]).alias("path"), scalars.dispatch(d, n, k).alias("variant"))


@query("SELECT o_orderkey, CASE WHEN t >= 1000000 THEN rtrim(rtrim(printf('%.2f', t / 1000000), '0'), '.') || 'M' WHEN t >= 1000 THEN rtrim(rtrim(printf('%.2f', t / 1000), '0'), '.') || 'K' ELSE CAST(t AS VARCHAR) END AS short FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 10 ELSE o_custkey * 10000 END AS t FROM orders)")
def abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.abbreviated(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") * 10).otherwise(F.col("o_custkey") * 10000)).alias("short"))


KEYS = ["l_returnflag", "l_linestatus", "l_suppkey", "l_linenumber"]


def _gaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").select(*KEYS).distinct()
    return lines, lines.filter("NOT (l_returnflag = 'N') AND NOT (l_returnflag = 'R' AND l_linestatus = 'O') AND NOT (l_suppkey IN (3, 4) AND l_linenumber < 3)")


@query(
    """WITH a AS (SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey, l_linenumber FROM lineitem), b AS (SELECT * FROM a WHERE NOT (l_returnflag = 'N') AND NOT (l_returnflag = 'R' AND l_linestatus = 'O') AND NOT (l_suppkey IN (3, 4) AND l_linenumber < 3)),
m AS (SELECT *, CASE WHEN l_returnflag NOT IN (SELECT l_returnflag FROM b) THEN 1 WHEN (l_returnflag, l_linestatus) NOT IN (SELECT (l_returnflag, l_linestatus) FROM b) THEN 2 END AS depth FROM (SELECT * FROM a EXCEPT SELECT * FROM b))
SELECT depth, CASE WHEN depth = 1 THEN [l_returnflag] ELSE [l_returnflag, l_linestatus] END AS path, count(*) AS n FROM m WHERE depth IS NOT NULL GROUP BY 1, 2"""
)
def missing_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.missing_branches(*_gaps(spark, sf_dir), KEYS, 2)[0]


@query()
def missing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(sets.missing_summary(*_gaps(spark, sf_dir), KEYS, 2), "path string, depth int, points int")


@query()
def rectangle_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one point beyond the bound is enough for cover to raise
    sizes = table(spark, sf_dir, "part").select("p_brand", "p_size", "p_type").distinct().limit(MOST_POINTS + 1).collect()
    boxes = cover([tuple(r) for r in sizes], ["p_brand", "p_size", "p_type"])
    return spark.createDataFrame([(i, ",".join(map(str, b.values["p_brand"])), ",".join(map(str, b.values["p_size"])), ",".join(b.values["p_type"]), b.points) for i, b in enumerate(boxes)], "box int, p_brand string, p_size string, p_type string, points int")


@query("SELECT l_suppkey, l_linenumber FROM (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem) WHERE (l_suppkey, l_linenumber) NOT IN (SELECT (l_suppkey, l_linenumber) FROM lineitem WHERE l_quantity > 49 AND l_tax > 0.06)")
def unreported_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_quantity", "l_tax")
    return sets.unreported(lines.select("l_suppkey", "l_linenumber").distinct(), lines.filter("l_quantity > 49 AND l_tax > 0.06"), ["l_suppkey", "l_linenumber"])


@query("SELECT DISTINCT r_name AS region, c_mktsegment AS segment, l_returnflag AS flag FROM (SELECT DISTINCT r_name FROM region), (SELECT DISTINCT c_mktsegment FROM customer), (SELECT DISTINCT l_returnflag FROM lineitem)")
def sweep_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.sweep_cases({"region": table(spark, sf_dir, "region").select("r_name"), "segment": table(spark, sf_dir, "customer").select("c_mktsegment"), "flag": table(spark, sf_dir, "lineitem").select("l_returnflag")})


@query("SELECT c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier")
def concat_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").selectExpr("c_name AS name", "c_acctbal AS acctbal", "c_mktsegment AS segment")
    return sets.concat([customers, table(spark, sf_dir, "supplier").selectExpr("s_name AS name", "s_acctbal AS acctbal")])


@query(
    """SELECT l_suppkey, round(m / n * 1000, 6) AS per_sample, round(greatest(m / n * 1000 - s / n * 1000, 0), 6) AS low, round(m / n * 1000 + s / n * 1000, 6) AS high FROM
(SELECT l_suppkey, median(l_tax) AS m, mad(l_tax) * 3 AS s, count(*) AS n FROM lineitem GROUP BY 1)"""
)
def per_sample_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.median("l_tax").alias("m"), F.count("*").alias("samples"))
    away = table(spark, sf_dir, "lineitem").join(stats, "l_suppkey").groupBy("l_suppkey").agg(F.median(F.abs(F.col("l_tax") - F.col("m"))).alias("mad"))
    timed = stats.join(away, "l_suppkey").select("l_suppkey", "samples", F.col("m").alias("time_per_iteration_s_median"), (F.col("mad") * 3).alias("time_per_iteration_s_mad"))
    return rounded(predicates.per_sample_times(timed, spread="mad").select("l_suppkey", "per_sample", "low", "high"), "per_sample", "low", "high")


@query("SELECT l_suppkey, round(m - lo, 6) AS lower_error, round(hi - m, 6) AS upper_error, round(hi - lo, 6) AS width, round(m * 1000, 6) AS speedup_ms FROM (SELECT l_suppkey, median(l_tax) AS m, quantile_cont(l_tax, 0.1) AS lo, quantile_cont(l_tax, 0.9) AS hi FROM lineitem GROUP BY 1)")
def interval_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.percentile("l_tax", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    made = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(q.alias("q")).select("l_suppkey", F.get("q", F.lit(1)).alias("speedup"), F.get("q", F.lit(0)).alias("ci_low"), F.get("q", F.lit(2)).alias("ci_high"))
    made = predicates.milliseconds(predicates.interval_widths(made), ["speedup"])
    return rounded(made.select("l_suppkey", "lower_error", "upper_error", "width", "speedup_ms"), "lower_error", "upper_error", "width", "speedup_ms")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0 AND l_tax > 0")
def positive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.positive(table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"]).select("l_orderkey", "l_linenumber")


@query("SELECT metric, count(*) AS n FROM (SELECT CASE l_linenumber WHEN 1 THEN 'Means Threshold' WHEN 2 THEN 'Py Point' WHEN 3 THEN 'C++ Point' ELSE 'Inertia' END AS metric FROM lineitem) WHERE NOT regexp_matches(metric, 'Threshold|Py|C\\+\\+') GROUP BY 1")
def relevant_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("l_linenumber") == 1, "Means Threshold").when(F.col("l_linenumber") == 2, "Py Point").when(F.col("l_linenumber") == 3, "C++ Point").otherwise("Inertia")
    return predicates.relevant(table(spark, sf_dir, "lineitem").select(name.alias("metric"))).groupBy("metric").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linenumber, l_orderkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linenumber ORDER BY l_quantity, l_orderkey, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1")
def first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return predicates.first_of(lines, ["l_returnflag", "l_linenumber"], ["l_quantity", "l_orderkey", "l_partkey", "l_suppkey"]).select("l_returnflag", "l_linenumber", "l_orderkey", "l_quantity")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY abs(o_totalprice - 250000) DESC, o_totalprice - 250000 DESC, o_orderkey LIMIT 25")
def pressure_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").withColumn("delta", F.col("o_totalprice") - 250000)
    return sets.by_pressure_change(orders, "delta", ["o_orderkey"]).limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT n_name, n_nationkey FROM nation ORDER BY CASE n_name WHEN 'NATION_7' THEN 0 WHEN 'NATION_3' THEN 1 ELSE 2 END, n_name LIMIT 9")
def ranked_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.ordered(table(spark, sf_dir, "nation"), ["n_name", "missing"], {"n_name": ["NATION_7", "NATION_3"]}).limit(9).select("n_name", "n_nationkey")


@query("SELECT v FROM (SELECT DISTINCT CASE WHEN p_size < 10 THEN CAST(p_size AS VARCHAR) ELSE p_type END AS v FROM part) ORDER BY TRY_CAST(v AS DOUBLE) IS NULL, TRY_CAST(v AS DOUBLE), v LIMIT 12")
def numbers_before_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "part").select(F.when(F.col("p_size") < 10, F.col("p_size").cast("string")).otherwise(F.col("p_type")).alias("v")).distinct()
    return values.orderBy(*sets.numbers_first("v")).limit(12)


@query("SELECT dataset, count(*) AS n FROM (SELECT CASE WHEN l_linenumber < 4 THEN 'blobs' ELSE l_returnflag END AS dataset FROM lineitem) WHERE dataset <> 'blobs' GROUP BY 1")
def non_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") < 4, "blobs").otherwise(F.col("l_returnflag")).alias("dataset"))
    return datasets.non_synthetic(lines).groupBy("dataset").agg(F.count("*").alias("n"))


@query(
    """SELECT 'lloyd_full_' || CASE WHEN l_linestatus = 'F' THEN 'static' ELSE 'dynamic' END || '_cpp_' || CASE WHEN l_returnflag = 'A' THEN '' ELSE 'real_set_' END || l_linenumber || 'D_' || l_suppkey || 'N_5K.json' AS name,
CASE WHEN l_returnflag = 'A' THEN 'blobs' ELSE 'real_set' END AS dataset, l_linenumber AS dimensions, CAST(l_suppkey AS INT) AS samples, 5 AS clusters, 'lloyd' AS phase_key, 'full' AS stage_key, CASE WHEN l_linestatus = 'F' THEN 'static' ELSE 'dynamic' END AS variant_key, 'cpp' AS language_key, 'default' AS params_key
FROM (SELECT DISTINCT l_linestatus, l_returnflag, l_linenumber, l_suppkey FROM lineitem)"""
)
def parsed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag", "l_linenumber", "l_suppkey").distinct()
    variant, dataset = F.when(F.col("l_linestatus") == "F", "static").otherwise("dynamic"), F.when(F.col("l_returnflag") == "A", "").otherwise("real_set_")
    name = F.concat(F.lit("lloyd_full_"), variant, F.lit("_cpp_"), dataset, F.col("l_linenumber"), F.lit("D_"), F.col("l_suppkey"), F.lit("N_5K.json"))
    return lines.select(name.alias("name")).withColumn("id", records.identity(F.col("name"))).select("name", "id.*")


@query("SELECT 'sklearn_brute' AS key")
def resolved_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    phases = _phases(spark, sf_dir)
    key = sets.resolve_reference(phases.filter("phase_key = 'hdbscan'"), phases.filter("phase_key = 'hdbscan'"), "reference_key", ["sklearn_brute", "reference"])
    return spark.createDataFrame([(key,)], "key string")


@query()
def timing_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("dimensions"), (F.col("l_suppkey") * 100 + 100).alias("samples"), (F.col("l_quantity") % 5 + 1).cast("int").alias("clusters"), (F.col("l_partkey") % 20 + 1).alias("algorithm_iterations"))
    lines = lines.dropDuplicates(["dimensions", "samples", "clusters"])
    timed = lines.withColumn("time_s", 1e-3 + 1e-9 * F.col("dimensions") * F.col("samples") * F.col("clusters") * F.col("algorithm_iterations"))
    model = regression.fit_models(timed, [])[()]
    return regression.with_predictions(timed, model).withColumn("log_r2", F.lit(model.metrics["log_r2"]))


QUERIES, ORACLE_SQL = query.queries, query.sql

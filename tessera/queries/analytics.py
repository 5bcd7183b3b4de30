"""Statistics, comparisons, joins and set operations on the star schema and the events, which stand in for benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import aggregates, joins, predicates, sets
from tessera.queries.catalogue import Catalogue, table

query = Catalogue()


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _round(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


STATS = ("median", "mean", "stddev", "mad", "min", "max", "p05", "p25", "p50", "p75", "p95")


@query(
    f"""SELECT l_returnflag, l_linestatus, n, {_round(*STATS)} FROM (SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, median(l_extendedprice) AS median, avg(l_extendedprice) AS mean,
  coalesce(stddev_samp(l_extendedprice), 0) AS stddev, mad(l_extendedprice) AS mad, min(l_extendedprice) AS min, max(l_extendedprice) AS max, quantile_cont(l_extendedprice, 0.05) AS p05,
  quantile_cont(l_extendedprice, 0.25) AS p25, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.75) AS p75, quantile_cont(l_extendedprice, 0.95) AS p95
  FROM lineitem GROUP BY l_returnflag, l_linestatus)"""
)
def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.summary_stats(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice"), *STATS)


def _speeds(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == status)
    return orders.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("speedup"))


@query(
    """SELECT a.o_orderpriority, round(a.s, 6) AS speedup_baseline, round(b.s, 6) AS speedup_candidate, round(b.s / a.s, 6) AS ratio, round(100 * (b.s / a.s - 1), 6) AS delta_pct
FROM (SELECT o_orderpriority, avg(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a JOIN (SELECT o_orderpriority, avg(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.o_orderpriority = b.o_orderpriority"""
)
def ratio_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = joins.speedup_comparison(_speeds(spark, sf_dir, "F"), _speeds(spark, sf_dir, "O"), ["o_orderpriority"])
    return rounded(made, "speedup_baseline", "speedup_candidate", "ratio", "delta_pct")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_quantity").alias("speedup"))


LINES = "lines AS (SELECT l_returnflag, l_linenumber, avg(l_quantity) AS speedup FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {LINES} SELECT a.l_returnflag, a.l_linenumber, round(a.speedup, 6) AS speedup, round(b.speedup, 6) AS base_value, round(a.speedup / b.speedup * 100, 6) AS retention_pct FROM lines a JOIN lines b ON a.l_returnflag = b.l_returnflag AND b.l_linenumber = 1")
def retention_vs_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = joins.retention(_lines(spark, sf_dir), F.col("l_linenumber") == 1, ["l_returnflag"])
    return rounded(made.select("l_returnflag", "l_linenumber", "speedup", "base_value", "retention_pct"), "speedup", "base_value", "retention_pct")


@query(f"WITH {LINES} SELECT l_returnflag, l_linenumber, round(speedup, 6) AS speedup, round(b, 6) AS base_value, round(speedup / b, 6) AS indexed FROM (SELECT *, first_value(speedup) OVER (PARTITION BY l_returnflag ORDER BY l_linenumber) AS b FROM lines)")
def indexed_to_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.indexed_to_base(_lines(spark, sf_dir), ["l_returnflag"], "l_linenumber", "speedup"), "speedup", "base_value", "indexed")


def _keysets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    buyers = table(spark, sf_dir, "orders").filter("o_totalprice > 480000").select(F.col("o_custkey").alias("custkey"))
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("custkey"))
    return joins.point_sets(buyers, rich, ["custkey"])


BUYERS, RICH = "SELECT o_custkey AS custkey FROM orders WHERE o_totalprice > 480000", "SELECT c_custkey AS custkey FROM customer WHERE c_acctbal > 5000"


@query(f"{BUYERS} INTERSECT {RICH}")
def keyset_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keysets(spark, sf_dir)["common"]


@query(f"{BUYERS} EXCEPT {RICH}")
def keyset_left_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keysets(spark, sf_dir)["left_only"]


@query(f"{RICH} EXCEPT {BUYERS}")
def keyset_right_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keysets(spark, sf_dir)["right_only"]


def _by_nation(spark: SparkSession, sf_dir: str, name: str, prefix: str, where: str = "true") -> DataFrame:
    return table(spark, sf_dir, name).filter(where).groupBy(F.col(f"{prefix}_nationkey").alias("nation")).agg(F.count("*").alias("rows"), F.avg(f"{prefix}_acctbal").alias("balance"))


def _nation_sql(name: str, prefix: str, where: str = "true") -> str:
    return f"(SELECT {prefix}_nationkey AS nation, count(*) AS rows, avg({prefix}_acctbal) AS balance FROM {name} WHERE {where} GROUP BY 1)"


@query(f"SELECT coalesce(a.nation, b.nation) AS nation, a.rows AS rows_baseline, b.rows AS rows_candidate, coalesce(b.rows, 0) - coalesce(a.rows, 0) AS delta FROM {_nation_sql('customer', 'c', 'c_nationkey < 18')} a FULL JOIN {_nation_sql('supplier', 's', 's_nationkey > 5')} b ON a.nation = b.nation")
def outer_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.outer_delta(_by_nation(spark, sf_dir, "customer", "c", "c_nationkey < 18"), _by_nation(spark, sf_dir, "supplier", "s", "s_nationkey > 5"), ["nation"], "rows")


@query(f"WITH low AS {_nation_sql('customer', 'c')}, high AS {_nation_sql('supplier', 's', 's_nationkey < 12')} SELECT nation, rows, round(balance, 6) AS balance FROM (SELECT * FROM high UNION ALL SELECT * FROM low WHERE nation NOT IN (SELECT nation FROM high))")
def priority_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sets.priority_merge(_by_nation(spark, sf_dir, "customer", "c"), _by_nation(spark, sf_dir, "supplier", "s", "s_nationkey < 12"), ["nation"]), "balance")


@query("SELECT n_nationkey AS nation, CASE WHEN n_nationkey < 10 THEN 'high' ELSE 'low' END AS reason FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 7000)")
def exclusion_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    data = table(spark, sf_dir, "supplier").filter("s_acctbal > 7000").select(F.col("s_nationkey").alias("nation"))
    return sets.merge_exclusions(nations.withColumn("reason", F.lit("low")), nations.filter("nation < 10").withColumn("reason", F.lit("high")), data, ["nation"])


@query("SELECT event_id, user_id, event_type FROM events WHERE value > 90 AND user_id IN (SELECT user_id FROM events WHERE value > 90 AND event_type IN ('click', 'purchase') GROUP BY user_id HAVING count(DISTINCT event_type) = 2)")
def completeness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter("value > 90").select("event_id", "user_id", "event_type")
    return predicates.complete(events, ["user_id"], "event_type", ["click", "purchase"])


RULES = [(0, "few items", ["A", "R"], None, None, None, 2), (1, "heavy", None, ["F"], [5, 6], None, None), (2, "few items", None, None, None, 1, 1), (3, "last", ["N"], None, None, 7, None)]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_index int, reason string, phase_key array<string>, stage_key array<string>, dimensions array<int>, min_dimensions int, max_dimensions int")


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("phase_key"), F.col("l_linestatus").alias("stage_key"), F.col("l_linenumber").alias("dimensions")).distinct()


RULE_ROWS = """rules AS (SELECT * FROM (VALUES (0, 'few items', ['A', 'R'], NULL, NULL, NULL, 2), (1, 'heavy', NULL, ['F'], [5, 6], NULL, NULL), (2, 'few items', NULL, NULL, NULL, 1, 1), (3, 'last', ['N'], NULL, NULL, 7, NULL)) t(rule_index, reason, p, s, d, lo, hi)),
cases AS (SELECT DISTINCT l_returnflag AS phase_key, l_linestatus AS stage_key, l_linenumber AS dimensions FROM lineitem),
hits AS (SELECT cases.*, rule_index, reason FROM cases JOIN rules ON (p IS NULL OR list_contains(p, phase_key)) AND (s IS NULL OR list_contains(s, stage_key)) AND (d IS NULL OR list_contains(d, dimensions)) AND (lo IS NULL OR dimensions >= lo) AND (hi IS NULL OR dimensions <= hi))"""
CASE_COLUMNS = ("phase_key", "stage_key", "dimensions")


@query(
    f"""WITH {RULE_ROWS}, firsts AS (SELECT phase_key, stage_key, dimensions, reason, min(rule_index) AS f FROM hits GROUP BY ALL)
SELECT phase_key, stage_key, dimensions, string_agg(reason, ' ; ' ORDER BY f) AS reason, (SELECT count(*) FROM hits h WHERE h.phase_key = firsts.phase_key AND h.stage_key = firsts.stage_key AND h.dimensions = firsts.dimensions) AS rules FROM firsts GROUP BY phase_key, stage_key, dimensions"""
)
def rule_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = predicates.excluded(_cases(spark, sf_dir), rules(spark), CASE_COLUMNS)
    return made.select(*CASE_COLUMNS, "reason", F.size("matched_rules").cast("long").alias("rules"))


@query(f"WITH {RULE_ROWS} SELECT * FROM cases EXCEPT SELECT phase_key, stage_key, dimensions FROM hits")
def rule_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.without_excluded(_cases(spark, sf_dir), rules(spark), CASE_COLUMNS)


GROUPINGS = [["l_returnflag"], ["l_returnflag", "l_linestatus"], ["l_linenumber"], []]
DELTAS = ("median", "mean", "min", "max")


@query(
    f"""SELECT l_returnflag, l_linestatus, l_linenumber, n, {_round(*DELTAS)}, CASE WHEN g = 3 THEN 0 WHEN g = 1 THEN 1 WHEN g = 6 THEN 2 ELSE 3 END AS grouping FROM (SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, median(l_discount - l_tax) AS median, avg(l_discount - l_tax) AS mean,
min(l_discount - l_tax) AS min, max(l_discount - l_tax) AS max, grouping_id(l_returnflag, l_linestatus, l_linenumber) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus), (l_linenumber), ()))"""
)
def delta_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("delta", F.col("l_discount") - F.col("l_tax"))
    return rounded(aggregates.delta_summaries(lines, GROUPINGS, "delta"), *DELTAS)


@query(f"SELECT l_returnflag, n, {_round('median', 'mean', 'min', 'max')} FROM (SELECT l_returnflag, count(*) AS n, median(l_tax - l_discount) AS median, avg(l_tax - l_discount) AS mean, min(l_tax - l_discount) AS min, max(l_tax - l_discount) AS max FROM lineitem GROUP BY 1)")
def delta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("delta", F.col("l_tax") - F.col("l_discount"))
    return rounded(aggregates.delta_summary(lines, ["l_returnflag"], "delta"), *DELTAS)


@query("SELECT o_orderkey, metric, value FROM (SELECT o_orderkey, o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders) UNPIVOT (value FOR metric IN (o_totalprice, o_custkey))")
def unpivot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.long_form(table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_totalprice", "o_custkey"])


@query('SELECT l_linenumber, round(max(CASE WHEN l_returnflag = \'A\' THEN q END), 6) AS "A", round(max(CASE WHEN l_returnflag = \'N\' THEN q END), 6) AS "N", round(max(CASE WHEN l_returnflag = \'R\' THEN q END), 6) AS "R" FROM (SELECT l_linenumber, l_returnflag, median(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1')
def pivot_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = aggregates.median_collapse(table(spark, sf_dir, "lineitem"), ["l_linenumber", "l_returnflag"], ["l_quantity"])
    return rounded(sets.grid(once, "l_linenumber", "l_returnflag", "l_quantity", ["A", "N", "R"]), "A", "N", "R")


@query(f"SELECT l_suppkey, {_round('l_quantity', 'l_tax')} FROM (SELECT l_suppkey, median(l_quantity) AS l_quantity, median(l_tax) AS l_tax FROM lineitem GROUP BY 1)")
def median_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.median_collapse(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_quantity", "l_tax"]), "l_quantity", "l_tax")


@query(
    """SELECT l_returnflag, count(*) AS value_count, count(*) AS finite_count, CAST(0 AS BIGINT) AS nan_count, CAST(0 AS BIGINT) AS pos_inf_count, CAST(0 AS BIGINT) AS neg_inf_count, round(sum(v), 2) AS sum, round(sum(abs(v)), 2) AS sum_abs, round(sum(v * v), 2) AS sum_squares,
round(sum(v * ((((m >> 11) & 2097151)) / 2097151.0)), 2) AS weighted_sum, min(v) AS min, max(v) AS max FROM (SELECT l_returnflag, v, CAST((CAST(xor(x, x >> 30) AS HUGEINT) * 13787848793156543929::HUGEINT) % 18446744073709551616::HUGEINT AS UBIGINT) AS m FROM
(SELECT l_returnflag, l_tax - l_discount AS v, CAST((CAST(l_orderkey AS HUGEINT) + 11400714819323198485::HUGEINT) % 18446744073709551616::HUGEINT AS UBIGINT) AS x FROM lineitem)) GROUP BY l_returnflag"""
)
def value_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_tax") - F.col("l_discount"))
    made = aggregates.fingerprint(lines, "l_orderkey", "v", ["l_returnflag"]).drop("hash")
    return rounded(made, "sum", "sum_abs", "sum_squares", "weighted_sum", digits=2)


@query("SELECT round(max(abs(a.o_totalprice - a.o_totalprice * 1.25)), 6) AS max_abs, round(max(abs(a.o_totalprice * 0.25) / greatest(abs(a.o_totalprice * 1.25), 2.220446049250313e-16)), 6) AS max_rel FROM orders a")
def max_abs_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rounded(aggregates.max_differences(orders, orders.withColumn("o_totalprice", F.col("o_totalprice") * 1.25), ["o_orderkey"], "o_totalprice"), "max_abs", "max_rel")


@query("WITH c AS (SELECT n_nationkey AS i, n_regionkey AS j, n_nationkey * 2.5 - n_regionkey AS value FROM nation) SELECT CAST(max(CASE WHEN p = q THEN top END) AS DOUBLE) AS diagonal_max_abs, CAST(max(CASE WHEN p <> q THEN gap END) AS DOUBLE) AS symmetry_max_abs FROM (SELECT least(i, j) AS p, greatest(i, j) AS q, max(value) - min(value) AS gap, max(abs(value)) AS top FROM c GROUP BY 1, 2)")
def matrix_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_regionkey").alias("j"), (F.col("n_nationkey") * 2.5 - F.col("n_regionkey")).alias("value"))
    return rounded(aggregates.matrix_diagnostics(cells), "diagonal_max_abs", "symmetry_max_abs")


@query("SELECT CAST(v AS DOUBLE) AS observed_median FROM (SELECT v, row_number() OVER (ORDER BY v) AS n, count(*) OVER () AS c FROM (SELECT DISTINCT p_size AS v FROM part)) WHERE n = (c + 1) // 2")
def observed_lower_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(predicates.lower_observed_median(table(spark, sf_dir, "part"), "p_size"),)], "observed_median double")


@query(
    """WITH here AS (SELECT (SELECT v FROM (SELECT v, row_number() OVER (ORDER BY v) AS n, count(*) OVER () AS c FROM (SELECT DISTINCT l_linenumber AS v FROM lineitem)) WHERE n = (c + 1) // 2) AS line)
SELECT l_returnflag, l_linestatus, l_suppkey, round(median(l_quantity), 6) AS l_quantity FROM lineitem WHERE l_linenumber = (SELECT line FROM here) GROUP BY 1, 2, 3"""
)
def sweep_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(predicates.sweep(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", ["l_returnflag", "l_linestatus"], ("l_suppkey", "l_linenumber")), "l_quantity")


COUNTERS = {"Ir": "l_partkey", "I1mr": "l_linenumber", "ILmr": "l_suppkey % 3", "Dr": "l_suppkey % 4", "D1mr": "l_linenumber % 2", "DLmr": "l_orderkey % 2", "Dw": "l_orderkey % 3", "D1mw": "l_partkey % 2", "DLmw": "l_suppkey % 2"}
RATES = {"i1_miss_rate": ("I1mr", "Ir"), "il_miss_rate": ("ILmr", "Ir"), "d1_miss_rate": ("d1_misses", "data_refs"), "ll_miss_rate": ("ll_misses", "data_refs"), "d1_read_miss_rate": ("D1mr", "Dr"), "d1_write_miss_rate": ("D1mw", "Dw"), "ll_read_miss_rate": ("DLmr", "Dr"), "ll_write_miss_rate": ("DLmw", "Dw")}


@query(
    f"""WITH c AS (SELECT l_orderkey, l_linenumber, {', '.join(f'CAST({e} AS BIGINT) AS {n}' for n, e in COUNTERS.items())} FROM lineitem),
s AS (SELECT *, Dr + Dw AS data_refs, D1mr + D1mw AS d1_misses, DLmr + DLmw AS ll_misses FROM c)
SELECT l_orderkey, l_linenumber, data_refs, d1_misses, ll_misses, {', '.join(f'round(CAST({a} AS DOUBLE) / nullif({b}, 0), 6) AS {n}' for n, (a, b) in RATES.items())} FROM s"""
)
def rates_null_on_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.expr(f"CAST({e} AS BIGINT)").alias(n) for n, e in COUNTERS.items()))
    return rounded(predicates.cache_rates(lines).select("l_orderkey", "l_linenumber", "data_refs", "d1_misses", "ll_misses", *RATES), *RATES)


@query()
def bootstrap_ratio_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view") & (F.col("value") > 0))
    timed = events.select(F.pmod("user_id", F.lit(3)).alias("config"), "event_type", F.pmod("user_id", F.lit(8)).alias("process"), "value")
    return aggregates.bootstrap_ratios(timed, ["config"], "event_type", "process", "value", "click", "view")


@query()
def bootstrap_per_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bootstrap_ratio_ci(spark, sf_dir).withColumns({"mine": F.lit(4), "theirs": F.lit(5)})
    return aggregates.per_iteration(made, "mine", "theirs")


@query("SELECT user_id, list_transform(map_entries(m), lambda e: e.key || ':' || e.value) AS counts FROM (SELECT user_id, map_from_entries(list((event_type, n) ORDER BY event_type)) AS m FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1)")
def values_per_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = aggregates.values_per_process(table(spark, sf_dir, "events"), ["user_id"], "event_type")
    return made.select("user_id", F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))).alias("counts"))


@query("SELECT o_custkey, CASE WHEN min(o_orderpriority) = max(o_orderpriority) THEN min(o_orderpriority) ELSE 'mixed' END AS priority FROM orders GROUP BY 1")
def one_or_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(aggregates.one_or_mixed("o_orderpriority").alias("priority"))


@query("SELECT l_returnflag, l_linestatus, min(l_returnflag || l_linestatus) AS label FROM lineitem GROUP BY 1, 2")
def single_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("label", F.concat("l_returnflag", "l_linestatus"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(aggregates.single_value("label", "two labels in a group").alias("label"))


@query("SELECT l_linenumber, l_returnflag || ' -> ' || l_linestatus AS transition, count(*) AS n FROM lineitem WHERE l_returnflag <> l_linestatus GROUP BY 1, 2")
def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.transitions(table(spark, sf_dir, "lineitem"), ["l_linenumber"], "l_returnflag", "l_linestatus")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> left(o_orderpriority, 1)")
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("p", F.substring("o_orderpriority", 1, 1))
    return predicates.changed(orders, "o_orderstatus", "p").select("o_orderkey", "o_orderstatus")


@query("SELECT round(quantile_cont(e, 0.5), 6) AS median_abs_error_pct, round(quantile_cont(e, 0.9), 6) AS p90_abs_error_pct, round(1 - sum((t - p) * (t - p)) / (var_pop(t) * count(*)), 6) AS log_r2 FROM (SELECT abs(l_quantity * 2000 / l_extendedprice - 1) * 100 AS e, ln(l_extendedprice) AS t, ln(l_quantity * 2000) AS p FROM lineitem)")
def error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("predicted", F.col("l_quantity") * 2000)
    return rounded(aggregates.error_metrics(lines, "l_extendedprice", "predicted"), "median_abs_error_pct", "p90_abs_error_pct", "log_r2")


@query("SELECT p_brand, count(*) AS n FROM (SELECT DISTINCT p_brand, p_type, p_size FROM part) GROUP BY 1")
def roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.roll_up(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"], ["p_brand"])


@query("SELECT CAST(max(abs(c_acctbal)) AS DOUBLE) AS bound FROM customer")
def symmetric_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(aggregates.symmetric_bound(table(spark, sf_dir, "customer"), "c_acctbal"),)], "bound double")


QUERIES, ORACLE_SQL = query.queries, query.sql

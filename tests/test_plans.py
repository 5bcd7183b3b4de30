"""Physical plans: what is pushed down, what stays in the JVM, what isn't shuffled."""

import re

import pytest

from tessera.queries import QUERIES
from tessera.queries.clustering import first_centers, points
from tessera.operators import kmeans

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize(
    "name",
    ["nearest_centroid_assign", "cluster_inertia", "centroid_update", "summary_stats", "ratio_compare", "retention_vs_base", "indexed_to_base", "outer_delta", "priority_merge", "completeness_gate", "rule_exclusion", "delta_grouping_sets", "unpivot_metrics", "pivot_grid", "value_fingerprint", "rates_null_on_zero", "parity_lloyd", "parity_gmm", "missing_branches", "parsed_names"],
)
def test_no_python_in_the_plan(spark, name):
    assert not re.search("Python|Pandas|Arrow", plan(QUERIES[name](spark, SF)).replace("ArrowEvalPythonExec", "Python"))


def test_filters_and_columns_reach_the_scan(spark):
    made = plan(QUERIES["filter_bench"](spark, SF))
    assert "EqualTo(o_orderstatus,F)" in made and "In(o_orderpriority" in made
    schema = re.findall(r"ReadSchema: struct<([^>]*)>", made)[-1]
    assert "o_totalprice" not in schema and "o_orderdate" not in schema


def test_assignment_has_no_shuffle(spark):
    found = points(spark, SF)
    made = kmeans.assign(found, first_centers(found))
    assert "Exchange" not in plan(made) and "Exchange" not in plan(kmeans.assign(found, first_centers(found), expressions=False))


def test_an_iteration_is_one_shuffle_of_partial_sums(spark):
    found = points(spark, SF)
    centers = first_centers(found)
    made = plan(kmeans.cluster_stats(kmeans.assign(found, centers, before=centers), centers.shape[1])).split("== Physical Plan ==")[-1]
    assert made.count("Exchange") == 1 and "partial_sum" in made


def test_grouping_sets_read_the_table_once(spark):
    made = plan(QUERIES["delta_grouping_sets"](spark, SF)).split("== Physical Plan ==")[-1]
    assert made.count("FileScan parquet") == 1 and "Expand" in made


def test_a_fused_iteration_is_one_python_node_and_one_shuffle(spark):
    found = points(spark, SF)
    centers = first_centers(found)
    made = plan(kmeans.iteration_stats(found, centers, centers)).split("== Physical Plan ==")[-1]
    assert made.count("MapInArrow") == 1 and made.count("Exchange") == 1 and "partial_sum" in made

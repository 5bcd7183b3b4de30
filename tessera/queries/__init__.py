"""The catalogue: one query for each operator, (spark, sf_dir) -> DataFrame, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from tessera.queries import analytics, clustering, reporting, runs

QUERIES = {**clustering.QUERIES, **analytics.QUERIES, **reporting.QUERIES, **runs.QUERIES}
ORACLE_SQL = {**clustering.ORACLE_SQL, **analytics.ORACLE_SQL, **reporting.ORACLE_SQL, **runs.ORACLE_SQL}

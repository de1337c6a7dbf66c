"""All queries of the engine with their DuckDB equivalents."""

from __future__ import annotations

from functools import partial

from bytelens.functions.dialect import duck_sql, spark_sql

from . import bytes as byte_plans
from . import coded, records, studies

_SQL = {**byte_plans.SQL, **records.SQL, **studies.SQL}


def _run(query: str, spark, sf_dir: str):
    return spark_sql(spark, sf_dir, query)


QUERIES: dict = {**{name: partial(_run, query) for name, query in _SQL.items()}, **coded.QUERIES, **byte_plans.QUERIES, **records.QUERIES}
ORACLES: dict = {**{name: duck_sql(query) for name, query in _SQL.items()}, **coded.ORACLES}

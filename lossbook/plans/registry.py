"""Registry of named queries: the Spark job and, where SQL can say it, the checking SQL."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossbook.session import apply_settings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _settled(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()}) if digits else df


def _settled_sql(sql: str, digits: Mapping[str, int]) -> str:
    if not digits:
        return sql
    cols = ", ".join(f"CASE WHEN round({c},{n})=0 THEN 0.0::DOUBLE ELSE round({c},{n}) END AS {c}"
                     for c, n in digits.items())
    return f"SELECT * REPLACE ({cols}) FROM ({sql})"


def query(name: str, sql: str | None = None, digits: Mapping[str, int] | None = None) -> Callable[[Query], Query]:
    """Register a query. `digits` rounds measured columns alike on both sides of the check."""
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_settings(spark)
            return _settled(fn(spark, sf_dir), digits or {})
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = _settled_sql(sql, digits or {})
        return run
    return register

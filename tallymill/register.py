"""The table of queries and their SQL, and the decorator that fills it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import workload

QUERIES: dict = {name: workload.view_query(sql) for name, sql in workload.SQL.items()}
ORACLE_SQL: dict[str, str] = dict(workload.SQL)


def query(sql: str | None = None):
    """Register a function under its name, with SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

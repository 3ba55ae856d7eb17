"""Named queries over the parquet tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Rows of a SELECT in SQL that both engines read; tables stand in braces."""
    names = {n for _, n, _, _ in Formatter().parse(sql) if n}
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def plain(sql: str) -> str:
    """The same SELECT for the comparison."""
    return sql.format(**{n: n for _, n, _, _ in Formatter().parse(sql) if n})

"""The register of named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function (spark, folder of tables) -> DataFrame under its name, with the SQL it is checked against."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits``, so that sums taken in another order compare equal."""
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})

"""The register of queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query (spark, folder) -> DataFrame under a name, with its SQL twin over the given tables."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def nudged(df: DataFrame, *names: str) -> DataFrame:
    """Values that may lie on a tie of the sixth digit, moved off it as their SQL twins do, so that the last bit of a double doesn't decide."""
    return df.withColumns({n: F.col(n) + 1e-9 for n in names})


def whole(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def pick(at, *values):
    """The value of a list at a place (from 0)."""
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))

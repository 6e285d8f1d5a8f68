"""Queries by name, each beside the SQL that DuckDB checks it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: SQL is put together when it is asked for, as it may use what a module defines later.
LATE: dict[str, Callable[[], str]] = {}
#: Decimals of floating results; engines differ only beyond them.
DECIMALS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to DECIMALS places, NaN as null, without negative zeros."""
    kinds = dict(df.dtypes)
    fix = lambda c: (F.round(F.nanvl(F.col(f"`{c}`"), F.lit(None).cast("double")), DECIMALS) + F.lit(0.0).cast("double")).alias(c)
    return df.select(*[fix(c) if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in df.columns])


def query(name: str, sql: str | Callable[[], str] | None = None, fixtures: bool = True) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame; ``sql`` may use the fixture views.

    In ``sql``, R(x) stands for the rounding that ``rounded`` does.
    """
    from tideline.plans.fixtures import SQL

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            LATE[name] = lambda: _expand((SQL if fixtures else "") + (sql() if callable(sql) else sql).strip())
        return f

    return add


def _expand(sql: str) -> str:
    """Replace R(...) by the SQL of rounding."""
    while (at := sql.find("R(")) >= 0 and (at == 0 or not (sql[at - 1].isalnum() or sql[at - 1] == "_")):
        depth, end = 0, at + 1
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if not depth:
                break
            end += 1
        inner = sql[at + 2 : end]
        sql = f"{sql[:at]}(round(case when isnan(cast({inner} as double)) then null else cast({inner} as double) end, {DECIMALS}) + cast(0 as double)){sql[end + 1 :]}"
    return sql

"""The registered queries and their SQL. Every query runs over its whole tables; numbers are rounded to six digits on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Doubles rounded to six digits, integers as longs."""
    change = {}
    for c, kind in df.dtypes:
        if kind in ("double", "float"):
            change[c] = F.round(F.col(c).cast("double"), 6) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint") or kind.startswith("decimal"):
            change[c] = F.col(c).cast("long")
    return df.withColumns(change) if change else df


def query(name: str, run: Callable, sql: str | None = None, doubles: str = "") -> None:
    """Registers run(spark, sf_dir); sql's columns named in doubles are rounded."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = lambda spark, sf_dir: plain(run(spark, sf_dir))
    if sql is not None:
        cols = ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in doubles.split())
        ORACLE_SQL[name] = f"SELECT * REPLACE ({cols}) FROM ({sql})" if cols else sql


from folioscope.plans import corpus, exchange, networks, references, series, structure  # noqa: E402, F401

"""Queries by name, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.sources.bars import BARS_SQL, EXPERTS_SQL, FORECASTS_SQL, REGIMES_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_TABLES = {"bars": BARS_SQL, "experts": EXPERTS_SQL, "regimes": REGIMES_SQL, "forecasts": FORECASTS_SQL}


def query(sql: str | None = None, uses: tuple[str, ...] = ("bars",), more: str = "", recursive: bool = False) -> Callable[[Query], Query]:
    """Registers a query. ``sql``: a SELECT on ``uses`` (derived tables) and ``more`` (further ones, as text)."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            parts = [*[_TABLES[u] for u in uses], *([more] if more else [])]
            ORACLES[f.__name__] = (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else "") + sql
        return f

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """The columns rounded, since sums differ in their last bits with the order of addition; -0.0 becomes 0.0."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def r(*columns: str, digits: int = 6) -> str:
    """The same in SQL."""
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


def over(fn: str, x: str, n: int, least: int, by: str = "symbol", order: str = "date") -> str:
    """A rolling aggregate with a minimum of known values, in SQL."""
    frame = f"(PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {frame} >= {least} THEN {fn}({x}) OVER {frame} END"


W = "(PARTITION BY symbol ORDER BY date)"

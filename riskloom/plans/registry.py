"""Registry of named queries with the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    """Declare a named sub-query; later ones may refer to earlier ones."""
    CTES[name] = sql.strip()


def _needed(text: str) -> list[str]:
    import re

    words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text))
    picked = {n for n in CTES if n in words}
    frontier = list(picked)
    while frontier:
        inner = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", CTES[frontier.pop()]))
        new = {n for n in CTES if n in inner} - picked
        picked |= new
        frontier.extend(new)
    return [n for n in CTES if n in picked]


def build_sql(tail: str, doubles: str = "", digits: int = 8) -> str:
    names = _needed(tail)
    with_clause = ("WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names) + "\n") if names else ""
    cols = doubles.split()
    replace = (" REPLACE (" + ", ".join(f'round(CAST("{c}" AS DOUBLE) + 1e-{digits + 3}, {digits}) + 0.0 AS "{c}"' for c in cols) + ")") if cols else ""
    return f"{with_clause}SELECT *{replace} FROM ({tail.strip()}) AS result"


def round_doubles(df: DataFrame, digits: int = 8) -> DataFrame:
    """Round every floating column so that summation order does not show.

    The small offset moves exact halves (sums of cents over powers of two) off
    the rounding boundary; the checking SQL adds the same.
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cols.append(F.round(c + float(f"1e-{digits + 3}"), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c)
    return df.select(*cols)


def query(name: str, covers: str, sql: str | None = None, doubles: str = "", digits: int = 8):
    """Register a query, the inventory rows it covers and its checking SQL."""

    def wrap(fn):
        QUERIES[name] = lambda spark, sf: round_doubles(fn(spark, sf), digits)
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = build_sql(sql, doubles, digits)
        return fn

    return wrap

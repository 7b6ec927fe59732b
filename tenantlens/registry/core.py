"""Query registry: a Spark callable and its comparison SQL under one key."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tenantlens.registry.oracle_tables import CTES
from tenantlens.sources.bindings import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_REF = re.compile(r"\b[bm]_[a-z0-9_]+\b")


def plain(df: DataFrame) -> DataFrame:
    """Dates and times as text, decimals as doubles, arrays joined.

    Applied to registered queries only, so both engines return the same types.
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        elif isinstance(f.dataType, (T.ShortType, T.IntegerType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _with_ctes(body: str) -> str:
    """Prefix the referenced bindings, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _REF.findall(text):
            if name in CTES and name not in order:
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    parts = ", ".join(f"{n} AS ({CTES[n].strip()})" for n in order)
    body = body.strip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {parts}, {body[15:]}"
    return f"WITH {parts}, {body[5:]}" if body.startswith("WITH ") else f"WITH {parts} {body}"


def _plain_sql(body: str, dates, times, nums) -> str:
    swaps = [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates]
    swaps += [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in times]
    swaps += [f"CAST({c} AS DOUBLE) AS {c}" for c in nums]
    if not swaps:
        return body
    return f"SELECT * REPLACE ({', '.join(swaps)}) FROM ({body.strip()})"


def query(key: str, sql: str | None = None, dates: str = "", times: str = "", nums: str = ""):
    """Register ``fn(tables)``; the three lists name columns to render plainly."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = lambda spark, sf_dir: plain(fn(Tables(spark, sf_dir)))
        if sql is not None:
            ORACLES[key] = _with_ctes(_plain_sql(sql, dates.split(), times.split(), nums.split()))
        return fn

    return wrap


def define(name: str, sql: str) -> None:
    """Add a shared comparison CTE for a mart that other queries build on."""
    CTES[name] = sql


def exact_avg(column: str, places: int, scale: int = 2) -> str:
    """SQL for the average of a decimal, rounded half away from zero in integers.

    A floating average can fall just below a tie that decimal arithmetic hits.
    """
    up, down = 10 ** max(places - scale, 0), 10 ** max(scale - places, 0)
    units = f"CAST(abs(sum({column})) * {10 ** scale} AS HUGEINT) * {up}"
    return f"(sign(sum({column})) * (({units} * 2 + {down} * count({column})) // (2 * {down} * count({column}))) / {10 ** places})"

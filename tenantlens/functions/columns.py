"""Column builders shared by the jobs.

Everything here returns a ``Column`` made of built-in functions, so it stays
inside whole-stage code generation.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, functions as F

Time = dt.datetime


def ts(as_of: Time) -> Column:
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def day(as_of: Time) -> Column:
    return F.lit(as_of.strftime("%Y-%m-%d")).cast("date")


def ago(as_of: Time, **delta) -> Column:
    """Timestamp literal ``as_of`` minus a timedelta; folds to a constant."""
    return ts(as_of - dt.timedelta(**delta))


def days_ago(as_of: Time, n: int) -> Column:
    return day(as_of - dt.timedelta(days=n))


def days_between(start: Column, end: Column) -> Column:
    """Calendar-day boundaries crossed from start to end."""
    return F.datediff(end, start)


def _crossed(unit: str, seconds: int, start: Column, end: Column) -> Column:
    lo = F.unix_timestamp(F.date_trunc(unit, start))
    hi = F.unix_timestamp(F.date_trunc(unit, end))
    return ((hi - lo) / F.lit(seconds)).cast("long")


def hours_between(start: Column, end: Column) -> Column:
    """Hour boundaries crossed: 00:59 to 01:01 is one hour."""
    return _crossed("hour", 3600, start, end)


def minutes_between(start: Column, end: Column) -> Column:
    return _crossed("minute", 60, start, end)


def dec(col: Column | str | float, precision: int = 18, scale: int = 2) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    if not isinstance(col, Column):
        col = F.lit(str(col))
    return col.cast(f"decimal({precision},{scale})")


def nz(col: Column | str, default=0) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col, F.lit(default))


def clamp(col: Column, low, high) -> Column:
    """Limit to [low, high]; NULL stays NULL (``least`` alone would drop it)."""
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(low)), F.lit(high)))


def null_greatest(*cols: Column) -> Column:
    """GREATEST that is NULL as soon as one argument is NULL."""
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
    return F.when(known, F.greatest(*cols))


def null_least(*cols: Column) -> Column:
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
    return F.when(known, F.least(*cols))


def bands(col: Column, cuts: list[tuple[float, object]], default) -> Column:
    """First label whose lower bound the value reaches; NULL takes the default."""
    out = None
    for cut, label in cuts:
        cond = col >= F.lit(cut)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def mapped(col: Column, mapping: dict, default=None) -> Column:
    """Simple CASE over literal values."""
    out = None
    for key, value in mapping.items():
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(col == key, value) if out is None else out.when(col == key, value)
    if default is None:
        return out
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def sum_if(cond: Column, value: Column, zero=0) -> Column:
    return F.sum(F.when(cond, value).otherwise(F.lit(zero)))


def risk_level(prob: Column, high: float = 0.65, medium: float = 0.35) -> Column:
    return bands(prob, [(high, "HIGH"), (medium, "MEDIUM")], "LOW")


def usage_trend(recent: Column, month: Column, threshold: float = 0.20) -> Column:
    """Last 7 days against a quarter of the last 30; the empty case is tested last."""
    weekly = dec(month, 20, 0) / 4
    return (
        F.when(recent > weekly * dec(1 + threshold, 6, 4), "up")
        .when(recent < weekly * dec(1 - threshold, 6, 4), "down")
        .when(month == 0, "no_data")
        .otherwise("stable")
    )


def health_score(churn: Column, nps_normalized: Column, usage_points: Column, sla_points: Column) -> Column:
    """Weighted 0-100 health: churn 35, NPS 30, usage 25, SLA 10."""
    raw = (
        (F.lit(1) - dec(churn, 8, 4)) * 35
        + dec(nps_normalized, 8, 2) * dec(0.30)
        + dec(usage_points, 8, 2) * dec(0.25)
        + dec(sla_points, 18, 2) * dec(0.10)
    )
    return clamp(F.round(raw, 1), 0, 100)


def sentiment_label(score: Column, cut: float) -> Column:
    return F.when(score > cut, "positive").when(score < -cut, "negative").otherwise("neutral")


def priority_weight(priority: Column) -> Column:
    return mapped(priority, {"HIGH": 3, "MEDIUM": 2}, 1)


def stable_id(*cols: Column | str) -> Column:
    """Deterministic row id from the natural key (never ``uuid()``)."""
    return F.md5(F.concat_ws("::", *cols))


def mean(col: Column | str) -> Column:
    """Average as exact sum over count.

    ``avg`` of a decimal keeps only four extra digits, which rounds twice when
    the result is rounded again; the division here keeps at least twelve.
    """
    col = F.col(col) if isinstance(col, str) else col
    return F.sum(col) / F.count(col)


def mean_if(cond: Column, col: Column | str) -> Column:
    return mean(F.when(cond, F.col(col) if isinstance(col, str) else col))

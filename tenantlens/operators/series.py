"""Forecasts and anomaly alerts over daily series.

A series has one row per day, so grouping or windowing by series key handles
at most a few thousand rows per group however large the raw data is.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from tenantlens.functions.columns import bands, day, days_ago, dec, nz
from tenantlens.settings import AS_OF

INTERVAL_90 = 1.645  # two-sided 90 % of a normal distribution


def forecast(history: DataFrame, keys: list[str], *, date: str = "revenue_date", value: str = "total_revenue_booked",
             horizon: int = 30, min_history: int = 14, as_of=AS_OF) -> DataFrame:
    """Daily forecast per series with lower and upper bounds.

    Short series repeat the mean of the last seven days with a band of 20 %.
    Longer ones use a linear trend plus a weekday effect and a 90 % band from
    the residual spread. This replaces a hosted forecaster and does not
    reproduce its numbers.

    Counts, means, variances and the covariance per weekday are all the model
    needs, so the history is aggregated once: the trend, the weekday effects
    and the residual spread follow from at most seven rows per series.
    """
    past = history.filter(F.col(date) <= day(as_of)).select(*keys, F.col(date).alias("d"), nz(value).alias("y"))
    x, y = F.datediff("d", day(as_of)).cast("double"), F.col("y").cast("double")
    recent = F.col("d") >= days_ago(as_of, 7)
    weekday = past.groupBy(*keys, F.dayofweek("d").alias("dow")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"),
        F.covar_pop(x, y).alias("cxy"), F.sum(F.when(recent, F.col("y"))).alias("rs"), F.count_if(recent).alias("rn"))
    rows = F.collect_list(F.struct("dow", "n", "mx", "my", "vx", "vy", "cxy"))
    series = weekday.groupBy(*keys).agg(
        rows.alias("w"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mx")) / F.sum("n")).alias("mx"),
        (F.sum(F.col("n") * F.col("my")) / F.sum("n")).alias("my"), (F.sum("rs") / F.sum("rn")).cast("decimal(24,6)").alias("recent"))

    def total(term) -> Column:
        return F.aggregate("w", F.lit(0.0), lambda acc, r: acc + r["n"] * term(r))

    sxx = total(lambda r: r["vx"] + (r["mx"] - F.col("mx")) * (r["mx"] - F.col("mx")))
    sxy = total(lambda r: r["cxy"] + (r["mx"] - F.col("mx")) * (r["my"] - F.col("my")))
    fit = series.withColumns({"slope": F.when(sxx > 0, sxy / sxx).otherwise(F.lit(0.0))})
    fit = fit.withColumn("base", F.col("my") - F.col("slope") * F.col("mx"))
    slope = F.col("slope")
    # Within a weekday the effect is the mean residual, so only centred sums remain.
    rest = total(lambda r: r["vy"] - 2 * slope * r["cxy"] + slope * slope * r["vx"])
    effects = F.map_from_entries(F.transform("w", lambda r: F.struct(r["dow"], r["my"] - F.col("base") - slope * r["mx"])))
    fit = fit.withColumns({"sigma": F.when(F.col("n") > 1, F.sqrt(F.greatest(rest, F.lit(0.0)) / (F.col("n") - 1))), "effects": effects})
    days = F.sequence(day(as_of + dt.timedelta(days=1)), day(as_of + dt.timedelta(days=horizon)))
    future = fit.select(*keys, "n", "recent", "slope", "base", "sigma", "effects", F.explode(days).alias("forecast_date"))
    ahead = F.datediff("forecast_date", day(as_of)).cast("double")
    effect = nz(F.try_element_at("effects", F.dayofweek("forecast_date")), 0.0)
    short, flat, band = F.col("n") < min_history, nz("recent"), nz("sigma", 0.0) * INTERVAL_90
    model = F.col("base") + slope * ahead + effect

    def pick(simple, modelled):
        return F.when(short, F.round(simple, 2).cast("double")).otherwise(F.round(modelled, 2))

    return future.select(
        *keys, "forecast_date", pick(flat, model).alias("forecast_value"), pick(flat * dec(0.8, 4, 2), model - band).alias("lower_bound"),
        pick(flat * dec(1.2, 4, 2), model + band).alias("upper_bound"), F.when(short, "mean7").otherwise("trend_weekday").alias("method"))


def anomalies(series: DataFrame, keys: list[str], *, date: str = "metric_date", value: str = "metric_value",
              window_days: int = 28, min_points: int = 7, k: float = 3.0, since: dt.date | None = None) -> DataFrame:
    """Days whose value is more than ``k`` deviations from the mean of the days before.

    Replaces a hosted detector; deviation percent and severity follow the source.
    """
    w = Window.partitionBy(*keys).orderBy(F.datediff(F.col(date), F.lit("2000-01-01").cast("date"))).rangeBetween(-window_days, -1)
    v = F.col(value).cast("double")
    scored = series.filter(F.col(value).isNotNull()).withColumns({
        "points": F.count(F.lit(1)).over(w), "expected": F.avg(v).over(w), "sigma": F.stddev_samp(v).over(w)})
    hit = (F.col("points") >= min_points) & (F.abs(v - F.col("expected")) > F.col("sigma") * k)
    out = scored.filter(hit) if since is None else scored.filter(hit & (F.col(date) >= F.lit(since)))
    deviation = F.when(F.col("expected") != 0, (v - F.col("expected")) / F.col("expected") * 100).otherwise(F.lit(0.0))
    return out.select(
        *keys, date, F.round(v, 4).alias("metric_value"), F.round("expected", 4).alias("expected_value"), F.round(deviation, 4).alias("deviation_pct"),
        bands(F.abs(deviation), [(50, "HIGH"), (25, "MEDIUM")], "LOW").alias("severity"))

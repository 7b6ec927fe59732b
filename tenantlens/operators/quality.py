"""Data-quality metrics, rule suites, declarative column tests and freshness."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tenantlens.functions.columns import ago, day, days_ago, hours_between, minutes_between, ts
from tenantlens.operators.latest import latest_by
from tenantlens.settings import AS_OF


# -- metrics -------------------------------------------------------------------
def null_count(col: str) -> Column:
    return F.count_if(F.col(col).isNull())


def duplicate_count(col: str) -> Column:
    """Rows minus distinct keys; NULL keys count as duplicates."""
    return F.count(F.lit(1)) - F.count_distinct(col)


def freshness_hours(col: str, as_of=AS_OF) -> Column:
    return hours_between(F.max(col), ts(as_of))


def null_rate(col: str) -> Column:
    blank = F.col(col).isNull() | (F.col(col).cast("string") == "")
    return F.round(F.count_if(blank) * 100 / F.nullif(F.count(F.lit(1)), F.lit(0)), 2)


# -- rule suite ----------------------------------------------------------------
@dataclass(frozen=True)
class Rule:
    """``mode``: max (value <= threshold), min (value >= threshold), soft (WARN up to twice the threshold)."""

    table: str
    metric: str
    value: Callable[[], Column]
    threshold: float
    mode: str = "max"


def standard_rules(as_of=AS_OF) -> list[Rule]:
    stale = lambda: F.count_if(F.col("scored_at") < ago(as_of, hours=48))
    return [
        Rule("customers", "null_rate_email", lambda: null_rate("email"), 5.0, "soft"),
        Rule("customers", "null_rate_nps", lambda: null_rate("nps_score"), 30.0, "soft"),
        Rule("customers", "duplicate_customer_ids", lambda: duplicate_count("customer_id"), 0.0),
        Rule("customers", "active_customer_count", lambda: F.count_if(F.col("lifecycle_stage") == "active"), 1.0, "min"),
        Rule("customer_360", "invalid_health_score", lambda: F.count_if((F.col("health_score") < 0) | (F.col("health_score") > 100)), 0.0),
        Rule("recommendations", "null_rec_text", lambda: F.count_if(F.coalesce("recommendation_text", F.lit("")) == ""), 0.0),
        Rule("churn_scores", "stale_churn_scores", stale, 0.0),
    ]


def _status(rule: Rule) -> Column:
    value = F.col("metric_value")
    if rule.mode == "min":
        return F.when(value >= rule.threshold, "PASS").otherwise("FAIL")
    out = F.when(value <= rule.threshold, "PASS")
    return (out.when(value <= 2 * rule.threshold, "WARN") if rule.mode == "soft" else out).otherwise("FAIL")


def run_rules(tables: dict[str, DataFrame], rules: list[Rule], *, by: list[str] = ()) -> DataFrame:
    """All rules of a table in one aggregate, turned into one row per rule."""
    parts = []
    for table, df in tables.items():
        mine = [r for r in rules if r.table == table]
        if not mine:
            continue
        wide = df.groupBy(*by).agg(*[r.value().cast("double").alias(r.metric) for r in mine])
        rows = F.array(*[F.struct(F.lit(r.metric).alias("metric_name"), F.col(r.metric).alias("metric_value"), F.lit(float(r.threshold)).alias("threshold")) for r in mine])
        long = wide.select(*by, F.lit(table).alias("table_name"), F.explode(rows).alias("r")).select(*by, "table_name", "r.*")
        status = reduce(lambda acc, r: F.when(F.col("metric_name") == r.metric, _status(r)).otherwise(acc), mine, F.lit("FAIL"))
        parts.append(long.withColumn("status", status))
    return reduce(DataFrame.unionByName, parts)


def daily_checks(customers: DataFrame, transactions: DataFrame, *, as_of=AS_OF) -> DataFrame:
    """Freshness of customers and the row-count change against the day before, per tenant."""
    hours = customers.groupBy("org_id").agg(freshness_hours("updated_at", as_of).cast("double").alias("metric_value")).select(
        "org_id", F.lit("customers").alias("table_name"), F.lit("freshness_hours").alias("metric_name"), "metric_value",
        F.lit(24.0).alias("threshold"), F.when(F.col("metric_value") <= 24, "PASS").otherwise("FAIL").alias("status"))
    date = F.col("transaction_date")
    two_days = transactions.filter(date.between(days_ago(as_of, 1), day(as_of))).groupBy("org_id").agg(
        F.count_if(date == day(as_of)).alias("today"), F.count_if(date == days_ago(as_of, 1)).alias("before"))
    delta = F.round(F.abs(F.col("today") - F.col("before")) / F.nullif(F.col("before"), F.lit(0)) * 100, 2)
    change = two_days.select(
        "org_id", F.lit("transactions").alias("table_name"), F.lit("row_count_delta_pct").alias("metric_name"), delta.alias("metric_value"),
        F.lit(20.0).alias("threshold")).withColumn("status", F.when(F.col("metric_value") <= 20, "PASS").otherwise("WARN"))
    return hours.unionByName(change)


def mart_lag(marts: dict[str, tuple[DataFrame, str]], *, hours: int = 2, as_of=AS_OF) -> DataFrame:
    """Age of the newest row per mart; older than ``hours`` fails."""
    newest = [df.agg(F.max(F.col(col).cast("timestamp")).alias("newest")).select(F.lit(name).alias("table_name"), "newest") for name, (df, col) in marts.items()]
    lag = reduce(DataFrame.unionByName, newest).withColumn("lag_minutes", minutes_between(F.col("newest"), ts(as_of)))
    return lag.withColumn("status", F.when(hours_between(F.col("newest"), ts(as_of)) > hours, "FAIL").otherwise("PASS"))


def latest_results(results: DataFrame) -> DataFrame:
    return latest_by(results, ["org_id", "table_name", "metric_name"], "measured_at", ["metric_value"])


def hourly_history(results: DataFrame, *, days: int = 7, as_of=AS_OF) -> DataFrame:
    recent = results.filter(F.col("measured_at") >= ago(as_of, days=days))

    def n(status):
        return F.count_if(F.col("status") == status)

    return recent.groupBy("org_id", F.date_trunc("hour", "measured_at").alias("hour")).agg(
        F.count(F.lit(1)).alias("total_checks"), n("PASS").alias("passed"), n("WARN").alias("warned"), n("FAIL").alias("failed"))


def staleness(results: DataFrame, *, pass_minutes: int = 60, warn_minutes: int = 240, as_of=AS_OF) -> DataFrame:
    minutes = minutes_between(F.max("measured_at"), ts(as_of))
    out = results.groupBy("org_id", "table_name").agg(minutes.alias("minutes_stale"), F.count(F.lit(1)).alias("row_count"))
    m = F.col("minutes_stale")
    return out.withColumn("status", F.when(m.isNull(), "UNKNOWN").when(m <= pass_minutes, "PASS").when(m <= warn_minutes, "WARN").otherwise("FAIL"))


# -- declarative column tests ----------------------------------------------------
@dataclass(frozen=True)
class ColumnTest:
    """``kind``: not_null, unique, accepted_values (values), accepted_range (low, high)."""

    column: str
    kind: str
    values: tuple = ()
    severity: str = "error"


def _failing(t: ColumnTest) -> Column:
    c = F.col(t.column)
    if t.kind == "not_null":
        return F.count_if(c.isNull())
    if t.kind == "accepted_values":
        return F.count_if(~c.isin(*t.values))
    low, high = t.values
    return F.count_if((c < low) | (c > high))


def check(df: DataFrame, tests: list[ColumnTest], table: str) -> DataFrame:
    """Failing rows per test; a unique test counts the values that repeat.

    All row tests share one aggregate. Each unique test is its own grouped
    count, which pre-aggregates before the exchange.
    """
    parts = []
    plain = [t for t in tests if t.kind != "unique"]
    if plain:
        wide = df.agg(*[_failing(t).alias(f"t{i}") for i, t in enumerate(plain)])
        rows = F.array(*[F.struct(F.lit(t.column).alias("column_name"), F.lit(t.kind).alias("test"), F.lit(t.severity).alias("severity"),
                                  F.col(f"t{i}").alias("failures")) for i, t in enumerate(plain)])
        parts.append(wide.select(F.explode(rows).alias("r")).select("r.*"))
    for t in tests:
        if t.kind == "unique":
            repeated = df.filter(F.col(t.column).isNotNull()).groupBy(t.column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            parts.append(repeated.agg(F.count(F.lit(1)).alias("failures")).select(
                F.lit(t.column).alias("column_name"), F.lit("unique").alias("test"), F.lit(t.severity).alias("severity"), "failures"))
    out = reduce(DataFrame.unionByName, parts)
    status = F.when(F.col("failures") == 0, "PASS").when(F.col("severity") == "warn", "WARN").otherwise("FAIL")
    return out.select(F.lit(table).alias("table_name"), "*", status.alias("status"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("orphan_rows"))


def source_freshness(sources: dict[str, tuple[DataFrame, str]], *, warn_hours: int = 24, error_hours: int = 48, as_of=AS_OF) -> DataFrame:
    parts = [df.agg(freshness_hours(col, as_of).alias("hours_old")).select(F.lit(name).alias("source"), "hours_old") for name, (df, col) in sources.items()]
    h = F.col("hours_old")
    status = F.when(h.isNull() | (h > error_hours), "ERROR").when(h > warn_hours, "WARN").otherwise("PASS")
    return reduce(DataFrame.unionByName, parts).withColumn("status", status)

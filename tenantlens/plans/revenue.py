"""Revenue movement, support intelligence and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tenantlens.functions.columns import ago, dec, hours_between, mean, mean_if, minutes_between, nz, sum_if, ts
from tenantlens.settings import AS_OF

# Revenue column prefix per transaction type.
MOVES = {"new": "new_contract", "expansion": "upsell", "contraction": "downgrade", "churn": "churn", "renewal": "renewal"}


def _typed_sum(kind: str, amount: Column) -> Column:
    return sum_if(F.col("transaction_type") == kind, amount, dec(0))


def _monthly(arr: str) -> Column:
    return F.round(F.col(arr).cast("double") / 12, 4)


def _by_day(tx: DataFrame, sums: list[Column]) -> DataFrame:
    """Sums, rows and customers per tenant and day.

    Rows are first reduced to one per customer, so customers are counted
    without a distinct over raw rows. transaction_id is unique in staged
    transactions, which the declared column tests check; rows are counted.
    """
    keys = ["org_id", F.col("transaction_date").alias("revenue_date")]
    each = tx.groupBy(*keys, "customer_id").agg(*sums, F.count("transaction_id").alias("transaction_count"))
    names = [c for c in each.columns if c not in ("org_id", "revenue_date", "customer_id", "transaction_count")]
    return each.groupBy("org_id", "revenue_date").agg(
        *[F.sum(c).cast(each.schema[c].dataType).alias(c) for c in names],
        F.sum("transaction_count").alias("transaction_count"), F.count("customer_id").alias("customers_transacted"))


def revenue_daily(transactions: DataFrame, *, since=None, as_of=AS_OF) -> DataFrame:
    """MRR movement per tenant and day from staged transactions.

    ``since`` limits the recomputation window; the result is then merged over
    the stored days (see ``merge_upsert``). Each conditional sum is taken once
    and the monthly and net figures derive from it.
    """
    tx = transactions if since is None else transactions.filter(F.col("transaction_date") >= F.lit(since))
    base = _by_day(tx, [*[_typed_sum(kind, F.col("amount_usd")).alias(f"{name}_sum") for name, kind in MOVES.items()],
                        F.sum("amount_usd").alias("total_revenue_booked")])
    net = F.col("new_sum") + F.col("expansion_sum") - F.col("contraction_sum") - F.col("churn_sum")
    return base.select(
        "org_id", "revenue_date", *[_monthly(f"{n}_sum").alias(f"{n}_mrr") for n in MOVES],
        "total_revenue_booked", "transaction_count", "customers_transacted",
        F.round(net.cast("double") / 12, 4).alias("net_new_mrr"), net.cast("double").alias("net_new_arr"),
    )


def revenue_movement(transactions: DataFrame, *, as_of=AS_OF) -> DataFrame:
    """Completed bookings per tenant and day, in ARR and MRR."""
    base = _by_day(transactions.filter(F.col("status") == "completed"),
                   [*[_typed_sum(kind, nz("amount")).alias(f"{name}_arr") for name, kind in MOVES.items()], F.sum(nz("amount")).alias("total_revenue_booked")])
    net = F.col("new_arr") + F.col("expansion_arr") - F.col("contraction_arr") - F.col("churn_arr")
    return base.withColumns({
        **{f"{n}_mrr": _monthly(f"{n}_arr") for n in MOVES},
        "net_arr": net, "net_mrr": F.round(net.cast("double") / 12, 4),
    })


def revenue_by_month(transactions: DataFrame, *, as_of=AS_OF) -> DataFrame:
    dated = transactions.filter(F.col("transaction_date").isNotNull())
    return dated.groupBy("org_id", F.trunc("transaction_date", "month").alias("month"), "transaction_type").agg(
        F.count(F.lit(1)).alias("transaction_count"), F.sum("amount").alias("total_amount"),
        F.round(mean("amount"), 2).alias("avg_amount"), F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"))


def support_intelligence(tickets: DataFrame, *, as_of=AS_OF) -> DataFrame:
    """Ticket, SLA, resolution and sentiment figures per tenant in one pass."""
    n = F.count(F.lit(1))
    is_open = F.col("status") == "open"
    hours = F.when(F.col("resolved_at").isNotNull(), minutes_between(F.col("created_at"), F.col("resolved_at")) / 60)

    def label(x):
        return F.count_if(F.col("sentiment_label") == x).alias(f"{x}_tickets")

    return tickets.groupBy("org_id").agg(
        n.alias("total_tickets"), F.count_if(is_open).alias("open_tickets"),
        F.count_if(F.col("status") == "resolved").alias("resolved_tickets"),
        F.count_if(is_open & F.col("priority").isin("urgent", "high")).alias("critical_tickets"),
        F.count_if("sla_breach").alias("sla_breached_count"),
        F.round(F.count_if("sla_breach") * 100 / F.nullif(n, F.lit(0)), 2).alias("sla_breach_rate_pct"),
        F.round(F.avg(hours), 2).alias("avg_resolution_hours"),
        F.round(F.min(hours), 2).alias("min_resolution_hours"),
        F.round(F.max(hours), 2).alias("max_resolution_hours"),
        F.round(mean_if(is_open, "sentiment_score"), 3).alias("avg_open_sentiment"),
        F.round(mean("sentiment_score"), 3).alias("avg_sentiment"),
        label("positive"), label("neutral"), label("negative"),
        F.count_if(F.col("created_at") >= ago(as_of, days=7)).alias("tickets_trend_7d"),
        F.count_if(is_open & (hours_between(F.col("created_at"), ts(as_of)) > 48)).alias("stale_open_tickets"),
        F.min(F.when(is_open, F.col("created_at"))).alias("oldest_open_ticket_at"),
    )


def pivot_sum(df: DataFrame, rows: list, column: str, values: list[str], measure: Column | str) -> DataFrame:
    """Wide sums with an explicit value list; absent cells become 0."""
    wide = df.groupBy(*rows).pivot(column, values).agg(F.sum(measure))
    return wide.fillna(0, subset=values)

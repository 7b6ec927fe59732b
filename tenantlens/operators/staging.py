"""Row-wise normalisation of the core entities.

Each function is one projection plus filters: no shuffle, and every filter is
on a raw column so that it reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tenantlens.functions.columns import (
    days_ago, day, days_between, dec, hours_between, nz, sentiment_label, ts,
)
from tenantlens.settings import AS_OF


def for_tenant(df: DataFrame, org_id: str | None) -> DataFrame:
    return df if org_id is None else df.filter(F.col("org_id") == org_id)


def _norm(col: str, default: str, case=F.lower) -> Column:
    return case(nz(F.col(col), default))


def stg_customers(customers: DataFrame, *, org_id: str | None = None, as_of=AS_OF) -> DataFrame:
    stage = _norm("lifecycle_stage", "active")
    status = F.when(stage == "churned", "churned").when(stage == "at_risk", "inactive").otherwise("active")
    kept = for_tenant(customers, org_id).filter(F.col("customer_id").isNotNull() & F.col("name").isNotNull())
    return kept.select(
        "customer_id", "org_id",
        F.trim("name").alias("customer_name"),
        F.lower(F.trim("email")).alias("email"),
        F.trim("phone").alias("phone"),
        _norm("segment", "UNKNOWN", F.upper).alias("segment"),
        _norm("region", "UNKNOWN", F.upper).alias("region"),
        _norm("industry", "unknown").alias("industry"),
        status.alias("status"),
        stage.alias("lifecycle_stage"),
        F.col("nps_score").cast("int").alias("nps_score"),
        F.col("created_at").alias("customer_since"),
        "updated_at",
    )


def stg_subscriptions(subscriptions: DataFrame, *, org_id: str | None = None, as_of=AS_OF) -> DataFrame:
    """A NULL status fails ``!= 'deleted'`` and the row is dropped, as in the source mart."""
    kept = for_tenant(subscriptions, org_id).filter(
        F.col("subscription_id").isNotNull() & F.col("customer_id").isNotNull() & (F.col("status") != "deleted")
    )
    return kept.select(
        "subscription_id", "org_id", "customer_id", "product_id",
        F.trim("plan_name").alias("plan_name"),
        _norm("plan_tier", "standard").alias("plan_tier"),
        _norm("status", "active").alias("status"),
        nz("seats", 1).alias("seats"),
        dec(nz("mrr")).alias("mrr"),
        dec(F.coalesce("arr", F.col("mrr") * 12, F.lit(0))).alias("arr"),
        F.coalesce(F.col("current_period_start").cast("timestamp"), "created_at").alias("started_at"),
        F.coalesce("current_period_end", "trial_end_date", "cancel_at").cast("date").alias("renewal_date"),
        F.col("canceled_at").alias("ended_at"),
    )


def stg_tickets(tickets: DataFrame, *, org_id: str | None = None, as_of=AS_OF, score: Column | None = None) -> DataFrame:
    """``score`` defaults to the sentiment carried by the ticket."""
    score = F.col("sentiment_score") if score is None else score
    return for_tenant(tickets, org_id).filter(F.col("ticket_id").isNotNull()).select(
        "ticket_id", "org_id", "customer_id",
        F.trim("subject").alias("subject"),
        _norm("status", "open").alias("status"),
        _norm("priority", "medium").alias("priority"),
        nz("sla_breach", False).alias("sla_breached"),
        score.alias("sentiment_score"),
        sentiment_label(score, 0.2).alias("sentiment_label"),
        "created_at", "resolved_at",
        F.when(F.col("resolved_at").isNotNull(), hours_between(F.col("created_at"), F.col("resolved_at"))).alias("resolution_hours"),
    )


def stg_product_events(events: DataFrame, *, org_id: str | None = None, as_of=AS_OF, window_days: int = 90) -> DataFrame:
    """The flags test the raw event type, not the normalised one."""
    kept = for_tenant(events, org_id).filter(
        (F.col("occurred_at") >= ts(as_of) - F.expr(f"INTERVAL {window_days} DAYS"))
        & F.col("event_id").isNotNull() & F.col("customer_id").isNotNull()
    )
    return kept.select(
        "event_id", "org_id", "customer_id",
        F.lower(F.trim("event_type")).alias("event_type"),
        F.lower(F.trim(nz("feature_name", "unknown"))).alias("feature_name"),
        nz("event_value", 1).alias("event_value"),
        _norm("platform", "web").alias("platform"),
        "occurred_at",
        F.to_date("occurred_at").alias("occurred_date"),
        nz(F.col("event_type") == "ai_agent_invocation", False).alias("is_ai_event"),
        nz(F.col("event_type").like("%error%"), False).alias("is_error_event"),
        nz(F.col("event_type") == "login", False).alias("is_login"),
    )


def stg_transactions(transactions: DataFrame, *, org_id: str | None = None, as_of=AS_OF) -> DataFrame:
    kept = for_tenant(transactions, org_id).filter(
        F.col("transaction_id").isNotNull() & (F.col("status") == "completed")
    )
    amount = dec(nz("amount"))
    return kept.select(
        "transaction_id", "org_id", "customer_id",
        _norm("transaction_type", "unknown").alias("transaction_type"),
        _norm("status", "completed").alias("status"),
        amount.alias("amount"),
        _norm("currency", "USD", F.upper).alias("currency"),
        amount.alias("amount_usd"),
        F.col("transaction_date").cast("date").alias("transaction_date"),
        F.trunc("transaction_date", "month").alias("transaction_month"),
    )


def stg_contracts(contracts: DataFrame, *, org_id: str | None = None, as_of=AS_OF) -> DataFrame:
    status = _norm("status", "active")
    left = days_between(day(as_of), F.col("end_date"))
    value = dec(nz("contract_value"))
    return for_tenant(contracts, org_id).filter(F.col("contract_id").isNotNull()).select(
        "contract_id", "org_id", "customer_id",
        F.trim(nz("contract_name", "Unnamed Contract")).alias("contract_name"),
        status.alias("contract_status"),
        nz("auto_renewal", False).alias("auto_renewal"),
        value.alias("contract_value"), value.alias("contract_arr"),
        "start_date", "end_date",
        left.alias("days_remaining"),
        ((left <= 90) & (status == "active")).alias("is_expiring_soon"),
    )


def stg_opportunities(opportunities: DataFrame, *, org_id: str | None = None, as_of=AS_OF) -> DataFrame:
    """The quadrant tests raw columns, so a NULL amount falls through to the lower bands."""
    stage = F.lower("stage")
    is_open = ~stage.isin("closed_won", "closed_lost")
    prob, amount = F.col("probability_pct"), F.col("amount_usd")
    quadrant = (
        F.when((prob >= 70) & (amount >= 50000), "A_PRIORITY")
        .when((prob >= 50) & (amount >= 20000), "B_PRIORITY")
        .when(prob >= 30, "C_PIPELINE").otherwise("D_NURTURE")
    )
    kept = for_tenant(opportunities, org_id).filter(F.col("opportunity_id").isNotNull() & F.col("customer_id").isNotNull())
    return kept.select(
        "opportunity_id", "org_id", "customer_id",
        F.trim("opportunity_name").alias("opportunity_name"),
        _norm("opportunity_type", "expansion").alias("opportunity_type"),
        _norm("stage", "prospecting").alias("stage"),
        nz("amount_usd").alias("amount_usd"),
        nz("probability_pct", 50).alias("probability_pct"),
        (nz("amount_usd") * nz("probability_pct", 50) / 100).cast("decimal(20,4)").alias("weighted_amount_usd"),
        "close_date",
        days_between(day(as_of), F.col("close_date")).alias("days_to_close"),
        (stage == "closed_won").alias("is_won"),
        (stage == "closed_lost").alias("is_lost"),
        is_open.alias("is_open"),
        ((F.col("close_date") < day(as_of)) & is_open).alias("is_overdue"),
        quadrant.alias("priority_quadrant"),
    )

"""Organisation-level KPI marts and briefing snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tenantlens.functions.columns import ago, day, dec, mean, mean_if, nz, sum_if
from tenantlens.operators.latest import latest_by, latest_scores
from tenantlens.settings import AS_OF

import datetime as dt

AT_RISK = ("HIGH", "MEDIUM")


def _pending(recommendations: DataFrame) -> DataFrame:
    return recommendations.filter((F.col("status") == "pending") & F.col("is_active"))


def executive_kpis(c360: DataFrame, tickets: DataFrame, recommendations: DataFrame, *, as_of=AS_OF) -> DataFrame:
    """Daily KPI row per tenant from the weighted customer 360.

    The profile already carries the latest score, so scores are not joined
    again. Tickets and recommendations are summed per tenant first and joined
    to the finished aggregate, so they cannot multiply customer rows.
    """
    live = F.col("lifecycle_stage") != "churned"
    soon = F.col("lifecycle_stage").isin("active", "at_risk") & (F.col("nearest_renewal_date") <= day(as_of + dt.timedelta(days=90)))
    base = c360.groupBy("org_id").agg(
        sum_if(live, F.col("arr")).alias("total_arr"), sum_if(live, F.col("mrr")).alias("total_mrr"),
        F.count_if(F.col("lifecycle_stage") == "active").alias("active_customers"),
        F.count_if(F.col("lifecycle_stage") == "at_risk").alias("at_risk_customers"),
        F.count_if(F.col("lifecycle_stage") == "churned").alias("churned_customers"),
        F.count(F.lit(1)).alias("total_customers"),
        F.round(mean_if(live, "health_score"), 1).alias("avg_health_score"),
        F.round(mean_if(live, "nps_score"), 1).alias("avg_nps"),
        sum_if(F.col("churn_risk_level").isin(*AT_RISK), nz("expected_revenue_at_risk")).alias("arr_at_risk"),
        sum_if(soon, F.col("arr")).alias("renewals_90d_arr"),
    )
    is_open = F.col("status") == "open"
    tick = tickets.groupBy("org_id").agg(
        F.count_if(is_open).alias("open_tickets"), F.count_if(is_open & (F.col("priority") == "urgent")).alias("urgent_tickets"))
    recs = _pending(recommendations).groupBy("org_id").agg(
        F.count(F.lit(1)).alias("pending_recommendations"), F.sum("expected_impact_usd").alias("total_expected_impact"))
    out = base.join(tick, "org_id", "left").join(recs, "org_id", "left")
    filled = {c: nz(c) for c in ("open_tickets", "urgent_tickets", "pending_recommendations", "total_expected_impact")}
    return out.withColumns(filled).withColumn("snapshot_date", day(as_of))


def executive_kpis_from_health(health: DataFrame, recommendations: DataFrame, *, as_of=AS_OF) -> DataFrame:
    """KPI row per tenant from customer health."""
    gone = F.col("lifecycle_stage").isin("churned", "cancelled")
    due = ~gone & F.col("contract_end_date").isNotNull() & F.col("days_to_renewal").between(0, 90)
    base = health.groupBy("org_id").agg(
        F.count(F.lit(1)).alias("customer_count"), F.count_if(~gone).alias("active_count"),
        F.count_if(F.col("churn_risk_level") == "HIGH").alias("at_risk_count"), F.count_if(gone).alias("churned_count"),
        sum_if(~gone, nz("arr")).alias("total_arr"), sum_if(~gone, nz("mrr")).alias("total_mrr"),
        F.round(mean_if(~gone, "nps_score"), 1).alias("avg_nps"),
        sum_if(F.col("churn_risk_level").isin(*AT_RISK), nz("expected_revenue_at_risk")).alias("arr_at_risk"),
        sum_if(due, nz("arr")).alias("renewal_90d_arr"),
        F.round(mean_if(~gone, "health_score"), 1).alias("avg_health_score"),
    )
    recs = _pending(recommendations).groupBy("org_id").agg(
        F.count(F.lit(1)).alias("open_recommendations"), F.sum("expected_impact_usd").alias("total_expected_impact_usd"))
    return base.join(recs, "org_id", "left").withColumns(
        {c: nz(c) for c in ("open_recommendations", "total_expected_impact_usd")})


def executive_kpis_risk(customers: DataFrame, churn_scores: DataFrame, tickets: DataFrame, *, as_of=AS_OF) -> DataFrame:
    """KPI row per tenant with average churn risk.

    The source joins every score and ticket before summing, which multiplies
    ARR. Here each customer counts once, with its latest score.
    """
    score = latest_scores(churn_scores).select("customer_id", "org_id", "churn_probability")
    prob = F.coalesce("churn_probability", dec(0.5, 5, 4))
    base = customers.join(score, ["customer_id", "org_id"], "left").groupBy("org_id").agg(
        F.count_distinct("customer_id").alias("total_customers"),
        F.round(mean(prob) * 100, 1).alias("avg_churn_risk_pct"),
        F.count_if(prob > 0.7).alias("critical_risk_count"),
        F.count_if(F.col("lifecycle_stage") == "active").alias("active_customers"),
        nz(F.sum("arr")).alias("total_arr"), nz(F.sum("mrr")).alias("total_mrr"),
        nz(F.round(mean("nps_score"), 1)).alias("avg_nps"),
    )
    tick = tickets.groupBy("org_id").agg(F.count_if(F.col("status") == "open").alias("open_tickets"))
    return base.join(tick, "org_id", "left").withColumn("open_tickets", nz("open_tickets"))


def kpi_snapshot(c360: DataFrame, customers: DataFrame, *, as_of=AS_OF) -> DataFrame:
    """Briefing input: KPIs per tenant plus 30-day new and churned counts."""
    risk = F.col("churn_risk_level")
    base = c360.groupBy("org_id").agg(
        F.count(F.lit(1)).alias("total_customers"), F.count_if(risk == "HIGH").alias("high_risk"),
        F.count_if(risk == "MEDIUM").alias("medium_risk"), F.round(F.sum("arr"), 2).alias("total_arr"),
        F.round(sum_if(risk == "HIGH", F.col("arr")), 2).alias("arr_at_risk"),
        F.round(mean("health_score"), 1).alias("avg_health_score"), F.round(mean("nps_score"), 1).alias("avg_nps"),
    )
    since = ago(as_of, days=30)
    delta = customers.groupBy("org_id").agg(
        F.count_if(F.col("created_at") >= since).alias("new_30d"),
        F.count_if((F.col("lifecycle_stage") == "churned") & (F.col("updated_at") >= since)).alias("churned_30d"))
    return base.join(delta, "org_id", "left")


def as_json(df: DataFrame, keys: list[str], name: str = "payload") -> DataFrame:
    """Fold every non-key column into one JSON object."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*rest)).alias(name))


def weekly_briefing(customers: DataFrame, churn_scores: DataFrame, *, as_of=AS_OF) -> DataFrame:
    """KPIs over the customers scored in the last seven days, each once with the latest score, as one JSON payload per tenant."""
    recent = latest_scores(churn_scores.filter(F.col("scored_at") >= ago(as_of, days=7))).select("customer_id", "org_id", "risk_level")
    high = F.col("risk_level") == "HIGH"
    kpis = customers.join(recent, ["customer_id", "org_id"]).groupBy("org_id").agg(
        F.count(F.lit(1)).alias("total_customers"), F.count_if(high).alias("high_risk_customers"),
        sum_if(high, F.col("arr"), dec(0, 18, 2)).alias("arr_at_risk"))
    return as_json(kpis, ["org_id"])


def snapshot_at(customers: DataFrame, churn_scores: DataFrame, *, as_of) -> DataFrame:
    """Tenant totals as they stood at ``as_of``."""
    known = customers.filter(F.col("created_at") <= ago(as_of)).select("customer_id", "org_id", "arr")
    score = latest_scores(churn_scores.filter(F.col("scored_at") <= ago(as_of))).select("customer_id", "org_id", "churn_probability", "risk_level")
    health = (F.lit(1) - F.coalesce("churn_probability", dec(0.5, 5, 4))) * 100
    return known.join(score, ["customer_id", "org_id"], "left").groupBy("org_id").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("arr").alias("total_arr"),
        F.round(mean(health), 2).alias("avg_health"), F.count_if(F.col("risk_level") == "HIGH").alias("high_risk"))


def kpi_compare(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Current snapshot beside the previous one, with ARR growth."""
    prev = previous.select("org_id", *[F.col(c).alias(f"{c}_prev") for c in ("customers", "total_arr", "avg_health")])
    growth = (F.col("total_arr") - F.col("total_arr_prev")).cast("double") / F.nullif(F.col("total_arr_prev").cast("double"), F.lit(0.0)) * 100
    return current.join(prev, "org_id", "left").withColumn("arr_growth_pct", F.round(growth, 2))


def latest_briefing(briefings: DataFrame) -> DataFrame:
    return latest_by(briefings, ["org_id", "briefing_type"], "created_at", ["briefing_id"])

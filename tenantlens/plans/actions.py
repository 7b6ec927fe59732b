"""Action centre, opportunity scoring and recommendation generation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tenantlens.functions.columns import ago, day, dec, mapped, null_greatest, nz, priority_weight
from tenantlens.operators.latest import latest_scores, top_per_tenant
from tenantlens.settings import AS_OF

CO = ["customer_id", "org_id"]


def open_recommendations(recommendations: DataFrame) -> DataFrame:
    return recommendations.filter(F.col("is_active") & ~F.col("status").isin("completed", "dismissed"))


def action_center(recommendations: DataFrame, c360: DataFrame, *, customers: DataFrame | None = None) -> DataFrame:
    """Open recommendations with customer context and a priority score.

    Passing ``customers`` gives the inner-join form, which drops
    recommendations for unknown customers.
    """
    recs = open_recommendations(recommendations).withColumn("customer_id", F.col("entity_id"))
    side = c360.select(*CO, "customer_name", "segment", "health_score", "churn_risk_level", "churn_probability", "arr",
                       "nearest_renewal_date", "nps_score", "open_tickets")
    if customers is not None:
        known = customers.select(*CO, F.col("name").alias("customer_name"), "segment")
        recs = recs.join(known, CO, "inner")
        side = side.drop("customer_name", "segment")
    joined = recs.join(side, CO, "left")
    impact = dec(nz("expected_impact_usd") / 100000, 24, 7)
    return joined.select(
        "recommendation_id", *CO, "customer_name", "segment", "recommendation_type", "priority", "recommendation_text",
        "expected_impact_usd", "confidence_score", "owner_role", "status", "created_at", "expires_at", "health_score",
        "churn_risk_level", "churn_probability", "arr", "nearest_renewal_date", "nps_score", "open_tickets",
        (priority_weight(F.col("priority")) * (F.lit(1) + impact)).alias("priority_score"),
    )


def _steps(prob: Column, cuts: list[tuple], default) -> Column:
    """First value whose upper probability bound (and extra condition) holds; NULL falls through."""
    out = None
    for cut, extra, value in cuts:
        cond = prob < dec(cut, 5, 4)
        cond = cond & extra if extra is not None else cond
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def _rate(x) -> Column:
    return dec(x, 4, 2)


def opportunity_score(customers: DataFrame, churn_scores: DataFrame, *, existing: DataFrame | None = None, as_of=AS_OF) -> DataFrame:
    """Six-band opportunity score per customer without a current one.

    Scores older than six hours are discarded first and do not count.
    A missing probability fails every comparison and lands in the last band,
    and the reasoning text is then NULL.
    """
    live = customers.filter(F.col("lifecycle_stage") != "churned")
    if existing is not None:
        current = existing.filter(F.col("scored_at") >= ago(as_of, hours=6)).select(*CO)
        live = live.join(current, CO, "left_anti")
    score = latest_scores(churn_scores).select(*CO, "churn_probability")
    j = live.join(score, CO, "left")
    p, arr = F.col("churn_probability"), F.col("arr")
    ends = F.col("contract_end_date") <= day(as_of + dt.timedelta(days=90))
    return j.select(
        *CO,
        _steps(p, [(0.2, arr > 50000, 0.90), (0.2, arr > 20000, 0.75), (0.3, arr > 10000, 0.65), (0.5, None, 0.50), (0.7, None, 0.30)], 0.10).alias("opportunity_score"),
        _steps(p, [(0.3, arr > 30000, "upsell"), (0.3, None, "expansion"), (0.5, None, "cross_sell")],
               F.when(ends, "renewal").otherwise("retention")).alias("opportunity_type"),
        dec(arr * _steps(p, [(0.2, None, _rate(0.25)), (0.4, None, _rate(0.12)), (0.6, None, _rate(0.05))], _rate(0.02))).alias("estimated_revenue_usd"),
        null_greatest(dec(0.1, 5, 4), F.lit(1) - p).alias("confidence"),
        F.concat(F.lit("Score from churn_probability="), p.cast("string"), F.lit(" ARR="), arr.cast("string"),
                 F.lit(" lifecycle="), F.col("lifecycle_stage")).alias("reasoning"),
    )


def opportunity_score_live(customers: DataFrame, churn_scores: DataFrame, *, as_of=AS_OF) -> DataFrame:
    """Opportunity mart over live customers; a missing probability counts as 0.5."""
    score = latest_scores(churn_scores).select(*CO, "churn_probability")
    j = customers.filter(F.col("lifecycle_stage") != "churned").join(score, CO, "left")
    p, arr = F.coalesce("churn_probability", dec(0.5, 5, 4)), F.col("arr")
    ends = F.col("contract_end_date") <= day(as_of + dt.timedelta(days=90))
    return j.select(
        *CO, F.col("name").alias("customer_name"), "arr", "segment", p.alias("churn_risk"),
        _steps(p, [(0.3, arr > 30000, 0.90), (0.3, None, 0.70), (0.5, None, 0.50)], 0.20).alias("opportunity_score"),
        _steps(p, [(0.3, arr > 30000, "upsell"), (0.3, None, "expansion")], F.when(ends, "renewal").otherwise("retention")).alias("opportunity_type"),
        dec(arr * _steps(p, [(0.3, None, _rate(0.25)), (0.5, None, _rate(0.10))], _rate(0.03))).alias("estimated_revenue_usd"),
        "contract_end_date",
    )


def opportunity_score_refresh(customers: DataFrame, churn_scores: DataFrame, *, existing: DataFrame, as_of=AS_OF) -> DataFrame:
    """Six-hourly refresh: score customers without a score in the last six hours."""
    fresh = existing.filter(F.col("scored_at") > ago(as_of, hours=6)).select(*CO)
    score = latest_scores(churn_scores).select(*CO, "churn_probability")
    j = customers.join(fresh, CO, "left_anti").join(score, CO, "left")
    p, arr = F.coalesce("churn_probability", dec(0.5, 5, 4)), F.col("arr")
    return j.select(
        *CO, F.col("name").alias("customer_name"),
        _steps(p, [(0.3, arr > 50000, 0.85), (0.3, arr > 20000, 0.70), (0.5, None, 0.55)], 0.20).alias("opportunity_score"),
        _steps(p, [(0.3, None, "upsell"), (0.5, None, "expansion")], "retention").alias("opportunity_type"),
        dec(arr * _steps(p, [(0.3, None, _rate(0.25)), (0.5, None, _rate(0.10))], _rate(0.05))).alias("estimated_revenue_usd"),
        (F.lit(1) - p).alias("confidence"), p.alias("churn_risk"), "contract_end_date", "arr",
    )


def recommend(churn_scores: DataFrame, customers: DataFrame, c360: DataFrame, recommendations: DataFrame, *,
              per_org: int = 20, as_of=AS_OF) -> DataFrame:
    """Retention recommendations for risky customers without a recent open one.

    All tenants in one plan: the per-tenant top list is a ranked window whose
    group limit runs before the exchange.
    """
    recent = recommendations.filter(
        (F.col("status") == "pending") & F.col("is_active") & (F.col("recommendation_type") == "churn_prevention")
        & (F.col("created_at") >= ago(as_of, days=7))
    ).select(F.col("entity_id").alias("customer_id"), "org_id")
    risky = latest_scores(churn_scores).filter(F.col("risk_level").isin("HIGH", "MEDIUM"))
    known = customers.select(*CO, "name")
    context = c360.select(*CO, "health_score", "nps_score", "arr", "segment", "nearest_renewal_date")
    pool = risky.join(known, CO).join(context, CO).join(recent, CO, "left_anti")
    best = top_per_tenant(pool, [F.col("expected_revenue_at_risk").desc_nulls_last(), F.col("customer_id")], per_org)
    return best.select(
        *CO, F.lit("churn_prevention").alias("recommendation_type"),
        mapped(F.col("risk_level"), {"HIGH": "HIGH"}, "MEDIUM").alias("priority"),
        F.col("recommended_action").alias("recommendation_text"),
        nz("expected_revenue_at_risk").alias("expected_impact_usd"),
        F.col("churn_probability").alias("confidence_score"),
        F.lit("customer_success").alias("owner_role"), F.lit("pending").alias("status"), "rank",
    )

"""Dashboard, API and catalogue reads, for every tenant in one plan.

Dashboards ask for one tenant at a time. Here top-k lists are
ranked per tenant (or per customer) with a group limit ahead of the exchange,
and lists without a limit are left unsorted; sort when displaying.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tenantlens.functions.columns import ago, day, days_between, dec, hours_between, mapped, mean, nz, sum_if, ts
from tenantlens.operators.latest import latest_with_ties, top_per, top_per_tenant
from tenantlens.plans.actions import open_recommendations
from tenantlens.settings import AS_OF

CO = ["customer_id", "org_id"]
PRIORITY_RANK = {"HIGH": 1, "MEDIUM": 2}
RISK_RANK = {"CRITICAL": 1, "HIGH": 2, "MEDIUM": 3}


def where(df: DataFrame, **filters) -> DataFrame:
    """Optional caller filters: None is ignored, a list is IN, ``days_back`` bounds ``created_at``."""
    as_of = filters.pop("as_of", AS_OF)
    days = filters.pop("days_back", None)
    if days is not None:
        df = df.filter(F.col("created_at") >= ago(as_of, days=days))
    for column, value in filters.items():
        if value is None:
            continue
        df = df.filter(F.col(column).isin(*value) if isinstance(value, (list, tuple)) else F.col(column) == value)
    return df


def _names(customers: DataFrame, *extra: str) -> DataFrame:
    return customers.select(*CO, F.col("name").alias("customer"), *extra)


def _top(df: DataFrame, order: list[Column], k: int | None, keys: tuple = ("org_id",)) -> DataFrame:
    """The first ``k`` rows per key with their rank; without ``k`` all rows, unranked."""
    if k is None:
        return df
    return top_per_tenant(df, order, k) if keys == ("org_id",) else top_per(df, list(keys), order, k, "rank")


def _listed(df: DataFrame, *columns) -> DataFrame:
    return df.select(*columns, *(["rank"] if "rank" in df.columns else []))


# -- home ----------------------------------------------------------------------
def top_alerts(churn_scores: DataFrame, customers: DataFrame, *, k: int = 5) -> DataFrame:
    last = latest_with_ties(churn_scores, CO, "scored_at").filter(F.col("risk_level").isin("HIGH", "MEDIUM"))
    best = _top(last, [F.col("churn_probability").desc(), F.col("customer_id")], k)
    return best.join(_names(customers), CO).select("org_id", "customer", "risk_level", "churn_probability", "expected_revenue_at_risk", "recommended_action", "rank")


def risk_distribution(churn_scores: DataFrame) -> DataFrame:
    last = latest_with_ties(churn_scores, CO, "scored_at")
    return last.groupBy("org_id", "risk_level").agg(F.count(F.lit(1)).alias("n"), F.sum("expected_revenue_at_risk").alias("total_arr_risk")) \
        .withColumn("sort_key", mapped(F.col("risk_level"), PRIORITY_RANK, 3))


def urgent_tickets(tickets: DataFrame, customers: DataFrame, *, k: int = 5) -> DataFrame:
    urgent = tickets.filter((F.col("status") == "open") & F.col("priority").isin("urgent", "high"))
    best = _top(urgent, [F.col("sla_breach").desc(), F.col("created_at").asc(), F.col("ticket_id")], k)
    return best.join(_names(customers), CO).select("org_id", "customer", "ticket_id", "subject", "priority", "sentiment_label", "sla_breach", "rank")


def pending_recommendations(recommendations: DataFrame, customers: DataFrame) -> DataFrame:
    pend = recommendations.filter((F.col("status") == "pending") & F.col("is_active")).withColumn("customer_id", F.col("entity_id"))
    return pend.join(_names(customers), CO).select("org_id", "customer", "recommendation_id", "recommendation_type", "priority", "recommendation_text",
                                                  "expected_impact_usd", "confidence_score", "owner_role")


def queue_totals(recommendations: DataFrame, *, as_of=AS_OF) -> DataFrame:
    is_open = F.col("is_active") & ~F.col("status").isin("completed", "dismissed")
    pend = (F.col("status") == "pending") & F.col("is_active")
    return recommendations.groupBy("org_id").agg(
        F.count_if(is_open).alias("total_open"), F.count_if(is_open & (F.col("priority") == "HIGH")).alias("high_priority"),
        sum_if(is_open, nz("expected_impact_usd")).alias("total_impact"),
        F.count_if(is_open & (F.col("recommendation_type") == "churn_prevention")).alias("churn_actions"),
        F.count_if(is_open & (F.col("recommendation_type") == "upsell")).alias("upsell_actions"),
        F.count_if(pend).alias("pending"), sum_if(pend, nz("expected_impact_usd")).alias("pending_impact"),
        F.count_if((F.col("status") == "completed") & (F.col("created_at") >= ago(as_of, days=7))).alias("completed_week"))


# -- executive -----------------------------------------------------------------
def high_risk_customers(health: DataFrame) -> DataFrame:
    return health.filter(F.col("churn_risk_level") == "HIGH").select(
        "org_id", "customer_name", "segment", "churn_probability", "expected_revenue_at_risk", "churn_recommended_action", "open_tickets")


def segment_summary(customers: DataFrame) -> DataFrame:
    live = customers.filter(F.col("lifecycle_stage") != "churned")
    return live.groupBy("org_id", "segment").agg(F.count(F.lit(1)).alias("customers"), F.sum("arr").alias("total_arr"), F.round(mean("nps_score"), 1).alias("avg_nps"))


def contracts_ending(contracts: DataFrame, customers: DataFrame, churn: DataFrame, *, days: int = 180, as_of=AS_OF) -> DataFrame:
    due = contracts.filter((F.col("status") == "active") & (F.col("end_date") <= day(as_of + dt.timedelta(days=days))))
    return due.join(_names(customers), CO).join(churn.select(*CO, F.col("churn_risk_level").alias("churn_risk")), CO, "left").select(
        "org_id", "customer", "contract_name", "contract_value", "end_date", "auto_renewal", "churn_risk",
        days_between(day(as_of), F.col("end_date")).alias("days_to_renewal"))


def what_if(c360: DataFrame, *, retain_pct: int = 20, avg_arr: int = 50000, upsell_pct: int = 15, upsell_value: int = 12000) -> DataFrame:
    """Retention and upsell effect; halves round to even, like the source."""
    base = c360.groupBy("org_id").agg(F.count_if(F.col("churn_risk_level") == "HIGH").alias("at_risk"), F.count_if(F.col("lifecycle_stage") == "active").alias("active"))
    kept, sold = F.bround(F.col("at_risk") * retain_pct / 100).cast("long"), F.bround(F.col("active") * upsell_pct / 100).cast("long")
    return base.select("org_id", "at_risk", "active", kept.alias("retained"), (kept * avg_arr).alias("arr_saved"), sold.alias("upsold"),
                       (sold * upsell_value).alias("arr_expansion"), (kept * avg_arr + sold * upsell_value).alias("total_impact"))


# -- customer page -------------------------------------------------------------
def event_breakdown(events: DataFrame, *, days: int = 14, k: int | None = None, as_of=AS_OF) -> DataFrame:
    daily = events.filter(F.col("occurred_at") >= ago(as_of, days=days)).groupBy(*CO, F.to_date("occurred_at").alias("day"), "event_type", "feature_name") \
        .agg(F.count(F.lit(1)).alias("n"))
    return _top(daily, [F.col("day").desc(), F.col("event_type"), F.col("feature_name")], k, tuple(CO))


def customer_tickets(tickets: DataFrame, *, k: int | None = None) -> DataFrame:
    order = [F.when(F.col("status") == "open", 0).otherwise(1), F.col("created_at").desc(), F.col("ticket_id")]
    return _listed(_top(tickets, order, k, tuple(CO)), *CO, "ticket_id", "subject", "status", "priority", nz("sentiment_label", "neutral").alias("sentiment_label"), "sla_breach", "created_at")


def active_subscriptions(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.filter(F.col("status") == "active").select(*CO, "subscription_id", "plan_name", "plan_tier", "mrr", "arr", F.col("current_period_end").alias("renewal_date"))


# -- action pages --------------------------------------------------------------
def action_queue(recommendations: DataFrame, customers: DataFrame, c360: DataFrame, **filters) -> DataFrame:
    recs = where(open_recommendations(recommendations), **filters).withColumn("customer_id", F.col("entity_id"))
    context = c360.select(*CO, "health_score", "churn_risk_level", "churn_probability", "arr", "nearest_renewal_date", "nps_score")
    return recs.join(_names(customers, "segment"), CO).join(context, CO, "left").select(
        "recommendation_id", *CO, "customer", "segment", "recommendation_type", "priority", "expected_impact_usd", "confidence_score", "owner_role", "status",
        "health_score", "churn_risk_level", "churn_probability", "arr", "nearest_renewal_date", "nps_score",
        mapped(F.col("priority"), PRIORITY_RANK, 3).alias("sort_key"))


def churn_table(churn_scores: DataFrame, customers: DataFrame, c360: DataFrame) -> DataFrame:
    context = c360.select(*CO, "health_score", F.col("arr").alias("c_arr"), "nearest_renewal_date")
    return churn_scores.join(_names(customers, "segment"), CO).join(context, CO, "left").select(
        "score_id", "org_id", "customer", "segment", "churn_probability", "risk_level", "top_drivers", "recommended_action", "expected_revenue_at_risk",
        "scored_at", "health_score", F.col("c_arr").alias("arr"), "nearest_renewal_date")


def expiring_contracts(intelligence: DataFrame, *, k: int = 10) -> DataFrame:
    due = intelligence.filter(F.col("renewal_status").isin("EXPIRING_SOON", "RENEW_WATCH"))
    return _top(due, [F.col("days_to_expiry"), F.col("document_id")], k).select("org_id", "document_id", "contract_name", "customer_name", "end_date", "auto_renewal", "days_to_expiry", "rank")


def open_approvals(queue: DataFrame, *, k: int | None = None, as_of=AS_OF) -> DataFrame:
    live = queue.filter((F.col("status") == "pending") & (F.col("expires_at") > ts(as_of)))
    order = [mapped(F.col("risk_level"), RISK_RANK, 4), F.col("created_at"), F.col("approval_id")]
    return _listed(_top(live, order, k), "org_id", "approval_id", "action_type", "risk_level", hours_between(ts(as_of), F.col("expires_at")).alias("hours_remaining"), "created_at")


# -- operations ----------------------------------------------------------------
def ticket_summary(tickets: DataFrame, *, as_of=AS_OF) -> DataFrame:
    return tickets.filter(F.col("status") == "open").groupBy("org_id").agg(
        F.count(F.lit(1)).alias("total_open"), F.count_if(F.col("priority") == "urgent").alias("urgent_count"),
        F.count_if(F.col("priority") == "high").alias("high_count"), F.round(F.avg(hours_between(F.col("created_at"), ts(as_of))), 1).alias("avg_age_hours"))


def tickets_by(tickets: DataFrame, *dims: str) -> DataFrame:
    return tickets.groupBy(*dims).agg(F.count(F.lit(1)).alias("ticket_count"))


def interaction_trend(interactions: DataFrame, *, days: int = 30, as_of=AS_OF) -> DataFrame:
    recent = interactions.filter(F.col("occurred_at") >= ago(as_of, days=days))
    return recent.groupBy("org_id", F.to_date("occurred_at").alias("day"), "channel").agg(
        F.count(F.lit(1)).alias("interaction_count"), F.round(mean(nz("sentiment_score")), 2).alias("avg_sentiment"))


def at_risk_with_tickets(health: DataFrame, *, level: str | None = None, min_risk: float = 0.5, k: int = 20) -> DataFrame:
    cond = (F.col("churn_risk_score") >= min_risk) if level is None else (F.col("risk_level") == level)
    rows = health.filter(cond & (F.col("open_ticket_count") > 0))
    order = [F.col("churn_risk_score").desc(), F.col("open_ticket_count").desc(), F.col("customer_id")]
    return _top(rows, order, k).select(*CO, "name", "churn_risk_score", "risk_level", "open_ticket_count", "segment", "arr", "rank")


# -- sales ---------------------------------------------------------------------
def top_opportunities(scores: DataFrame, *, k: int = 50) -> DataFrame:
    order = [F.col("opportunity_score").desc(), F.col("estimated_revenue_usd").desc(), F.col("customer_id")]
    return _top(scores, order, k).select(*CO, "customer_name", "arr", "churn_risk", "opportunity_score", "opportunity_type", "estimated_revenue_usd", "contract_end_date", "rank")


def pipeline_summary(scores: DataFrame) -> DataFrame:
    def n(kind):
        return F.count_if(F.col("opportunity_type") == kind).alias(f"{kind}_count")

    return scores.filter(F.col("opportunity_score") >= 0.5).groupBy("org_id").agg(
        F.count(F.lit(1)).alias("total_opportunities"), F.sum("estimated_revenue_usd").alias("total_pipeline"),
        F.round(mean(dec("opportunity_score", 4, 2)), 4).alias("avg_score"), n("upsell"), n("expansion"), n("renewal"))


def pipeline_by_type(scores: DataFrame) -> DataFrame:
    return scores.filter(F.col("opportunity_score") >= 0.5).groupBy("org_id", "opportunity_type").agg(
        F.count(F.lit(1)).alias("opportunities"), F.sum("estimated_revenue_usd").alias("pipeline_usd"), F.round(mean(dec("opportunity_score", 4, 2)), 2).alias("avg_score"))


# -- admin and agents ------------------------------------------------------------
def recent_log(log: DataFrame, columns: list[str], *, days_back: int | None = None, k: int | None = None, as_of=AS_OF) -> DataFrame:
    """Log rows of every tenant; ``days_back`` and ``k`` (newest first) bound the list on request."""
    rows = where(log, days_back=days_back, as_of=as_of)
    return _listed(_top(rows, [F.col("created_at").desc(), F.col("log_id")], k), "org_id", "log_id", "created_at", *columns)


def log_stats(prompts: DataFrame, access: DataFrame) -> DataFrame:
    asked = prompts.groupBy("org_id").agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg("latency_ms"), 0).alias("avg_latency_ms"),
                                          F.count_distinct("session_id").alias("sessions"))
    seen = access.groupBy("org_id").agg(F.count(F.lit(1)).alias("accesses"), F.count_if(~F.col("success")).alias("denied"))
    return seen.join(asked, "org_id", "left")


def agent_stats(sessions: DataFrame, *, as_of=AS_OF) -> DataFrame:
    today, week = F.col("started_at") >= day(as_of), F.col("started_at") >= ago(as_of, days=7)
    return sessions.groupBy("org_id", "agent_type").agg(
        F.count_if(today).alias("sessions_today"), sum_if(today, F.col("message_count")).alias("messages_today"),
        F.count_if(week).alias("sessions_7d"), F.round(F.avg("message_count"), 2).alias("avg_messages"))


def customer_list(c360: DataFrame, *, limit: int | None = None, **filters) -> DataFrame:
    rows = where(c360, **filters)
    return _listed(_top(rows, [F.col("arr").desc_nulls_last(), F.col("customer_id")], limit),
                   *CO, "customer_name", "health_score", "churn_risk_level", "arr", "segment", "nearest_renewal_date")


def customer_by_id(c360: DataFrame, customer_id: str, org_id: str | None = None) -> DataFrame:
    """The customer in one tenant, or in every tenant that has the id."""
    rows = c360.filter(F.col("customer_id") == customer_id)
    return customer_list(rows if org_id is None else rows.filter(F.col("org_id") == org_id))


def tenant_list(health: DataFrame, *, k: int | None = None) -> DataFrame:
    """Tenants for the provider's dashboard; ``k`` keeps those that use the models most."""
    rows = health.select("org_id", "last_active", "dau", "model_calls", "agent_sessions", "features_adopted", "engagement_tier")
    return rows if k is None else rows.orderBy(F.col("model_calls").desc_nulls_last(), "org_id").limit(k)


# -- digests ---------------------------------------------------------------------
def risk_digest(c360: DataFrame, *, k: int = 5, health: float = 40) -> DataFrame:
    """Count and message per tenant; the message names at most ``k`` accounts."""
    risky = c360.filter((F.col("churn_risk_level") == "HIGH") & (F.col("health_score") < health)).select("org_id", "customer_id", "customer_name", "health_score", "arr")
    counts = risky.groupBy("org_id").agg(F.count(F.lit(1)).alias("high_risk_customers"))
    best = _top(risky, [F.col("arr").desc_nulls_last(), F.col("customer_id")], k)
    line = F.concat(F.lit("- "), F.col("customer_name"), F.lit(" (Health: "), F.col("health_score").cast("decimal(5,1)").cast("string"),
                    F.lit(" | ARR: $"), F.round("arr", 0).cast("long").cast("string"), F.lit(")"))
    lines = best.groupBy("org_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return counts.join(lines, "org_id").select(
        "org_id", "high_risk_customers", F.concat("high_risk_customers", F.lit(" high-risk customers detected")).alias("title"),
        F.concat_ws("\n", F.lit("Top at-risk accounts:"), F.transform("l", lambda x: x["line"])).alias("message"))


def sla_digest(tickets: DataFrame, *, hours: int = 24, as_of=AS_OF) -> DataFrame:
    late = tickets.filter(F.col("sla_breach") & ~F.col("status").isin("resolved", "closed") & (F.col("created_at") >= ago(as_of, hours=hours)))
    out = late.groupBy("org_id").agg(F.count(F.lit(1)).alias("breaches"), F.count_if(F.col("priority").isin("critical", "urgent")).alias("critical"))
    return out.withColumns({
        "message": F.concat("breaches", F.lit(" open SLA breaches ("), "critical", F.lit(" critical) in the last "), F.lit(hours), F.lit("h.")),
        "severity": F.when(F.col("critical") > 0, "CRITICAL").otherwise("WARNING")})

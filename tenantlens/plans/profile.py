"""Customer metrics, the three customer-360 definitions and customer health.

Every right-hand side is reduced to one row per (customer, tenant) before it
is joined, so no join fans out and all joins share one partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tenantlens.functions.columns import (
    ago, bands, clamp, day, days_ago, days_between, dec, health_score, mean, nz, sum_if, ts,
)
from tenantlens.operators import staging as st
from tenantlens.operators.latest import latest_scores
from tenantlens.settings import AS_OF

CO = ["customer_id", "org_id"]


def left_all(base: DataFrame, *sides: DataFrame) -> DataFrame:
    for side in sides:
        base = base.join(side, CO, "left")
    return base


def subscription_metrics(subs: DataFrame, *, as_of=AS_OF) -> DataFrame:
    """Active subscription totals per customer from staged subscriptions.

    Summed per plan tier first: the dominant tier is then the smallest of a
    few rows, and everything stays a plain hash aggregate. A ``mode`` aggregate
    keeps a map per customer and falls back to sorting all rows.
    """
    active = F.col("status") == "active"
    per_tier = subs.groupBy(*CO, "plan_tier").agg(
        sum_if(active, F.col("mrr")).alias("mrr"), sum_if(active, F.col("arr")).alias("arr"),
        sum_if(active, F.col("seats")).alias("seats"), F.count_if(active).alias("n"),
        F.min(F.when(active & (F.col("renewal_date") >= day(as_of)), F.col("renewal_date"))).alias("renewal"),
        F.count_if(F.col("status") == "cancelled").alias("cancelled"),
    )
    held = F.col("n") > 0
    out = per_tier.groupBy(*CO).agg(
        F.sum("mrr").alias("mrr"), F.sum("arr").alias("arr"), F.sum("seats").alias("total_seats"), F.sum("n").alias("active_subscriptions"),
        F.min("renewal").alias("nearest_renewal_date"),
        F.min_by("plan_tier", F.when(held, F.struct(-F.col("n"), F.col("plan_tier")))).alias("primary_plan_tier"),
        F.max(F.when(held & (F.col("plan_tier") == "enterprise"), 1).otherwise(0)).alias("is_enterprise"),
        F.sum("cancelled").alias("cancelled_subs"),
    )
    return out.withColumn("days_to_renewal", days_between(day(as_of), F.col("nearest_renewal_date")))


def ticket_metrics(tickets: DataFrame, *, as_of=AS_OF) -> DataFrame:
    recent = F.col("created_at") >= ago(as_of, days=30)
    breached = F.col("sla_breached")
    label = F.col("sentiment_label")
    counts = tickets.groupBy(*CO).agg(
        F.count(F.lit(1)).alias("total_tickets"),
        F.count_if(F.col("status") == "open").alias("open_tickets"),
        F.count_if(F.col("status") == "resolved").alias("resolved_tickets"),
        F.count_if(F.col("priority").isin("high", "critical")).alias("high_priority_tickets"),
        F.count_if(breached).alias("sla_breaches"),
        F.round(mean("sentiment_score"), 3).alias("avg_sentiment_score"),
        *[F.count_if(label == x).alias(f"_{x}") for x in ("negative", "neutral", "positive")],
        F.round(F.avg("resolution_hours"), 1).alias("avg_resolution_hours"),
        F.max("created_at").alias("last_ticket_at"),
        F.count_if(recent).alias("tickets_30d"),
        F.count_if(recent & breached).alias("sla_breaches_30d"),
    )
    # Most frequent label; ties go to the first in alphabetical order.
    negative, neutral, positive = F.col("_negative"), F.col("_neutral"), F.col("_positive")
    top = (F.when((negative >= neutral) & (negative >= positive), "negative").when(neutral >= positive, "neutral").otherwise("positive"))
    return counts.withColumn("dominant_sentiment", top).drop("_negative", "_neutral", "_positive")


def _day_bit(time: str, as_of) -> Column:
    """Bit n set for an event n days before ``as_of`` (0 to 30), else no bit."""
    back = F.datediff(day(as_of), F.to_date(time))
    return F.when(back.between(0, 30), F.call_function("shiftright", F.lit(1 << 30).cast("long"), back)).otherwise(F.lit(0).cast("long"))


_LAST_30 = (1 << 31) - 1
_LAST_7 = _LAST_30 - ((1 << 23) - 1)


def _active_days(bits: str, mask: int) -> Column:
    return F.bit_count(F.bit_or(bits).bitwiseAND(F.lit(mask).cast("long"))).cast("long")


def usage_metrics(events: DataFrame, *, as_of=AS_OF) -> DataFrame:
    """Usage counts per customer up to ``as_of``.

    Events are first reduced to one row per (customer, type, feature), with
    the active days kept as a 31-bit set that merges with OR. The distinct
    counts then expand that small frame instead of the raw events, and a
    customer with very many events is pre-summed map-side.
    """
    date = F.col("occurred_date")
    in7, in30, in90 = (date >= days_ago(as_of, n) for n in (7, 30, 90))
    seen = events.filter(F.col("occurred_at") <= ts(as_of))
    facts = seen.groupBy(*CO, "event_type", "feature_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(in7).alias("n7"), F.count_if(in30).alias("n30"), F.count_if(in90).alias("n90"),
        F.count_if("is_ai_event").alias("ai"), F.count_if(F.col("is_ai_event") & in30).alias("ai30"),
        F.count_if("is_error_event").alias("err"), F.bit_or(_day_bit("occurred_at", as_of)).alias("bits"),
        F.max("occurred_at").alias("last_at"),
    )
    out = facts.groupBy(*CO).agg(
        F.sum("n").alias("total_events"),
        F.count_distinct("event_type").alias("unique_event_types"),
        F.count_distinct("feature_name").alias("features_used"),
        F.sum("n7").alias("events_7d"), F.sum("n30").alias("events_30d"), F.sum("n90").alias("events_90d"),
        _active_days("bits", _LAST_30).alias("active_days_30d"),
        _active_days("bits", _LAST_7).alias("active_days_7d"),
        F.sum("ai").alias("ai_invocations"), F.sum("ai30").alias("ai_invocations_30d"),
        F.sum("err").alias("error_events"),
        F.max("last_at").alias("last_activity_at"),
    )
    weekly = dec(F.col("events_30d"), 20, 0) / 4
    trend = (
        F.when(F.col("events_7d") > weekly * dec(1.2, 4, 2), "up")
        .when(F.col("events_7d") < weekly * dec(0.8, 4, 2), "down").otherwise("stable")
    )
    return out.select(
        "*", days_between(F.col("last_activity_at"), ts(as_of)).alias("days_since_last_activity"),
        trend.alias("usage_trend"),
    )


def usage_windows(events: DataFrame, *, as_of=AS_OF, agent_event: str | None = None) -> DataFrame:
    """30-day and 7-day usage in one pass over the raw events.

    The feature count is the only distinct aggregate left, so nothing is
    expanded and the raw events are exchanged once.
    """
    at = F.col("occurred_at")
    recent = events.filter((at >= ago(as_of, days=30)) & (at <= ts(as_of)))
    in7 = at >= ago(as_of, days=7)
    bit = _day_bit("occurred_at", as_of)
    return recent.withColumns({"_bit": bit, "_bit7": F.when(in7, bit).otherwise(F.lit(0).cast("long"))}).groupBy(*CO).agg(
        F.count(F.lit(1)).alias("events_30d"),
        _active_days("_bit", _LAST_30).alias("active_days_30d"),
        F.count_distinct("feature_name").alias("distinct_features"),
        F.count_if(F.col("event_type") == (agent_event or "")).alias("agent_invocations_30d"),
        F.max("occurred_at").alias("last_activity_at"),
        F.count_if(in7).alias("events_7d"),
        _active_days("_bit7", _LAST_30).alias("active_days_7d"),
    )


def customer_360_weighted(customers, subscriptions, tickets, events, churn_scores, *, org_id=None, as_of=AS_OF) -> DataFrame:
    """Default customer 360: weighted health from churn, NPS, usage and SLA."""
    base = st.stg_customers(customers, org_id=org_id).drop("updated_at")
    subs = subscription_metrics(st.stg_subscriptions(subscriptions, org_id=org_id), as_of=as_of)
    tick = ticket_metrics(st.stg_tickets(tickets, org_id=org_id), as_of=as_of)
    used = usage_metrics(st.stg_product_events(events, org_id=org_id, as_of=as_of), as_of=as_of)
    churn = latest_scores(st.for_tenant(churn_scores, org_id)).select(
        *CO, "churn_probability", F.col("risk_level").alias("churn_risk_level"),
        F.col("recommended_action").alias("churn_recommended_action"),
        "expected_revenue_at_risk", F.col("top_drivers").alias("churn_top_drivers"),
    )
    joined = left_all(
        base,
        subs.select(*CO, "mrr", "arr", "total_seats", "active_subscriptions", "nearest_renewal_date",
                    "days_to_renewal", "primary_plan_tier", "is_enterprise"),
        tick.select(*CO, "open_tickets", "sla_breaches", "avg_sentiment_score",
                    F.col("dominant_sentiment").alias("sentiment_label"), "tickets_30d", "sla_breaches_30d"),
        used.select(*CO, "events_30d", "events_7d", "active_days_30d", "features_used",
                    "ai_invocations_30d", "days_since_last_activity", "usage_trend"),
        churn,
    )
    zero = ["mrr", "arr", "total_seats", "active_subscriptions", "open_tickets", "sla_breaches", "avg_sentiment_score",
            "tickets_30d", "sla_breaches_30d", "events_30d", "events_7d", "active_days_30d", "features_used",
            "ai_invocations_30d", "expected_revenue_at_risk"]
    filled = joined.withColumns({
        **{c: nz(c) for c in zero},
        "is_enterprise": nz("is_enterprise") == 1,
        "sentiment_label": nz("sentiment_label", "neutral"),
        "days_since_last_activity": nz("days_since_last_activity", 999),
        "usage_trend": nz("usage_trend", "no_data"),
        "churn_probability": F.coalesce("churn_probability", dec(0.1, 5, 4)),
        "churn_risk_level": nz("churn_risk_level", "LOW"),
    })
    points = filled.withColumns({
        "nps_normalized": F.round((dec(nz("nps_score"), 8, 2) + 100) / 2, 1).cast("decimal(8,1)"),
        "usage_points": bands(F.col("active_days_30d"), [(20, 100), (10, 70), (5, 40)], 10),
        "sla_points": F.greatest(F.lit(0), F.lit(100) - F.col("sla_breaches") * 15),
    })
    health = health_score(F.col("churn_probability"), F.col("nps_normalized"), F.col("usage_points"), F.col("sla_points"))
    near = F.col("days_to_renewal").isNotNull() & (F.col("days_to_renewal") <= 30) & (F.col("churn_risk_level") != "LOW")
    stage = (
        F.when(F.col("lifecycle_stage") == "churned", "churned")
        .when((F.col("churn_risk_level") == "HIGH") | near, "at_risk").otherwise("active")
    )
    return points.withColumns({
        "health_score": health,
        "derived_lifecycle_stage": stage,
        "ai_recommendations": F.array("churn_recommended_action"),
    })


def plan_names(active_subs: DataFrame) -> DataFrame:
    """Plans per customer, largest ARR first.

    Each plan name appears once: the list is bounded by the plan catalogue,
    not by how many subscriptions a customer holds.
    """
    per_plan = active_subs.groupBy(*CO, "plan_name").agg(F.max(nz("arr")).alias("top_arr"))
    return per_plan.groupBy(*CO).agg(plan_list().alias("plan_names"))


def plan_list() -> Column:
    """Aggregate over (plan_name, top_arr) rows: the names, largest ARR first."""
    pairs = F.collect_list(F.struct((-F.col("top_arr")).alias("o"), "plan_name"))
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: p["plan_name"]), " | ")


def customer_360_bucketed(customers, subscriptions, tickets, events, contracts, churn_scores, *, as_of=AS_OF) -> DataFrame:
    """Second definition: points per bucket, plan list, contract metrics."""
    # one pass per plan, then per customer
    per_plan = subscriptions.filter(F.col("status") == "active").groupBy(*CO, "plan_name").agg(
        F.count(F.lit(1)).alias("active_subscriptions"), F.sum("mrr").alias("total_mrr"), F.sum("arr").alias("total_arr"),
        F.sum("seats").alias("total_seats"), F.min("current_period_end").alias("nearest_renewal_date"), F.max(nz("arr")).alias("top_arr"))
    subs = per_plan.groupBy(*CO).agg(
        *[F.sum(c).cast(per_plan.schema[c].dataType).alias(c) for c in ("active_subscriptions", "total_mrr", "total_arr", "total_seats")],
        F.min("nearest_renewal_date").alias("nearest_renewal_date"), plan_list().alias("plan_names"))
    is_open = F.col("status") == "open"
    tick = tickets.groupBy(*CO).agg(
        F.count(F.lit(1)).alias("total_tickets"), F.count_if(is_open).alias("open_tickets"),
        F.count_if(F.col("priority").isin("urgent", "high") & is_open).alias("critical_open_tickets"),
        F.count_if("sla_breach").alias("sla_breaches"),
        F.round(mean("sentiment_score"), 3).alias("avg_sentiment_score"),
        F.max(F.when(F.col("sentiment_score") < -0.5, 1).otherwise(0)).alias("has_critical_negative"),
        F.max("created_at").alias("last_ticket_date"),
    )
    deals = contracts.groupBy(*CO).agg(
        F.max("contract_value").alias("highest_contract_value"), F.min("end_date").alias("nearest_contract_end"),
        F.count_if(F.col("status") == "active").alias("active_contracts"), F.bool_or("auto_renewal").alias("has_auto_renewal"),
    )
    churn = latest_scores(churn_scores).select(
        *CO, "churn_probability", F.col("risk_level").alias("churn_risk_level"),
        F.col("recommended_action").alias("churn_recommended_action"), "expected_revenue_at_risk",
    )
    used = usage_windows(events, as_of=as_of, agent_event="ai_agent_invocation")
    j = left_all(customers, subs, churn, tick, used, deals)
    zeros = ["total_tickets", "open_tickets", "critical_open_tickets", "sla_breaches", "events_30d", "active_days_30d",
             "distinct_features", "agent_invocations_30d", "events_7d", "active_days_7d"]
    j = j.withColumns({c: nz(c) for c in zeros})
    nps = F.col("nps_score")
    nps_points = F.when(nps.isNull(), 15).otherwise(bands(nps, [(70, 30), (50, 20), (30, 10)], 5))
    sla_points = F.when(F.col("sla_breaches") == 0, 10).when(F.col("sla_breaches") <= 1, 5).otherwise(0)
    raw = (
        (F.lit(1) - F.coalesce("churn_probability", dec(0.5, 5, 4))) * 35
        + nps_points + F.least(F.lit(25), F.col("active_days_30d")) + sla_points
    )
    weekly = dec(F.col("events_30d"), 20, 0) / 4
    trend = (
        F.when(F.col("events_30d") == 0, "no_data")
        .when(F.col("events_7d") >= weekly * dec(1.2, 4, 2), "up")
        .when(F.col("events_7d") <= weekly * dec(0.8, 4, 2), "down").otherwise("stable")
    )
    mood = F.when(F.col("avg_sentiment_score") >= 0.3, "positive").when(F.col("avg_sentiment_score") <= -0.3, "negative").otherwise("neutral")
    return j.select(
        *CO, F.col("name").alias("customer_name"), "segment", "lifecycle_stage",
        F.coalesce("total_arr", "arr").alias("arr"), F.coalesce("total_mrr", "mrr").alias("mrr"),
        "total_seats", "active_subscriptions", "plan_names", "nearest_renewal_date",
        "churn_probability", "churn_risk_level", "expected_revenue_at_risk",
        clamp(F.round(raw, 1), 0, 100).alias("health_score"), "nps_score",
        "total_tickets", "open_tickets", "critical_open_tickets", "sla_breaches", "avg_sentiment_score",
        mood.alias("sentiment_label"), "has_critical_negative", "last_ticket_date", "events_30d", "active_days_30d",
        F.col("distinct_features").alias("distinct_features_used"), "agent_invocations_30d", "last_activity_at",
        "events_7d", "active_days_7d",
        days_between(F.col("last_activity_at"), ts(as_of)).alias("days_since_last_activity"),
        trend.alias("usage_trend"), "active_contracts", "highest_contract_value", "nearest_contract_end", "has_auto_renewal",
    )


def customer_360_inverse_churn(customers, subscriptions, tickets, events, churn_scores, *, as_of=AS_OF) -> DataFrame:
    """Third definition: health is the inverse churn probability."""
    is_open = F.col("status") == "open"
    tick = tickets.groupBy(*CO).agg(
        F.count(F.lit(1)).alias("total_tickets"), F.count_if(is_open).alias("open_tickets"),
        F.count_if(is_open & F.col("priority").isin("urgent", "high")).alias("critical_open_tickets"),
        F.count_if("sla_breach").alias("sla_breaches"),
        F.round(mean("sentiment_score"), 6).alias("avg_sentiment_score"),
        F.max(F.when(F.col("sentiment_label").isNotNull(), F.struct("created_at", "ticket_id", "sentiment_label")))["sentiment_label"].alias("sentiment_label"),
    )
    renewal = subscriptions.filter((F.col("status") == "active") & (F.col("current_period_end") >= day(as_of))) \
        .groupBy(*CO).agg(F.min("current_period_end").alias("nearest_renewal_date"))
    churn = latest_scores(churn_scores).select(
        *CO, "churn_probability", F.col("risk_level").alias("churn_risk_level"), "expected_revenue_at_risk",
        F.col("recommended_action").alias("churn_recommended_action"), "scored_at",
    )
    j = left_all(customers, tick, renewal, churn, usage_windows(events, as_of=as_of, agent_event="ai_agent_invocation"))
    zeros = ["total_tickets", "open_tickets", "critical_open_tickets", "sla_breaches", "events_30d", "active_days_30d",
             "distinct_features", "events_7d", "active_days_7d", "agent_invocations_30d"]
    j = j.withColumns({c: nz(c) for c in zeros})
    month = dec(F.col("events_30d"), 20, 0)
    trend = (
        F.when(F.col("events_30d") == 0, "no_data")
        .when(F.col("events_7d") > month * dec(0.35, 4, 2), "up")
        .when(F.col("events_7d") < month * dec(0.15, 4, 2), "down").otherwise("stable")
    )
    return j.select(
        *CO, F.col("name").alias("customer_name"), "segment", "lifecycle_stage", "nps_score", "arr", "mrr", "contract_end_date",
        "churn_probability", "churn_risk_level", "expected_revenue_at_risk", "churn_recommended_action", "scored_at",
        F.round((F.lit(1) - F.coalesce("churn_probability", dec(0.5, 5, 4))) * 100, 0).alias("health_score"),
        "nearest_renewal_date", "total_tickets", "open_tickets", "critical_open_tickets", "sla_breaches",
        "avg_sentiment_score", "sentiment_label", "events_30d", "active_days_30d",
        F.col("distinct_features").alias("distinct_features_used"), "last_activity_at",
        nz(days_between(F.col("last_activity_at"), ts(as_of)), 999).alias("days_since_last_activity"),
        "events_7d", "active_days_7d", "agent_invocations_30d", trend.alias("usage_trend"),
    )


def customer_health(customers, churn_scores, tickets, events, *, as_of=AS_OF) -> DataFrame:
    """Health per customer from the latest score, open tickets and 30-day usage."""
    churn = latest_scores(churn_scores).select(
        *CO, "churn_probability", F.col("risk_level").alias("churn_risk_level"), "expected_revenue_at_risk",
        F.col("recommended_action").alias("churn_recommended_action"), F.col("scored_at").alias("churn_scored_at"),
    )
    tick = tickets.filter(F.col("status") == "open").groupBy(*CO).agg(
        F.count(F.lit(1)).alias("open_tickets"),
        F.count_if(F.col("priority").isin("urgent", "high")).alias("critical_open_tickets"),
        F.count_if("sla_breach").alias("sla_breaches"),
    )
    used = usage_windows(events, as_of=as_of).select(
        *CO, "events_30d", "active_days_30d", F.col("distinct_features").alias("distinct_features_30d"), "last_activity_at")
    j = left_all(customers, churn, tick, used)
    prob = F.coalesce("churn_probability", dec(0.5, 5, 4))
    return j.select(
        *CO, F.col("name").alias("customer_name"), "segment", "lifecycle_stage", "arr", "mrr", "nps_score", "contract_end_date",
        days_between(day(as_of), F.col("contract_end_date")).alias("days_to_renewal"),
        prob.alias("churn_probability"), nz("churn_risk_level", "UNKNOWN").alias("churn_risk_level"),
        nz("expected_revenue_at_risk").alias("expected_revenue_at_risk"), "churn_recommended_action", "churn_scored_at",
        *[nz(c).alias(c) for c in ("open_tickets", "critical_open_tickets", "sla_breaches", "events_30d", "active_days_30d", "distinct_features_30d")],
        "last_activity_at", days_between(F.col("last_activity_at"), ts(as_of)).alias("days_since_last_activity"),
        F.round((F.lit(1) - prob) * 100, 0).alias("health_score"),
    )


def customer_health_segmented(customers, churn_scores, tickets, interactions, *, as_of=AS_OF) -> DataFrame:
    """Segmented health; one row per customer and score, as the source joins every score.

    The counts come from pre-aggregated sides, so they equal the distinct
    counts of the fanned-out form.
    """
    open_t = tickets.filter(F.col("status") == "open").groupBy(*CO).agg(F.count_distinct("ticket_id").alias("open_ticket_count"))
    calls = interactions.filter(F.col("occurred_at") >= ago(as_of, days=30)).groupBy(*CO) \
        .agg(F.count_distinct("interaction_id").alias("interaction_count_30d"))
    scores = churn_scores.select(*CO, "churn_probability", "risk_level", "recommended_action").distinct()
    prob = F.coalesce("churn_probability", dec(0.5, 5, 4))
    return (
        customers.join(scores, CO, "left").join(open_t, CO, "left").join(calls, CO, "left")
        .select(
            *CO, "name", "segment", "region", "arr", "mrr", "nps_score", "lifecycle_stage", "contract_end_date",
            prob.alias("churn_risk_score"), nz("risk_level", "MEDIUM").alias("risk_level"),
            nz("recommended_action", "Watch engagement pattern").alias("recommended_action"),
            bands(prob, [(0.7, "CRITICAL"), (0.5, "AT_RISK"), (0.3, "HEALTHY")], "CHAMPION").alias("health_segment"),
            nz("open_ticket_count").alias("open_ticket_count"), nz("interaction_count_30d").alias("interaction_count_30d"),
        )
    )


def churn_features(c360: DataFrame) -> DataFrame:
    """Model features from the weighted customer 360, with defaults."""
    defaults = {"health_score": 50, "nps_score": 0, "events_30d": 0, "active_days_30d": 0, "days_since_last_activity": 999,
                "open_tickets": 0, "sla_breaches": 0, "mrr": 0, "arr": 0, "total_seats": 0, "events_7d": 0,
                "features_used": 0, "sla_breaches_30d": 0, "tickets_30d": 0, "ai_invocations_30d": 0, "days_to_renewal": 365}
    base = c360.select(
        *CO, "customer_name", "segment", "region", "industry", "lifecycle_stage",
        *[nz(c, v).alias(c) for c, v in defaults.items()],
        F.coalesce("churn_probability", dec(0.1, 5, 4)).alias("churn_probability"), "usage_trend", "churn_risk_level",
        F.when(F.col("lifecycle_stage") == "churned", 1).otherwise(0).alias("is_churned"),
    )

    def capped(name, full):
        return F.least(dec(F.col(name), 18, 4) / full, F.lit(1))

    engagement = capped("active_days_30d", 20) * dec(0.5) + capped("events_30d", 500) * dec(0.3) + capped("features_used", 10) * dec(0.2)
    return base.withColumns({
        "tickets_per_seat": F.when(F.col("total_seats") > 0, F.round(dec(F.col("open_tickets"), 18, 2) / F.col("total_seats"), 3)).otherwise(0),
        "usage_velocity_ratio": F.when(F.col("events_30d") > 0, F.round(F.col("events_7d") * dec(4.3, 4, 2) / F.col("events_30d"), 2)).otherwise(1),
        "engagement_score": F.round(engagement, 3),
    })

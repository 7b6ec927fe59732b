"""Dashboard, catalogue, metric-layer, digest, context, model and series queries."""

from pyspark.sql import functions as F

from tenantlens.functions import columns as cb
from tenantlens.operators import churn as ch, series as se, staging as st, workflow as wf
from tenantlens.plans import content as co, context as cx, metrics as me, profile as p, reads as r, revenue as rv, verticals as v
from tenantlens.registry.core import define, exact_avg, query
from tenantlens.registry.marts import kpis, opportunities
from tenantlens.registry.oracle_tables import D0, T0
from tenantlens.registry.profile import c360, health
from tenantlens.sources.sinks import materialize

# -- home and executive ----------------------------------------------------------
define("m_tied_scores", "SELECT * FROM b_churn_scores s WHERE scored_at = (SELECT max(scored_at) FROM b_churn_scores x WHERE x.customer_id = s.customer_id AND x.org_id = s.org_id)")


@query("q1_top_alerts", """
SELECT org_id, name AS customer, risk_level, churn_probability, expected_revenue_at_risk, recommended_action, rank FROM (
  SELECT s.*, c.name, row_number() OVER (PARTITION BY s.org_id ORDER BY churn_probability DESC, s.customer_id) AS rank
  FROM m_tied_scores s JOIN b_customers c ON s.customer_id = c.customer_id WHERE risk_level IN ('HIGH', 'MEDIUM')) WHERE rank <= 5""", nums="churn_probability expected_revenue_at_risk")
def _(t):
    return r.top_alerts(t.churn_scores, t.customers)


@query("q2_risk_distribution", """
SELECT org_id, risk_level, count(*) AS n, sum(expected_revenue_at_risk) AS total_arr_risk, CASE risk_level WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END::BIGINT AS sort_key
FROM m_tied_scores GROUP BY 1, 2""", nums="total_arr_risk")
def _(t):
    return r.risk_distribution(t.churn_scores)


@query("q3_urgent_tickets", """
SELECT org_id, name AS customer, ticket_id, subject, priority, sentiment_label, sla_breach, rank FROM (
  SELECT t.*, c.name, row_number() OVER (PARTITION BY t.org_id ORDER BY sla_breach DESC, t.created_at, ticket_id) AS rank
  FROM b_tickets t JOIN b_customers c ON t.customer_id = c.customer_id WHERE t.status = 'open' AND priority IN ('urgent', 'high')) WHERE rank <= 5""")
def _(t):
    return r.urgent_tickets(t.tickets, t.customers)


@query("q4_pending_recommendations", """
SELECT r.org_id, c.name AS customer, recommendation_id, recommendation_type, priority, recommendation_text, expected_impact_usd, confidence_score, owner_role
FROM b_recommendations r JOIN b_customers c ON entity_id = customer_id WHERE r.status = 'pending' AND is_active""", nums="expected_impact_usd confidence_score")
def _(t):
    return r.pending_recommendations(t.recommendations, t.customers)


@query("q5_queue_totals", f"""
SELECT org_id, count(*) FILTER (is_active) AS total_open, count(*) FILTER (is_active AND priority = 'HIGH') AS high_priority,
  coalesce(sum(expected_impact_usd) FILTER (is_active), 0) AS total_impact, count(*) FILTER (is_active AND recommendation_type = 'churn_prevention') AS churn_actions,
  count(*) FILTER (is_active AND recommendation_type = 'upsell') AS upsell_actions, count(*) FILTER (status = 'pending') AS pending,
  coalesce(sum(expected_impact_usd) FILTER (status = 'pending'), 0) AS pending_impact,
  count(*) FILTER (status = 'completed' AND created_at >= {T0} - INTERVAL 7 DAYS) AS completed_week FROM b_recommendations GROUP BY 1""", nums="total_impact pending_impact")
def _(t):
    return r.queue_totals(t.recommendations)


@query("q6_high_risk_customers", """
SELECT org_id, customer_name, segment, churn_probability, expected_revenue_at_risk, churn_recommended_action, open_tickets FROM m_health WHERE churn_risk_level = 'HIGH'""",
       nums="churn_probability expected_revenue_at_risk")
def _(t):
    return r.high_risk_customers(health(t))


@query("q7_segment_summary", """
SELECT org_id, segment, count(*) AS customers, sum(arr) AS total_arr, round(avg(nps_score), 1) AS avg_nps FROM b_customers WHERE lifecycle_stage <> 'churned' GROUP BY 1, 2""", nums="total_arr")
def _(t):
    return r.segment_summary(t.customers)


@query("q8_contracts_ending", f"""
SELECT k.org_id, c.name AS customer, contract_name, contract_value, end_date, auto_renewal, h.churn_risk_level AS churn_risk, date_diff('day', {D0}, end_date) AS days_to_renewal
FROM b_contracts k JOIN b_customers c ON k.customer_id = c.customer_id LEFT JOIN m_health h ON k.customer_id = h.customer_id
WHERE k.status = 'active' AND end_date <= {D0} + 180""", dates="end_date", nums="contract_value")
def _(t):
    return r.contracts_ending(t.contracts, t.customers, health(t))


@query("q9_what_if", """
SELECT org_id, a AS at_risk, b AS active, round_even(a * 0.2, 0)::BIGINT AS retained, round_even(a * 0.2, 0)::BIGINT * 50000 AS arr_saved, round_even(b * 0.15, 0)::BIGINT AS upsold,
  round_even(b * 0.15, 0)::BIGINT * 12000 AS arr_expansion, round_even(a * 0.2, 0)::BIGINT * 50000 + round_even(b * 0.15, 0)::BIGINT * 12000 AS total_impact
FROM (SELECT org_id, count(*) FILTER (churn_risk_level = 'HIGH') AS a, count(*) FILTER (lifecycle_stage = 'active') AS b FROM m_c360 GROUP BY 1)""")
def _(t):
    return r.what_if(c360(t))


# -- customer page ---------------------------------------------------------------
@query("q10_event_breakdown", f"""
SELECT customer_id, org_id, CAST(occurred_at AS DATE) AS day, event_type, feature_name, count(*) AS n
  FROM b_product_events WHERE occurred_at >= {T0} - INTERVAL 14 DAYS GROUP BY 1, 2, 3, 4, 5""", dates="day")
def _(t):
    return r.event_breakdown(t.product_events)


@query("q11_customer_tickets", """
SELECT customer_id, org_id, ticket_id, subject, status, priority, sentiment_label, sla_breach, created_at FROM b_tickets""", times="created_at")
def _(t):
    return r.customer_tickets(t.tickets)


@query("q12_active_subscriptions", "SELECT customer_id, org_id, subscription_id, plan_name, plan_tier, mrr, arr, current_period_end AS renewal_date FROM b_subscriptions WHERE status = 'active'",
       dates="renewal_date", nums="mrr arr")
def _(t):
    return r.active_subscriptions(t.subscriptions)


@query("q12_customer_contracts", "SELECT customer_id, org_id, contract_name, contract_value, start_date, end_date, status, auto_renewal FROM b_contracts", dates="start_date end_date", nums="contract_value")
def _(t):
    return t.contracts.select("customer_id", "org_id", "contract_name", "contract_value", "start_date", "end_date", "status", "auto_renewal")


@query("q12_customer_recommendations", "SELECT entity_id, org_id, recommendation_id, recommendation_type, priority, status FROM b_recommendations WHERE is_active")
def _(t):
    return r.where(t.recommendations, is_active=True).select("entity_id", "org_id", "recommendation_id", "recommendation_type", "priority", "status")


# -- action pages ----------------------------------------------------------------
define("m_queue", """
SELECT r.recommendation_id, r.entity_id AS customer_id, r.org_id, b.name AS customer, b.segment, r.recommendation_type, r.priority, r.expected_impact_usd, r.confidence_score,
  r.owner_role, r.status, c.health_score, c.churn_risk_level, c.churn_probability, c.arr, c.nearest_renewal_date, c.nps_score,
  CASE r.priority WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END::BIGINT AS sort_key, r.created_at
FROM b_recommendations r JOIN b_customers b ON r.entity_id = b.customer_id LEFT JOIN m_c360 c ON r.entity_id = c.customer_id WHERE r.is_active""")
_Q13 = dict(dates="nearest_renewal_date", nums="expected_impact_usd confidence_score health_score churn_probability arr")


@query("q13_action_queue", "SELECT * EXCLUDE created_at FROM m_queue", **_Q13)
def _(t):
    return r.action_queue(t.recommendations, t.customers, c360(t))


@query("c9_action_queue_filtered", f"""
SELECT * EXCLUDE created_at FROM m_queue WHERE priority IN ('HIGH', 'MEDIUM') AND recommendation_type = 'upsell' AND created_at >= {T0} - INTERVAL 14 DAYS""", **_Q13)
def _(t):
    return r.action_queue(t.recommendations, t.customers, c360(t), priority=["HIGH", "MEDIUM"], recommendation_type="upsell", owner_role=None, days_back=14)


@query("q14_churn_table", """
SELECT score_id, s.org_id, c.name AS customer, c.segment, s.churn_probability, s.risk_level, s.top_driver AS top_drivers, s.recommended_action, s.expected_revenue_at_risk, s.scored_at,
  h.health_score, h.arr, h.nearest_renewal_date FROM b_churn_scores s JOIN b_customers c ON s.customer_id = c.customer_id LEFT JOIN m_c360 h ON s.customer_id = h.customer_id""",
       dates="nearest_renewal_date", times="scored_at", nums="churn_probability expected_revenue_at_risk health_score arr")
def _(t):
    return r.churn_table(t.churn_scores, t.customers, c360(t))


@query("q15_expiring_contracts", f"""
SELECT org_id, document_id, document_name AS contract_name, name AS customer_name, end_date, auto_renewal, date_diff('day', {D0}, end_date) AS days_to_expiry, rank FROM (
  SELECT d.*, c.name, row_number() OVER (PARTITION BY d.org_id ORDER BY end_date, document_id) AS rank FROM b_documents d LEFT JOIN b_customers c ON entity_id = customer_id
  WHERE document_type = 'contract' AND end_date BETWEEN {D0} AND {D0} + 90) WHERE rank <= 10""", dates="end_date")
def _(t):
    return r.expiring_contracts(co.contract_intelligence(t.documents, c360(t)))


@query("q16_open_approvals", f"""
SELECT org_id, approval_id, action_type, risk_level, hours_remaining, created_at FROM m_approvals WHERE status = 'pending' AND expires_at > {T0}""", times="created_at")
def _(t):
    return r.open_approvals(wf.apply_approval_events(wf.submit(t.approvals), t.approval_events))


# -- operations ------------------------------------------------------------------
@query("q17_ticket_summary", f"""
SELECT org_id, count(*) AS total_open, count(*) FILTER (priority = 'urgent') AS urgent_count, count(*) FILTER (priority = 'high') AS high_count,
  round(avg(date_diff('hour', created_at, {T0})), 1) AS avg_age_hours FROM b_tickets WHERE status = 'open' GROUP BY 1""")
def _(t):
    return r.ticket_summary(t.tickets)


@query("q18_tickets_by_status_priority", "SELECT org_id, status, priority, count(*) AS ticket_count FROM b_tickets GROUP BY 1, 2, 3")
def _(t):
    return r.tickets_by(t.tickets, "org_id", "status", "priority")


@query("q19_interaction_trend", f"""
SELECT org_id, CAST(occurred_at AS DATE) AS day, channel, count(*) AS interaction_count, {exact_avg('sentiment_score', 2)} AS avg_sentiment
FROM b_interactions WHERE occurred_at >= {T0} - INTERVAL 30 DAYS GROUP BY 1, 2, 3""", dates="day")
def _(t):
    return r.interaction_trend(t.interactions)


define("m_seg_health", """
SELECT DISTINCT c.customer_id, c.org_id, c.name, c.segment, c.arr, coalesce(h.churn_probability, 0.5) AS churn_risk_score, coalesce(h.risk_level, 'MEDIUM') AS risk_level,
  coalesce(t.n, 0) AS open_ticket_count FROM b_customers c LEFT JOIN m_latest_churn h ON c.customer_id = h.customer_id
LEFT JOIN (SELECT customer_id, count(DISTINCT ticket_id) AS n FROM b_tickets WHERE status = 'open' GROUP BY 1) t ON c.customer_id = t.customer_id""")


def seg_health(t):
    from tenantlens.operators.latest import latest_scores
    return p.customer_health_segmented(t.customers, latest_scores(t.churn_scores), t.tickets, t.interactions)


def _risk_sql(cond):
    return f"""SELECT customer_id, org_id, name, churn_risk_score, risk_level, open_ticket_count, segment, arr, rank FROM (SELECT *, row_number() OVER (PARTITION BY org_id
  ORDER BY churn_risk_score DESC, open_ticket_count DESC, customer_id) AS rank FROM m_seg_health WHERE {cond} AND open_ticket_count > 0) WHERE rank <= 20"""


@query("q20_at_risk_with_tickets", _risk_sql("churn_risk_score >= 0.5"), nums="churn_risk_score arr")
def _(t):
    return r.at_risk_with_tickets(seg_health(t))


# -- sales -----------------------------------------------------------------------
@query("q21_top_opportunities", """
SELECT customer_id, org_id, customer_name, arr, churn_risk, opportunity_score, opportunity_type, estimated_revenue_usd, contract_end_date, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY opportunity_score DESC, estimated_revenue_usd DESC, customer_id) AS rank FROM m_opportunity) WHERE rank <= 50""",
       dates="contract_end_date", nums="arr churn_risk opportunity_score estimated_revenue_usd")
def _(t):
    return r.top_opportunities(opportunities(t))


@query("q21_pipeline_summary", """
SELECT org_id, count(*) AS total_opportunities, sum(estimated_revenue_usd) AS total_pipeline, round(avg(opportunity_score), 4) AS avg_score,
  count(*) FILTER (opportunity_type = 'upsell') AS upsell_count, count(*) FILTER (opportunity_type = 'expansion') AS expansion_count,
  count(*) FILTER (opportunity_type = 'renewal') AS renewal_count FROM m_opportunity WHERE opportunity_score >= 0.5 GROUP BY 1""", nums="total_pipeline")
def _(t):
    return r.pipeline_summary(opportunities(t))


# -- admin and agents --------------------------------------------------------------
def _log_sql(table, cols):
    return f"SELECT org_id, log_id, created_at, {cols} FROM {table}"


@query("q22_analyst_log", _log_sql("b_prompt_log", "user_name, session_id, prompt, latency_ms"), times="created_at")
def _(t):
    return r.recent_log(t.prompt_log, ["user_name", "session_id", "prompt", "latency_ms"])


@query("q22_access_log", _log_sql("b_access_log", "user_name, resource_type, success"), times="created_at")
def _(t):
    return r.recent_log(t.access_log, ["user_name", "resource_type", "success"])


@query("q22_log_stats", """
SELECT org_id, accesses, denied, questions, avg_latency_ms, sessions FROM (SELECT org_id, count(*) AS accesses, count(*) FILTER (NOT success) AS denied FROM b_access_log GROUP BY 1)
LEFT JOIN (SELECT org_id, count(*) AS questions, round(avg(latency_ms), 0) AS avg_latency_ms, count(DISTINCT session_id) AS sessions FROM b_prompt_log GROUP BY 1) USING (org_id)""")
def _(t):
    return r.log_stats(t.prompt_log, t.access_log)


@query("q23_agent_stats", f"""
SELECT org_id, agent_type, count(*) FILTER (started_at >= {T0}) AS sessions_today, CAST(coalesce(sum(message_count) FILTER (started_at >= {T0}), 0) AS BIGINT) AS messages_today,
  count(*) FILTER (started_at >= {T0} - INTERVAL 7 DAYS) AS sessions_7d, round(avg(message_count), 2) AS avg_messages FROM b_agent_sessions GROUP BY 1, 2""")
def _(t):
    return r.agent_stats(t.agent_sessions)


@query("q23_session_list", """
SELECT org_id, session_id AS log_id, started_at AS created_at, agent_type, user_name, message_count FROM b_agent_sessions""", times="created_at")
def _(t):
    log = t.agent_sessions.withColumns({"log_id": F.col("session_id"), "created_at": F.col("started_at")})
    return r.recent_log(log, ["agent_type", "user_name", "message_count"])


@query("q24_customer_list", """
SELECT customer_id, org_id, customer_name, health_score, churn_risk_level, arr, segment, nearest_renewal_date FROM m_c360 WHERE churn_risk_level = 'HIGH'""",
       dates="nearest_renewal_date", nums="health_score arr")
def _(t):
    return r.customer_list(c360(t), churn_risk_level="HIGH")


@query("q24_customer_by_id", """
SELECT customer_id, org_id, customer_name, health_score, churn_risk_level, arr, segment, nearest_renewal_date FROM m_c360 WHERE customer_id = 'CUST-7'""",
       dates="nearest_renewal_date", nums="health_score arr")
def _(t):
    return r.customer_by_id(c360(t), "CUST-7")


# -- verified questions --------------------------------------------------------------
@query("q25_high_risk", """
SELECT org_id, customer_name, segment, churn_probability, arr, expected_revenue_at_risk FROM m_c360 WHERE churn_risk_level = 'HIGH' AND lifecycle_stage <> 'churned'""",
       nums="churn_probability arr expected_revenue_at_risk")
def _(t):
    rows = c360(t).filter((F.col("churn_risk_level") == "HIGH") & (F.col("lifecycle_stage") != "churned"))
    return rows.select("org_id", "customer_name", "segment", "churn_probability", "arr", "expected_revenue_at_risk")


_LIVE = "lifecycle_stage <> 'churned'"


@query("q25_health_by_segment", f"SELECT org_id, segment, round(avg(health_score), 1) AS avg_health_score, count(*) AS total_customers, round(avg(churn_probability), 3) AS avg_churn_probability FROM m_c360 WHERE {_LIVE} GROUP BY 1, 2")
def _(t):
    out = me.model_metric("customer_360", c360(t), ["avg_health_score", "total_customers", "avg_churn_probability"], ["org_id", "segment"], _LIVE)
    return out.withColumns({"avg_health_score": F.round("avg_health_score", 1), "avg_churn_probability": F.round("avg_churn_probability", 3)})


@query("q25_renewals_90d", f"SELECT org_id, customer_name, segment, arr, nearest_renewal_date, churn_risk_level, health_score FROM m_c360 WHERE nearest_renewal_date <= {D0} + 90 AND lifecycle_stage = 'active'",
       dates="nearest_renewal_date", nums="arr health_score")
def _(t):
    import datetime as dt
    from tenantlens.settings import AS_OF
    rows = c360(t).filter((F.col("nearest_renewal_date") <= cb.day(AS_OF + dt.timedelta(days=90))) & (F.col("lifecycle_stage") == "active"))
    return rows.select("org_id", "customer_name", "segment", "arr", "nearest_renewal_date", "churn_risk_level", "health_score")


@query("q25_total_arr_at_risk", f"""
SELECT org_id, sum(expected_revenue_at_risk) AS total_arr_at_risk, count(*) AS at_risk_customers, sum(arr) AS total_arr,
  round(sum(expected_revenue_at_risk)::DOUBLE / nullif(sum(arr), 0)::DOUBLE * 100, 1) AS pct_arr_at_risk FROM m_c360
WHERE churn_risk_level IN ('HIGH', 'MEDIUM') AND {_LIVE} GROUP BY 1""", nums="total_arr_at_risk total_arr")
def _(t):
    rows = me.metric(c360(t), {"total_arr_at_risk": ("expected_revenue_at_risk", "sum"), "at_risk_customers": ("1", "count"), "total_arr": ("arr", "sum")},
                     ["org_id"], f"churn_risk_level IN ('HIGH', 'MEDIUM') AND {_LIVE}")
    pct = F.col("total_arr_at_risk").cast("double") / F.nullif(F.col("total_arr").cast("double"), F.lit(0.0)) * 100
    return rows.withColumn("pct_arr_at_risk", F.round(pct, 1))


@query("q25_pending_actions", """
SELECT customer_id, c.org_id, customer_name, segment, churn_risk_level, n AS pending_actions, s AS total_expected_impact FROM m_c360 c
  JOIN (SELECT entity_id, org_id, count(*) AS n, sum(expected_impact_usd) AS s FROM b_recommendations WHERE status = 'pending' AND is_active GROUP BY 1, 2) p
  ON entity_id = customer_id AND p.org_id = c.org_id""",
       nums="total_expected_impact")
def _(t):
    pend = t.recommendations.filter((F.col("status") == "pending") & F.col("is_active")).groupBy(F.col("entity_id").alias("customer_id"), "org_id").agg(
        F.count(F.lit(1)).alias("pending_actions"), F.sum("expected_impact_usd").alias("total_expected_impact"))
    return c360(t).join(pend, ["customer_id", "org_id"]).select(
        "customer_id", "org_id", "customer_name", "segment", "churn_risk_level", "pending_actions", "total_expected_impact")


_KPI = "total_arr total_mrr arr_at_risk renewals_90d_arr total_expected_impact"


@query("q25_kpis_today", f"""
SELECT org_id, total_arr, total_mrr, active_customers, at_risk_customers, arr_at_risk, avg_health_score, avg_nps, open_tickets, renewals_90d_arr, pending_recommendations,
  total_expected_impact FROM m_kpis WHERE snapshot_date = {D0}""", nums=_KPI)
def _(t):
    cols = "org_id total_arr total_mrr active_customers at_risk_customers arr_at_risk avg_health_score avg_nps open_tickets renewals_90d_arr pending_recommendations total_expected_impact"
    from tenantlens.settings import AS_OF
    return kpis(t).filter(F.col("snapshot_date") == cb.day(AS_OF)).select(*cols.split())


@query("q25_arr_trend_30d", f"SELECT org_id, snapshot_date, total_arr, arr_at_risk, at_risk_customers FROM m_kpis WHERE snapshot_date >= {D0} - 30", dates="snapshot_date", nums="total_arr arr_at_risk")
def _(t):
    from tenantlens.settings import AS_OF
    return kpis(t).filter(F.col("snapshot_date") >= cb.days_ago(AS_OF, 30)).select("org_id", "snapshot_date", "total_arr", "arr_at_risk", "at_risk_customers")


@query("q25_at_risk_rate", """
SELECT org_id, at_risk_customers, active_customers + at_risk_customers AS total_active, round(at_risk_customers * 100 / nullif(active_customers + at_risk_customers, 0), 1) AS pct_at_risk,
  arr_at_risk, round(arr_at_risk::DOUBLE * 100 / nullif(total_arr, 0)::DOUBLE, 1) AS pct_arr_at_risk FROM m_kpis""", nums="arr_at_risk")
def _(t):
    live = F.col("active_customers") + F.col("at_risk_customers")
    return kpis(t).select("org_id", "at_risk_customers", live.alias("total_active"), F.round(F.col("at_risk_customers") * 100 / F.nullif(live, F.lit(0)), 1).alias("pct_at_risk"), "arr_at_risk",
                          F.round(F.col("arr_at_risk").cast("double") * 100 / F.nullif(F.col("total_arr").cast("double"), F.lit(0.0)), 1).alias("pct_arr_at_risk"))


@query("q25_arr_by_segment", f"SELECT org_id, segment, sum(arr) AS total_arr, count(*) AS total_customers FROM m_c360 WHERE {_LIVE} GROUP BY 1, 2", nums="total_arr")
def _(t):
    return me.model_metric("customer_360", c360(t), ["total_arr", "total_customers"], ["org_id", "segment"], _LIVE)


@query("q25_urgent_tickets", "SELECT org_id, count(*) AS ticket_count FROM b_tickets WHERE status = 'open' AND priority = 'urgent' GROUP BY 1")
def _(t):
    return me.model_metric("tickets", t.tickets, ["ticket_count"], ["org_id"], "status = 'open' AND priority = 'urgent'")


@query("q25_ticket_volume", "SELECT status, priority, count(*) AS ticket_count FROM b_tickets GROUP BY 1, 2")
def _(t):
    return me.model_metric("tickets", t.tickets, ["ticket_count"], ["status", "priority"])


@query("q25_channels_30d", f"SELECT org_id, channel, count(*) AS interaction_count, {exact_avg('sentiment_score', 2)} AS avg_sentiment FROM b_interactions WHERE occurred_at >= {T0} - INTERVAL 30 DAYS GROUP BY 1, 2")
def _(t):
    from tenantlens.settings import AS_OF
    recent = t.interactions.filter(F.col("occurred_at") >= cb.ago(AS_OF, days=30))
    return me.model_metric("interactions", recent, ["interaction_count", "avg_sentiment"], ["org_id", "channel"]).withColumn("avg_sentiment", F.round("avg_sentiment", 2))


@query("q25_critical_with_tickets", _risk_sql("risk_level = 'HIGH'"), nums="churn_risk_score arr")
def _(t):
    return r.at_risk_with_tickets(seg_health(t), level="HIGH")


@query("q25_resolution_by_priority", f"SELECT org_id, priority, round(avg(date_diff('hour', created_at, coalesce(resolved_at, {T0}))), 1) AS avg_resolution_hours, count(*) AS ticket_count FROM b_tickets GROUP BY 1, 2")
def _(t):
    from tenantlens.settings import AS_OF
    hours = cb.hours_between(F.col("created_at"), F.coalesce("resolved_at", cb.ts(AS_OF)))
    return t.tickets.groupBy("org_id", "priority").agg(F.round(F.avg(hours), 1).alias("avg_resolution_hours"), F.count(F.lit(1)).alias("ticket_count"))


@query("q25_pipeline_by_type", """
SELECT org_id, opportunity_type, count(*) AS opportunities, sum(estimated_revenue_usd) AS pipeline_usd, round(avg(opportunity_score), 2) AS avg_score
FROM m_opportunity WHERE opportunity_score >= 0.5 GROUP BY 1, 2""", nums="pipeline_usd")
def _(t):
    return r.pipeline_by_type(opportunities(t))


@query("q25_renewals_60d", f"""
SELECT org_id, customer_name, contract_end_date, opportunity_score, estimated_revenue_usd, churn_risk, arr FROM m_opportunity
WHERE opportunity_type = 'renewal' AND contract_end_date BETWEEN {D0} AND {D0} + 60""", dates="contract_end_date", nums="opportunity_score estimated_revenue_usd churn_risk arr")
def _(t):
    import datetime as dt
    from tenantlens.settings import AS_OF
    rows = opportunities(t).filter((F.col("opportunity_type") == "renewal") & F.col("contract_end_date").between(cb.day(AS_OF), cb.day(AS_OF + dt.timedelta(days=60))))
    return rows.select("org_id", "customer_name", "contract_end_date", "opportunity_score", "estimated_revenue_usd", "churn_risk", "arr")


@query("q25_top5_opportunities", """
SELECT customer_id, org_id, opportunity_type, opportunity_score, estimated_revenue_usd, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY opportunity_score DESC, estimated_revenue_usd DESC, customer_id) AS rank FROM m_opportunity) WHERE rank <= 5""",
       nums="opportunity_score estimated_revenue_usd")
def _(t):
    return r.top_opportunities(opportunities(t), k=5).select("customer_id", "org_id", "opportunity_type", "opportunity_score", "estimated_revenue_usd", "rank")


@query("q25_movement_6m", f"SELECT org_id, month, transaction_type, transaction_count, total_amount FROM m_monthly WHERE month >= DATE '2023-07-01' AND month <= {D0}", dates="month", nums="total_amount")
def _(t):
    import datetime as dt
    tx = t.transactions.filter(F.col("transaction_date").between(F.lit(dt.date(2023, 7, 1)), F.lit(dt.date(2024, 1, 31))))
    return rv.revenue_by_month(tx).select("org_id", "month", "transaction_type", "transaction_count", "total_amount")


@query("q25_active_products", "SELECT product_name, product_category, unit_price FROM b_products WHERE is_active", nums="unit_price")
def _(t):
    return t.products.filter("is_active").select("product_name", "product_category", "unit_price")


# -- metric layer --------------------------------------------------------------------
@query("q26_metric_customer_360", """
SELECT region, churn_risk_level, count(*) AS total_customers, sum(CASE WHEN churn_risk_level = 'HIGH' THEN 1 ELSE 0 END)::BIGINT AS high_risk_count, sum(arr) AS total_arr,
  sum(expected_revenue_at_risk) AS revenue_at_risk, sum(open_tickets)::BIGINT AS open_tickets FROM m_c360 GROUP BY 1, 2""", nums="total_arr revenue_at_risk")
def _(t):
    return me.model_metric("customer_360", c360(t), ["total_customers", "high_risk_count", "total_arr", "revenue_at_risk", "open_tickets"], ["region", "churn_risk_level"])


@query("q26_metric_tickets", """
SELECT category, count(*) AS ticket_count, sum(CASE WHEN status = 'open' THEN 1 ELSE 0 END)::BIGINT AS open_ticket_count,
  sum(CASE WHEN priority = 'urgent' THEN 1 ELSE 0 END)::BIGINT AS urgent_ticket_count FROM b_tickets GROUP BY 1""")
def _(t):
    return me.model_metric("tickets", t.tickets, ["ticket_count", "open_ticket_count", "urgent_ticket_count"], ["category"])


@query("q26_metric_products", "SELECT product_category, count(*) AS product_count, round(avg(unit_price), 4) AS avg_unit_price, sum(unit_price) AS total_catalog_value FROM b_products GROUP BY 1", nums="total_catalog_value")
def _(t):
    return me.model_metric("products", t.products, ["product_count", "avg_unit_price", "total_catalog_value"], ["product_category"]).withColumn("avg_unit_price", F.round("avg_unit_price", 4))


@query("d14_star_join", """
SELECT i.org_id, c.segment AS dim_segment, channel, count(*) AS interaction_count, sum(CASE WHEN direction = 'inbound' THEN 1 ELSE 0 END)::BIGINT AS inbound_count
FROM b_interactions i LEFT JOIN m_c360 c ON i.customer_id = c.customer_id AND i.org_id = c.org_id GROUP BY 1, 2, 3""")
def _(t):
    fact = me.star("interactions", t.interactions, "customer_360", c360(t), ["segment"])
    names = me.MODELS["interactions"][1]
    return me.metric(fact, {m: names[m] for m in ("interaction_count", "inbound_count")}, ["org_id", "dim_segment", "channel"])


@query("q26_metric_recommendations", """
SELECT recommendation_type, priority, sum(CASE WHEN status = 'pending' AND is_active THEN 1 ELSE 0 END)::BIGINT AS pending_recommendations, sum(expected_impact_usd) AS expected_impact
FROM b_recommendations GROUP BY 1, 2""", nums="expected_impact")
def _(t):
    return me.model_metric("recommendations", t.recommendations, ["pending_recommendations", "expected_impact"], ["recommendation_type", "priority"])


@query("q26_metric_interactions", f"""
SELECT channel, direction, count(*) AS interaction_count, {exact_avg('sentiment_score', 4)} AS avg_sentiment,
  sum(CASE WHEN sentiment_score < 0 THEN 1 ELSE 0 END)::BIGINT AS negative_interactions FROM b_interactions GROUP BY 1, 2""", nums="avg_sentiment")
def _(t):
    out = me.model_metric("interactions", t.interactions, ["interaction_count", "avg_sentiment", "negative_interactions"], ["channel", "direction"])
    return out.withColumn("avg_sentiment", F.round("avg_sentiment", 4))


@query("q26_metric_transactions", "SELECT transaction_type, status, currency, sum(amount) AS total_revenue, count(*) AS transaction_count FROM b_transactions GROUP BY 1, 2, 3", nums="total_revenue")
def _(t):
    return me.model_metric("transactions", t.transactions, ["total_revenue", "transaction_count"], ["transaction_type", "status", "currency"])


@query("q26_metric_customer_health", """
SELECT segment, risk_level, sum(open_ticket_count)::BIGINT AS total_open_tickets, sum(arr) AS total_arr, sum(CASE WHEN risk_level = 'HIGH' THEN 1 ELSE 0 END)::BIGINT AS critical_customers
FROM m_seg_health GROUP BY 1, 2""", nums="total_arr")
def _(t):
    return me.model_metric("customer_health", seg_health(t), ["total_open_tickets", "total_arr", "critical_customers"], ["segment", "risk_level"])


@query("q26_metric_executive_kpis", "SELECT snapshot_date, sum(total_arr) AS total_arr, sum(active_customers)::BIGINT AS active_customers, sum(open_tickets)::BIGINT AS open_tickets FROM m_kpis GROUP BY 1",
       dates="snapshot_date", nums="total_arr")
def _(t):
    return me.model_metric("executive_kpis", kpis(t), ["total_arr", "active_customers", "open_tickets"], ["snapshot_date"])


@query("q26_drill_across", """
WITH k AS (SELECT f.org_id, d.segment, count(*) AS ticket_count FROM b_tickets f LEFT JOIN m_seg_health d USING (customer_id, org_id) GROUP BY 1, 2),
  x AS (SELECT f.org_id, d.segment, sum(amount) AS total_revenue FROM b_transactions f LEFT JOIN m_c360 d USING (customer_id, org_id) GROUP BY 1, 2),
  r AS (SELECT f.org_id, d.segment, sum(expected_impact_usd) AS expected_impact FROM b_recommendations f
    LEFT JOIN m_c360 d ON f.entity_id = d.customer_id AND f.org_id = d.org_id GROUP BY 1, 2),
  c AS (SELECT org_id, segment, count(*) AS total_customers, sum(arr) AS total_arr FROM m_c360 GROUP BY 1, 2),
  g AS (SELECT org_id, segment FROM k UNION SELECT org_id, segment FROM x UNION SELECT org_id, segment FROM r UNION SELECT org_id, segment FROM c)
SELECT g.org_id, g.segment, ticket_count, total_revenue, expected_impact, total_customers, total_arr FROM g
LEFT JOIN k ON g.org_id IS NOT DISTINCT FROM k.org_id AND g.segment IS NOT DISTINCT FROM k.segment
LEFT JOIN x ON g.org_id IS NOT DISTINCT FROM x.org_id AND g.segment IS NOT DISTINCT FROM x.segment
LEFT JOIN r ON g.org_id IS NOT DISTINCT FROM r.org_id AND g.segment IS NOT DISTINCT FROM r.segment
LEFT JOIN c ON g.org_id IS NOT DISTINCT FROM c.org_id AND g.segment IS NOT DISTINCT FROM c.segment""", nums="total_revenue expected_impact total_arr")
def _(t):
    frames = {"tickets": t.tickets, "transactions": t.transactions, "recommendations": t.recommendations, "customer_360": c360(t),
              "customer_health": seg_health(t)}
    return me.drill_across(frames, ["tickets.ticket_count", "transactions.total_revenue", "recommendations.expected_impact",
                                    "customer_360.total_customers", "customer_360.total_arr"], ["org_id", "segment"])


def _star_sql(fact, key, dim, on, column, measures):
    return f"SELECT f.org_id, d.{column} AS dim_{column}, {measures} FROM {fact} f LEFT JOIN {dim} d ON f.{key} = d.{on} AND f.org_id = d.org_id GROUP BY 1, 2"


@query("d14_star_recommendations", _star_sql("b_recommendations", "entity_id", "m_c360", "customer_id", "segment", "sum(expected_impact_usd) AS expected_impact"), nums="expected_impact")
def _(t):
    fact = me.star("recommendations", t.recommendations, "customer_360", c360(t), ["segment"])
    return me.metric(fact, {"expected_impact": me.MODELS["recommendations"][1]["expected_impact"]}, ["org_id", "dim_segment"])


@query("d14_star_transactions", _star_sql("b_transactions", "customer_id", "m_c360", "customer_id", "region", "sum(amount) AS total_revenue, count(*) AS transaction_count"), nums="total_revenue")
def _(t):
    fact = me.star("transactions", t.transactions, "customer_360", c360(t), ["region"])
    return me.metric(fact, me.MODELS["transactions"][1], ["org_id", "dim_region"])


@query("d14_star_tickets", _star_sql("b_tickets", "customer_id", "m_seg_health", "customer_id", "segment", "count(*) AS ticket_count"))
def _(t):
    fact = me.star("tickets", t.tickets, "customer_health", seg_health(t), ["segment"])
    return me.metric(fact, {"ticket_count": me.MODELS["tickets"][1]["ticket_count"]}, ["org_id", "dim_segment"])


@query("q27_ops_tickets_by_status", "SELECT status, count(*) AS ticket_count FROM b_tickets GROUP BY 1")
def _(t):
    return r.tickets_by(t.tickets, "status")


@query("q27_ops_channels", "SELECT channel, count(*) AS interaction_count FROM b_interactions GROUP BY 1")
def _(t):
    return me.model_metric("interactions", t.interactions, ["interaction_count"], ["channel"])


@query("q27_ops_daily_interactions", "SELECT CAST(occurred_at AS DATE) AS day, count(*) AS n FROM b_interactions GROUP BY 1", dates="day")
def _(t):
    return t.interactions.groupBy(F.to_date("occurred_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("q28_risk_digest", """
WITH x AS (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY arr DESC, customer_id) AS rank FROM m_c360_inverse WHERE churn_risk_level = 'HIGH' AND health_score < 40)
SELECT org_id, count(*) AS high_risk_customers, count(*) || ' high-risk customers detected' AS title, 'Top at-risk accounts:' || chr(10) ||
  string_agg('- ' || customer_name || ' (Health: ' || CAST(health_score AS DECIMAL(5,1)) || ' | ARR: $' || CAST(round(arr, 0) AS BIGINT) || ')', chr(10) ORDER BY rank) FILTER (rank <= 5) AS message
FROM x GROUP BY org_id""")
def _(t):
    from tenantlens.registry.profile import c360_inverse
    return r.risk_digest(c360_inverse(t))


@query("q29_sla_digest", f"""
SELECT org_id, breaches, critical, breaches || ' open SLA breaches (' || critical || ' critical) in the last 720h.' AS message, CASE WHEN critical > 0 THEN 'CRITICAL' ELSE 'WARNING' END AS severity
FROM (SELECT org_id, count(*) AS breaches, count(*) FILTER (priority = 'urgent') AS critical FROM b_tickets WHERE sla_breach AND status <> 'resolved'
  AND created_at >= {T0} - INTERVAL 30 DAYS GROUP BY 1)""")
def _(t):
    return r.sla_digest(t.tickets, hours=720)


# -- pivots --------------------------------------------------------------------------
_TYPES = ["new_contract", "upsell", "renewal", "downgrade", "churn", "refund"]
_CHANNELS = ["email", "call", "chat", "meeting", "sms"]


def _pivot_sql(col, values, measure):
    return ", ".join(f"coalesce(sum(CASE WHEN {col} = '{x}' THEN {measure} END), 0)::DOUBLE AS {x}" for x in values)


@query("e60_revenue_pivot", f"SELECT org_id, month, {_pivot_sql('transaction_type', _TYPES, 'total_amount')} FROM m_monthly GROUP BY 1, 2", dates="month")
def _(t):
    return rv.pivot_sum(rv.revenue_by_month(t.transactions), ["org_id", "month"], "transaction_type", _TYPES, "total_amount")


@query("e61_channel_pivot", f"SELECT org_id, CAST(occurred_at AS DATE) AS day, {_pivot_sql('channel', _CHANNELS, '1')} FROM b_interactions GROUP BY 1, 2", dates="day")
def _(t):
    rows = t.interactions.withColumn("one", F.lit(1.0))
    return rv.pivot_sum(rows, ["org_id", F.to_date("occurred_at").alias("day")], "channel", _CHANNELS, "one")


@query("e62_pipeline_pivot", f"SELECT org_id, {_pivot_sql('opportunity_type', ['upsell', 'expansion', 'renewal', 'retention'], 'estimated_revenue_usd')} FROM m_opportunity GROUP BY 1")
def _(t):
    return rv.pivot_sum(opportunities(t), ["org_id"], "opportunity_type", ["upsell", "expansion", "renewal", "retention"], "estimated_revenue_usd")


@query("e62_priority_pivot", f"SELECT org_id, {_pivot_sql('priority', ['urgent', 'high', 'medium', 'low'], '1')} FROM b_tickets GROUP BY 1")
def _(t):
    return rv.pivot_sum(t.tickets.withColumn("one", F.lit(1.0)), ["org_id"], "priority", ["urgent", "high", "medium", "low"], "one")


# -- context -------------------------------------------------------------------------
def _pct(c, s=1):
    return f"CAST(round({c} * 100, {s}) AS DECIMAL(20,{s})) || '%'"


def _fx(c, s):
    return f"CAST(round({c}, {s}) AS DECIMAL(20,{s}))"


def _ctx(keys, table, parts):
    lines = " || chr(10) || ".join(f"'{label}: ' || coalesce(CAST({e} AS VARCHAR), 'N/A')" for label, e in parts)
    return f"SELECT {keys}, {lines} AS context FROM {table}"


@query("m17_patient_context", _ctx("patient_id, org_id", "m_patients", [("Segment", "population_segment"), ("Engagement", _fx("engagement_score", 1)),
       ("Adherence", _fx("appointment_adherence", 1)), ("Care gaps", "care_gap_count"), ("Readmission risk", _pct("readmission_risk"))]))
def _(t):
    return cx.patient_context(v.patient_engagement(c360(t), t.tickets))


@query("m17_guest_context", _ctx("guest_id, org_id", "m_guests", [("Tier", "loyalty_tier"), ("Lifetime value", _fx("lifetime_value_usd", 0)), ("Stays", "stays_count"),
       ("Daily rate", "avg_daily_rate_usd"), ("NPS", "nps_score"), ("Churn risk", "churn_risk"), ("Upsell", _pct("upsell_propensity", 0))]))
def _(t):
    return cx.guest_context(v.guest_profile(c360(t)))


@query("m17_network_context", _ctx("customer_id, org_id", "m_telecom", [("Customer", "customer_name"), ("ARPU", _fx("arpu_usd", 2)), ("QoS", _fx("qos_score", 2)),
       ("Latency ms", _fx("avg_latency_ms", 2)), ("Packet loss", _fx("avg_packet_loss_pct", 2)), ("Downtime h", _fx("avg_downtime_hours", 2)),
       ("Complaints", "complaints_30d"), ("Churn risk", _pct("churn_probability"))]))
def _(t):
    return cx.network_context(v.telecom_quality(c360(t), t.network_events))


@query("m17_equipment_context", _ctx("equipment_id, org_id", "m_oee", [("Plant", "plant_id"), ("OEE", _fx("oee_score", 2)), ("Availability", _fx("availability_pct", 2)),
       ("Performance", _fx("performance_pct", 2)), ("Quality", _fx("quality_pct", 2)), ("MTBF", "mtbf_hours"), ("MTTR", "mttr_hours"),
       ("Failure risk", _pct("failure_risk_score")), ("Maintenance due", "strftime(maintenance_due, '%Y-%m-%d')")]))
def _(t):
    return cx.equipment_context(v.oee(t.equipment))


define("m_promo", """
SELECT promotion_id, name, start_date, end_date, discount_pct, coalesce(sum(revenue_usd), 0) AS revenue_usd, coalesce(sum(qty_sold), 0) AS units_sold, cost_usd
FROM b_promotions LEFT JOIN b_sales_history ON sku_id = promotion_id GROUP BY ALL""")


@query("m17_promotion_context", _ctx("promotion_id", "m_promo", [("Promotion", "name"), ("From", "strftime(start_date, '%Y-%m-%d')"), ("To", "strftime(end_date, '%Y-%m-%d')"),
       ("Discount", "discount_pct"), ("Revenue", _fx("revenue_usd", 2)), ("Units", _fx("units_sold", 0)), ("Cost", _fx("cost_usd", 2))]))
def _(t):
    return cx.promotion_context(v.promotion_performance(t.promotions, t.sales_history.withColumn("promotion_id", F.col("sku_id"))))


@query("m17_recommendation_context", _ctx("customer_id, org_id", "m_c360", [("Customer", "customer_name"), ("Segment", "segment"), ("ARR", _fx("arr", 0)), ("Risk", "churn_risk_level"),
       ("Probability", _pct("churn_probability", 0)), ("Health", _fx("health_score", 1)), ("NPS", "nps_score"), ("Renewal", "strftime(nearest_renewal_date, '%Y-%m-%d')")]))
def _(t):
    return cx.recommendation_context(c360(t))


@query("m17_kpi_context", _ctx("org_id", "m_kpis", [("ARR", _fx("total_arr", 0)), ("Active customers", "active_customers"), ("At-risk customers", "at_risk_customers"),
       ("ARR at risk", _fx("arr_at_risk", 0)), ("Average health", _fx("avg_health_score", 1)), ("Average NPS", _fx("avg_nps", 1)), ("Open tickets", "open_tickets"),
       ("Pending recommendations", "pending_recommendations")]))
def _(t):
    return cx.kpi_context(kpis(t))


# -- model and rules -------------------------------------------------------------------
@query("m1_churn_model")
def _(t):
    features = materialize(p.churn_features(c360(t)))
    return ch.score_churn(ch.fit_churn(features), features)


# Written out, so that a wrong constant in the rules shows.
_RULES = """concat_ws('|', CASE WHEN health_score < 40 THEN 'critical_health_score' END, CASE WHEN nps_score < -20 THEN 'very_low_nps' END,
  CASE WHEN active_days_30d < 5 THEN 'low_engagement' END, CASE WHEN days_since_last_activity > 14 THEN 'long_inactivity' END,
  CASE WHEN sla_breaches > 2 THEN 'repeated_sla_breaches' END, CASE WHEN open_tickets > 3 THEN 'ticket_backlog' END, CASE WHEN mrr < 100 THEN 'low_mrr' END)"""


@query("m2_risk_rules", f"""
SELECT customer_id, org_id, churn_probability, risk_level, top_drivers,
  CASE risk_level
    WHEN 'HIGH' THEN CASE coalesce(nullif(list_filter(string_split(top_drivers, '|'), lambda d: d IN ('low_engagement', 'long_inactivity', 'repeated_sla_breaches'))[1], ''), '-')
      WHEN 'repeated_sla_breaches' THEN 'Open a service recovery case with the support lead'
      WHEN '-' THEN 'Offer a renewal conversation before the end of the month' ELSE 'Call the sponsor this week and agree on a usage plan' END
    WHEN 'MEDIUM' THEN CASE WHEN list_contains(string_split(top_drivers, '|'), 'very_low_nps') THEN 'Ask for the reasons behind the survey score'
      ELSE 'Check in every two weeks until the score recovers' END
    ELSE 'No action, look again at the next renewal' END AS recommended_action,
  CAST(mrr * 12 * churn_probability AS DECIMAL(18,2)) AS expected_revenue_at_risk, '1.0.0-lr' AS model_version, {T0} AS scored_at
FROM (SELECT customer_id, org_id, CAST(churn_probability AS DECIMAL(5,4)) AS churn_probability, CAST(mrr AS DECIMAL(18,2)) AS mrr,
    CASE WHEN churn_probability >= 0.65 THEN 'HIGH' WHEN churn_probability >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
    CASE WHEN rules = '' THEN 'moderate_risk_profile' ELSE array_to_string(list_slice(string_split(rules, '|'), 1, 3), '|') END AS top_drivers
  FROM (SELECT *, {_RULES} AS rules FROM m_features))""", times="scored_at", nums="churn_probability expected_revenue_at_risk")
def _(t):
    return ch.score_rows(p.churn_features(c360(t)), F.col("churn_probability"))


@query("m3_macros", """
SELECT customer_id, org_id, CASE WHEN churn_probability >= 0.7 THEN 'HIGH' WHEN churn_probability >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  CASE WHEN events_7d > events_30d / 4 * 1.2 THEN 'up' WHEN events_7d < events_30d / 4 * 0.8 THEN 'down' WHEN events_30d = 0 THEN 'no_data' ELSE 'stable' END AS usage_trend,
  health_score FROM m_c360""", nums="health_score")
def _(t):
    score = cb.health_score(F.col("churn_probability"), F.col("nps_normalized"), F.col("usage_points"), F.col("sla_points"))
    return c360(t).select("customer_id", "org_id", cb.risk_level(F.col("churn_probability"), 0.70, 0.40).alias("risk_level"),
                          cb.usage_trend(F.col("events_7d"), F.col("events_30d")).alias("usage_trend"), score.alias("health_score"))


# -- series ------------------------------------------------------------------------------
def _forecast_sql(key):
    return f"""WITH pts AS (SELECT {key}, transaction_date AS d, sum(amount) AS y, sum(amount)::DOUBLE AS yd, date_diff('day', {D0}, transaction_date)::DOUBLE AS x,
    dayofweek(transaction_date) AS dow FROM b_transactions WHERE status = 'completed' AND transaction_date <= {D0} GROUP BY 1, 2),
fit AS (SELECT {key}, count(*) AS n, regr_slope(yd, x) AS slope, regr_intercept(yd, x) AS base,
    CAST(sum(y) FILTER (d >= {D0} - 7) / count(*) FILTER (d >= {D0} - 7) AS DECIMAL(24,6)) AS recent FROM pts GROUP BY 1),
res AS (SELECT pts.{key}, dow, yd - (base + slope * x) AS r FROM pts JOIN fit USING ({key})),
wk AS (SELECT {key}, dow, avg(r) AS effect FROM res GROUP BY 1, 2),
sp AS (SELECT res.{key}, stddev_samp(r - effect) AS sigma FROM res JOIN wk ON res.{key} = wk.{key} AND res.dow = wk.dow GROUP BY 1),
fut AS (SELECT fit.*, sigma, i::DOUBLE AS x, {D0} + CAST(i AS INT) AS forecast_date FROM fit LEFT JOIN sp USING ({key}), generate_series(1, 30) AS g(i)),
o AS (SELECT fut.*, base + slope * x + coalesce(effect, 0) AS m, coalesce(sigma, 0) * 1.645 AS band FROM fut LEFT JOIN wk ON fut.{key} = wk.{key} AND wk.dow = dayofweek(forecast_date))
SELECT {key}, forecast_date, CASE WHEN n < 14 THEN round(coalesce(recent, 0), 2)::DOUBLE ELSE round(m, 2) END AS forecast_value,
  CASE WHEN n < 14 THEN round(coalesce(recent, 0) * 0.8, 2)::DOUBLE ELSE round(m - band, 2) END AS lower_bound,
  CASE WHEN n < 14 THEN round(coalesce(recent, 0) * 1.2, 2)::DOUBLE ELSE round(m + band, 2) END AS upper_bound,
  CASE WHEN n < 14 THEN 'mean7' ELSE 'trend_weekday' END AS method FROM o"""


@query("m4_forecast_tenant", _forecast_sql("org_id"), dates="forecast_date")
def _(t):
    return se.forecast(rv.revenue_daily(st.stg_transactions(t.transactions)), ["org_id"])


@query("m4_forecast_customer", _forecast_sql("customer_id"), dates="forecast_date")
def _(t):
    daily = st.stg_transactions(t.transactions).groupBy("customer_id", F.col("transaction_date").alias("revenue_date")).agg(F.sum("amount_usd").alias("total_revenue_booked"))
    return se.forecast(daily, ["customer_id"])


@query("m5_anomalies", f"""
WITH d AS (SELECT org_id, transaction_date AS metric_date, sum(amount)::DOUBLE AS daily_revenue,
    round(sum(CASE transaction_type WHEN 'new_contract' THEN amount WHEN 'upsell' THEN amount WHEN 'downgrade' THEN -amount WHEN 'churn' THEN -amount ELSE 0 END)::DOUBLE / 12, 4) AS daily_new_mrr
  FROM b_transactions WHERE status = 'completed' GROUP BY 1, 2),
s AS (SELECT * FROM d UNPIVOT (v FOR metric_name IN (daily_revenue, daily_new_mrr))
  UNION ALL SELECT org_id, snapshot_date, unnest(['avg_health_score', 'arr_at_risk']), unnest([avg_health_score::DOUBLE, arr_at_risk::DOUBLE]) FROM m_kpis),
w AS (SELECT *, count(*) OVER x AS n, avg(v) OVER x AS e, stddev_samp(v) OVER x AS sd FROM s WINDOW x AS (PARTITION BY org_id, metric_name ORDER BY metric_date
  RANGE BETWEEN INTERVAL 28 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT org_id, metric_name, metric_date, round(v, 4) AS metric_value, round(e, 4) AS expected_value, round(dev, 4) AS deviation_pct,
  CASE WHEN abs(dev) >= 50 THEN 'HIGH' WHEN abs(dev) >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM (SELECT *, CASE WHEN e <> 0 THEN (v - e) / e * 100 ELSE 0 END AS dev FROM w WHERE n >= 7 AND abs(v - e) > 3 * sd)""", dates="metric_date")
def _(t):
    daily = rv.revenue_daily(st.stg_transactions(t.transactions)).select(
        "org_id", F.col("revenue_date").alias("metric_date"), F.col("total_revenue_booked").cast("double").alias("a"), F.col("net_new_mrr").alias("b"))
    k = kpis(t).select("org_id", F.col("snapshot_date").alias("metric_date"), F.col("avg_health_score").cast("double").alias("a"), F.col("arr_at_risk").cast("double").alias("b"))
    rows = daily.select("org_id", "metric_date", F.expr("stack(2, 'daily_revenue', a, 'daily_new_mrr', b) as (metric_name, metric_value)")).unionByName(
        k.select("org_id", "metric_date", F.expr("stack(2, 'avg_health_score', a, 'arr_at_risk', b) as (metric_name, metric_value)")))
    return se.anomalies(rows, ["org_id", "metric_name"])

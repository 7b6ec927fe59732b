"""KPI, revenue, support, opportunity, usage and model-log queries."""

import datetime as dt

from pyspark.sql import functions as F

from tenantlens.operators import staging as st
from tenantlens.plans import actions as ac, kpis as k, reads as rd, revenue as rv, usage as us
from tenantlens.registry.core import define, exact_avg, query
from tenantlens.registry.oracle_tables import D0, T0
from tenantlens.registry.profile import c360, c360_inverse, health
from tenantlens.settings import AS_OF

define("m_kpis", f"""
WITH base AS (SELECT c.org_id, sum(CASE WHEN lifecycle_stage <> 'churned' THEN c.arr ELSE 0 END) AS total_arr,
    sum(CASE WHEN lifecycle_stage <> 'churned' THEN c.mrr ELSE 0 END) AS total_mrr,
    count(*) FILTER (lifecycle_stage = 'active') AS active_customers, count(*) FILTER (lifecycle_stage = 'at_risk') AS at_risk_customers,
    count(*) FILTER (lifecycle_stage = 'churned') AS churned_customers, count(*) AS total_customers,
    round(avg(health_score) FILTER (lifecycle_stage <> 'churned'), 1) AS avg_health_score,
    round(avg(nps_score) FILTER (lifecycle_stage <> 'churned'), 1) AS avg_nps,
    sum(CASE WHEN h.risk_level IN ('HIGH', 'MEDIUM') THEN h.expected_revenue_at_risk ELSE 0 END) AS arr_at_risk,
    sum(CASE WHEN lifecycle_stage IN ('active', 'at_risk') AND nearest_renewal_date <= {D0} + 90 THEN c.arr ELSE 0 END) AS renewals_90d_arr
  FROM m_c360 c LEFT JOIN m_latest_churn h ON c.customer_id = h.customer_id AND c.org_id = h.org_id GROUP BY 1),
t AS (SELECT org_id, count(*) FILTER (status = 'open') AS open_tickets, count(*) FILTER (status = 'open' AND priority = 'urgent') AS urgent_tickets
  FROM b_tickets GROUP BY 1),
r AS (SELECT org_id, count(*) AS pending_recommendations, sum(expected_impact_usd) AS total_expected_impact
  FROM b_recommendations WHERE status = 'pending' AND is_active GROUP BY 1)
SELECT base.*, coalesce(open_tickets, 0) AS open_tickets, coalesce(urgent_tickets, 0) AS urgent_tickets,
  coalesce(pending_recommendations, 0) AS pending_recommendations, coalesce(total_expected_impact, 0) AS total_expected_impact,
  {D0} AS snapshot_date
FROM base LEFT JOIN t USING (org_id) LEFT JOIN r USING (org_id)""")


def kpis(t):
    return k.executive_kpis(c360(t), t.tickets, t.recommendations)


@query("e9_executive_kpis", "SELECT * FROM m_kpis", dates="snapshot_date",
       nums="total_arr total_mrr arr_at_risk renewals_90d_arr total_expected_impact")
def _(t):
    return kpis(t)


define("m_kpis_health", """
SELECT h.org_id, count(*) AS customer_count, count(*) FILTER (lifecycle_stage <> 'churned') AS active_count,
  count(*) FILTER (churn_risk_level = 'HIGH') AS at_risk_count, count(*) FILTER (lifecycle_stage = 'churned') AS churned_count,
  sum(CASE WHEN lifecycle_stage <> 'churned' THEN arr ELSE 0 END) AS total_arr,
  sum(CASE WHEN lifecycle_stage <> 'churned' THEN mrr ELSE 0 END) AS total_mrr,
  round(avg(nps_score) FILTER (lifecycle_stage <> 'churned'), 1) AS avg_nps,
  sum(CASE WHEN churn_risk_level IN ('HIGH', 'MEDIUM') THEN expected_revenue_at_risk ELSE 0 END) AS arr_at_risk,
  sum(CASE WHEN lifecycle_stage <> 'churned' AND days_to_renewal BETWEEN 0 AND 90 THEN arr ELSE 0 END) AS renewal_90d_arr,
  round(avg(health_score) FILTER (lifecycle_stage <> 'churned'), 1) AS avg_health_score,
  any_value(coalesce(n, 0)) AS open_recommendations, any_value(coalesce(impact, 0)) AS total_expected_impact_usd
FROM m_health h LEFT JOIN (SELECT org_id, count(*) AS n, sum(expected_impact_usd) AS impact FROM b_recommendations
  WHERE status = 'pending' AND is_active GROUP BY 1) r ON h.org_id = r.org_id GROUP BY h.org_id""")


@query("e10_executive_kpis_health", "SELECT * FROM m_kpis_health",
       nums="total_arr total_mrr arr_at_risk renewal_90d_arr total_expected_impact_usd")
def _(t):
    return k.executive_kpis_from_health(health(t), t.recommendations)


@query("e11_executive_kpis_risk", """
SELECT c.org_id, count(*) AS total_customers, round(avg(coalesce(churn_probability, 0.5)) * 100, 1) AS avg_churn_risk_pct,
  count(*) FILTER (coalesce(churn_probability, 0.5) > 0.7) AS critical_risk_count,
  count(*) FILTER (lifecycle_stage = 'active') AS active_customers, sum(arr) AS total_arr, sum(mrr) AS total_mrr,
  round(avg(nps_score), 1) AS avg_nps, any_value(t.n) AS open_tickets
FROM b_customers c LEFT JOIN m_latest_churn h ON c.customer_id = h.customer_id
LEFT JOIN (SELECT org_id, count(*) FILTER (status = 'open') AS n FROM b_tickets GROUP BY 1) t ON c.org_id = t.org_id
GROUP BY c.org_id""", nums="total_arr total_mrr")
def _(t):
    return k.executive_kpis_risk(t.customers, t.churn_scores, t.tickets)


@query("e12_revenue_daily", """
WITH d AS (SELECT org_id, transaction_date AS revenue_date,
    sum(CASE WHEN transaction_type = 'new_contract' THEN amount_usd ELSE 0 END)::DOUBLE AS n,
    sum(CASE WHEN transaction_type = 'upsell' THEN amount_usd ELSE 0 END)::DOUBLE AS e,
    sum(CASE WHEN transaction_type = 'downgrade' THEN amount_usd ELSE 0 END)::DOUBLE AS x,
    sum(CASE WHEN transaction_type = 'churn' THEN amount_usd ELSE 0 END)::DOUBLE AS c,
    sum(CASE WHEN transaction_type = 'renewal' THEN amount_usd ELSE 0 END)::DOUBLE AS r,
    sum(CASE transaction_type WHEN 'new_contract' THEN amount_usd WHEN 'upsell' THEN amount_usd WHEN 'downgrade' THEN -amount_usd
      WHEN 'churn' THEN -amount_usd ELSE 0 END)::DOUBLE AS net,
    sum(amount_usd) AS total_revenue_booked, count(DISTINCT transaction_id) AS transaction_count, count(DISTINCT customer_id) AS customers_transacted
  FROM m_stg_transactions GROUP BY 1, 2)
SELECT org_id, revenue_date, round(n / 12, 4) AS new_mrr, round(e / 12, 4) AS expansion_mrr, round(x / 12, 4) AS contraction_mrr,
  round(c / 12, 4) AS churn_mrr, round(r / 12, 4) AS renewal_mrr, total_revenue_booked, transaction_count, customers_transacted,
  round(net / 12, 4) AS net_new_mrr, net AS net_new_arr FROM d""", dates="revenue_date", nums="total_revenue_booked")
def _(t):
    return rv.revenue_daily(st.stg_transactions(t.transactions))


@query("e13_revenue_movement", """
WITH d AS (SELECT org_id, transaction_date AS revenue_date,
    sum(CASE WHEN transaction_type = 'new_contract' THEN amount ELSE 0 END) AS new_arr,
    sum(CASE WHEN transaction_type = 'upsell' THEN amount ELSE 0 END) AS expansion_arr,
    sum(CASE WHEN transaction_type = 'downgrade' THEN amount ELSE 0 END) AS contraction_arr,
    sum(CASE WHEN transaction_type = 'churn' THEN amount ELSE 0 END) AS churn_arr,
    sum(CASE WHEN transaction_type = 'renewal' THEN amount ELSE 0 END) AS renewal_arr,
    count(DISTINCT transaction_id) AS transaction_count, count(DISTINCT customer_id) AS customers_transacted, sum(amount) AS total_revenue_booked
  FROM b_transactions WHERE status = 'completed' GROUP BY 1, 2)
SELECT *, new_arr + expansion_arr - contraction_arr - churn_arr AS net_arr,
  round((new_arr + expansion_arr - contraction_arr - churn_arr)::DOUBLE / 12, 4) AS net_mrr, round(new_arr::DOUBLE / 12, 4) AS new_mrr,
  round(expansion_arr::DOUBLE / 12, 4) AS expansion_mrr, round(contraction_arr::DOUBLE / 12, 4) AS contraction_mrr,
  round(churn_arr::DOUBLE / 12, 4) AS churn_mrr, round(renewal_arr::DOUBLE / 12, 4) AS renewal_mrr FROM d""",
       dates="revenue_date", nums="new_arr expansion_arr contraction_arr churn_arr renewal_arr net_arr total_revenue_booked")
def _(t):
    return rv.revenue_movement(t.transactions)


define("m_monthly", f"""
SELECT org_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month, transaction_type, count(*) AS transaction_count,
  sum(amount) AS total_amount,
  {exact_avg('amount', 2)} AS avg_amount, min(amount) AS min_amount, max(amount) AS max_amount
FROM b_transactions GROUP BY 1, 2, 3""")


@query("e14_revenue_by_month", "SELECT * FROM m_monthly", dates="month", nums="total_amount min_amount max_amount")
def _(t):
    return rv.revenue_by_month(t.transactions)


@query("e15_support_intelligence", f"""
SELECT org_id, count(*) AS total_tickets, count(*) FILTER (status = 'open') AS open_tickets,
  count(*) FILTER (status = 'resolved') AS resolved_tickets,
  count(*) FILTER (status = 'open' AND priority IN ('urgent', 'high')) AS critical_tickets,
  count(*) FILTER (sla_breach) AS sla_breached_count, round(count(*) FILTER (sla_breach) * 100 / count(*), 2) AS sla_breach_rate_pct,
  round(avg(date_diff('minute', created_at, resolved_at) / 60), 2) AS avg_resolution_hours,
  round(min(date_diff('minute', created_at, resolved_at) / 60), 2) AS min_resolution_hours,
  round(max(date_diff('minute', created_at, resolved_at) / 60), 2) AS max_resolution_hours,
  round(avg(sentiment_score) FILTER (status = 'open'), 3) AS avg_open_sentiment, round(avg(sentiment_score), 3) AS avg_sentiment,
  count(*) FILTER (sentiment_label = 'positive') AS positive_tickets, count(*) FILTER (sentiment_label = 'neutral') AS neutral_tickets,
  count(*) FILTER (sentiment_label = 'negative') AS negative_tickets,
  count(*) FILTER (created_at >= {T0} - INTERVAL 7 DAYS) AS tickets_trend_7d,
  count(*) FILTER (status = 'open' AND date_diff('hour', created_at, {T0}) > 48) AS stale_open_tickets,
  min(created_at) FILTER (status = 'open') AS oldest_open_ticket_at
FROM b_tickets GROUP BY org_id""", times="oldest_open_ticket_at")
def _(t):
    return rv.support_intelligence(t.tickets)


define("m_action_center", """
SELECT r.recommendation_id, r.entity_id AS customer_id, r.org_id, c.customer_name, c.segment, r.recommendation_type, r.priority,
  r.recommendation_text, r.expected_impact_usd, r.confidence_score, r.owner_role, r.status, r.created_at, r.expires_at,
  c.health_score, c.churn_risk_level, c.churn_probability, c.arr, c.nearest_renewal_date, c.nps_score, c.open_tickets,
  CASE r.priority WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END * (1 + coalesce(r.expected_impact_usd, 0) * 0.00001) AS priority_score
FROM b_recommendations r LEFT JOIN m_c360 c ON r.entity_id = c.customer_id AND r.org_id = c.org_id
WHERE r.is_active AND r.status NOT IN ('completed', 'dismissed')""")
_AC_NUMS = "priority_score expected_impact_usd confidence_score health_score churn_probability arr"


@query("e17_action_center", "SELECT * FROM m_action_center", dates="nearest_renewal_date", times="created_at expires_at", nums=_AC_NUMS)
def _(t):
    return ac.action_center(t.recommendations, c360(t))


@query("e18_action_center_inner", """
SELECT r.recommendation_id, r.entity_id AS customer_id, r.org_id, c.name AS customer_name, c.segment, r.recommendation_type, r.priority,
  r.recommendation_text, r.expected_impact_usd, r.confidence_score, r.owner_role, r.status, r.created_at, r.expires_at,
  h.health_score, h.churn_risk_level, h.churn_probability, h.arr, h.nearest_renewal_date, h.nps_score, h.open_tickets,
  CASE r.priority WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END * (1 + coalesce(r.expected_impact_usd, 0) * 0.00001) AS priority_score
FROM b_recommendations r JOIN b_customers c ON r.entity_id = c.customer_id AND r.org_id = c.org_id
LEFT JOIN m_c360_inverse h ON r.entity_id = h.customer_id
WHERE r.is_active AND r.status NOT IN ('completed', 'dismissed')""", dates="nearest_renewal_date", times="created_at expires_at", nums=_AC_NUMS)
def _(t):
    return ac.action_center(t.recommendations, c360_inverse(t), customers=t.customers)


# Scores that already exist: every second recommendation subject, half of them stale.
define("m_existing_scores", f"""
SELECT DISTINCT entity_id AS customer_id, org_id, {T0} - to_hours(CASE WHEN priority = 'HIGH' THEN 2 ELSE 12 END) AS scored_at
FROM b_recommendations WHERE priority <> 'LOW'""")


def existing_scores(t):
    from tenantlens.functions.columns import ago
    recent = F.when(F.col("priority") == "HIGH", ago(AS_OF, hours=2)).otherwise(ago(AS_OF, hours=12))
    return t.recommendations.filter(F.col("priority") != "LOW").select(F.col("entity_id").alias("customer_id"), "org_id", recent.alias("scored_at"))


@query("e19_opportunity_score", f"""
SELECT c.customer_id, c.org_id,
  CASE WHEN p < 0.2 AND arr > 50000 THEN 0.9 WHEN p < 0.2 AND arr > 20000 THEN 0.75 WHEN p < 0.3 AND arr > 10000 THEN 0.65
    WHEN p < 0.5 THEN 0.5 WHEN p < 0.7 THEN 0.3 ELSE 0.1 END AS opportunity_score,
  CASE WHEN p < 0.3 AND arr > 30000 THEN 'upsell' WHEN p < 0.3 THEN 'expansion' WHEN p < 0.5 THEN 'cross_sell'
    WHEN contract_end_date <= {D0} + 90 THEN 'renewal' ELSE 'retention' END AS opportunity_type,
  CAST(arr * CASE WHEN p < 0.2 THEN 0.25 WHEN p < 0.4 THEN 0.12 WHEN p < 0.6 THEN 0.05 ELSE 0.02 END AS DECIMAL(18,2)) AS estimated_revenue_usd,
  CASE WHEN p IS NOT NULL THEN greatest(0.1, 1 - p) END AS confidence,
  'Score from churn_probability=' || p || ' ARR=' || arr || ' lifecycle=' || lifecycle_stage AS reasoning
FROM b_customers c LEFT JOIN (SELECT customer_id, churn_probability AS p FROM m_latest_churn) h ON c.customer_id = h.customer_id
WHERE lifecycle_stage <> 'churned' AND NOT EXISTS (SELECT 1 FROM m_existing_scores r WHERE r.customer_id = c.customer_id AND r.org_id = c.org_id AND r.scored_at >= {T0} - INTERVAL 6 HOURS)""",
       nums="opportunity_score estimated_revenue_usd confidence")
def _(t):
    return ac.opportunity_score(t.customers, t.churn_scores, existing=existing_scores(t))


define("m_opportunity", f"""
SELECT c.customer_id, c.org_id, c.name AS customer_name, arr, segment, coalesce(p, 0.5) AS churn_risk,
  CASE WHEN coalesce(p, 0.5) < 0.3 AND arr > 30000 THEN 0.9 WHEN coalesce(p, 0.5) < 0.3 THEN 0.7 WHEN coalesce(p, 0.5) < 0.5 THEN 0.5 ELSE 0.2 END AS opportunity_score,
  CASE WHEN coalesce(p, 0.5) < 0.3 AND arr > 30000 THEN 'upsell' WHEN coalesce(p, 0.5) < 0.3 THEN 'expansion'
    WHEN contract_end_date <= {D0} + 90 THEN 'renewal' ELSE 'retention' END AS opportunity_type,
  CAST(arr * CASE WHEN coalesce(p, 0.5) < 0.3 THEN 0.25 WHEN coalesce(p, 0.5) < 0.5 THEN 0.1 ELSE 0.03 END AS DECIMAL(18,2)) AS estimated_revenue_usd,
  contract_end_date
FROM b_customers c LEFT JOIN (SELECT customer_id, churn_probability AS p FROM m_latest_churn) h ON c.customer_id = h.customer_id
WHERE lifecycle_stage <> 'churned'""")


def opportunities(t):
    return ac.opportunity_score_live(t.customers, t.churn_scores)


@query("e20_opportunity_score_live", "SELECT * FROM m_opportunity", dates="contract_end_date",
       nums="arr churn_risk opportunity_score estimated_revenue_usd")
def _(t):
    return opportunities(t)


@query("e21_opportunity_score_refresh", f"""
SELECT c.customer_id, c.org_id, c.name AS customer_name,
  CASE WHEN p < 0.3 AND arr > 50000 THEN 0.85 WHEN p < 0.3 AND arr > 20000 THEN 0.7 WHEN p < 0.5 THEN 0.55 ELSE 0.2 END AS opportunity_score,
  CASE WHEN p < 0.3 THEN 'upsell' WHEN p < 0.5 THEN 'expansion' ELSE 'retention' END AS opportunity_type,
  CAST(arr * CASE WHEN p < 0.3 THEN 0.25 WHEN p < 0.5 THEN 0.1 ELSE 0.05 END AS DECIMAL(18,2)) AS estimated_revenue_usd,
  1 - p AS confidence, p AS churn_risk, contract_end_date, arr
FROM (SELECT b.*, coalesce(h.churn_probability, 0.5) AS p FROM b_customers b LEFT JOIN m_latest_churn h ON b.customer_id = h.customer_id) c
WHERE NOT EXISTS (SELECT 1 FROM m_existing_scores r WHERE r.customer_id = c.customer_id AND r.org_id = c.org_id AND r.scored_at > {T0} - INTERVAL 6 HOURS)""",
       dates="contract_end_date", nums="opportunity_score estimated_revenue_usd confidence churn_risk arr")
def _(t):
    return ac.opportunity_score_refresh(t.customers, t.churn_scores, existing=existing_scores(t))


@query("e25_feature_usage", f"""
SELECT org_id, customer_id, date_trunc('hour', occurred_at) AS event_hour, event_type, count(*) AS event_count,
  count(DISTINCT user_id) AS unique_users, count(DISTINCT session_id) AS unique_sessions, max(occurred_at) AS last_seen
FROM b_product_events WHERE occurred_at >= {T0} - INTERVAL 90 DAYS GROUP BY 1, 2, 3, 4""", times="event_hour last_seen")
def _(t):
    return us.feature_usage(t.raw_product_events)


define("m_api_cost", f"""
SELECT org_id, CAST(request_ts AS DATE) AS usage_date, model_name, count(*) AS api_calls, CAST(sum(tokens_used) AS BIGINT) AS total_tokens,
  count(*) FILTER (status_code >= 400) AS error_count, round(avg(latency_ms), 0) AS avg_latency_ms,
  round(sum(tokens_used) * 0.000003::DOUBLE, 4) AS estimated_cost_usd
FROM b_api_usage_events WHERE request_ts >= {T0} - INTERVAL 90 DAYS GROUP BY 1, 2, 3""")


@query("e26_api_cost", "SELECT * FROM m_api_cost", dates="usage_date")
def _(t):
    return us.api_cost(t.api_usage_events)


define("m_snapshots", """
WITH l AS (SELECT org_id, CAST(created_at AS DATE) AS snapshot_date, count(*) FILTER (resource_type = 'APP_SESSION') AS app_sessions,
    count(DISTINCT user_name) AS dau, count(*) FILTER (resource_type = 'MODEL_CALL') AS model_calls,
    count(*) FILTER (resource_type = 'DOC_SEARCH') AS doc_searches, count(*) FILTER (resource_type = 'AGENT_SESSION') AS agent_n
  FROM b_access_log GROUP BY 1, 2),
k AS (SELECT org_id, usage_date AS snapshot_date, CAST(sum(total_tokens) AS BIGINT) AS model_tokens FROM m_api_cost GROUP BY 1, 2),
a AS (SELECT org_id, CAST(started_at AS DATE) AS snapshot_date, count(*) AS agent_sessions FROM b_agent_sessions GROUP BY 1, 2),
r AS (SELECT org_id, CAST(created_at AS DATE) AS snapshot_date, count(*) AS recommendations_generated FROM b_recommendations GROUP BY 1, 2),
d AS (SELECT org_id, count(*) AS documents_indexed FROM b_documents WHERE processing_status = 'completed' GROUP BY 1)
SELECT org_id, snapshot_date, app_sessions, dau, model_calls, doc_searches, coalesce(model_tokens, 0) AS model_tokens,
  coalesce(agent_sessions, 0) AS agent_sessions, coalesce(recommendations_generated, 0) AS recommendations_generated,
  coalesce(documents_indexed, 0) AS documents_indexed,
  concat_ws('|', CASE WHEN model_calls > 0 THEN 'ai_chat' END, CASE WHEN doc_searches > 0 THEN 'document_search' END,
    CASE WHEN agent_n > 0 THEN 'agents' END) AS features_used,
  (model_calls > 0)::BIGINT + (doc_searches > 0)::BIGINT + (agent_n > 0)::BIGINT AS features_adopted
FROM l LEFT JOIN k USING (org_id, snapshot_date) LEFT JOIN a USING (org_id, snapshot_date)
LEFT JOIN r USING (org_id, snapshot_date) LEFT JOIN d USING (org_id)""")


def snapshots(t):
    return us.tenant_usage_snapshots(t.access_log, us.api_cost(t.api_usage_events), t.agent_sessions, t.documents, t.recommendations)


@query("e27_tenant_usage_snapshots", "SELECT * EXCLUDE features_adopted FROM m_snapshots", dates="snapshot_date")
def _(t):
    return snapshots(t)


@query("e28_tenant_health", f"""
SELECT s.org_id, snapshot_date AS last_active, dau, model_calls, model_tokens, agent_sessions, documents_indexed, features_used,
  round(dau_7d, 1) AS avg_dau_7d, round(calls_7d, 0) AS avg_model_calls_7d,
  CASE WHEN dau_7d >= 5 AND calls_7d >= 20 THEN 'HIGHLY_ENGAGED' WHEN dau_7d >= 2 AND calls_7d >= 5 THEN 'ENGAGED'
    WHEN dau_7d >= 1 THEN 'CASUAL' ELSE 'AT_RISK_OF_CHURN' END AS engagement_tier, features_adopted
FROM m_snapshots s JOIN (SELECT org_id, max(snapshot_date) AS d FROM m_snapshots GROUP BY 1) x ON s.org_id = x.org_id AND s.snapshot_date = x.d
LEFT JOIN (SELECT org_id, avg(dau) AS dau_7d, avg(model_calls) AS calls_7d FROM m_snapshots WHERE snapshot_date >= {D0} - 7 GROUP BY 1) a ON s.org_id = a.org_id""",
       dates="last_active")
def _(t):
    return us.tenant_health(snapshots(t))


@query("q24_tenants", f"""
SELECT s.org_id, snapshot_date AS last_active, dau, model_calls, agent_sessions, features_adopted,
  CASE WHEN dau_7d >= 5 AND calls_7d >= 20 THEN 'HIGHLY_ENGAGED' WHEN dau_7d >= 2 AND calls_7d >= 5 THEN 'ENGAGED'
    WHEN dau_7d >= 1 THEN 'CASUAL' ELSE 'AT_RISK_OF_CHURN' END AS engagement_tier
FROM m_snapshots s JOIN (SELECT org_id, max(snapshot_date) AS d FROM m_snapshots GROUP BY 1) x ON s.org_id = x.org_id AND s.snapshot_date = x.d
LEFT JOIN (SELECT org_id, avg(dau) AS dau_7d, avg(model_calls) AS calls_7d FROM m_snapshots WHERE snapshot_date >= {D0} - 7 GROUP BY 1) a ON s.org_id = a.org_id""",
       dates="last_active")
def _(t):
    return rd.tenant_list(us.tenant_health(snapshots(t)))


@query("e29_kpi_snapshot", f"""
SELECT h.*, d.new_30d, d.churned_30d FROM (
  SELECT org_id, count(*) AS total_customers, count(*) FILTER (churn_risk_level = 'HIGH') AS high_risk,
    count(*) FILTER (churn_risk_level = 'MEDIUM') AS medium_risk, sum(arr) AS total_arr,
    sum(CASE WHEN churn_risk_level = 'HIGH' THEN arr ELSE 0 END) AS arr_at_risk, round(avg(health_score), 1) AS avg_health_score,
    round(avg(nps_score), 1) AS avg_nps FROM m_c360_inverse GROUP BY org_id) h
JOIN (SELECT org_id, count(*) FILTER (created_at >= {T0} - INTERVAL 30 DAYS) AS new_30d,
    count(*) FILTER (lifecycle_stage = 'churned' AND updated_at >= {T0} - INTERVAL 30 DAYS) AS churned_30d FROM b_customers GROUP BY 1) d
ON h.org_id = d.org_id""", nums="total_arr arr_at_risk")
def _(t):
    return k.kpi_snapshot(c360_inverse(t), t.customers)


@query("e29b_weekly_briefing", f"""
SELECT org_id, '{{"total_customers":' || count(*) || ',"high_risk_customers":' || count(*) FILTER (risk_level = 'HIGH') || ',"arr_at_risk":'
  || sum(CASE WHEN risk_level = 'HIGH' THEN arr ELSE 0 END)::DECIMAL(28,2) || '}}' AS payload
FROM b_customers JOIN (SELECT customer_id, org_id, risk_level FROM b_churn_scores WHERE scored_at >= {T0} - INTERVAL 7 DAYS
  QUALIFY row_number() OVER (PARTITION BY customer_id, org_id ORDER BY scored_at DESC, score_id) = 1) USING (customer_id, org_id) GROUP BY org_id""")
def _(t):
    return k.weekly_briefing(t.customers, t.churn_scores)


def _state_sql(at):
    return f"""SELECT c.org_id, count(*) AS customers, sum(arr) AS total_arr, round(avg((1 - coalesce(h.churn_probability, 0.5)) * 100), 2) AS avg_health,
    count(*) FILTER (h.risk_level = 'HIGH') AS high_risk
  FROM b_customers c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY scored_at DESC) AS rn
    FROM b_churn_scores WHERE scored_at <= {at}) h ON c.customer_id = h.customer_id AND h.rn = 1
  WHERE c.created_at <= {at} GROUP BY 1"""


@query("e30_weekly_compare", f"""
SELECT a.*, b.customers AS customers_prev, b.total_arr AS total_arr_prev, b.avg_health AS avg_health_prev,
  round((a.total_arr - b.total_arr)::DOUBLE / nullif(b.total_arr, 0)::DOUBLE * 100, 2) AS arr_growth_pct
FROM ({_state_sql(T0)}) a LEFT JOIN ({_state_sql(T0 + " - INTERVAL 7 DAYS")}) b ON a.org_id = b.org_id""",
       nums="total_arr total_arr_prev")
def _(t):
    week = AS_OF - dt.timedelta(days=7)
    return k.kpi_compare(k.snapshot_at(t.customers, t.churn_scores, as_of=AS_OF), k.snapshot_at(t.customers, t.churn_scores, as_of=week))


@query("e31_latest_briefing", """
SELECT briefing_id, org_id, briefing_type, created_at FROM (SELECT document_id AS briefing_id, org_id, document_type AS briefing_type, created_at,
  row_number() OVER (PARTITION BY org_id, document_type ORDER BY created_at DESC, document_id) AS rn FROM b_documents) WHERE rn = 1""", times="created_at")
def _(t):
    return k.latest_briefing(t.documents.select(F.col("document_id").alias("briefing_id"), "org_id", F.col("document_type").alias("briefing_type"), "created_at"))


define("m_last_metric", """
SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY model_name, model_version, metric_name ORDER BY run_date DESC) AS rn FROM b_model_log) WHERE rn = 1""")


@query("e32_model_registry", """
SELECT model_name, model_version, max(run_date) AS last_evaluated, count(*) AS metric_count,
  string_agg(metric_name || '=' || metric_value, '|' ORDER BY metric_name) AS latest_metrics, any_value(dataset_split) AS latest_split
FROM m_last_metric GROUP BY 1, 2""", dates="last_evaluated")
def _(t):
    df = us.model_registry(t.model_log)
    pairs = F.transform(F.map_entries("latest_metrics"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return df.withColumn("latest_metrics", F.array_join(pairs, "|"))


@query("e33_model_health", f"""
SELECT model_name, model_version, metric_name, metric_value, run_date AS last_evaluation, date_diff('day', run_date, {D0}) AS days_since_evaluation,
  CASE WHEN date_diff('day', run_date, {D0}) > 30 THEN 'STALE' WHEN metric_name = 'accuracy' AND metric_value < 0.75 THEN 'DEGRADED' ELSE 'HEALTHY' END AS health_status
FROM (SELECT *, row_number() OVER (PARTITION BY model_name, model_version, metric_name ORDER BY run_date DESC) AS rn FROM b_model_log) WHERE rn = 1""",
       dates="last_evaluation", nums="metric_value")
def _(t):
    return us.model_health(t.model_log)


@query("e34_model_precision", """
SELECT org_id, count(*) FILTER (churn_risk_level = 'HIGH' AND lifecycle_stage = 'churned') AS true_positives,
  count(*) FILTER (churn_risk_level = 'HIGH') AS flagged,
  round(count(*) FILTER (churn_risk_level = 'HIGH' AND lifecycle_stage = 'churned') / count(*) FILTER (churn_risk_level = 'HIGH'), 4) AS precision,
  round(avg(health_score), 2) AS avg_health_score FROM m_c360 GROUP BY org_id""")
def _(t):
    return us.model_precision(c360(t))


@query("f5_ratio_to_report", """
SELECT org_id, segment, sum(arr) AS amount, round(sum(arr)::DOUBLE / (sum(sum(arr)) OVER (PARTITION BY org_id))::DOUBLE, 6) AS share
FROM m_stg_customers JOIN (SELECT customer_id, arr FROM b_customers) USING (customer_id) GROUP BY org_id, segment""", nums="amount")
def _(t):
    df = t.customers.withColumn("segment", F.upper(F.coalesce("segment", F.lit("UNKNOWN"))))
    return us.share_of_total(df, ["org_id"], "segment", F.col("arr"))


@query("m18_recommend", f"""
SELECT customer_id, org_id, 'churn_prevention' AS recommendation_type, CASE WHEN risk_level = 'HIGH' THEN 'HIGH' ELSE 'MEDIUM' END AS priority,
  recommended_action AS recommendation_text, expected_revenue_at_risk AS expected_impact_usd, churn_probability AS confidence_score,
  'customer_success' AS owner_role, 'pending' AS status, rank
FROM (SELECT h.*, row_number() OVER (PARTITION BY org_id ORDER BY expected_revenue_at_risk DESC, customer_id) AS rank FROM m_latest_churn h
  WHERE risk_level IN ('HIGH', 'MEDIUM') AND customer_id NOT IN (SELECT entity_id FROM b_recommendations WHERE status = 'pending' AND is_active
    AND recommendation_type = 'churn_prevention' AND created_at >= {T0} - INTERVAL 7 DAYS)) WHERE rank <= 20""",
       nums="expected_impact_usd confidence_score")
def _(t):
    return ac.recommend(t.churn_scores, t.customers, c360(t), t.recommendations)

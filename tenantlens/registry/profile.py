"""Customer metrics and customer-360 queries."""

from tenantlens.operators import staging as st
from tenantlens.plans import profile as p
from tenantlens.registry.core import define, query
from tenantlens.registry.oracle_tables import D0, T0

define("m_subs", f"""
SELECT customer_id, org_id, sum(CASE WHEN status = 'active' THEN mrr ELSE 0 END) AS mrr,
  sum(CASE WHEN status = 'active' THEN arr ELSE 0 END) AS arr,
  CAST(sum(CASE WHEN status = 'active' THEN seats ELSE 0 END) AS BIGINT) AS total_seats,
  count(*) FILTER (status = 'active') AS active_subscriptions,
  min(renewal_date) FILTER (status = 'active' AND renewal_date >= {D0}) AS nearest_renewal_date,
  date_diff('day', {D0}, min(renewal_date) FILTER (status = 'active' AND renewal_date >= {D0})) AS days_to_renewal,
  max(CASE WHEN status = 'active' AND plan_tier = 'enterprise' THEN 1 ELSE 0 END)::BIGINT AS is_enterprise,
  count(*) FILTER (status = 'cancelled') AS cancelled_subs
FROM m_stg_subscriptions GROUP BY customer_id, org_id""")
define("m_tiers", """
SELECT customer_id, org_id, plan_tier AS primary_plan_tier,
  row_number() OVER (PARTITION BY customer_id, org_id ORDER BY count(*) DESC, plan_tier) AS rn
FROM m_stg_subscriptions WHERE status = 'active' GROUP BY customer_id, org_id, plan_tier""")
define("m_subscription_metrics", """
SELECT s.*, t.primary_plan_tier FROM m_subs s
LEFT JOIN (SELECT * FROM m_tiers WHERE rn = 1) t ON s.customer_id = t.customer_id AND s.org_id = t.org_id""")
define("m_moods", """
SELECT customer_id, org_id, sentiment_label,
  row_number() OVER (PARTITION BY customer_id, org_id ORDER BY count(*) DESC, sentiment_label) AS rn
FROM m_stg_tickets GROUP BY customer_id, org_id, sentiment_label""")
define("m_ticket_metrics", f"""
SELECT t.customer_id, t.org_id, count(*) AS total_tickets, count(*) FILTER (status = 'open') AS open_tickets,
  count(*) FILTER (status = 'resolved') AS resolved_tickets,
  count(*) FILTER (priority IN ('high', 'critical')) AS high_priority_tickets,
  count(*) FILTER (sla_breached) AS sla_breaches, round(avg(sentiment_score), 3) AS avg_sentiment_score,
  any_value(m.sentiment_label) AS dominant_sentiment, round(avg(resolution_hours), 1) AS avg_resolution_hours,
  max(created_at) AS last_ticket_at, count(*) FILTER (created_at >= {T0} - INTERVAL 30 DAYS) AS tickets_30d,
  count(*) FILTER (created_at >= {T0} - INTERVAL 30 DAYS AND sla_breached) AS sla_breaches_30d
FROM m_stg_tickets t JOIN m_moods m ON t.customer_id = m.customer_id AND t.org_id = m.org_id AND m.rn = 1
GROUP BY t.customer_id, t.org_id""")
define("m_usage_counts", f"""
SELECT customer_id, org_id, count(*) AS total_events, count(DISTINCT event_type) AS unique_event_types,
  count(DISTINCT feature_name) AS features_used, count(*) FILTER (occurred_date >= {D0} - 7) AS events_7d,
  count(*) FILTER (occurred_date >= {D0} - 30) AS events_30d, count(*) FILTER (occurred_date >= {D0} - 90) AS events_90d,
  count(DISTINCT CASE WHEN occurred_date >= {D0} - 30 THEN occurred_date END) AS active_days_30d,
  count(DISTINCT CASE WHEN occurred_date >= {D0} - 7 THEN occurred_date END) AS active_days_7d,
  count(*) FILTER (is_ai_event) AS ai_invocations,
  count(*) FILTER (is_ai_event AND occurred_date >= {D0} - 30) AS ai_invocations_30d,
  count(*) FILTER (is_error_event) AS error_events, max(occurred_at) AS last_activity_at,
  date_diff('day', max(occurred_at), {T0}) AS days_since_last_activity
FROM m_stg_product_events GROUP BY customer_id, org_id""")
define("m_usage_metrics", """
SELECT *, CASE WHEN events_7d > events_30d / 4 * 1.2 THEN 'up' WHEN events_7d < events_30d / 4 * 0.8 THEN 'down'
  ELSE 'stable' END AS usage_trend FROM m_usage_counts""")
define("m_latest_churn", """
SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, org_id ORDER BY scored_at DESC) AS rn
FROM b_churn_scores) WHERE rn = 1""")
define("m_c360_joined", """
SELECT c.customer_id, c.org_id, c.customer_name, c.email, c.phone, c.segment, c.region, c.industry, c.status,
  c.lifecycle_stage, c.nps_score, c.customer_since, coalesce(s.mrr, 0) AS mrr, coalesce(s.arr, 0) AS arr,
  coalesce(total_seats, 0) AS total_seats, coalesce(active_subscriptions, 0) AS active_subscriptions,
  nearest_renewal_date, days_to_renewal, primary_plan_tier, coalesce(is_enterprise, 0) = 1 AS is_enterprise,
  coalesce(open_tickets, 0) AS open_tickets, coalesce(sla_breaches, 0) AS sla_breaches,
  coalesce(avg_sentiment_score, 0) AS avg_sentiment_score, coalesce(dominant_sentiment, 'neutral') AS sentiment_label,
  coalesce(tickets_30d, 0) AS tickets_30d, coalesce(sla_breaches_30d, 0) AS sla_breaches_30d,
  coalesce(events_30d, 0) AS events_30d, coalesce(events_7d, 0) AS events_7d, coalesce(active_days_30d, 0) AS active_days_30d,
  coalesce(features_used, 0) AS features_used, coalesce(ai_invocations_30d, 0) AS ai_invocations_30d,
  coalesce(days_since_last_activity, 999) AS days_since_last_activity, coalesce(usage_trend, 'no_data') AS usage_trend,
  coalesce(churn_probability, 0.1) AS churn_probability, coalesce(risk_level, 'LOW') AS churn_risk_level,
  recommended_action AS churn_recommended_action, coalesce(expected_revenue_at_risk, 0) AS expected_revenue_at_risk,
  top_driver AS churn_top_drivers
FROM m_stg_customers c
LEFT JOIN m_subscription_metrics s ON c.customer_id = s.customer_id AND c.org_id = s.org_id
LEFT JOIN m_ticket_metrics t ON c.customer_id = t.customer_id AND c.org_id = t.org_id
LEFT JOIN m_usage_metrics u ON c.customer_id = u.customer_id AND c.org_id = u.org_id
LEFT JOIN m_latest_churn h ON c.customer_id = h.customer_id AND c.org_id = h.org_id""")
define("m_c360_points", """
SELECT *, CAST((coalesce(nps_score, 0) + 100) * 0.5 AS DECIMAL(8,1)) AS nps_normalized,
  CASE WHEN active_days_30d >= 20 THEN 100 WHEN active_days_30d >= 10 THEN 70 WHEN active_days_30d >= 5 THEN 40 ELSE 10 END::BIGINT AS usage_points,
  greatest(0, 100 - 15 * sla_breaches) AS sla_points
FROM m_c360_joined""")
define("m_c360", """
SELECT *, least(100, greatest(0, round((1 - CAST(churn_probability AS DECIMAL(8,4))) * 35 + nps_normalized * 0.3
    + usage_points * 0.25 + CAST(sla_points AS DECIMAL(18,2)) * 0.1, 1))) AS health_score,
  CASE WHEN lifecycle_stage = 'churned' THEN 'churned' WHEN churn_risk_level = 'HIGH' THEN 'at_risk'
    WHEN days_to_renewal <= 30 AND churn_risk_level <> 'LOW' THEN 'at_risk' ELSE 'active' END AS derived_lifecycle_stage,
  coalesce(churn_recommended_action, '') AS ai_recommendations
FROM m_c360_points""")

_ACT = f"occurred_at >= {T0} - INTERVAL 30 DAYS"
define("m_usage_windows", f"""
SELECT customer_id, org_id, count(*) AS events_30d, count(DISTINCT CAST(occurred_at AS DATE)) AS active_days_30d,
  count(DISTINCT feature_name) AS distinct_features_used,
  count(*) FILTER (event_type = 'ai_agent_invocation') AS agent_invocations_30d, max(occurred_at) AS last_activity_at,
  count(*) FILTER (occurred_at >= {T0} - INTERVAL 7 DAYS) AS events_7d,
  count(DISTINCT CASE WHEN occurred_at >= {T0} - INTERVAL 7 DAYS THEN CAST(occurred_at AS DATE) END) AS active_days_7d
FROM b_product_events WHERE {_ACT} GROUP BY customer_id, org_id""")
define("m_plan_names", """
SELECT customer_id, org_id, string_agg(plan_name, ' | ' ORDER BY top_arr DESC, plan_name) AS plan_names
FROM (SELECT customer_id, org_id, plan_name, max(coalesce(arr, 0)) AS top_arr FROM b_subscriptions WHERE status = 'active' GROUP BY ALL)
GROUP BY customer_id, org_id""")
define("m_c360_bucketed", f"""
WITH s AS (SELECT customer_id, org_id, count(*) AS active_subscriptions, sum(mrr) AS total_mrr, sum(arr) AS total_arr,
    CAST(sum(seats) AS BIGINT) AS total_seats, min(current_period_end) AS nearest_renewal_date
  FROM b_subscriptions WHERE status = 'active' GROUP BY 1, 2),
t AS (SELECT customer_id, org_id, count(*) AS total_tickets, count(*) FILTER (status = 'open') AS open_tickets,
    count(*) FILTER (status = 'open' AND priority IN ('urgent', 'high')) AS critical_open_tickets,
    count(*) FILTER (sla_breach) AS sla_breaches, round(avg(sentiment_score), 3) AS avg_sentiment_score,
    max(CASE WHEN sentiment_score < -0.5 THEN 1 ELSE 0 END)::BIGINT AS has_critical_negative, max(created_at) AS last_ticket_date
  FROM b_tickets GROUP BY 1, 2),
k AS (SELECT customer_id, org_id, max(contract_value) AS highest_contract_value, min(end_date) AS nearest_contract_end,
    count(*) FILTER (status = 'active') AS active_contracts, bool_or(auto_renewal) AS has_auto_renewal
  FROM b_contracts GROUP BY 1, 2)
SELECT c.customer_id, c.org_id, c.name AS customer_name, c.segment, c.lifecycle_stage,
  coalesce(s.total_arr, c.arr) AS arr, coalesce(s.total_mrr, c.mrr) AS mrr, s.total_seats, s.active_subscriptions,
  p.plan_names, s.nearest_renewal_date, h.churn_probability, h.risk_level AS churn_risk_level, h.expected_revenue_at_risk,
  least(100, greatest(0, round((1 - coalesce(h.churn_probability, 0.5)) * 35
    + CASE WHEN c.nps_score IS NULL THEN 15 WHEN c.nps_score >= 70 THEN 30 WHEN c.nps_score >= 50 THEN 20 WHEN c.nps_score >= 30 THEN 10 ELSE 5 END
    + least(25, coalesce(u.active_days_30d, 0))
    + CASE WHEN coalesce(t.sla_breaches, 0) = 0 THEN 10 WHEN t.sla_breaches <= 1 THEN 5 ELSE 0 END, 1))) AS health_score,
  c.nps_score, coalesce(t.total_tickets, 0) AS total_tickets, coalesce(t.open_tickets, 0) AS open_tickets,
  coalesce(t.critical_open_tickets, 0) AS critical_open_tickets, coalesce(t.sla_breaches, 0) AS sla_breaches, t.avg_sentiment_score,
  CASE WHEN t.avg_sentiment_score >= 0.3 THEN 'positive' WHEN t.avg_sentiment_score <= -0.3 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
  t.has_critical_negative, t.last_ticket_date, coalesce(u.events_30d, 0) AS events_30d, coalesce(u.active_days_30d, 0) AS active_days_30d,
  coalesce(u.distinct_features_used, 0) AS distinct_features_used, coalesce(u.agent_invocations_30d, 0) AS agent_invocations_30d,
  u.last_activity_at, coalesce(u.events_7d, 0) AS events_7d, coalesce(u.active_days_7d, 0) AS active_days_7d,
  date_diff('day', u.last_activity_at, {T0}) AS days_since_last_activity,
  CASE WHEN coalesce(u.events_30d, 0) = 0 THEN 'no_data' WHEN u.events_7d >= u.events_30d / 4 * 1.2 THEN 'up'
    WHEN u.events_7d <= u.events_30d / 4 * 0.8 THEN 'down' ELSE 'stable' END AS usage_trend,
  k.active_contracts, k.highest_contract_value, k.nearest_contract_end, k.has_auto_renewal
FROM b_customers c LEFT JOIN s USING (customer_id, org_id) LEFT JOIN m_plan_names p USING (customer_id, org_id)
LEFT JOIN m_latest_churn h USING (customer_id, org_id) LEFT JOIN t USING (customer_id, org_id)
LEFT JOIN m_usage_windows u USING (customer_id, org_id) LEFT JOIN k USING (customer_id, org_id)""")
define("m_c360_inverse", f"""
WITH t AS (SELECT customer_id, org_id, count(*) AS total_tickets, count(*) FILTER (status = 'open') AS open_tickets,
    count(*) FILTER (status = 'open' AND priority IN ('urgent', 'high')) AS critical_open_tickets,
    count(*) FILTER (sla_breach) AS sla_breaches, round(avg(sentiment_score), 6) AS avg_sentiment_score FROM b_tickets GROUP BY 1, 2),
m AS (SELECT customer_id, org_id, sentiment_label FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, org_id
    ORDER BY created_at DESC, ticket_id DESC) AS rn FROM b_tickets) WHERE rn = 1),
r AS (SELECT customer_id, org_id, min(current_period_end) AS nearest_renewal_date FROM b_subscriptions
    WHERE status = 'active' AND current_period_end >= {D0} GROUP BY 1, 2)
SELECT c.customer_id, c.org_id, c.name AS customer_name, c.segment, c.lifecycle_stage, c.nps_score, c.arr, c.mrr, c.contract_end_date,
  h.churn_probability, h.risk_level AS churn_risk_level, h.expected_revenue_at_risk, h.recommended_action AS churn_recommended_action,
  h.scored_at, round((1 - coalesce(h.churn_probability, 0.5)) * 100, 0) AS health_score, r.nearest_renewal_date,
  coalesce(t.total_tickets, 0) AS total_tickets, coalesce(t.open_tickets, 0) AS open_tickets,
  coalesce(t.critical_open_tickets, 0) AS critical_open_tickets, coalesce(t.sla_breaches, 0) AS sla_breaches,
  t.avg_sentiment_score, m.sentiment_label, coalesce(u.events_30d, 0) AS events_30d, coalesce(u.active_days_30d, 0) AS active_days_30d,
  coalesce(u.distinct_features_used, 0) AS distinct_features_used, u.last_activity_at,
  coalesce(date_diff('day', u.last_activity_at, {T0}), 999) AS days_since_last_activity,
  coalesce(u.events_7d, 0) AS events_7d, coalesce(u.active_days_7d, 0) AS active_days_7d,
  coalesce(u.agent_invocations_30d, 0) AS agent_invocations_30d,
  CASE WHEN coalesce(u.events_30d, 0) = 0 THEN 'no_data' WHEN u.events_7d > u.events_30d * 0.35 THEN 'up'
    WHEN u.events_7d < u.events_30d * 0.15 THEN 'down' ELSE 'stable' END AS usage_trend
FROM b_customers c LEFT JOIN m_latest_churn h USING (customer_id, org_id) LEFT JOIN t USING (customer_id, org_id)
LEFT JOIN m USING (customer_id, org_id) LEFT JOIN r USING (customer_id, org_id) LEFT JOIN m_usage_windows u USING (customer_id, org_id)""")
define("m_health", f"""
WITH t AS (SELECT customer_id, org_id, count(*) AS open_tickets, count(*) FILTER (priority IN ('urgent', 'high')) AS critical_open_tickets,
    count(*) FILTER (sla_breach) AS sla_breaches FROM b_tickets WHERE status = 'open' GROUP BY 1, 2)
SELECT c.customer_id, c.org_id, c.name AS customer_name, c.segment, c.lifecycle_stage, c.arr, c.mrr, c.nps_score, c.contract_end_date,
  date_diff('day', {D0}, c.contract_end_date) AS days_to_renewal, coalesce(h.churn_probability, 0.5) AS churn_probability,
  coalesce(h.risk_level, 'UNKNOWN') AS churn_risk_level, coalesce(h.expected_revenue_at_risk, 0) AS expected_revenue_at_risk,
  h.recommended_action AS churn_recommended_action, h.scored_at AS churn_scored_at, coalesce(t.open_tickets, 0) AS open_tickets,
  coalesce(t.critical_open_tickets, 0) AS critical_open_tickets, coalesce(t.sla_breaches, 0) AS sla_breaches,
  coalesce(u.events_30d, 0) AS events_30d, coalesce(u.active_days_30d, 0) AS active_days_30d,
  coalesce(u.distinct_features_used, 0) AS distinct_features_30d, u.last_activity_at,
  date_diff('day', u.last_activity_at, {T0}) AS days_since_last_activity,
  round((1 - coalesce(h.churn_probability, 0.5)) * 100, 0) AS health_score
FROM b_customers c LEFT JOIN m_latest_churn h USING (customer_id, org_id) LEFT JOIN t USING (customer_id, org_id)
LEFT JOIN m_usage_windows u USING (customer_id, org_id)""")


def c360(t):
    return p.customer_360_weighted(t.customers, t.subscriptions, t.tickets, t.product_events, t.churn_scores)


def c360_inverse(t):
    return p.customer_360_inverse_churn(t.customers, t.subscriptions, t.tickets, t.product_events, t.churn_scores)


def health(t):
    return p.customer_health(t.customers, t.churn_scores, t.tickets, t.product_events)


@query("e1_subscription_metrics", "SELECT * FROM m_subscription_metrics", dates="nearest_renewal_date", nums="mrr arr")
def _(t):
    return p.subscription_metrics(st.stg_subscriptions(t.subscriptions))


@query("e2_ticket_metrics", "SELECT * FROM m_ticket_metrics", times="last_ticket_at")
def _(t):
    return p.ticket_metrics(st.stg_tickets(t.tickets))


@query("e3_usage_metrics", "SELECT * FROM m_usage_metrics", times="last_activity_at")
def _(t):
    return p.usage_metrics(st.stg_product_events(t.product_events))


@query("e4_customer_360_weighted", "SELECT * FROM m_c360", dates="nearest_renewal_date", times="customer_since",
       nums="mrr arr avg_sentiment_score churn_probability expected_revenue_at_risk nps_normalized health_score")
def _(t):
    return c360(t)


@query("e5_customer_360_bucketed", "SELECT * FROM m_c360_bucketed", dates="nearest_renewal_date nearest_contract_end",
       times="last_ticket_date last_activity_at",
       nums="arr mrr churn_probability expected_revenue_at_risk health_score highest_contract_value")
def _(t):
    return p.customer_360_bucketed(t.customers, t.subscriptions, t.tickets, t.product_events, t.contracts, t.churn_scores)


@query("e6_customer_360_inverse_churn", "SELECT * FROM m_c360_inverse", dates="contract_end_date nearest_renewal_date",
       times="scored_at last_activity_at", nums="arr mrr churn_probability expected_revenue_at_risk health_score")
def _(t):
    return c360_inverse(t)


@query("e7_customer_health", "SELECT * FROM m_health", dates="contract_end_date", times="churn_scored_at last_activity_at",
       nums="arr mrr churn_probability expected_revenue_at_risk health_score")
def _(t):
    return health(t)


@query("e8_customer_health_segmented", f"""
SELECT c.customer_id, c.org_id, c.name, c.segment, c.region, c.arr, c.mrr, c.nps_score, c.lifecycle_stage, c.contract_end_date,
  coalesce(h.churn_probability, 0.5) AS churn_risk_score, coalesce(h.risk_level, 'MEDIUM') AS risk_level,
  coalesce(h.recommended_action, 'Watch engagement pattern') AS recommended_action,
  CASE WHEN coalesce(h.churn_probability, 0.5) >= 0.7 THEN 'CRITICAL' WHEN coalesce(h.churn_probability, 0.5) >= 0.5 THEN 'AT_RISK'
    WHEN coalesce(h.churn_probability, 0.5) >= 0.3 THEN 'HEALTHY' ELSE 'CHAMPION' END AS health_segment,
  count(DISTINCT t.ticket_id) AS open_ticket_count, count(DISTINCT i.interaction_id) AS interaction_count_30d
FROM b_customers c LEFT JOIN b_churn_scores h ON c.customer_id = h.customer_id AND c.org_id = h.org_id
LEFT JOIN b_tickets t ON c.customer_id = t.customer_id AND c.org_id = t.org_id AND t.status = 'open'
LEFT JOIN b_interactions i ON c.customer_id = i.customer_id AND c.org_id = i.org_id AND i.occurred_at >= {T0} - INTERVAL 30 DAYS
GROUP BY ALL""", dates="contract_end_date", nums="arr mrr churn_risk_score")
def _(t):
    return p.customer_health_segmented(t.customers, t.churn_scores, t.tickets, t.interactions)


define("m_features", """
SELECT customer_id, org_id, customer_name, segment, region, industry, lifecycle_stage, health_score, coalesce(nps_score, 0) AS nps_score,
  events_30d, active_days_30d, days_since_last_activity, open_tickets, sla_breaches, mrr, arr, total_seats, events_7d, features_used,
  sla_breaches_30d, tickets_30d, ai_invocations_30d, coalesce(days_to_renewal, 365) AS days_to_renewal, churn_probability,
  usage_trend, churn_risk_level, CASE WHEN lifecycle_stage = 'churned' THEN 1 ELSE 0 END::BIGINT AS is_churned,
  CASE WHEN total_seats > 0 THEN round(open_tickets / total_seats, 3) ELSE 0 END AS tickets_per_seat,
  CASE WHEN events_30d > 0 THEN round(events_7d * 4.3 / events_30d, 2) ELSE 1 END AS usage_velocity_ratio,
  round(least(active_days_30d / 20, 1) * 0.5 + least(events_30d / 500, 1) * 0.3 + least(features_used / 10, 1) * 0.2, 3) AS engagement_score
FROM m_c360""")


@query("e16_churn_features", "SELECT * FROM m_features", nums="health_score mrr arr churn_probability")
def _(t):
    return p.churn_features(c360(t))

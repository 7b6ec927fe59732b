"""Staging queries."""

from tenantlens.operators import staging as st
from tenantlens.registry.core import define, query
from tenantlens.registry.oracle_tables import D0, T0

define("m_stg_customers", """
SELECT customer_id, org_id, trim(name) AS customer_name, lower(trim(email)) AS email, phone,
  upper(coalesce(segment, 'UNKNOWN')) AS segment, upper(region) AS region, lower(industry) AS industry,
  CASE lifecycle_stage WHEN 'churned' THEN 'churned' WHEN 'at_risk' THEN 'inactive' ELSE 'active' END AS status,
  lifecycle_stage, nps_score, created_at AS customer_since, updated_at
FROM b_customers""")

define("m_stg_subscriptions", """
SELECT subscription_id, org_id, customer_id, product_id, plan_name, coalesce(plan_tier, 'standard') AS plan_tier, status,
  seats, mrr, CAST(coalesce(arr, mrr * 12, 0) AS DECIMAL(18,2)) AS arr, current_period_start AS started_at,
  current_period_end AS renewal_date
FROM b_subscriptions WHERE status <> 'deleted'""")

define("m_stg_tickets", """
SELECT ticket_id, org_id, customer_id, subject, status, priority, sla_breach AS sla_breached, sentiment_score, sentiment_label,
  created_at, resolved_at, date_diff('hour', created_at, resolved_at) AS resolution_hours
FROM b_tickets""")

define("m_stg_product_events", f"""
SELECT event_id, org_id, customer_id, event_type, feature_name, event_value, 'web' AS platform, occurred_at,
  CAST(occurred_at AS DATE) AS occurred_date, event_type = 'ai_agent_invocation' AS is_ai_event,
  contains(event_type, 'error') AS is_error_event, event_type = 'login' AS is_login
FROM b_product_events WHERE occurred_at >= {T0} - INTERVAL 90 DAYS""")

define("m_stg_transactions", """
SELECT transaction_id, org_id, customer_id, transaction_type, status, amount, 'USD' AS currency, amount AS amount_usd,
  transaction_date, CAST(date_trunc('month', transaction_date) AS DATE) AS transaction_month
FROM b_transactions WHERE status = 'completed'""")

define("m_stg_contracts", f"""
SELECT contract_id, org_id, customer_id, contract_name, status AS contract_status, auto_renewal, contract_value,
  contract_value AS contract_arr, start_date, end_date, date_diff('day', {D0}, end_date) AS days_remaining,
  end_date <= {D0} + 90 AND status = 'active' AS is_expiring_soon
FROM b_contracts""")

define("m_stg_opportunities", f"""
SELECT opportunity_id, org_id, customer_id, trim(opportunity_name) AS opportunity_name, opportunity_type, stage,
  coalesce(amount_usd, 0) AS amount_usd, probability_pct,
  coalesce(amount_usd, 0) * probability_pct * 0.01 AS weighted_amount_usd, close_date,
  date_diff('day', {D0}, close_date) AS days_to_close, stage = 'closed_won' AS is_won, stage = 'closed_lost' AS is_lost,
  stage NOT IN ('closed_won', 'closed_lost') AS is_open,
  close_date < {D0} AND stage NOT IN ('closed_won', 'closed_lost') AS is_overdue,
  CASE WHEN probability_pct >= 70 AND amount_usd >= 50000 THEN 'A_PRIORITY'
       WHEN probability_pct >= 50 AND amount_usd >= 20000 THEN 'B_PRIORITY'
       WHEN probability_pct >= 30 THEN 'C_PIPELINE' ELSE 'D_NURTURE' END AS priority_quadrant
FROM b_opportunities""")


@query("b1_stg_customers", "SELECT * FROM m_stg_customers", times="customer_since updated_at")
def _(t):
    return st.stg_customers(t.customers)


@query("b2_stg_subscriptions", "SELECT * FROM m_stg_subscriptions", dates="renewal_date started_at", nums="mrr arr")
def _(t):
    df = st.stg_subscriptions(t.subscriptions).drop("ended_at")
    return df.withColumn("started_at", df.started_at.cast("date"))


@query("b3_stg_tickets", "SELECT * FROM m_stg_tickets", times="created_at resolved_at", nums="sentiment_score")
def _(t):
    return st.stg_tickets(t.tickets)


@query("b4_stg_product_events", "SELECT * FROM m_stg_product_events", dates="occurred_date", times="occurred_at", nums="event_value")
def _(t):
    return st.stg_product_events(t.product_events)


@query("b5_stg_transactions", "SELECT * FROM m_stg_transactions", dates="transaction_date transaction_month", nums="amount amount_usd")
def _(t):
    return st.stg_transactions(t.transactions)


@query("b6_stg_contracts", "SELECT * FROM m_stg_contracts", dates="start_date end_date", nums="contract_value contract_arr")
def _(t):
    return st.stg_contracts(t.contracts)


@query("b7_stg_opportunities", "SELECT * FROM m_stg_opportunities", dates="close_date", nums="amount_usd weighted_amount_usd")
def _(t):
    return st.stg_opportunities(t.opportunities)

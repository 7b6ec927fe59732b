"""The entity bindings written a second time, as SQL.

These common table expressions are prefixed to the comparison SQL of each
query. They are independent of the Spark bindings on purpose.
"""

T0 = "TIMESTAMP '2024-01-31 00:00:00'"
D0 = "DATE '2024-01-31'"

CTES: dict[str, str] = {}

CTES["b_tenants"] = """
SELECT c_custkey AS custkey, 'CUST-' || c_custkey AS customer_id, 'ORG-' || n_regionkey AS org_id
FROM customer JOIN nation ON c_nationkey = n_nationkey"""

CTES["b_user_org_map"] = """
SELECT lower(n_name) AS user_name, CASE WHEN n_nationkey % 9 <> 8 THEN 'ORG-' || n_regionkey END AS org_id,
       CASE WHEN n_nationkey % 7 = 0 THEN 'ADMIN' ELSE 'ANALYST' END AS role
FROM nation"""

CTES["b_customers"] = f"""
SELECT 'CUST-' || c_custkey AS customer_id, 'ORG-' || r_regionkey AS org_id, c_name AS name,
  CASE WHEN c_custkey % 17 <> 0 THEN lower(replace(c_name, '#', '.')) || '@example.com' END AS email,
  '55' || (1000000 + c_custkey) || '99' AS phone,
  CASE WHEN c_custkey % 23 <> 0 THEN c_mktsegment END AS segment,
  r_name AS region, lower(c_mktsegment) AS industry,
  CASE WHEN c_custkey % 10 = 0 THEN 'churned' WHEN c_custkey % 10 IN (1, 2) THEN 'at_risk'
       WHEN c_custkey % 10 = 3 THEN 'onboarding' ELSE 'active' END AS lifecycle_stage,
  CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey * 37) % 201 - 100 END AS nps_score,
  CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS mrr,
  CAST(CAST(abs(c_acctbal) AS DECIMAL(18,2)) * 12 AS DECIMAL(18,2)) AS arr,
  {D0} - 60 + CAST((c_custkey * 13) % 400 AS INT) - 365 AS contract_start_date,
  {D0} - 60 + CAST((c_custkey * 13) % 400 AS INT) AS contract_end_date,
  'crm' AS source_system,
  {T0} - to_days(CAST((c_custkey * 7) % 900 AS INT)) AS created_at,
  {T0} - to_hours(c_custkey % 120) AS updated_at
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

CTES["b_subscriptions"] = """
SELECT 'SUB-' || o_orderkey AS subscription_id, org_id, customer_id, 'PROD-' || (o_orderkey % 12) AS product_id,
  'plan-' || CASE o_orderpriority WHEN '1-URGENT' THEN 'enterprise' WHEN '2-HIGH' THEN 'business'
     WHEN '3-MEDIUM' THEN 'standard' ELSE 'base' END AS plan_name,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'enterprise' WHEN '2-HIGH' THEN 'business'
     WHEN '3-MEDIUM' THEN 'standard' END AS plan_tier,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN 'deleted'
     WHEN o_orderstatus = 'O' THEN 'active' WHEN o_orderstatus = 'F' THEN 'cancelled' ELSE 'paused' END AS status,
  1 + o_orderkey % 50 AS seats,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 0.01 AS DECIMAL(18,2)) AS mrr,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 0.01 AS DECIMAL(18,2)) * 12 AS DECIMAL(18,2)) END AS arr,
  CAST(o_orderdate AS DATE) + 8218 AS current_period_start,
  CAST(o_orderdate AS DATE) + 8218 + 365 AS current_period_end,
  CAST(NULL AS DATE) AS trial_end_date, CAST(NULL AS DATE) AS cancel_at, CAST(NULL AS TIMESTAMP) AS canceled_at,
  o_orderdate + INTERVAL 8218 DAYS AS created_at
FROM orders JOIN b_tenants ON o_custkey = custkey"""

CTES["b_contracts"] = f"""
SELECT 'CTR-' || o_orderkey AS contract_id, org_id, customer_id, 'Contract ' || o_orderkey AS contract_name,
  CAST(o_totalprice AS DECIMAL(18,2)) AS contract_value, CAST(o_orderdate AS DATE) + 8218 AS start_date,
  {D0} - 120 + CAST((o_orderkey * 7) % 700 AS INT) AS end_date, o_orderkey % 2 = 0 AS auto_renewal,
  CASE o_orderstatus WHEN 'F' THEN 'expired' WHEN 'O' THEN 'active' ELSE 'pending' END AS status
FROM orders JOIN b_tenants ON o_custkey = custkey"""

CTES["b_opportunities"] = f"""
SELECT 'OPP-' || o_orderkey AS opportunity_id, org_id, customer_id, ' Deal ' || o_orderkey AS opportunity_name,
  CASE o_orderkey % 5 WHEN 0 THEN 'new_business' WHEN 1 THEN 'expansion' WHEN 2 THEN 'renewal'
     WHEN 3 THEN 'upsell' ELSE 'cross_sell' END AS opportunity_type,
  CASE o_orderkey % 6 WHEN 0 THEN 'prospecting' WHEN 1 THEN 'qualification' WHEN 2 THEN 'proposal'
     WHEN 3 THEN 'negotiation' WHEN 4 THEN 'closed_won' ELSE 'closed_lost' END AS stage,
  CASE WHEN o_orderkey % 13 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 0.2 AS DECIMAL(18,2)) END AS amount_usd,
  (o_orderkey * 17) % 101 AS probability_pct,
  {D0} - 30 + CAST(o_orderkey % 120 AS INT) AS close_date
FROM orders JOIN b_tenants ON o_custkey = custkey"""

_LINE_ID = """md5(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' ||
     CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) || '|' || strftime(l_shipdate, '%Y-%m-%d'))"""

CTES["b_transactions"] = f"""
SELECT {_LINE_ID} AS transaction_id, org_id, customer_id,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2)) AS amount,
  'usd' AS currency,
  CASE l_linenumber % 6 WHEN 0 THEN 'new_contract' WHEN 1 THEN 'upsell' WHEN 2 THEN 'renewal'
     WHEN 3 THEN 'downgrade' WHEN 4 THEN 'churn' ELSE 'refund' END AS transaction_type,
  CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'pending' END AS status,
  CAST(l_shipdate AS DATE) + 8218 AS transaction_date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN b_tenants ON o_custkey = custkey"""

CTES["b_tickets"] = f"""
SELECT {_LINE_ID} AS ticket_id, org_id, customer_id, 'Order ' || l_orderkey AS subject,
  CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'open' ELSE 'pending' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS priority,
  CASE WHEN l_returnflag = 'R' THEN 'return' WHEN l_linenumber = 1 THEN 'billing' ELSE 'support' END AS category,
  CAST(l_tax AS DECIMAL(4,2)) > 0.06 AS sla_breach,
  CAST(20 * CAST(l_discount AS DECIMAL(4,2)) - 1 AS DECIMAL(4,3)) AS sentiment_score,
  CASE WHEN 20 * CAST(l_discount AS DECIMAL(4,2)) - 1 > 0.2 THEN 'positive'
       WHEN 20 * CAST(l_discount AS DECIMAL(4,2)) - 1 < -0.2 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
  least(l_shipdate + INTERVAL 8218 DAYS, {T0}) AS created_at,
  CASE WHEN o_orderstatus = 'F' THEN least(l_shipdate + INTERVAL 8218 DAYS, {T0}) + to_hours(CAST(l_quantity AS INT)) END AS resolved_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN b_tenants ON o_custkey = custkey"""

CTES["b_product_events"] = """
SELECT 'EV-' || event_id AS event_id, org_id, customer_id,
  CASE event_type WHEN 'signup' THEN 'login' WHEN 'purchase' THEN 'ai_agent_invocation' WHEN 'click' THEN 'feature_used'
     WHEN 'view' THEN 'page_view' WHEN 'error' THEN 'api_error' END AS event_type,
  'f' || (CAST(json_extract_string(props, '$.k') AS INT) % 10) AS feature_name,
  CAST(value AS DECIMAL(18,4)) AS event_value,
  user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id, CAST(user_id AS VARCHAR) AS user_id, ts AS occurred_at
FROM events JOIN b_tenants ON user_id = custkey"""

CTES["b_api_usage_events"] = """
SELECT 'AP-' || event_id AS event_id, org_id, '/' || event_type AS endpoint, 'POST' AS method,
  CAST(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS BIGINT) AS status_code,
  CAST(round(CAST(value AS DECIMAL(12,2)) * 10) AS BIGINT) AS latency_ms,
  CAST(round(CAST(value AS DECIMAL(12,2)) * 100) AS BIGINT) AS tokens_used,
  'model-' || (user_id % 3) AS model_name, ts AS request_ts
FROM events JOIN b_tenants ON user_id = custkey"""

CTES["b_health_score_events"] = """
SELECT 'HS-' || event_id AS event_id, org_id, customer_id,
  CAST(CAST(value AS DECIMAL(12,2)) % 10 - 5 AS DECIMAL(5,2)) AS score_delta,
  CAST(CAST(value AS DECIMAL(12,2)) % 100 AS DECIMAL(5,2)) AS new_score, event_type AS score_driver, ts AS event_ts
FROM events JOIN b_tenants ON user_id = custkey"""

CTES["b_access_log"] = """
SELECT 'LOG-' || event_id AS log_id, org_id, 'user-' || user_id AS user_name,
  CASE event_type WHEN 'view' THEN 'APP_SESSION' WHEN 'click' THEN 'DOC_SEARCH' WHEN 'purchase' THEN 'MODEL_CALL'
     WHEN 'signup' THEN 'AGENT_SESSION' ELSE 'OTHER' END AS resource_type,
  event_type <> 'error' AS success, ts AS created_at
FROM events JOIN b_tenants ON user_id = custkey"""

CTES["b_agent_sessions"] = f"""
SELECT 'SES-' || conv_id AS session_id, org_id, 'user-' || (conv_id % 20) AS user_name,
  CASE conv_id % 3 WHEN 0 THEN 'customer' WHEN 1 THEN 'document' ELSE 'operations' END AS agent_type,
  message_count, {T0} - to_days(CAST(conv_id % 10 AS INT)) - INTERVAL 1 HOUR AS started_at
FROM (SELECT conv_id, count(*) AS message_count FROM conversations GROUP BY conv_id) JOIN b_tenants ON conv_id = custkey"""

CTES["b_churn_scores"] = f"""
SELECT 'SC-' || c_custkey || '-' || v AS score_id, c.org_id, c.customer_id,
  CAST(((c_custkey * 7919 + v * 13) % 1000) * 0.001 AS DECIMAL(5,4)) AS churn_probability,
  CASE WHEN (c_custkey * 7919 + v * 13) % 1000 >= 650 THEN 'HIGH'
       WHEN (c_custkey * 7919 + v * 13) % 1000 >= 350 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  'driver_' || (c_custkey % 4) AS top_driver, 'action_' || (c_custkey % 3) AS recommended_action,
  CAST(arr * CAST(((c_custkey * 7919 + v * 13) % 1000) * 0.001 AS DECIMAL(5,4)) AS DECIMAL(18,2)) AS expected_revenue_at_risk,
  {T0} - to_days(CAST(11 - v * 10 AS INT)) AS scored_at
FROM b_customers c JOIN customer ON customer_id = 'CUST-' || c_custkey, (VALUES (0), (1)) AS versions(v)"""

CTES["b_recommendations"] = f"""
SELECT 'REC-' || c_custkey AS recommendation_id, c.org_id, c.customer_id AS entity_id, 'customer' AS entity_type,
  CASE c_custkey % 5 WHEN 0 THEN 'churn_prevention' WHEN 1 THEN 'upsell' WHEN 2 THEN 'renewal'
     WHEN 3 THEN 'health_improvement' ELSE 'support_escalation' END AS recommendation_type,
  CASE c_custkey % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
  'Do step ' || (c_custkey % 7) AS recommendation_text,
  CASE WHEN c_custkey % 21 <> 0 THEN CAST(arr * 0.1 AS DECIMAL(18,2)) END AS expected_impact_usd,
  CAST((c_custkey % 100) * 0.01 AS DECIMAL(4,3)) AS confidence_score, 'role-' || (c_custkey % 3) AS owner_role,
  CASE c_custkey % 6 WHEN 3 THEN 'in_progress' WHEN 4 THEN 'completed' WHEN 5 THEN 'dismissed' ELSE 'pending' END AS status,
  c_custkey % 6 NOT IN (4, 5) AS is_active,
  {T0} - to_days(CAST(c_custkey % 20 AS INT)) AS created_at,
  {T0} - to_days(CAST(c_custkey % 20 AS INT)) + INTERVAL 30 DAYS AS expires_at
FROM b_customers c JOIN customer ON customer_id = 'CUST-' || c_custkey"""

CTES["b_interactions"] = f"""
SELECT conv_id || '-' || turn AS interaction_id, org_id, customer_id,
  CASE conv_id % 5 WHEN 0 THEN 'email' WHEN 1 THEN 'call' WHEN 2 THEN 'chat' WHEN 3 THEN 'meeting' ELSE 'sms' END AS channel,
  CASE WHEN role = 'user' THEN 'inbound' ELSE 'outbound' END AS direction, text AS body,
  CAST(((conv_id * 31 + turn * 17) % 201 - 100) * 0.01 AS DECIMAL(4,2)) AS sentiment_score,
  {T0} - to_days(CAST(conv_id % 60 AS INT)) AS occurred_at
FROM conversations JOIN b_tenants ON conv_id = custkey"""

CTES["b_documents"] = f"""
SELECT 'DOC-' || doc_id AS document_id, org_id, customer_id AS entity_id, 'doc_' || doc_id || '.pdf' AS document_name,
  CASE doc_id % 7 WHEN 0 THEN 'contract' WHEN 1 THEN 'sla' WHEN 2 THEN 'amendment' WHEN 3 THEN 'invoice'
     WHEN 4 THEN 'proposal' WHEN 5 THEN 'nda' ELSE 'other' END AS document_type,
  text AS extracted_text, CASE WHEN doc_id % 9 = 0 THEN 'pending' ELSE 'completed' END AS processing_status,
  doc_id % 4 AS risk_flag_count,
  CASE WHEN doc_id % 13 <> 0 THEN {D0} - 100 + CAST((doc_id * 11) % 365 AS INT) END AS end_date,
  doc_id % 2 = 0 AS auto_renewal, {T0} - to_days(CAST(doc_id % 30 AS INT)) AS created_at
FROM documents JOIN b_tenants ON doc_id % 150 = custkey"""

CTES["b_embeddings"] = """
SELECT vec_id AS chunk_id, 'ORG-' || (vec_id % 5) AS org_id, embedding, CAST(label AS BIGINT) AS label FROM embeddings"""

CTES["b_sales_history"] = """
SELECT 'ORG-' || (l_suppkey % 5) AS org_id, l_partkey AS sku_id, l_suppkey AS location_id,
  CAST(l_shipdate AS DATE) + 8218 AS sale_date, sum(CAST(l_quantity AS DECIMAL(18,2))) AS qty_sold,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DECIMAL(20,2)) AS revenue_usd
FROM lineitem GROUP BY ALL"""

CTES["b_inventory"] = """
SELECT DISTINCT 'ORG-' || (l_suppkey % 5) AS org_id, l_partkey AS sku_id, l_suppkey AS location_id,
  (l_partkey * 31 + l_suppkey * 7) % 500 AS current_stock FROM lineitem"""

CTES["b_promotions"] = f"""
SELECT p_partkey AS promotion_id, p_name AS name, {D0} - 30 AS start_date, {D0} AS end_date, CAST(p_size AS BIGINT) AS discount_pct,
  CAST(p_retailprice AS DECIMAL(18,2)) AS cost_usd FROM part"""

CTES["b_equipment"] = f"""
SELECT 'ORG-' || (p_partkey % 5) AS org_id, 'EQ-' || p_partkey AS equipment_id, p_brand AS plant_id,
  168 - p_size AS uptime_hours, CASE WHEN p_partkey % 113 = 0 THEN 0 ELSE 168 END AS planned_hours,
  1000 - p_size * 5 AS actual_units, 1000 AS ideal_units,
  CASE WHEN p_partkey % 101 = 0 THEN 0 ELSE 1000 - p_size * 5 - p_partkey % 60 END AS good_units,
  CASE WHEN p_partkey % 101 = 0 THEN 0 ELSE 1000 - p_size * 5 END AS total_units,
  50 + p_partkey % 200 AS mtbf_hours, CAST(1 + p_size % 12 AS BIGINT) AS mttr_hours,
  CASE WHEN p_partkey % 7 <> 0 THEN 90 END AS maintenance_interval_days,
  {D0} - CAST(p_partkey % 150 AS INT) AS last_maintenance_date, p_partkey % 37 <> 0 AS is_active FROM part"""

CTES["b_network_events"] = """
SELECT customer_id, org_id, CAST(ts AS DATE) AS event_date,
  CAST(sum(CAST(value AS DECIMAL(12,2))) / count(*) AS DECIMAL(18,6)) AS avg_latency_ms,
  CAST(count(*) FILTER (event_type = 'error') / count(*) AS DECIMAL(18,6)) AS avg_packet_loss_pct,
  CAST(count(*) FILTER (event_type = 'error') / 10 AS DECIMAL(18,6)) AS avg_downtime_hours,
  count(*) FILTER (event_type = 'error') AS complaints_30d
FROM events JOIN b_tenants ON user_id = custkey GROUP BY ALL"""

CTES["b_property_performance"] = """
SELECT 'ORG-' || (l_suppkey % 5) AS org_id, l_suppkey AS property_id, performance_date, occ AS occupancy_rate, adr AS adr_usd,
  CAST(occ * adr * 0.01 AS DECIMAL(14,2)) AS revpar_usd,
  CAST(CAST(occ * adr * 0.01 AS DECIMAL(14,2)) * 1.2 AS DECIMAL(14,2)) AS trevpar_usd,
  ancillary_revenue, CAST(cancel AS DECIMAL(10,2)) AS cancellation_rate, CAST(qty * 0.1 AS DECIMAL(10,2)) AS avg_los_nights
FROM (
  SELECT l_suppkey, CAST(l_shipdate AS DATE) + 8218 AS performance_date,
    CAST(CAST(sum(CAST(l_discount AS DECIMAL(4,2))) / count(*) AS DECIMAL(18,6)) * 500 + 50 AS DECIMAL(10,2)) AS occ,
    CAST(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) / count(*) AS DECIMAL(18,6)) * 0.01 AS DECIMAL(12,2)) AS adr,
    CAST(sum(CAST(l_tax AS DECIMAL(4,2)) * CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(20,2)) AS ancillary_revenue,
    CAST(count(*) FILTER (l_returnflag = 'R') * 100 / count(*) AS DECIMAL(18,6)) AS cancel,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) / count(*) AS DECIMAL(18,6)) AS qty
  FROM lineitem GROUP BY 1, 2)"""

CTES["b_approvals"] = f"""
SELECT 'APR-' || o_orderkey AS approval_id, org_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'send_offer' WHEN 1 THEN 'apply_discount' ELSE 'escalate' END AS action_type,
  customer_id AS target_entity_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level,
  {T0} - INTERVAL 4 DAYS + to_hours(o_orderkey % 96) AS created_at
FROM orders JOIN b_tenants ON o_custkey = custkey"""

CTES["b_approval_events"] = f"""
SELECT 'APR-' || o_orderkey AS approval_id, CASE WHEN o_orderkey % 3 = 2 THEN 'comment' WHEN (o_orderkey % 3 + v) % 2 = 0 THEN 'approve' ELSE 'reject' END AS action,
  'mgr-' || (o_orderkey % 5) AS actor, 'reason ' || v AS reason,
  {T0} - INTERVAL 4 DAYS + to_hours(o_orderkey % 96) + to_hours((o_orderkey * 7) % 60 + v * 5) AS ev_at
FROM orders, (VALUES (0), (1)) AS versions(v)"""

CTES["b_model_log"] = """
SELECT 'model-' || m AS model_name, '1.' || (day(run_date) % 2) AS model_version, run_date, metric_name, metric_value,
  CASE WHEN day(run_date) % 3 = 0 THEN 'test' ELSE 'production' END AS dataset_split, CAST(run_date AS TIMESTAMP) AS created_at
FROM (
  SELECT user_id % 3 AS m, CAST(ts AS DATE) AS run_date,
    CAST(count(*) FILTER (event_type <> 'error') / count(*) AS DECIMAL(18,6)) AS accuracy,
    CAST(sum(CAST(value AS DECIMAL(12,2))) / count(*) AS DECIMAL(18,6)) AS mape
  FROM events GROUP BY 1, 2) UNPIVOT (metric_value FOR metric_name IN (accuracy, mape))"""

CTES["b_contract_texts"] = """
SELECT 'TXT-' || o_orderkey AS document_id, org_id, CASE k % 3 WHEN 0 THEN 'contract' WHEN 1 THEN 'sla' ELSE 'amendment' END AS document_type,
  CASE WHEN k % 7 = 3 THEN 'scanned page without a text layer' ELSE
    'Service agreement between ' || name || ', and Vendor ' || (k % 50) || '.' || chr(10) || 'Effective date: ' || strftime(d, '%Y-%m-%d')
    || '. Expiration date: ' || CASE WHEN k % 6 = 0 THEN '2024-13-45' ELSE strftime(d + 730, '%Y-%m-%d') END || '.' || chr(10)
    || 'Total value: ' || CASE WHEN k % 3 = 0 THEN 'EUR' ELSE 'USD' END || ' ' || CAST(o_totalprice AS DECIMAL(18,2))
    || '. Payment terms: net ' || ((k % 4 + 1) * 15) || ' days.'
    || CASE k % 4 WHEN 0 THEN ' The contract renews automatically.' WHEN 1 THEN ' The contract renews automatically with notice of ' || (k % 90 + 1) || ' days.'
         WHEN 2 THEN ' The contract does not renew.' ELSE '' END
    || ' This contract is governed by the laws of ' || region || '.'
    || CASE WHEN k % 5 = 0 THEN ' Uptime of 99.5% with a response target and a resolution target; availability is reported.' ELSE '' END
    || CASE WHEN k % 11 = 0 THEN ' The vendor accepts unlimited liability.' ELSE '' END END AS extracted_text
FROM (SELECT *, o_orderkey AS k, CAST(o_orderdate AS DATE) + 8218 AS d FROM orders)
JOIN b_tenants ON o_custkey = custkey JOIN b_customers USING (customer_id, org_id)"""

CTES["b_status_events"] = """
SELECT event_id, 'REC-' || user_id AS recommendation_id,
  CASE event_type WHEN 'click' THEN 'in_progress' WHEN 'view' THEN 'snoozed' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'dismissed' ELSE 'archived' END AS new_status,
  'user-' || (event_id % 9) AS acted_by, ts AS ev_at FROM events"""

CTES["b_prompt_log"] = f"""
SELECT 'P-' || q.conv_id || '-' || q.turn AS log_id, 'SES-' || q.conv_id AS session_id, org_id, 'user-' || (q.conv_id % 20) AS user_name,
  CASE q.conv_id % 3 WHEN 0 THEN 'customer' WHEN 1 THEN 'document' ELSE 'operations' END AS agent_id, q.text AS prompt, a.text AS answer,
  (q.conv_id * 7 + q.turn * 13) % 900 AS tokens_used, (q.conv_id * 31 + q.turn * 17) % 2000 AS latency_ms,
  {T0} - to_days(CAST(q.conv_id % 10 AS INT)) - to_hours(q.turn) AS created_at
FROM conversations q JOIN b_tenants ON q.conv_id = custkey
LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role <> 'user' WHERE q.role = 'user'"""

CTES["b_quality_results"] = """
SELECT org_id, 'product_events' AS table_name, metric_name, metric_value, CASE WHEN metric_name = 'error_rate' THEN 20.0 ELSE 1.0 END::DOUBLE AS threshold,
  CASE WHEN metric_name = 'volume' THEN 'PASS' WHEN metric_value <= 20 THEN 'PASS' WHEN metric_value <= 40 THEN 'WARN' ELSE 'FAIL' END AS status, measured_at
FROM (SELECT org_id, date_trunc('hour', ts) AS measured_at, round(count(*) FILTER (event_type = 'error') * 100 / count(*), 2) AS error_rate,
    count(*)::DOUBLE AS volume FROM events JOIN b_tenants ON user_id = custkey GROUP BY 1, 2) UNPIVOT (metric_value FOR metric_name IN (error_rate, volume))"""

CTES["b_products"] = """
SELECT 'PROD-' || p_partkey AS product_id, p_name AS product_name, p_type AS product_category, CAST(p_retailprice AS DECIMAL(18,2)) AS unit_price,
  p_partkey % 5 <> 0 AS is_active FROM part"""

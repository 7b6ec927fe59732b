"""Data quality, governance and workflow queries."""

import uuid

from pyspark.sql import functions as F

from tenantlens.functions import masks as mk
from tenantlens.functions.columns import ago, ts
from tenantlens.operators import documents as doc, governance as gv, quality as dq, workflow as wf
from tenantlens.plans import revenue as rv
from tenantlens.registry.core import define, query
from tenantlens.registry.oracle_tables import D0, T0
from tenantlens.registry.profile import c360
from tenantlens.settings import AS_OF, checkpoint_root
from tenantlens.sources import sinks
from tenantlens.streaming import approvals as sa, jobs

# -- data quality ----------------------------------------------------------------


@query("n1_null_count", "SELECT count(*) FILTER (email IS NULL) AS null_email, count(*) FILTER (segment IS NULL) AS null_segment FROM b_customers")
def _(t):
    return t.customers.agg(dq.null_count("email").alias("null_email"), dq.null_count("segment").alias("null_segment"))


@query("n2_duplicate_count", "SELECT count(*) - count(DISTINCT l_orderkey) AS duplicate_orders FROM lineitem")
def _(t):
    return t.raw("lineitem").agg(dq.duplicate_count("l_orderkey").alias("duplicate_orders"))


@query("n3_freshness", f"SELECT org_id, date_diff('hour', max(occurred_at), {T0}) AS hours_old FROM b_product_events GROUP BY 1")
def _(t):
    return t.product_events.groupBy("org_id").agg(dq.freshness_hours("occurred_at").alias("hours_old"))


def _rule(table, metric, value, threshold, status):
    return f"SELECT org_id, '{table}' AS table_name, '{metric}' AS metric_name, v AS metric_value, {threshold}::DOUBLE AS threshold, {status} AS status FROM (SELECT org_id, {value}::DOUBLE AS v FROM {{src}} GROUP BY org_id)"


_SOFT = "CASE WHEN v <= {0} THEN 'PASS' WHEN v <= 2 * {0} THEN 'WARN' ELSE 'FAIL' END"
_MAX = "CASE WHEN v <= 0 THEN 'PASS' ELSE 'FAIL' END"


@query("n4_quality_rules", " UNION ALL ".join([
    _rule("customers", "null_rate_email", "round(count(*) FILTER (email IS NULL) * 100 / count(*), 2)", 5, _SOFT.format(5)).format(src="b_customers"),
    _rule("customers", "null_rate_nps", "round(count(*) FILTER (nps_score IS NULL) * 100 / count(*), 2)", 30, _SOFT.format(30)).format(src="b_customers"),
    _rule("customers", "duplicate_customer_ids", "(count(*) - count(DISTINCT customer_id))", 0, _MAX).format(src="b_customers"),
    _rule("customers", "active_customer_count", "count(*) FILTER (lifecycle_stage = 'active')", 1, "CASE WHEN v >= 1 THEN 'PASS' ELSE 'FAIL' END").format(src="b_customers"),
    _rule("customer_360", "invalid_health_score", "count(*) FILTER (health_score < 0 OR health_score > 100)", 0, _MAX).format(src="m_c360"),
    _rule("recommendations", "null_rec_text", "count(*) FILTER (recommendation_text IS NULL)", 0, _MAX).format(src="b_recommendations"),
    _rule("churn_scores", "stale_churn_scores", f"count(*) FILTER (scored_at < {T0} - INTERVAL 48 HOURS)", 0, _MAX).format(src="b_churn_scores"),
]))
def _(t):
    tables = {"customers": t.customers, "customer_360": c360(t), "recommendations": t.recommendations, "churn_scores": t.churn_scores}
    return dq.run_rules(tables, dq.standard_rules(), by=["org_id"])


@query("n5_daily_checks", f"""
SELECT org_id, 'customers' AS table_name, 'freshness_hours' AS metric_name, date_diff('hour', max(updated_at), {T0})::DOUBLE AS metric_value, 24::DOUBLE AS threshold,
  CASE WHEN date_diff('hour', max(updated_at), {T0}) <= 24 THEN 'PASS' ELSE 'FAIL' END AS status FROM b_customers GROUP BY 1
UNION ALL SELECT org_id, 'transactions', 'row_count_delta_pct', v, 20, CASE WHEN v <= 20 THEN 'PASS' ELSE 'WARN' END FROM (
  SELECT org_id, round(abs(count(*) FILTER (transaction_date = {D0}) - count(*) FILTER (transaction_date = {D0} - 1)) / nullif(count(*) FILTER (transaction_date = {D0} - 1), 0) * 100, 2) AS v
  FROM b_transactions WHERE transaction_date IN ({D0}, {D0} - 1) GROUP BY 1)""")
def _(t):
    return dq.daily_checks(t.customers, t.transactions)


@query("n6_mart_lag", f"""
SELECT *, date_diff('minute', newest, {T0}) AS lag_minutes, CASE WHEN date_diff('hour', newest, {T0}) > 2 THEN 'FAIL' ELSE 'PASS' END AS status FROM (
  SELECT 'customers' AS table_name, max(updated_at) AS newest FROM b_customers
  UNION ALL SELECT 'feature_usage', max(date_trunc('hour', occurred_at)) FROM b_product_events
  UNION ALL SELECT 'revenue_by_month', max(CAST(date_trunc('month', transaction_date) AS TIMESTAMP)) FROM b_transactions)""", times="newest")
def _(t):
    from tenantlens.plans.usage import feature_usage
    return dq.mart_lag({"customers": (t.customers, "updated_at"), "feature_usage": (feature_usage(t.raw_product_events), "event_hour"),
                        "revenue_by_month": (rv.revenue_by_month(t.transactions), "month")})


@query("n7_latest_results", """
SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY org_id, table_name, metric_name ORDER BY measured_at DESC) AS rn FROM b_quality_results) WHERE rn = 1""", times="measured_at")
def _(t):
    return dq.latest_results(t.quality_results)


@query("n7_hourly_history", f"""
SELECT org_id, measured_at AS hour, count(*) AS total_checks, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'WARN') AS warned,
  count(*) FILTER (status = 'FAIL') AS failed FROM b_quality_results WHERE measured_at >= {T0} - INTERVAL 7 DAYS GROUP BY 1, 2""", times="hour")
def _(t):
    return dq.hourly_history(t.quality_results)


@query("n7_staleness", f"""
SELECT org_id, table_name, m AS minutes_stale, row_count, CASE WHEN m <= 60 THEN 'PASS' WHEN m <= 240 THEN 'WARN' ELSE 'FAIL' END AS status
FROM (SELECT org_id, table_name, date_diff('minute', max(measured_at), {T0}) AS m, count(*) AS row_count FROM b_quality_results GROUP BY 1, 2)""")
def _(t):
    return dq.staleness(t.quality_results)


TESTS = [
    dq.ColumnTest("ticket_id", "unique"), dq.ColumnTest("ticket_id", "not_null"), dq.ColumnTest("customer_id", "not_null"),
    dq.ColumnTest("resolved_at", "not_null", severity="warn"), dq.ColumnTest("status", "accepted_values", ("open", "resolved")),
    dq.ColumnTest("priority", "accepted_values", ("low", "medium", "high", "urgent")), dq.ColumnTest("sentiment_score", "accepted_range", (-0.5, 1)),
]


@query("n8_column_tests", """
SELECT 'tickets' AS table_name, *, CASE WHEN failures = 0 THEN 'PASS' WHEN severity = 'warn' THEN 'WARN' ELSE 'FAIL' END AS status FROM (
  SELECT 'ticket_id' AS column_name, 'unique' AS test, 'error' AS severity, (SELECT count(*) FROM (SELECT ticket_id FROM b_tickets GROUP BY 1 HAVING count(*) > 1)) AS failures
  UNION ALL SELECT 'ticket_id', 'not_null', 'error', count(*) FILTER (ticket_id IS NULL) FROM b_tickets
  UNION ALL SELECT 'customer_id', 'not_null', 'error', count(*) FILTER (customer_id IS NULL) FROM b_tickets
  UNION ALL SELECT 'resolved_at', 'not_null', 'warn', count(*) FILTER (resolved_at IS NULL) FROM b_tickets
  UNION ALL SELECT 'status', 'accepted_values', 'error', count(*) FILTER (status NOT IN ('open', 'resolved')) FROM b_tickets
  UNION ALL SELECT 'priority', 'accepted_values', 'error', count(*) FILTER (priority NOT IN ('low', 'medium', 'high', 'urgent')) FROM b_tickets
  UNION ALL SELECT 'sentiment_score', 'accepted_range', 'error', count(*) FILTER (sentiment_score < -0.5 OR sentiment_score > 1) FROM b_tickets)""")
def _(t):
    return dq.check(t.tickets, TESTS, "tickets")


@query("n9_orphans", "SELECT count(*) AS orphan_rows FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return dq.orphans(t.raw("documents"), t.raw("labels"), "doc_id")


@query("n10_source_freshness", f"""
SELECT *, CASE WHEN hours_old > 48 THEN 'ERROR' WHEN hours_old > 24 THEN 'WARN' ELSE 'PASS' END AS status FROM (
  SELECT 'customers' AS source, date_diff('hour', max(updated_at), {T0}) AS hours_old FROM b_customers
  UNION ALL SELECT 'product_events', date_diff('hour', max(occurred_at), {T0}) FROM b_product_events
  UNION ALL SELECT 'subscriptions', date_diff('hour', max(created_at), {T0}) FROM b_subscriptions)""")
def _(t):
    return dq.source_freshness({"customers": (t.customers, "updated_at"), "product_events": (t.product_events, "occurred_at"), "subscriptions": (t.subscriptions, "created_at")})


# -- governance --------------------------------------------------------------------
_MASK = {
    "g1_mask_email": ("email", mk.mask_email, "regexp_replace(email, '(^[^@]{1,2})[^@]*(@.*)', '\\1***\\2')"),
    "g2_mask_phone": ("phone", mk.mask_phone, "regexp_replace(phone, '(\\d{2})(\\d+)(\\d{2})', '\\1****\\3', 'g')"),
    "g3_mask_name": ("name", mk.mask_name, "split_part(name, ' ', 1) || ' ****'"),
}
for key, (column, mask, sql) in _MASK.items():
    query(key, f"SELECT customer_id, {sql} AS masked FROM b_customers")(
        lambda t, column=column, mask=mask: t.customers.select("customer_id", mask(column).alias("masked")))


@query("g4_redact_text", f"SELECT interaction_id, CASE WHEN body IS NOT NULL THEN '{mk.TEXT_MASK}' END AS body, '{mk.PATIENT_MASK}' AS patient_id FROM b_interactions")
def _(t):
    return t.interactions.select("interaction_id", mk.mask_text("body").alias("body"), mk.mask_patient_id("customer_id").alias("patient_id"))


@query("g5_apply_masks", f"""
SELECT customer_id, org_id, {_MASK['g3_mask_name'][2]} AS name, {_MASK['g1_mask_email'][2]} AS email, {_MASK['g2_mask_phone'][2]} AS phone, segment FROM b_customers""")
def _(t):
    return gv.apply_masks(t.customers.select("customer_id", "org_id", "name", "email", "phone", "segment"), "customers", "ANALYST")


@query("g6_tenant_filter", "SELECT customer_id, org_id, arr FROM b_customers WHERE org_id IN (SELECT org_id FROM b_user_org_map WHERE user_name = 'nation_3')", nums="arr")
def _(t):
    return gv.tenant_filter(t.customers.select("customer_id", "org_id", "arr"), t.user_org_map, "nation_3")


@query("g6_visible_rows", """
SELECT user_name, role, CASE WHEN role = 'ADMIN' THEN (SELECT count(*) FROM b_customers) ELSE coalesce(n, 0) END AS visible
FROM b_user_org_map LEFT JOIN (SELECT org_id, count(*) AS n FROM b_customers GROUP BY 1) c USING (org_id)""")
def _(t):
    return gv.visible_rows(t.customers, t.user_org_map)


# Written out again, so that a wrong pattern in the package shows.
_PAT = {
    "email": r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z.]+",
    "phone": r"(^|[^0-9])[0-9]{10,13}([^0-9]|$)",
    "ip": r"(^|[^0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}([^0-9.]|$)",
}
define("m_pii_scan", " UNION ALL ".join(
    f"SELECT 'customers' AS table_name, '{c}' AS column_name, count({c}) AS non_null, " + ", ".join(
        f"count(*) FILTER (regexp_matches({c}, '{p}')) AS {k}_hits" for k, p in _PAT.items()) + " FROM b_customers"
    for c in ("name", "email", "phone", "segment", "region")))
define("m_pii", "SELECT *, CASE " + " ".join(f"WHEN {k}_hits > non_null * 0.5 THEN '{k}'" for k in _PAT) + " ELSE 'none' END AS detected FROM m_pii_scan")


def scan(t):
    return gv.classify_columns(t.customers.select("name", "email", "phone", "segment", "region"), "customers")


@query("g8_classify_columns", "SELECT * FROM m_pii")
def _(t):
    return scan(t)


@query("g8_classify_documents", "SELECT 'documents' AS table_name, 'extracted_text' AS column_name, count(extracted_text) AS non_null, " + ", ".join(
    f"count(*) FILTER (regexp_matches(extracted_text, '{p}')) AS {k}_hits" for k, p in _PAT.items()) + ", 'none' AS detected FROM b_documents")
def _(t):
    return gv.classify_columns(t.documents.select("extracted_text"), "documents")


@query("g7_pii_inventory", """
SELECT *, detected <> 'none' AND pii_level = 'NONE' AS untagged_hit FROM (SELECT *, CASE WHEN column_name IN ('name', 'email', 'phone') THEN 'DIRECT' ELSE 'NONE' END AS pii_level,
  CASE WHEN column_name IN ('email', 'phone') THEN 'LGPD' ELSE '' END AS compliance FROM m_pii)""")
def _(t):
    return gv.pii_inventory(scan(t))


@query("g9_kb_policy", "SELECT doc_id, kb_name, url FROM m_kb WHERE kb_name <> 'release_notes'")
def _(t):
    return gv.kb_policy(doc.kb_documents(t.pages), t.kb_access, "ANALYST").select("doc_id", "kb_name", "url")


# -- workflow ------------------------------------------------------------------------
define("m_closing", """
SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY recommendation_id ORDER BY ev_at, event_id) AS rn FROM b_status_events WHERE new_status IN ('completed', 'dismissed')) WHERE rn = 1""")
define("m_ordinary", """
SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY recommendation_id ORDER BY ev_at DESC, event_id DESC) AS rn FROM b_status_events
  WHERE new_status IN ('pending', 'in_progress', 'snoozed')) WHERE rn = 1""")


@query("w1_apply_status_events", """
SELECT r.recommendation_id, r.org_id, CASE WHEN r.is_active THEN coalesce(c.new_status, o.new_status, r.status) ELSE r.status END AS status,
  CASE WHEN r.is_active THEN c.ev_at END AS acted_at, r.is_active AND c.ev_at IS NULL AS is_active
FROM b_recommendations r LEFT JOIN m_closing c ON r.recommendation_id = c.recommendation_id LEFT JOIN m_ordinary o ON r.recommendation_id = o.recommendation_id""", times="acted_at")
def _(t):
    return wf.apply_status_events(t.recommendations, t.status_events).select("recommendation_id", "org_id", "status", "acted_at", "is_active")


@query("w1_action_log", """
SELECT r.org_id, e.acted_by AS user_name, 'recommendation_' || e.new_status AS action_type, 'recommendation' AS object_type, e.recommendation_id AS object_id,
  e.ev_at AS created_at, e.event_id
FROM b_status_events e JOIN b_recommendations r ON e.recommendation_id = r.recommendation_id LEFT JOIN m_closing c ON e.recommendation_id = c.recommendation_id
WHERE r.is_active AND e.new_status <> 'archived' AND (c.ev_at IS NULL OR e.ev_at < c.ev_at OR (e.ev_at = c.ev_at AND e.event_id <= c.event_id))""", times="created_at")
def _(t):
    return wf.action_log(t.recommendations, t.status_events)


define("m_decisions", f"""
SELECT * EXCLUDE rn FROM (SELECT e.*, row_number() OVER (PARTITION BY e.approval_id ORDER BY ev_at, action) AS rn
  FROM b_approval_events e JOIN b_approvals q ON e.approval_id = q.approval_id
  WHERE ev_at <= {T0} AND ((action = 'approve' AND ev_at < q.created_at + INTERVAL 48 HOURS) OR (action = 'reject' AND ev_at < q.created_at + INTERVAL 49 HOURS))) WHERE rn = 1""")
define("m_approvals", f"""
SELECT q.approval_id, q.org_id, q.action_type, q.target_entity_id, q.risk_level, q.created_at, q.created_at + INTERVAL 48 HOURS AS expires_at,
  CASE WHEN action = 'approve' THEN 'approved' WHEN action = 'reject' THEN 'rejected' WHEN q.created_at + INTERVAL 49 HOURS <= {T0} THEN 'expired' ELSE 'pending' END AS status,
  d.actor AS decided_by, d.ev_at AS decided_at, CASE WHEN action = 'reject' THEN d.reason END AS rejection_reason,
  date_diff('hour', {T0}, q.created_at + INTERVAL 48 HOURS) AS hours_remaining
FROM b_approvals q LEFT JOIN m_decisions d ON q.approval_id = d.approval_id""")


def approvals(t):
    return wf.apply_approval_events(wf.submit(t.approvals), t.approval_events)


@query("w2_approval_lifecycle", "SELECT * FROM m_approvals", times="created_at expires_at decided_at")
def _(t):
    return approvals(t)


@query("w2_approval_stream", "SELECT approval_id, org_id, status, decided_by, decided_at, rejection_reason FROM m_approvals", times="decided_at")
def _(t):
    """The same lifecycle from a stream: three runs with a restart between them, then a tick that moves the watermark to AS_OF."""
    folder = f"{checkpoint_root(t.spark)}/run-{uuid.uuid4().hex}"
    rows = sinks.materialize(sa.feed(t.approvals, t.approval_events).where(F.col("at") <= ts(AS_OF)))
    tick = t.spark.range(1).select(F.lit(sa.TICK).alias("approval_id"), F.lit("tick").alias("kind"), (ts(AS_OF) + F.expr("INTERVAL 2 HOURS 1 MILLISECOND")).alias("at"))
    cuts = [ago(AS_OF, days=3), ago(AS_OF, days=2)]
    parts = [rows.where(F.col("at") < cuts[0]), rows.where((F.col("at") >= cuts[0]) & (F.col("at") < cuts[1])), rows.where(F.col("at") >= cuts[1]), tick]
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/feed")
        events = t.spark.readStream.schema(sa.FEED).parquet(f"{folder}/feed")
        jobs.run(sa.start_approvals(events, f"{folder}/out", f"{folder}/ck"))
    ended = t.spark.read.parquet(f"{folder}/out")
    return t.approvals.select("approval_id", "org_id").join(ended, "approval_id", "left").select(
        "approval_id", "org_id", F.coalesce("status", F.lit("pending")).alias("status"), "decided_by", "decided_at", "rejection_reason")


@query("w2_approval_log", """
SELECT org_id, decided_by AS user_name, CASE WHEN status = 'approved' THEN 'APPROVE' ELSE 'REJECT' END AS action_type, 'APPROVAL_QUEUE' AS entity_type,
  approval_id AS entity_id, decided_at AS created_at FROM m_approvals WHERE decided_at IS NOT NULL""", times="created_at")
def _(t):
    return wf.approval_log(approvals(t))


@query("w3_normalize_audit", """
SELECT log_id, session_id, org_id, user_name, agent_id, prompt AS prompt_text, coalesce(answer, '') AS response_summary,
  tokens_used, latency_ms, created_at FROM b_prompt_log""", times="created_at")
def _(t):
    return wf.normalize_audit(t.prompt_log)

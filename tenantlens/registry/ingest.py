"""Landing, normalisation, CDC, sink and streaming queries."""

import uuid

from pyspark.sql import functions as F

from tenantlens import schemas as sc
from tenantlens.functions.columns import ago, dec, ts
from tenantlens.operators import merge as mg, normalize as no, staging as st
from tenantlens.plans import revenue as rv
from tenantlens.registry.core import define, query
from tenantlens.registry.oracle_tables import D0, T0
from tenantlens.settings import AS_OF, checkpoint_root
from tenantlens.sources import envelopes as en, landing as la, sinks
from tenantlens.streaming import jobs, usage as su


def scratch(t) -> str:
    """A new folder on the shared storage of the session."""
    return f"{checkpoint_root(t.spark)}/run-{uuid.uuid4().hex}"


def event_files(t, df, repeats: bool = True) -> str:
    """Write events as JSON-line files; with ``repeats`` every 20th event arrives twice."""
    path = scratch(t)
    if repeats:
        number = F.regexp_extract("event_id", r"(\d+)$", 1).cast("long")
        copies = F.when(number % 20 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        df = df.withColumn("_copy", F.explode(copies)).drop("_copy")
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)
    return path


define("m_order_versions", """
SELECT o.*, t.org_id, v FROM orders o JOIN b_tenants t ON o_custkey = custkey, (VALUES (0), (1), (2), (3)) AS x(v)
WHERE (v = 0 AND o_orderkey % 10 <> 9) OR (v = 1 AND o_orderkey % 10 IN (0, 9)) OR (v = 2 AND o_orderkey % 100 = 0) OR (v = 3 AND o_orderkey % 50 = 5)""")
define("m_customer_versions", """
SELECT c.*, t.org_id, v FROM customer c JOIN b_tenants t ON c_custkey = custkey, (VALUES (0), (1), (2), (3)) AS x(v)
WHERE (v = 0 AND c_custkey % 10 <> 9) OR (v = 1 AND c_custkey % 10 IN (0, 9)) OR (v = 2 AND c_custkey % 100 = 0) OR (v = 3 AND c_custkey % 50 = 5)""")

# -- batch sources -------------------------------------------------------------
_EVENTS = """SELECT event_id, org_id, customer_id, user_id, session_id, event_type, date_trunc('second', occurred_at) AS client_ts, occurred_at AS server_ts
FROM b_product_events"""


def landed_events(t):
    src, out = event_files(t, t.raw_product_events), scratch(t)
    events = la.land_product_events(la.read_event_stream(t.spark, src, sc.RAW_PRODUCT_EVENT))
    jobs.run(jobs.start_landing(events, f"{out}/data", f"{out}/ck"))
    return t.spark.read.parquet(f"{out}/data")


@query("a1_land_product_events", f"""
SELECT * FROM ({_EVENTS}) UNION ALL SELECT * FROM ({_EVENTS}) WHERE CAST(event_id[4:] AS INT) % 20 = 0""", times="client_ts server_ts")
def _(t):
    return landed_events(t).drop("event_payload", "_metadata_json")


@query("a2_land_api_usage", """
SELECT * FROM b_api_usage_events UNION ALL SELECT * FROM b_api_usage_events WHERE CAST(event_id[4:] AS INT) % 20 = 0""", times="request_ts")
def _(t):
    src, out = event_files(t, t.api_usage_events), scratch(t)
    jobs.run(jobs.start_landing(la.read_event_stream(t.spark, src, sc.API_USAGE_EVENT), f"{out}/data", f"{out}/ck"))
    return t.spark.read.parquet(f"{out}/data").drop("_metadata_json")


@query("a3_land_health_events", """
SELECT * FROM b_health_score_events UNION ALL SELECT * FROM b_health_score_events WHERE CAST(event_id[4:] AS INT) % 20 = 0""",
       times="event_ts", nums="score_delta new_score")
def _(t):
    src, out = event_files(t, t.health_score_events), scratch(t)
    jobs.run(jobs.start_landing(la.read_event_stream(t.spark, src, sc.HEALTH_SCORE_EVENT), f"{out}/data", f"{out}/ck"))
    return t.spark.read.parquet(f"{out}/data").drop("_metadata_json")


@query("a4_copy_customers", """
SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS name, c_mktsegment AS segment, CAST(c_acctbal AS DECIMAL(18,2)) AS balance FROM customer""", nums="balance")
def _(t):
    return la.copy_customers(t.raw("customer"), {
        "customer_id": F.col("c_custkey").cast("string"), "name": F.col("c_name"), "segment": F.col("c_mktsegment"), "balance": dec("c_acctbal")})


@query("a5_envelope_load", f"""
SELECT 'ORG-' || n_regionkey AS org_id, CAST(c_custkey AS VARCHAR) AS id, c_name AS name, {T0} - to_hours(1) AS loaded_at
FROM customer JOIN nation ON c_nationkey = n_nationkey""", times="loaded_at")
def _(t):
    rows = t._with_tenant(t.raw("customer"), "c_custkey")
    env = en.to_envelope(rows, "org_id", ago(AS_OF, hours=1), F.struct("c_custkey", "c_name"))
    v = F.try_parse_json("raw_data")
    return env.select("org_id", F.variant_get(v, "$.c_custkey", "string").alias("id"), F.variant_get(v, "$.c_name", "string").alias("name"), "loaded_at")


@query("a14_check_contract", """
SELECT 'customers' AS table_name, false AS valid, 'tax_id' AS missing_columns, count(*) AS row_count,
  'customer_id=' || count(*) FILTER (customer_id IS NULL) || '|email=' || count(*) FILTER (email IS NULL) || '|nps_score=' || count(*) FILTER (nps_score IS NULL) AS null_counts
FROM b_customers""")
def _(t):
    return la.check_contract(t.customers, ["CUSTOMER_ID", "email", "NPS_score", "tax_id"], "customers")


@query("a15_run_summary", f"""
SELECT org_id, 'sap_customers' AS source, count(*) FILTER (v <> 3) AS rows_loaded, count(*) FILTER (v = 3) AS rows_failed,
  CASE WHEN count(*) FILTER (v = 3) = 0 THEN 'success' WHEN count(*) FILTER (v <> 3) > 0 THEN 'partial' ELSE 'failed' END AS status,
  {T0} - to_hours(CASE WHEN max(CASE WHEN v = 2 THEN 1 END) = 1 THEN 1 ELSE 2 END) AS loaded_at FROM m_customer_versions GROUP BY org_id""", times="loaded_at")
def _(t):
    env = en.envelopes(t, "sap_customers")
    ok = F.try_variant_get(F.try_parse_json("raw_data"), "$.CustomerID", "string").isNotNull()
    return la.run_summary(env, "sap_customers", ok)


@query("a15_observed_load", """
SELECT 'sap_customers' AS source, count(*) FILTER (v <> 3) AS rows_loaded, count(*) FILTER (v = 3) AS rows_failed, 'partial' AS status
FROM m_customer_versions""")
def _(t):
    ok = F.try_variant_get(F.try_parse_json("raw_data"), "$.CustomerID", "string").isNotNull()
    return la.load_observed(en.envelopes(t, "sap_customers"), scratch(t), "sap_customers", ok).drop("loaded_at")


@query("a5_envelope_files", f"""
SELECT 'ORG-0' AS org_id, CAST(c_custkey AS VARCHAR) AS id, c_name AS name, {T0} - to_hours(1) AS loaded_at FROM customer""", times="loaded_at")
def _(t):
    """Payloads written as line-delimited JSON and read back untouched."""
    path = scratch(t)
    t.raw("customer").select(F.to_json(F.struct("c_custkey", "c_name")).alias("value")).write.text(path)
    v = F.try_parse_json("raw_data")
    return en.read_envelopes(t.spark, path, "ORG-0", ago(AS_OF, hours=1)).select(
        "org_id", F.variant_get(v, "$.c_custkey", "string").alias("id"), F.variant_get(v, "$.c_name", "string").alias("name"), "loaded_at")


# -- normalisers ---------------------------------------------------------------
define("m_desk", f"""
SELECT CAST(o_orderkey AS VARCHAR) AS ticket_id, org_id, CAST(o_custkey AS VARCHAR) AS customer_id,
  'Order ' || o_orderkey || ' ' || repeat('x', CAST(o_orderkey % 700 AS INT)) AS subject,
  CASE WHEN v > 0 OR o_orderkey % 7 IN (4, 5) THEN 'resolved' ELSE 'open' END AS status,
  CASE o_orderkey % 5 WHEN 0 THEN 'low' WHEN 2 THEN 'high' WHEN 3 THEN 'critical' ELSE 'medium' END AS priority,
  o_orderkey % 4 <> 0 AND o_orderkey % 3 = 0 AS sla_breached, o_orderdate AS created_at,
  {T0} - to_hours(CASE v WHEN 0 THEN 3 WHEN 2 THEN 1 ELSE 2 END) AS loaded_at
FROM m_order_versions WHERE v <> 3""")


@query("b8_support_tickets", "SELECT * FROM m_desk", times="created_at loaded_at")
def _(t):
    return no.support_tickets(en.support_tickets(t))


@query("b13_latest_tickets", """
SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY org_id, ticket_id ORDER BY loaded_at DESC) AS rn FROM m_desk) WHERE rn = 1""",
       times="created_at loaded_at")
def _(t):
    return no.latest_tickets(en.support_tickets(t))


@query("b9_billing_subscriptions", """
SELECT 'sub_' || o_orderkey AS subscription_id, org_id, 'cus_' || o_custkey AS customer_id, 'plan-0' AS plan_name,
  CASE o_orderkey % 6 WHEN 1 THEN 'trial' WHEN 3 THEN 'cancelled' WHEN 4 THEN 'cancelled' ELSE 'active' END AS status,
  CAST(cents * 0.01 AS DECIMAL(18,2)) AS mrr, CAST(cents * 0.12 AS DECIMAL(18,2)) AS arr, CAST(o_orderdate AS DATE) + 365 AS renewal_date
FROM (SELECT *, CAST(floor(o_totalprice) * (o_orderkey % 3 + 1) + (o_orderkey % 3) * (o_orderkey % 3 + 1) / 2 AS BIGINT) AS cents FROM orders)
JOIN b_tenants ON o_custkey = custkey""", dates="renewal_date", nums="mrr arr")
def _(t):
    return no.billing_subscriptions(en.billing_subscriptions(t))


@query("b10_billing_transactions", """
SELECT 'in_' || o_orderkey AS transaction_id, org_id, 'cus_' || o_custkey AS customer_id, CAST(CAST(floor(o_totalprice * 10) AS BIGINT) * 0.01 AS DECIMAL(18,2)) AS amount,
  CASE WHEN o_orderkey % 3 = 1 THEN 'EUR' ELSE 'USD' END AS currency,
  CASE o_orderkey % 5 WHEN 0 THEN 'new_contract' WHEN 2 THEN 'upsell' ELSE 'renewal' END AS transaction_type, 'completed' AS status,
  CAST(o_orderdate AS DATE) AS transaction_date FROM orders JOIN b_tenants ON o_custkey = custkey WHERE o_orderkey % 4 IN (0, 1)""", dates="transaction_date", nums="amount")
def _(t):
    return no.billing_transactions(en.billing_invoices(t))


@query("b11_staged_subscriptions", """
SELECT 'sub_' || o_orderkey AS external_id, org_id, CASE o_orderkey % 6 WHEN 0 THEN 'active' WHEN 1 THEN 'trialing' WHEN 2 THEN 'past_due'
    WHEN 3 THEN 'canceled' WHEN 4 THEN 'unpaid' ELSE 'unknown' END AS status, CAST(CAST(floor(o_totalprice) AS BIGINT) * 0.01 AS DECIMAL(18,2)) AS mrr,
  CASE WHEN o_orderkey % 2 = 0 THEN 'month' ELSE 'year' END AS billing_interval, o_orderdate AS current_period_start,
  o_orderdate + INTERVAL 365 DAYS AS current_period_end FROM orders JOIN b_tenants ON o_custkey = custkey WHERE o_orderkey % 4 <> 3""",
       times="current_period_start current_period_end", nums="mrr")
def _(t):
    return no.staged_subscriptions(en.billing_subscriptions(t))


@query("b11_staged_transactions", """
SELECT 'in_' || o_orderkey AS external_id, org_id, CAST(CAST(floor(o_totalprice * 10) AS BIGINT) * 0.01 AS DECIMAL(18,2)) AS amount,
  CASE o_orderkey % 3 WHEN 0 THEN 'usd' WHEN 1 THEN 'eur' END AS currency, 'paid' AS status,
  CASE o_orderkey % 5 WHEN 0 THEN 'new_business' WHEN 1 THEN 'renewal' WHEN 2 THEN 'expansion' ELSE 'other' END AS transaction_type,
  o_orderdate AS transaction_date FROM orders JOIN b_tenants ON o_custkey = custkey WHERE o_orderkey % 4 IN (0, 1)""", times="transaction_date", nums="amount")
def _(t):
    return no.staged_transactions(en.billing_invoices(t))


@query("b12_crm_customers", """
SELECT '001' || c_custkey AS customer_id, org_id, c_name AS name, CASE WHEN c_custkey % 5 <> 0 THEN 'b' || c_custkey || '@example.com' ELSE '' END AS email,
  CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment ELSE 'SMB' END AS segment, 'C' || c_nationkey AS region,
  CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment ELSE '' END AS industry, 'active' AS lifecycle_stage, 'salesforce' AS source_system
FROM customer JOIN b_tenants ON c_custkey = custkey""")
def _(t):
    return no.crm_customers(en.crm_accounts(t))


# -- CDC -------------------------------------------------------------------------
def first_load():
    return ago(AS_OF, hours=en.FIRST_LOAD_HOURS)


def merged_feed(t, feed):
    """First load creates the table; the second is read as changes since then and merged."""
    env = en.envelopes(t, feed)
    base = sinks.materialize(no.merge_feed(None, env.filter(F.col("loaded_at") <= first_load()), feed, stamp=first_load()))
    return no.merge_feed(base, mg.changes_since(env, first_load()), feed, stamp=ts(AS_OF))


_VER_C = "CASE WHEN c_custkey % 100 = 0 THEN 2 WHEN c_custkey % 10 IN (0, 9) THEN 1 ELSE 0 END"
_VER_O = "CASE WHEN o_orderkey % 100 = 0 THEN 2 WHEN o_orderkey % 10 IN (0, 9) THEN 1 ELSE 0 END"
_STAMP = f"CASE WHEN v > 0 THEN {T0} ELSE {T0} - to_hours(3) END AS updated_at"
_CUST = f"(SELECT *, {_VER_C} AS v FROM customer JOIN b_tenants ON c_custkey = custkey)"
_ORD = f"(SELECT *, {_VER_O} AS v, CAST(o_totalprice AS DECIMAL(18,2)) + {_VER_O} AS amt, CAST(o_orderdate AS DATE) + 8218 AS d FROM orders JOIN b_tenants ON o_custkey = custkey)"
_EMAIL = "lower(replace(c_name, '#', '.')) || '@example.com' AS email"
for feed, prefix in (("sap_customers", "SAP-"), ("oracle_customers", "ORCL-")):
    query(f"k2_merge_{feed}", f"SELECT '{prefix}' || c_custkey AS customer_id, org_id, c_name || ' v' || v AS name, {_EMAIL}, {_STAMP} FROM {_CUST}",
          times="updated_at")(lambda t, feed=feed: merged_feed(t, feed))
query("k2_merge_hubspot_contacts", f"""SELECT 'HS-' || c_custkey AS customer_id, org_id, CASE WHEN c_custkey % 3 <> 0 THEN c_name || ' v' || v ELSE 'v' || v END AS name,
  {_EMAIL}, {_STAMP} FROM {_CUST}""", times="updated_at")(lambda t: merged_feed(t, "hubspot_contacts"))
query("k2_merge_hubspot_companies", f"""SELECT 'HS-' || c_custkey AS account_id, org_id, c_name || ' v' || v AS account_name, c_mktsegment AS industry,
  c_custkey % 1000 + v AS employee_count, CAST(abs(c_acctbal) * 100 AS DECIMAL(18,2)) AS annual_revenue, 'www' || c_custkey || '.example.com' AS website, {_STAMP}
  FROM {_CUST}""", times="updated_at", nums="annual_revenue")(lambda t: merged_feed(t, "hubspot_companies"))
for feed, prefix, kind, currency in (("sap_invoices", "SAP-", "invoice", True), ("sap_orders", "SAP-", "order", True),
                                     ("oracle_orders", "ORCL-", "order", False), ("oracle_invoices", "ORCL-", "invoice", False),
                                     ("hubspot_deals", "HS-", "deal", False)):
    query(f"k2_merge_{feed}", f"""SELECT '{prefix}' || o_orderkey AS transaction_id, org_id, amt AS amount, d AS transaction_date,
      {"'EUR' AS currency," if currency else ""} '{prefix}' || o_custkey AS customer_id, '{kind}' AS transaction_type, 'completed' AS status, {_STAMP} FROM {_ORD}""",
          dates="transaction_date", times="updated_at", nums="amount")(lambda t, feed=feed: merged_feed(t, feed))


@query("b14_cdc_projection", f"""
SELECT 'HS-' || o_orderkey AS transaction_id, org_id, CAST(o_totalprice AS DECIMAL(18,2)) + v AS amount, CAST(o_orderdate AS DATE) + 8218 AS transaction_date,
  'HS-' || o_custkey AS customer_id, 'deal' AS transaction_type, {T0} - to_hours(CASE v WHEN 0 THEN 3 WHEN 2 THEN 1 ELSE 2 END) AS loaded_at
FROM m_order_versions WHERE v <> 3""", dates="transaction_date", times="loaded_at", nums="amount")
def _(t):
    return no.project(en.envelopes(t, "hubspot_deals"), "hubspot_deals")


@query("k6_empty_stream_is_skipped", "SELECT count(*) AS events, count(DISTINCT event_id) AS ids FROM b_health_score_events")
def _(t):
    """The second run on the same checkpoint finds no new file and adds nothing."""
    src, out = event_files(t, t.health_score_events, repeats=False), scratch(t)
    for _run in range(2):
        jobs.run(jobs.start_landing(la.read_event_stream(t.spark, src, sc.HEALTH_SCORE_EVENT), f"{out}/data", f"{out}/ck"))
    return t.spark.read.parquet(f"{out}/data").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("event_id").alias("ids"))


@query("l6_backfill_late_days", f"""
SELECT org_id, CAST(request_ts AS DATE) AS usage_date, model_name, count(*) AS api_calls FROM b_api_usage_events GROUP BY 1, 2, 3""", dates="usage_date")
def _(t):
    """Days before the window keep the streamed figures; the last week is recomputed with the late events."""
    import datetime as dt
    since = F.lit((AS_OF - dt.timedelta(days=7)).date())
    keys = ["org_id", F.to_date("request_ts").alias("usage_date"), "model_name"]
    late = (F.col("request_ts") >= ago(AS_OF, days=7)) & F.col("event_id").endswith("3")
    on_time = t.api_usage_events.filter(~late).groupBy(*keys).agg(F.count(F.lit(1)).alias("api_calls"))
    everything = t.api_usage_events.filter(F.col("request_ts") >= ago(AS_OF, days=7)).groupBy(*keys).agg(F.count(F.lit(1)).alias("api_calls"))
    return mg.replace_window(on_time, everything, "usage_date", since)


@query("k1_changes_since", f"SELECT org_id, count(*) AS n FROM m_customer_versions WHERE v > 0 GROUP BY org_id")
def _(t):
    return mg.changes_since(en.envelopes(t, "sap_customers"), first_load()).groupBy("org_id").agg(F.count(F.lit(1)).alias("n"))


@query("k3_merge_rejects", """
SELECT count(*) FILTER (v = 2) AS duplicate_rows, count(*) FILTER (v = 3) AS null_key_rows FROM m_order_versions WHERE v > 0""")
def _(t):
    env = mg.changes_since(en.envelopes(t, "sap_orders"), first_load())
    rows = env.select(F.try_variant_get(F.try_parse_json("raw_data"), "$.OrderID", "string").alias("id"))
    return mg.rejected(rows, ["id"])


@query("k4_insert_absent", """
SELECT 'SAP-' || c_custkey AS customer_id, c_name || ' v' || CASE WHEN c_custkey % 10 = 9 THEN 1 ELSE 0 END AS name FROM customer""")
def _(t):
    env = en.envelopes(t, "sap_customers")
    base = no.project(env.filter(F.col("loaded_at") <= first_load()), "sap_customers")
    later = no.project(mg.changes_since(env, first_load()), "sap_customers")
    return mg.insert_absent(base, later, ["customer_id", "org_id"]).select("customer_id", "name")


@query("k5_trailing_reprocess", f"""
SELECT org_id, transaction_date AS revenue_date, sum(amount) * CASE WHEN transaction_date >= {D0} - 900 THEN 1 ELSE 0 END AS total_revenue_booked
FROM b_transactions WHERE status = 'completed' GROUP BY 1, 2""", dates="revenue_date", nums="total_revenue_booked")
def _(t):
    """Stored days are zero; the trailing window is recomputed from late data."""
    import datetime as dt
    staged = st.stg_transactions(t.transactions)
    since = (AS_OF - dt.timedelta(days=900)).date()
    cols = ["org_id", "revenue_date", "total_revenue_booked"]
    fresh = rv.revenue_daily(staged, since=since).select(*cols)
    stored = rv.revenue_daily(staged).select("org_id", "revenue_date", (F.col("total_revenue_booked") * 0).cast("decimal(28,2)").alias("total_revenue_booked"))
    return mg.replace_window(stored, fresh, "revenue_date", F.lit(since))


@query("k7_reload_groups", """
SELECT document_id, CASE WHEN auto_renewal THEN 'fresh' ELSE 'stored' END AS origin, document_type FROM b_documents""")
def _(t):
    d = t.documents.select("document_id", "document_type", "auto_renewal")
    stored = d.select("document_id", F.lit("stored").alias("origin"), "document_type")
    fresh = d.filter("auto_renewal").select("document_id", F.lit("fresh").alias("origin"), "document_type")
    return mg.reload_groups(stored, fresh, ["document_id"])


# -- sinks -----------------------------------------------------------------------
@query("a10_full_refresh_sink", "SELECT org_id, count(*) AS n, sum(arr) AS arr FROM b_customers GROUP BY 1", nums="arr")
def _(t):
    path = scratch(t)
    sinks.full_refresh(t.customers.select("customer_id", "org_id", "arr"), path, ["org_id"])
    return t.spark.read.parquet(path).groupBy("org_id").agg(F.count(F.lit(1)).alias("n"), F.sum("arr").alias("arr"))


@query("a11_incremental_merge_sink", f"SELECT 'SAP-' || c_custkey AS customer_id, org_id, c_name || ' v' || v AS name, {_EMAIL}, {_STAMP} FROM {_CUST}", times="updated_at")
def _(t):
    path, feed = scratch(t), "sap_customers"
    env = en.envelopes(t, feed)
    base = no.merge_feed(None, env.filter(F.col("loaded_at") <= first_load()), feed, stamp=first_load())
    sinks.create_merge_table(base, path, ["customer_id", "org_id"], rows_per_bucket=100)
    stamp = {"updated_at": ts(AS_OF)}
    sinks.merge_into(t.spark, path, no.project(mg.changes_since(env, first_load()), feed), ["name", "email"], on_update=stamp, on_insert=stamp)
    return sinks.read_merge_table(t.spark, path)


@query("a12_append_sink", "SELECT lifecycle_stage, 2 * count(*) AS n FROM b_customers GROUP BY 1")
def _(t):
    path = scratch(t)
    rows = t.customers.select("customer_id", "lifecycle_stage")
    sinks.append(rows, path)
    sinks.append(rows, path)
    return t.spark.read.parquet(path).groupBy("lifecycle_stage").agg(F.count(F.lit(1)).alias("n"))


@query("a13_physical_layout", "SELECT status, sum(amount) AS amount FROM b_transactions WHERE org_id = 'ORG-1' AND transaction_date >= DATE '2024-01-01' GROUP BY 1", nums="amount")
def _(t):
    path = scratch(t)
    sinks.write_layout(t.transactions.select("org_id", "transaction_date", "status", "amount"), path, ["org_id"], ["transaction_date"])
    rows = t.spark.read.parquet(path).filter((F.col("org_id") == "ORG-1") & (F.col("transaction_date") >= F.lit("2024-01-01").cast("date")))
    return rows.groupBy("status").agg(F.sum("amount").alias("amount"))


@query("a13_clustered_layout", """
SELECT 'amount' AS filter, count(*) AS n, sum(amount) AS amount FROM b_transactions WHERE amount < 60000
UNION ALL SELECT 'date', count(*), sum(amount) FROM b_transactions WHERE transaction_date >= DATE '1995-01-01' AND transaction_date < DATE '1995-04-01'
UNION ALL SELECT 'customer', count(*), sum(amount) FROM b_transactions WHERE customer_id = (SELECT max(customer_id) FROM b_transactions)""", nums="amount")
def _(t):
    """One table, three filters on different columns, each served by the same layout."""
    path = scratch(t)
    sinks.write_clustered(t.transactions.select("customer_id", "transaction_date", "amount"), path, ["transaction_date", "amount", "customer_id"])
    rows = t.spark.read.parquet(path)
    last = rows.agg(F.max("customer_id")).first()[0]
    day = F.col("transaction_date")
    picks = {"amount": F.col("amount") < 60000, "date": (day >= F.lit("1995-01-01").cast("date")) & (day < F.lit("1995-04-01").cast("date")),
             "customer": F.col("customer_id") == last}
    parts = [rows.filter(keep).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")).select(F.lit(k).alias("filter"), "n", "amount")
             for k, keep in picks.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("a16_retention", f"SELECT document_id, document_type, created_at FROM b_documents WHERE NOT (document_type IN ('invoice', 'other') AND created_at < {T0} - INTERVAL 8 DAYS)",
       times="created_at")
def _(t):
    expired = F.col("document_type").isin("invoice", "other") & (F.col("created_at") < ago(AS_OF, days=8))
    return mg.retain(t.documents.select("document_id", "document_type", "created_at"), expired)


# -- streams ---------------------------------------------------------------------
@query("l1_stream_feature_usage", f"""
SELECT org_id, customer_id, date_trunc('hour', occurred_at) AS event_hour, event_type, count(*) AS event_count,
  count(DISTINCT user_id) AS unique_users, count(DISTINCT session_id) AS unique_sessions, max(occurred_at) AS last_seen
FROM b_product_events GROUP BY 1, 2, 3, 4""", times="event_hour last_seen")
def _(t):
    src, out = event_files(t, t.raw_product_events, repeats=False), scratch(t)
    events = la.read_event_stream(t.spark, src, sc.RAW_PRODUCT_EVENT).filter("server_ts IS NOT NULL")
    jobs.run(jobs.start_feature_usage(events, f"{out}/data", f"{out}/ck"))
    return jobs.read_updates(t.spark, f"{out}/data", ["org_id", "customer_id", "event_hour", "event_type"])


@query("l1_stream_exact_usage", f"""
SELECT org_id, customer_id, date_trunc('hour', occurred_at) AS event_hour, event_type, count(*) AS event_count,
  count(DISTINCT user_id) AS unique_users, count(DISTINCT session_id) AS unique_sessions, max(occurred_at) AS last_seen
FROM b_product_events GROUP BY 1, 2, 3, 4""", times="event_hour last_seen")
def _(t):
    """Two runs: events whose number ends with 7 come after the others and mostly late; then an event that closes the last hours."""
    out, events = scratch(t), t.raw_product_events.filter("server_ts IS NOT NULL")
    closing = events.agg(F.max("server_ts").alias("server_ts")).select(
        *[(F.col("server_ts") + F.expr("INTERVAL 3 DAYS") if c == "server_ts" else F.lit(None).cast(k)).alias(c) for c, k in events.dtypes])
    delayed = F.col("event_id").endswith("7")
    for part in (events.filter(~delayed), events.filter(delayed).unionByName(closing)):
        part.write.mode("append").parquet(f"{out}/feed")
        feed = t.spark.readStream.schema(events.schema).parquet(f"{out}/feed")
        jobs.run(su.start_routing(feed, f"{out}/routed", f"{out}/ck1"))
        jobs.run(su.start_exact_usage(t.spark, f"{out}/routed", events.schema, f"{out}/hours", f"{out}/ck2"))
    routed = su.read_routed(t.spark, f"{out}/routed", events.schema).filter("event_id IS NOT NULL")
    return su.with_late(t.spark.read.parquet(f"{out}/hours"), routed)


@query("l2_stream_api_cost", """
SELECT org_id, CAST(request_ts AS DATE) AS usage_date, model_name, count(*) AS api_calls, CAST(sum(tokens_used) AS BIGINT) AS total_tokens,
  count(*) FILTER (status_code >= 400) AS error_count, round(avg(latency_ms), 0) AS avg_latency_ms, round(sum(tokens_used) * 0.000003::DOUBLE, 4) AS estimated_cost_usd
FROM (SELECT * FROM b_api_usage_events UNION ALL SELECT * FROM b_api_usage_events WHERE CAST(event_id[4:] AS INT) % 20 = 0) GROUP BY 1, 2, 3""", dates="usage_date")
def _(t):
    src, out = event_files(t, t.api_usage_events), scratch(t)
    jobs.run(jobs.start_api_cost(la.read_event_stream(t.spark, src, sc.API_USAGE_EVENT), f"{out}/data", f"{out}/ck"))
    return jobs.read_updates(t.spark, f"{out}/data", ["org_id", "usage_date", "model_name"])


@query("l3_stream_dedupe", f"SELECT * FROM ({_EVENTS})", times="client_ts server_ts")
def _(t):
    src, out = event_files(t, t.raw_product_events), scratch(t)
    events = jobs.dedupe_events(la.read_event_stream(t.spark, src, sc.RAW_PRODUCT_EVENT), "server_ts")
    jobs.run(jobs.start_landing(la.land_product_events(events), f"{out}/data", f"{out}/ck"))
    return t.spark.read.parquet(f"{out}/data").drop("event_payload", "_metadata_json")


@query("l4_stream_latest_health", """
SELECT customer_id, org_id, event_ts, new_score, score_driver FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, org_id ORDER BY event_ts DESC, event_id DESC) AS rn
FROM b_health_score_events) WHERE rn = 1""", times="event_ts", nums="new_score")
def _(t):
    src, out = event_files(t, t.health_score_events), scratch(t)
    jobs.run(jobs.start_latest_health(la.read_event_stream(t.spark, src, sc.HEALTH_SCORE_EVENT), f"{out}/data", f"{out}/ck"))
    return jobs.read_updates(t.spark, f"{out}/data", ["customer_id", "org_id"])


@query("l5_stream_cdc_merge", f"SELECT 'SAP-' || c_custkey AS customer_id, org_id, c_name || ' v' || v AS name, {_EMAIL}, {_STAMP} FROM {_CUST}", times="updated_at")
def _(t):
    feed, out = "sap_customers", scratch(t)
    env = en.envelopes(t, feed)
    base = no.merge_feed(None, env.filter(F.col("loaded_at") <= first_load()), feed, stamp=first_load())
    sinks.create_merge_table(base, f"{out}/table", ["customer_id", "org_id"], rows_per_bucket=100)
    mg.changes_since(env, first_load()).write.parquet(f"{out}/changes")
    stream = t.spark.readStream.schema(sc.ENVELOPE).parquet(f"{out}/changes")
    stamp = {"updated_at": ts(AS_OF)}
    jobs.run(jobs.start_merge(no.project(stream, feed), f"{out}/table", f"{out}/ck", ["name", "email"], on_update=stamp, on_insert=stamp))
    return sinks.read_merge_table(t.spark, f"{out}/table")

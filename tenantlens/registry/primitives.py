"""One query per relational building block the jobs rely on."""

import datetime as dt

from pyspark.sql import functions as F

from tenantlens.functions import columns as cb
from tenantlens.operators import latest as la, staging as st
from tenantlens.plans import profile as p, verticals as v
from tenantlens.registry.core import query
from tenantlens.registry.oracle_tables import D0, T0
from tenantlens.settings import AS_OF
from tenantlens.sources.sinks import materialize

CO = ["customer_id", "org_id"]


# -- filters -----------------------------------------------------------------------
@query("c1_tenant_equality", "SELECT customer_id, arr FROM b_customers WHERE org_id = 'ORG-2'", nums="arr")
def _(t):
    return st.for_tenant(t.customers, "ORG-2").select("customer_id", "arr")


@query("c2_relative_window", f"SELECT org_id, count(*) AS n FROM b_product_events WHERE occurred_at >= {T0} - INTERVAL 36 HOURS GROUP BY 1")
def _(t):
    return t.product_events.filter(F.col("occurred_at") >= cb.ago(AS_OF, hours=36)).groupBy("org_id").agg(F.count(F.lit(1)).alias("n"))


@query("c3_in_lists", "SELECT recommendation_id FROM b_recommendations WHERE priority IN ('HIGH', 'MEDIUM') AND status NOT IN ('completed', 'dismissed')")
def _(t):
    return t.recommendations.filter(F.col("priority").isin("HIGH", "MEDIUM") & ~F.col("status").isin("completed", "dismissed")).select("recommendation_id")


@query("c4_between", f"SELECT customer_id FROM b_customers WHERE contract_end_date BETWEEN {D0} AND {D0} + 90")
def _(t):
    return t.customers.filter(F.col("contract_end_date").between(cb.day(AS_OF), cb.day(AS_OF + dt.timedelta(days=90)))).select("customer_id")


@query("c5_like", "SELECT event_type, count(*) AS n FROM b_product_events WHERE event_type LIKE '%error%' OR event_type LIKE 'page%' GROUP BY 1")
def _(t):
    kind = F.col("event_type")
    return t.product_events.filter(kind.like("%error%") | kind.like("page%")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("c6_null_tests", "SELECT customer_id FROM b_customers WHERE email IS NULL AND nps_score IS NOT NULL")
def _(t):
    return t.customers.filter(F.col("email").isNull() & F.col("nps_score").isNotNull()).select("customer_id")


@query("c7_boolean_column", f"SELECT contract_id, status = 'active' AND end_date <= {D0} + 90 AS is_expiring, auto_renewal AND status <> 'expired' AS will_renew FROM b_contracts")
def _(t):
    soon = F.col("end_date") <= cb.day(AS_OF + dt.timedelta(days=90))
    return t.contracts.select("contract_id", ((F.col("status") == "active") & soon).alias("is_expiring"), (F.col("auto_renewal") & (F.col("status") != "expired")).alias("will_renew"))


@query("c8_min_length", "SELECT document_id, length(extracted_text) AS chars FROM b_documents WHERE length(trim(extracted_text)) > 50")
def _(t):
    return t.documents.filter(F.length(F.trim("extracted_text")) > 50).select("document_id", F.length("extracted_text").alias("chars"))


# -- joins -------------------------------------------------------------------------
@query("d1_left_joins", """
SELECT c.customer_id, c.org_id, coalesce(s.n, 0) AS subscriptions, coalesce(k.n, 0) AS contracts, coalesce(t.n, 0) AS tickets FROM b_customers c
LEFT JOIN (SELECT customer_id, org_id, count(*) AS n FROM b_subscriptions GROUP BY 1, 2) s USING (customer_id, org_id)
LEFT JOIN (SELECT customer_id, org_id, count(*) AS n FROM b_contracts GROUP BY 1, 2) k USING (customer_id, org_id)
LEFT JOIN (SELECT customer_id, org_id, count(*) AS n FROM b_tickets GROUP BY 1, 2) t USING (customer_id, org_id)""")
def _(t):
    sides = {"subscriptions": t.subscriptions, "contracts": t.contracts, "tickets": t.tickets}
    out = p.left_all(t.customers.select(*CO), *[df.groupBy(*CO).agg(F.count(F.lit(1)).alias(name)) for name, df in sides.items()])
    return out.withColumns({name: cb.nz(name) for name in sides})


@query("d2_inner_join", "SELECT s.score_id, c.name, s.risk_level FROM b_churn_scores s JOIN b_customers c ON s.customer_id = c.customer_id AND s.org_id = c.org_id")
def _(t):
    return t.churn_scores.join(t.customers, CO).select("score_id", "name", "risk_level")


@query("d3_left_join_residual", f"""
SELECT c.customer_id, count(t.ticket_id) AS open_recent FROM b_customers c LEFT JOIN b_tickets t
  ON c.customer_id = t.customer_id AND t.status = 'open' AND t.created_at >= {T0} - INTERVAL 365 DAYS GROUP BY 1""")
def _(t):
    recent = t.tickets.filter((F.col("status") == "open") & (F.col("created_at") >= cb.ago(AS_OF, days=365)))
    counts = recent.groupBy("customer_id").agg(F.count(F.lit(1)).alias("open_recent"))
    return t.customers.select("customer_id").join(counts, "customer_id", "left").withColumn("open_recent", cb.nz("open_recent"))


@query("d4_anti_join", f"""
SELECT s.score_id FROM b_churn_scores s LEFT JOIN b_recommendations r ON s.customer_id = r.entity_id AND r.status = 'pending' AND r.created_at >= {T0} - INTERVAL 7 DAYS
WHERE s.risk_level = 'HIGH' AND r.recommendation_id IS NULL""")
def _(t):
    recent = t.recommendations.filter((F.col("status") == "pending") & (F.col("created_at") >= cb.ago(AS_OF, days=7)))
    return t.churn_scores.filter(F.col("risk_level") == "HIGH").join(recent.select(F.col("entity_id").alias("customer_id")), "customer_id", "left_anti").select("score_id")


@query("d5_not_exists", f"SELECT customer_id FROM b_customers c WHERE NOT EXISTS (SELECT 1 FROM b_churn_scores s WHERE s.customer_id = c.customer_id AND s.scored_at > {T0} - INTERVAL 6 DAYS)")
def _(t):
    fresh = t.churn_scores.filter(F.col("scored_at") > cb.ago(AS_OF, days=6)).select("customer_id")
    return t.customers.join(fresh, "customer_id", "left_anti").select("customer_id")


@query("d6_exists", "SELECT customer_id FROM b_customers c WHERE EXISTS (SELECT 1 FROM b_tickets t WHERE t.customer_id = c.customer_id AND t.sla_breach)")
def _(t):
    return t.customers.join(t.tickets.filter("sla_breach").select("customer_id"), "customer_id", "left_semi").select("customer_id")


@query("d7_in_subquery", "SELECT document_id FROM b_documents WHERE entity_id IN (SELECT customer_id FROM b_contracts WHERE status = 'active')")
def _(t):
    holders = t.contracts.filter(F.col("status") == "active").select(F.col("customer_id").alias("entity_id"))
    return t.documents.join(holders, "entity_id", "left_semi").select("document_id")


@query("d8_scalar_subquery", f"""
SELECT customer_id, (SELECT min(current_period_end) FROM b_subscriptions s WHERE s.customer_id = c.customer_id AND s.status = 'active' AND s.current_period_end >= {D0}) AS next_renewal,
  coalesce((SELECT max(date_diff('day', created_at, {T0})) FROM b_tickets t WHERE t.customer_id = c.customer_id AND t.status = 'open'), 0) AS oldest_open_days FROM b_customers c""", dates="next_renewal")
def _(t):
    renewal = t.subscriptions.filter((F.col("status") == "active") & (F.col("current_period_end") >= cb.day(AS_OF))).groupBy("customer_id").agg(F.min("current_period_end").alias("next_renewal"))
    oldest = t.tickets.filter(F.col("status") == "open").groupBy("customer_id").agg(F.max(cb.days_between(F.col("created_at"), cb.ts(AS_OF))).alias("oldest_open_days"))
    out = t.customers.select("customer_id").join(renewal, "customer_id", "left").join(oldest, "customer_id", "left")
    return out.withColumn("oldest_open_days", cb.nz("oldest_open_days"))


@query("d9_latest_with_ties", "SELECT customer_id, ticket_id, created_at FROM b_tickets t WHERE created_at = (SELECT max(created_at) FROM b_tickets x WHERE x.customer_id = t.customer_id)", times="created_at")
def _(t):
    return la.latest_with_ties(t.tickets, ["customer_id"], "created_at").select("customer_id", "ticket_id", "created_at")


@query("d10_single_row_aggregates", f"""
SELECT a.today, b.before FROM (SELECT count(*) AS today FROM b_transactions WHERE transaction_date = {D0}) a, (SELECT count(*) AS before FROM b_transactions WHERE transaction_date = {D0} - 1) b""")
def _(t):
    date = F.col("transaction_date")
    two = t.transactions.filter(date.between(cb.days_ago(AS_OF, 1), cb.day(AS_OF)))
    return two.agg(F.count_if(date == cb.day(AS_OF)).alias("today"), F.count_if(date == cb.days_ago(AS_OF, 1)).alias("before"))


@query("d11_date_horizon", f"SELECT org_id, CAST(d AS DATE) AS day FROM (SELECT DISTINCT org_id FROM b_customers), generate_series({D0}::TIMESTAMP, {D0}::TIMESTAMP + INTERVAL 29 DAYS, INTERVAL 1 DAY) AS g(d)", dates="day")
def _(t):
    days = F.sequence(cb.day(AS_OF), cb.day(AS_OF + dt.timedelta(days=29)))
    return t.customers.select("org_id").distinct().select("org_id", F.explode(days).alias("day"))


@query("d12_flatten_split", """
SELECT document_id, i - 1 AS idx, length(piece) AS chars FROM (SELECT document_id, unnest(string_split(extracted_text, chr(10))) AS piece,
  generate_subscripts(string_split(extracted_text, chr(10)), 1) AS i FROM b_documents)""")
def _(t):
    return t.documents.select("document_id", F.posexplode(F.split("extracted_text", "\n")).alias("idx", "piece")).select("document_id", "idx", F.length("piece").alias("chars"))


@query("d13_latest_dimension", "SELECT c.customer_id, h.risk_level, h.scored_at FROM b_customers c LEFT JOIN m_latest_churn h ON c.customer_id = h.customer_id", times="scored_at")
def _(t):
    return t.customers.select(*CO).join(la.latest_scores(t.churn_scores), CO, "left").select("customer_id", "risk_level", "scored_at")


@query("d15_map_join", "SELECT user_name, count(*) AS customers, sum(arr) AS arr FROM b_customers JOIN b_user_org_map USING (org_id) GROUP BY 1", nums="arr")
def _(t):
    """Tenant totals first: the map then multiplies a handful of rows, not customers."""
    per_org = t.customers.groupBy("org_id").agg(F.count(F.lit(1)).alias("customers"), F.sum("arr").alias("arr"))
    return per_org.join(t.user_org_map, "org_id").groupBy("user_name").agg(F.sum("customers").alias("customers"), F.sum("arr").alias("arr"))


# -- windows, order, sets ------------------------------------------------------------
@query("f1_latest_row", "SELECT customer_id, org_id, score_id, churn_probability FROM m_latest_churn", nums="churn_probability")
def _(t):
    return la.latest_scores(t.churn_scores).select(*CO, "score_id", "churn_probability")


@query("f2_share_of_total", """
SELECT customer_id, round(arr::DOUBLE * 100 / nullif(org_arr, 0)::DOUBLE, 4) AS pct_of_tenant FROM (SELECT customer_id, arr, sum(arr) OVER (PARTITION BY org_id) AS org_arr FROM b_customers)""")
def _(t):
    total = materialize(t.customers.groupBy("org_id").agg(F.sum("arr").alias("org_arr")))
    share = F.col("arr").cast("double") * 100 / F.nullif(F.col("org_arr").cast("double"), F.lit(0.0))
    return t.customers.join(total, "org_id").select("customer_id", F.round(share, 4).alias("pct_of_tenant"))


@query("f4_dedupe_horizon", "SELECT org_id, sku_id, location_id, forecast_date FROM m_demand", dates="forecast_date")
def _(t):
    return v.demand_forecast(t.sales_history).select("org_id", "sku_id", "location_id", "forecast_date")


@query("f6_order_nulls", """
SELECT org_id, priority, recommendation_id, expected_impact_usd FROM b_recommendations
ORDER BY org_id, CASE priority WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, expected_impact_usd DESC NULLS LAST, recommendation_id""", nums="expected_impact_usd")
def _(t):
    order = [F.col("org_id"), cb.mapped(F.col("priority"), {"HIGH": 1, "MEDIUM": 2}, 3), F.col("expected_impact_usd").desc_nulls_last(), F.col("recommendation_id")]
    return t.recommendations.orderBy(*order).select("org_id", "priority", "recommendation_id", "expected_impact_usd")


@query("f7_top_k", "SELECT customer_id, arr FROM b_customers ORDER BY arr DESC, customer_id LIMIT 50", nums="arr")
def _(t):
    return t.customers.select("customer_id", "arr").orderBy(F.col("arr").desc_nulls_last(), "customer_id").limit(50)


@query("f8_top_per_tenant", """
SELECT org_id, customer_id, expected_revenue_at_risk, rank FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY expected_revenue_at_risk DESC, customer_id) AS rank FROM m_latest_churn) WHERE rank <= 20""", nums="expected_revenue_at_risk")
def _(t):
    order = [F.col("expected_revenue_at_risk").desc_nulls_last(), F.col("customer_id")]
    return la.top_per_tenant(la.latest_scores(t.churn_scores), order, 20).select("org_id", "customer_id", "expected_revenue_at_risk", "rank")


@query("f9_union_all", """
SELECT origin, count(*) AS n, sum(amount) AS amount FROM (SELECT 'contract' AS origin, contract_value AS amount FROM b_contracts UNION ALL SELECT 'transaction', amount FROM b_transactions) GROUP BY 1""", nums="amount")
def _(t):
    both = t.contracts.select(F.lit("contract").alias("origin"), F.col("contract_value").alias("amount")).unionByName(
        t.transactions.select(F.lit("transaction").alias("origin"), "amount"))
    return both.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@query("f10_distinct", "SELECT DISTINCT org_id, channel, direction FROM b_interactions")
def _(t):
    return t.interactions.select("org_id", "channel", "direction").distinct()

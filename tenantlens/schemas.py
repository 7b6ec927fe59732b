"""Declared schemas of landed events and of the core tables, as DDL strings."""

RAW_PRODUCT_EVENT = (
    "event_id STRING, org_id STRING, customer_id STRING, user_id STRING, session_id STRING, event_type STRING, "
    "event_payload STRING, client_ts STRING, server_ts TIMESTAMP")
API_USAGE_EVENT = (
    "event_id STRING, org_id STRING, endpoint STRING, method STRING, status_code INT, latency_ms INT, tokens_used INT, "
    "model_name STRING, request_ts TIMESTAMP")
HEALTH_SCORE_EVENT = (
    "event_id STRING, org_id STRING, customer_id STRING, score_delta DECIMAL(5,2), new_score DECIMAL(5,2), "
    "score_driver STRING, event_ts TIMESTAMP")
ENVELOPE = ("org_id STRING, raw_data STRING, loaded_at TIMESTAMP")

CORE = {
    "customers": (
        "customer_id STRING, org_id STRING, name STRING, email STRING, phone STRING, segment STRING, region STRING, industry STRING, "
        "lifecycle_stage STRING, arr DECIMAL(18,2), mrr DECIMAL(18,2), contract_start_date DATE, contract_end_date DATE, nps_score INT, "
        "source_system STRING, created_at TIMESTAMP, updated_at TIMESTAMP"),
    "subscriptions": (
        "subscription_id STRING, org_id STRING, customer_id STRING, product_id STRING, plan_name STRING, plan_tier STRING, status STRING, "
        "seats INT, mrr DECIMAL(18,2), arr DECIMAL(18,2), trial_end_date DATE, current_period_start DATE, current_period_end DATE, "
        "cancel_at DATE, canceled_at TIMESTAMP, created_at TIMESTAMP"),
    "tickets": (
        "ticket_id STRING, org_id STRING, customer_id STRING, subject STRING, status STRING, priority STRING, category STRING, "
        "sentiment_score DECIMAL(4,3), sentiment_label STRING, sla_breach BOOLEAN, created_at TIMESTAMP, resolved_at TIMESTAMP"),
    "product_events": (
        "event_id STRING, org_id STRING, customer_id STRING, subscription_id STRING, event_type STRING, feature_name STRING, "
        "event_value DECIMAL(18,4), session_id STRING, user_id STRING, platform STRING, occurred_at TIMESTAMP"),
    "transactions": (
        "transaction_id STRING, org_id STRING, customer_id STRING, amount DECIMAL(18,2), currency STRING, transaction_type STRING, "
        "status STRING, transaction_date DATE"),
    "contracts": (
        "contract_id STRING, org_id STRING, customer_id STRING, contract_name STRING, contract_value DECIMAL(18,2), start_date DATE, "
        "end_date DATE, auto_renewal BOOLEAN, status STRING"),
    "churn_scores": (
        "score_id STRING, org_id STRING, customer_id STRING, churn_probability DECIMAL(5,4), risk_level STRING, top_drivers ARRAY<STRING>, "
        "recommended_action STRING, expected_revenue_at_risk DECIMAL(18,2), model_version STRING, scored_at TIMESTAMP"),
    "recommendations": (
        "recommendation_id STRING, org_id STRING, entity_id STRING, entity_type STRING, recommendation_type STRING, priority STRING, "
        "recommendation_text STRING, expected_impact_usd DECIMAL(18,2), confidence_score DECIMAL(4,3), owner_role STRING, status STRING, "
        "is_active BOOLEAN, created_at TIMESTAMP, expires_at TIMESTAMP, acted_at TIMESTAMP"),
}

# The supplied tables: declared, so that reading one needs no inference job.
SOURCES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, "
                "l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

"""Event usage, API cost, tenant usage snapshots and the model metric log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tenantlens.functions.columns import ago, day, days_ago, days_between, dec, mean, nz
from tenantlens.operators.latest import latest_by
from tenantlens.settings import AS_OF


def feature_usage(events: DataFrame, *, lookback_days: int | None = 90, as_of=AS_OF) -> DataFrame:
    """Hourly usage per customer and event type (batch: exact distinct counts).

    Events are first reduced to one row per user and session within the hour,
    so the two distinct counts expand that frame and not the raw events.
    """
    kept = events if lookback_days is None else events.filter(F.col("server_ts") >= ago(as_of, days=lookback_days))
    keys = ["org_id", "customer_id", "event_hour", "event_type"]
    facts = kept.withColumn("event_hour", F.date_trunc("hour", "server_ts")).groupBy(*keys, "user_id", "session_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("server_ts").alias("last"))
    return facts.groupBy(*keys).agg(
        F.sum("n").alias("event_count"), F.count_distinct("user_id").alias("unique_users"),
        F.count_distinct("session_id").alias("unique_sessions"), F.max("last").alias("last_seen"))


def api_cost_measures(usd_per_token: float = 3e-6) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("api_calls"), F.sum("tokens_used").alias("total_tokens"),
        F.count_if(F.col("status_code") >= 400).alias("error_count"),
        F.round(F.avg("latency_ms"), 0).alias("avg_latency_ms"),
        F.round(F.sum("tokens_used") * F.lit(usd_per_token), 4).alias("estimated_cost_usd"),
    ]


def api_cost(api_usage: DataFrame, *, lookback_days: int | None = 90, usd_per_token: float = 3e-6, as_of=AS_OF) -> DataFrame:
    kept = api_usage if lookback_days is None else api_usage.filter(F.col("request_ts") >= ago(as_of, days=lookback_days))
    return kept.groupBy("org_id", F.to_date("request_ts").alias("usage_date"), "model_name").agg(*api_cost_measures(usd_per_token))


def tenant_usage_snapshots(access_log, cost, agent_sessions, documents, recommendations, *, as_of=AS_OF) -> DataFrame:
    """Usage per tenant and day; each source is reduced to that grain before joining."""
    grain = ["org_id", "snapshot_date"]
    kind = F.col("resource_type")
    log = access_log.groupBy("org_id", F.to_date("created_at").alias("snapshot_date")).agg(
        F.count_if(kind == "APP_SESSION").alias("app_sessions"), F.count_distinct("user_name").alias("dau"),
        F.count_if(kind == "MODEL_CALL").alias("model_calls"), F.count_if(kind == "DOC_SEARCH").alias("doc_searches"),
        F.count_if(kind == "AGENT_SESSION").alias("agent_accesses"))
    tokens = cost.groupBy("org_id", F.col("usage_date").alias("snapshot_date")).agg(F.sum("total_tokens").alias("model_tokens"))
    agents = agent_sessions.groupBy("org_id", F.to_date("started_at").alias("snapshot_date")).agg(F.count(F.lit(1)).alias("agent_sessions"))
    docs = documents.filter(F.col("processing_status") == "completed").groupBy("org_id").agg(F.count(F.lit(1)).alias("documents_indexed"))
    recs = recommendations.groupBy("org_id", F.to_date("created_at").alias("snapshot_date")).agg(F.count(F.lit(1)).alias("recommendations_generated"))
    out = log.join(tokens, grain, "left").join(agents, grain, "left").join(recs, grain, "left").join(docs, "org_id", "left")
    used = F.array_compact(F.array(
        F.when(F.col("model_calls") > 0, "ai_chat"), F.when(F.col("doc_searches") > 0, "document_search"),
        F.when(F.col("agent_accesses") > 0, "agents")))
    zero = ("model_tokens", "agent_sessions", "documents_indexed", "recommendations_generated")
    return out.withColumns({c: nz(c) for c in zero}).withColumn("features_used", used).drop("agent_accesses")


def tenant_health(snapshots: DataFrame, *, as_of=AS_OF) -> DataFrame:
    """Latest snapshot per tenant with seven-day averages and an engagement tier."""
    trend = snapshots.filter(F.col("snapshot_date") >= days_ago(as_of, 7)).groupBy("org_id").agg(
        F.avg("dau").alias("dau_7d"), F.avg("model_calls").alias("calls_7d"))
    dau, calls = F.col("dau_7d"), F.col("calls_7d")
    tier = (F.when((dau >= 5) & (calls >= 20), "HIGHLY_ENGAGED").when((dau >= 2) & (calls >= 5), "ENGAGED")
            .when(dau >= 1, "CASUAL").otherwise("AT_RISK_OF_CHURN"))
    return latest_by(snapshots, ["org_id"], "snapshot_date").join(trend, "org_id", "left").select(
        "org_id", F.col("snapshot_date").alias("last_active"), "dau", "model_calls", "model_tokens", "agent_sessions",
        "documents_indexed", "features_used", F.round(dau, 1).alias("avg_dau_7d"), F.round(calls, 0).alias("avg_model_calls_7d"),
        tier.alias("engagement_tier"), F.size("features_used").alias("features_adopted"))


def model_registry(log: DataFrame) -> DataFrame:
    """Latest value of every metric per model version, as one map.

    Reduced to one row per metric first, so the map holds one entry per
    metric name however long the log is.
    """
    per_metric = log.groupBy("model_name", "model_version", "metric_name").agg(
        F.max("run_date").alias("last_run"), F.max_by("metric_value", F.struct("created_at", "metric_value")).alias("value"),
        F.max_by("dataset_split", F.struct("created_at", "metric_value", "dataset_split")).alias("split"))
    entries = F.array_sort(F.collect_list(F.struct("metric_name", "value")))
    return per_metric.groupBy("model_name", "model_version").agg(
        F.max("last_run").alias("last_evaluated"), F.count(F.lit(1)).alias("metric_count"),
        F.map_from_entries(entries).alias("latest_metrics"),
        F.max_by("split", F.struct("last_run", "metric_name")).alias("latest_split"))


def model_health(log: DataFrame, *, as_of=AS_OF) -> DataFrame:
    tested = log.filter(F.col("dataset_split").isin("test", "production"))
    last = latest_by(tested, ["model_name", "model_version", "metric_name"], "run_date", ["metric_value", "dataset_split"])
    age = days_between(F.col("run_date"), day(as_of))
    state = (F.when(age > 30, "STALE")
             .when((F.col("metric_name") == "accuracy") & (F.col("metric_value") < 0.75), "DEGRADED")
             .when((F.col("metric_name") == "auc") & (F.col("metric_value") < 0.70), "DEGRADED").otherwise("HEALTHY"))
    return last.select("model_name", "model_version", "metric_name", "metric_value", F.col("run_date").alias("last_evaluation"),
                       age.alias("days_since_evaluation"), state.alias("health_status"))


def model_precision(c360: DataFrame) -> DataFrame:
    """Precision of the HIGH flag against churned customers, plus average health."""
    high, churned = F.col("churn_risk_level") == "HIGH", F.col("lifecycle_stage") == "churned"
    flagged = F.count_if(high)
    return c360.groupBy("org_id").agg(
        F.count_if(high & churned).alias("true_positives"), flagged.alias("flagged"),
        F.round(F.count_if(high & churned) / F.nullif(flagged, F.lit(0)), 4).alias("precision"),
        F.round(mean("health_score"), 2).alias("avg_health_score"))


def share_of_total(df: DataFrame, by: list[str], group: str, value: Column) -> DataFrame:
    """Each group's part of its partition total, over the aggregated rows only."""
    sums = df.groupBy(*by, group).agg(F.sum(value).alias("amount"))
    totals = sums.groupBy(*by).agg(F.sum("amount").alias("total"))
    share = F.col("amount").cast("double") / F.nullif(F.col("total").cast("double"), F.lit(0.0))
    return sums.join(totals, by).select(*by, group, "amount", F.round(share, 6).alias("share"))

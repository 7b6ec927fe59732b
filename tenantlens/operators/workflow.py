"""Recommendation status, approval lifecycle and audit events.

Event sequences are folded with min/max aggregates, not by walking them: the
outcome only depends on the first decisive and the last ordinary event, and
both pre-aggregate before the exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tenantlens.functions.columns import hours_between, nz, ts
from tenantlens.settings import AS_OF

# Statuses a recommendation may take, and those that close it.
STATUSES = ("pending", "in_progress", "completed", "dismissed", "snoozed")
CLOSING = ("completed", "dismissed")


def _outcomes(events: DataFrame) -> DataFrame:
    valid = events.filter(F.col("new_status").isin(*STATUSES))
    step = F.struct("at", "event_id", "new_status")
    closing = F.col("new_status").isin(*CLOSING)
    return valid.groupBy("recommendation_id").agg(
        F.min(F.when(closing, step)).alias("closed"), F.max(F.when(~closing, step)).alias("last"))


def apply_status_events(recommendations: DataFrame, events: DataFrame) -> DataFrame:
    """Recommendations after their events.

    Unknown statuses are ignored, inactive recommendations do not change, and
    nothing after the first closing event counts.
    """
    out = recommendations.join(_outcomes(events), "recommendation_id", "left")
    live = F.col("is_active")
    closed, last = F.col("closed"), F.col("last")
    status = F.when(live & closed.isNotNull(), closed["new_status"]).when(live & last.isNotNull(), last["new_status"]).otherwise(F.col("status"))
    return out.withColumns({
        "status": status, "acted_at": F.when(live, closed["at"]),
        "is_active": live & closed.isNull(),
    }).drop("closed", "last")


def action_log(recommendations: DataFrame, events: DataFrame) -> DataFrame:
    """One log row per event that took effect."""
    valid = events.filter(F.col("new_status").isin(*STATUSES))
    live = recommendations.filter("is_active").select("recommendation_id", "org_id")
    ends = _outcomes(events).select("recommendation_id", "closed")
    step, end = F.struct("at", "event_id"), F.struct(F.col("closed.at").alias("at"), F.col("closed.event_id").alias("event_id"))
    return valid.join(live, "recommendation_id").join(ends, "recommendation_id").filter(F.col("closed").isNull() | (step <= end)).select(
        "org_id", F.col("acted_by").alias("user_name"), F.concat(F.lit("recommendation_"), "new_status").alias("action_type"),
        F.lit("recommendation").alias("object_type"), F.col("recommendation_id").alias("object_id"), F.col("at").alias("created_at"), "event_id")


def submit(requests: DataFrame, *, hours: int = 48) -> DataFrame:
    """New requests enter as pending with an expiry."""
    return requests.withColumns({"status": F.lit("pending"), "expires_at": F.col("created_at") + F.expr(f"INTERVAL {hours} HOURS")})


def apply_approval_events(queue: DataFrame, events: DataFrame, *, as_of=AS_OF) -> DataFrame:
    """Queue state at ``as_of``.

    The first effective decision wins. An approval needs an unexpired request;
    a rejection needs one that the hourly expiry run has not closed yet.
    """
    sweep = F.date_trunc("hour", "expires_at") + F.expr("INTERVAL 1 HOUR")
    seen = events.filter(F.col("at") <= ts(as_of))
    joined = seen.join(queue.select("approval_id", "expires_at"), "approval_id")
    counts = ((F.col("action") == "approve") & (F.col("at") < F.col("expires_at"))) | ((F.col("action") == "reject") & (F.col("at") < sweep))
    first = joined.filter(counts).groupBy("approval_id").agg(F.min(F.struct("at", "action", "actor", "reason")).alias("d"))
    d = F.col("d")
    status = (F.when(d["action"] == "approve", "approved").when(d["action"] == "reject", "rejected")
              .when(sweep <= ts(as_of), "expired").otherwise("pending"))
    return queue.join(first, "approval_id", "left").withColumns({
        "status": status, "decided_by": d["actor"], "decided_at": d["at"],
        "rejection_reason": F.when(d["action"] == "reject", d["reason"]),
        "hours_remaining": hours_between(ts(as_of), F.col("expires_at")),
    }).drop("d")


def approval_log(decided: DataFrame) -> DataFrame:
    return decided.filter(F.col("decided_at").isNotNull()).select(
        "org_id", F.col("decided_by").alias("user_name"), F.when(F.col("status") == "approved", "APPROVE").otherwise("REJECT").alias("action_type"),
        F.lit("APPROVAL_QUEUE").alias("entity_type"), F.col("approval_id").alias("entity_id"), F.col("decided_at").alias("created_at"))


def normalize_audit(log: DataFrame) -> DataFrame:
    """Audit rows; prompt and answer stay whole."""
    return log.select(
        "log_id", "session_id", "org_id", "user_name", "agent_id", F.col("prompt").alias("prompt_text"),
        nz("answer", "").alias("response_summary"), nz("tokens_used").alias("tokens_used"),
        nz("latency_ms").alias("latency_ms"), "created_at")

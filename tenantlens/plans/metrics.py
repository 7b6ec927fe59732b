"""Metric layer: named dimensions and measures over the marts, and their star joins."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from tenantlens.functions.columns import mean

ONE = "1"


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


# Table -> (dimensions, measure -> (SQL expression, aggregation)).
MODELS: dict[str, tuple[list[str], dict[str, tuple[str, str]]]] = {
    "customer_360": (
        ["customer_id", "customer_name", "org_id", "segment", "lifecycle_stage", "churn_risk_level", "nearest_renewal_date", "region",
         "industry", "usage_trend", "sentiment_label", "customer_since"],
        {"total_customers": (ONE, "count"), "avg_health_score": ("health_score", "avg"),
         "high_risk_count": (_flag("churn_risk_level = 'HIGH'"), "sum"), "avg_arr": ("arr", "avg"), "total_arr": ("arr", "sum"),
         "total_mrr": ("mrr", "sum"), "avg_churn_probability": ("churn_probability", "avg"), "avg_nps": ("nps_score", "avg"),
         "revenue_at_risk": ("expected_revenue_at_risk", "sum"), "open_tickets": ("open_tickets", "sum"), "sla_breaches": ("sla_breaches", "sum"),
         "events_30d": ("events_30d", "sum"), "avg_active_days_30d": ("active_days_30d", "avg"),
         "avg_days_since_last_activity": ("days_since_last_activity", "avg")}),
    "recommendations": (
        ["recommendation_type", "priority", "status", "org_id"],
        {"pending_recommendations": (_flag("status = 'pending' AND is_active"), "sum"), "expected_impact": ("expected_impact_usd", "sum")}),
    "tickets": (
        ["ticket_id", "status", "priority", "category", "customer_id", "org_id", "created_at"],
        {"ticket_count": (ONE, "count"), "open_ticket_count": (_flag("status = 'open'"), "sum"),
         "urgent_ticket_count": (_flag("priority = 'urgent'"), "sum")}),
    "interactions": (
        ["interaction_id", "customer_id", "org_id", "channel", "direction", "occurred_at"],
        {"interaction_count": (ONE, "count"), "avg_sentiment": ("sentiment_score", "avg"),
         "inbound_count": (_flag("direction = 'inbound'"), "sum"), "negative_interactions": (_flag("sentiment_score < 0"), "sum")}),
    "customer_health": (
        ["customer_id", "org_id", "name", "segment", "risk_level"],
        {"avg_churn_risk": ("churn_risk_score", "avg"), "total_open_tickets": ("open_ticket_count", "sum"), "total_arr": ("arr", "sum"),
         "critical_customers": (_flag("risk_level = 'HIGH'"), "sum")}),
    "opportunities": (
        ["customer_id", "customer_name", "opportunity_type", "org_id", "contract_end_date"],
        {"opportunity_count": (ONE, "count"), "avg_opportunity_score": ("opportunity_score", "avg"), "total_pipeline_usd": ("estimated_revenue_usd", "sum"),
         "avg_pipeline_per_customer": ("estimated_revenue_usd", "avg"), "total_arr_in_pipeline": ("arr", "sum"),
         "high_score_opportunities": (_flag("opportunity_score >= 0.7"), "sum")}),
    "revenue_movement": (
        ["org_id", "month", "transaction_type"],
        {"transaction_count": ("transaction_count", "sum"), "total_revenue_movement": ("total_amount", "sum")}),
    "transactions": (
        ["transaction_type", "status", "transaction_date", "currency", "org_id"],
        {"total_revenue": ("amount", "sum"), "transaction_count": (ONE, "count")}),
    "products": (
        ["product_id", "product_name", "product_category", "is_active"],
        {"product_count": (ONE, "count"), "avg_unit_price": ("unit_price", "avg"), "total_catalog_value": ("unit_price", "sum")}),
    "executive_kpis": (
        ["snapshot_date", "org_id"],
        {**{m: (m, "sum") for m in ("total_arr", "total_mrr", "active_customers", "at_risk_customers", "churned_customers", "arr_at_risk",
                                     "open_tickets", "renewals_90d_arr", "pending_recommendations", "total_expected_impact")},
         "avg_health_score": ("avg_health_score", "avg"), "avg_nps": ("avg_nps", "avg")}),
}

# Fact table -> dimension table: (fact key, dimension key), always left outer.
STARS = {
    ("recommendations", "customer_360"): ("entity_id", "customer_id"), ("interactions", "customer_360"): ("customer_id", "customer_id"),
    ("tickets", "customer_health"): ("customer_id", "customer_id"), ("interactions", "customer_health"): ("customer_id", "customer_id"),
    ("opportunities", "customer_health"): ("customer_id", "customer_id"), ("transactions", "customer_360"): ("customer_id", "customer_id"),
}


# Dimensions that mean the same in every model that has them or reaches them.
CONFORMED = {"org_id", "customer_id", "customer_name", "segment", "lifecycle_stage", "region", "industry", "churn_risk_level", "risk_level"}


def _measure(expr: str, agg: str) -> Column:
    value = F.expr(expr)
    return {"count": F.count, "sum": F.sum, "avg": mean, "min": F.min, "max": F.max}[agg](value)


def metric(df: DataFrame, measures: dict[str, tuple[str, str]], dims: list[str], where: str | None = None) -> DataFrame:
    rows = df if where is None else df.filter(where)
    return rows.groupBy(*dims).agg(*[_measure(expr, agg).alias(name) for name, (expr, agg) in measures.items()])


def model_metric(model: str, df: DataFrame, measures: list[str], dims: list[str], where: str | None = None) -> DataFrame:
    """Named measures of a model; unknown names are rejected."""
    known_dims, known = MODELS[model]
    unknown = [m for m in measures if m not in known] + [d for d in dims if d not in known_dims]
    if unknown:
        raise KeyError(f"{model} has no {unknown}")
    return metric(df, {m: known[m] for m in measures}, dims, where)


def star(fact_name: str, fact: DataFrame, dim_name: str, dim: DataFrame, columns: list[str]) -> DataFrame:
    """Fact rows with dimension columns; the dimension has one row per key and tenant, so rows never multiply."""
    left, right = STARS[(fact_name, dim_name)]
    side = dim.select(F.col(right).alias(left), "org_id", *[F.col(c).alias(f"dim_{c}") for c in columns])
    return fact.join(side, [left, "org_id"], "left")


def _source(model: str, dim: str, frames: dict[str, DataFrame]) -> str | None:
    """Table that gives a model its dimension: None for its own, else the first star that has it."""
    if dim in MODELS[model][0]:
        return None
    for fact, other in STARS:
        if fact == model and other in frames and dim in MODELS[other][0]:
            return other
    raise KeyError(f"{model} does not reach {dim}: its measures would be repeated for every value")


def drill_across(frames: dict[str, DataFrame], measures: list[str], dims: list[str], where: dict[str, str] | None = None) -> DataFrame:
    """Measures of several models (``model.measure``) by shared dimensions, one row per combination that any model has.

    Each model is reduced to the dimensions first; only the reduced rows meet,
    so no fact multiplies another. A dimension comes from the model itself or
    over a star from its dimension table. Rejected with KeyError: unknown
    names, a dimension that a model does not reach, and, across several
    models, one that is not conformed. A missing combination is NULL; NULL
    dimension values meet each other. ``where`` filters a model's own rows.
    """
    wanted: dict[str, list[str]] = {}
    for name in measures:
        model, _, measure = name.partition(".")
        if model not in MODELS or measure not in MODELS[model][1]:
            raise KeyError(f"unknown measure {name}")
        wanted.setdefault(model, []).append(measure)
    loose = [d for d in dims if d not in CONFORMED] if len(wanted) > 1 else []
    if loose:
        raise KeyError(f"not shared between models: {loose}")
    names = Counter(m for ms in wanted.values() for m in ms)
    parts = []
    for model, picked in wanted.items():
        sources = {d: _source(model, d, frames) for d in dims}
        rows = frames[model] if (where or {}).get(model) is None else frames[model].filter(where[model])
        for other in dict.fromkeys(s for s in sources.values() if s):
            columns = [d for d in dims if sources[d] == other]
            rows = star(model, rows, other, frames[other], columns).withColumnsRenamed({f"dim_{d}": d for d in columns})
        known = MODELS[model][1]
        parts.append(metric(rows, {m if names[m] == 1 else f"{model}_{m}": known[m] for m in picked}, dims))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    values = [c for c in out.columns if c not in dims]
    return out.groupBy(*dims).agg(*[F.max(c).alias(c) for c in values])  # one row per model: max only picks it

"""Context text assembled per entity for a downstream writer or model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def context_text(df: DataFrame, keys: list[str], parts: dict[str, Column], name: str = "context") -> DataFrame:
    """``label: value`` lines in order; a missing value reads N/A."""
    lines = [F.concat(F.lit(f"{label}: "), F.coalesce(value.cast("string"), F.lit("N/A"))) for label, value in parts.items()]
    return df.select(*keys, F.concat_ws("\n", *lines).alias(name))


def fixed(col: str, scale: int) -> Column:
    return F.round(F.col(col), scale).cast(f"decimal(20,{scale})")


def percent(col: str, scale: int = 1) -> Column:
    return F.concat(F.round(F.col(col) * 100, scale).cast(f"decimal(20,{scale})").cast("string"), F.lit("%"))


def patient_context(profiles: DataFrame) -> DataFrame:
    return context_text(profiles, ["patient_id", "org_id"], {
        "Segment": F.col("population_segment"), "Engagement": fixed("engagement_score", 1), "Adherence": fixed("appointment_adherence", 1),
        "Care gaps": F.col("care_gap_count"), "Readmission risk": percent("readmission_risk")})


def guest_context(guests: DataFrame) -> DataFrame:
    return context_text(guests, ["guest_id", "org_id"], {
        "Tier": F.col("loyalty_tier"), "Lifetime value": fixed("lifetime_value_usd", 0), "Stays": F.col("stays_count"),
        "Daily rate": F.col("avg_daily_rate_usd"), "NPS": F.col("nps_score"), "Churn risk": F.col("churn_risk"), "Upsell": percent("upsell_propensity", 0)})


def network_context(quality: DataFrame) -> DataFrame:
    return context_text(quality, ["customer_id", "org_id"], {
        "Customer": F.col("customer_name"), "ARPU": fixed("arpu_usd", 2), "QoS": fixed("qos_score", 2), "Latency ms": fixed("avg_latency_ms", 2),
        "Packet loss": fixed("avg_packet_loss_pct", 2), "Downtime h": fixed("avg_downtime_hours", 2), "Complaints": F.col("complaints_30d"),
        "Churn risk": percent("churn_probability")})


def equipment_context(oee_rows: DataFrame) -> DataFrame:
    return context_text(oee_rows, ["equipment_id", "org_id"], {
        "Plant": F.col("plant_id"), "OEE": fixed("oee_score", 2), "Availability": fixed("availability_pct", 2), "Performance": fixed("performance_pct", 2),
        "Quality": fixed("quality_pct", 2), "MTBF": F.col("mtbf_hours"), "MTTR": F.col("mttr_hours"), "Failure risk": percent("failure_risk_score"),
        "Maintenance due": F.date_format("maintenance_due", "yyyy-MM-dd")})


def promotion_context(performance: DataFrame) -> DataFrame:
    return context_text(performance, ["promotion_id"], {
        "Promotion": F.col("name"), "From": F.date_format("start_date", "yyyy-MM-dd"), "To": F.date_format("end_date", "yyyy-MM-dd"),
        "Discount": F.col("discount_pct"), "Revenue": fixed("revenue_usd", 2), "Units": fixed("units_sold", 0), "Cost": fixed("cost_usd", 2)})


def recommendation_context(pool: DataFrame) -> DataFrame:
    return context_text(pool, ["customer_id", "org_id"], {
        "Customer": F.col("customer_name"), "Segment": F.col("segment"), "ARR": fixed("arr", 0), "Risk": F.col("churn_risk_level"),
        "Probability": percent("churn_probability", 0), "Health": fixed("health_score", 1), "NPS": F.col("nps_score"),
        "Renewal": F.date_format("nearest_renewal_date", "yyyy-MM-dd")})


def kpi_context(kpis: DataFrame) -> DataFrame:
    return context_text(kpis, ["org_id"], {
        "ARR": fixed("total_arr", 0), "Active customers": F.col("active_customers"), "At-risk customers": F.col("at_risk_customers"),
        "ARR at risk": fixed("arr_at_risk", 0), "Average health": fixed("avg_health_score", 1), "Average NPS": fixed("avg_nps", 1),
        "Open tickets": F.col("open_tickets"), "Pending recommendations": F.col("pending_recommendations")})

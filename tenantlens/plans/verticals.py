"""Industry packs: finance, health, hospitality, manufacturing, retail, telecom."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from tenantlens.functions.columns import (
    ago, bands, clamp, day, days_ago, days_between, dec, mapped, mean, nz, ts,
)
from tenantlens.operators.latest import top_per
from tenantlens.settings import AS_OF
from tenantlens.sources.sinks import materialize

CO = ["customer_id", "org_id"]
SKU = ["org_id", "sku_id", "location_id"]


# -- finance ------------------------------------------------------------------
def portfolio_risk(c360: DataFrame, tickets: DataFrame, *, as_of=AS_OF) -> DataFrame:
    """Exposure, concentration, credit score and risk class per customer.

    The tenant total is one row per tenant, joined back, not a window: a
    window over the tenant would pull all its customers into one task. It is
    written first, so that Spark knows its size when it plans the join and
    does not exchange the customers by tenant.
    """
    risk, health, arr = F.col("churn_risk_level"), F.col("health_score"), F.col("arr")
    total = materialize(c360.groupBy("org_id").agg(F.sum("arr").alias("org_arr")))
    overdue = tickets.filter((F.col("category") == "billing") & (F.col("status") == "open")).groupBy(*CO).agg(
        F.max(days_between(F.col("created_at"), ts(as_of))).alias("days_past_due"))
    category = (
        F.when((risk == "HIGH") & (health < 30), "CRITICAL").when(risk == "HIGH", "HIGH")
        .when((risk == "MEDIUM") & (health < 50), "HIGH").when(risk == "MEDIUM", "MEDIUM").otherwise("LOW"))
    share = (arr.cast("double") * 100 / F.nullif(F.col("org_arr").cast("double"), F.lit(0.0)))
    return c360.select(*CO, "segment", "arr", "health_score", "churn_risk_level").join(total, "org_id").join(overdue, CO, "left").select(
        *CO, "segment", arr.alias("exposure_usd"), F.round(share, 2).alias("concentration_pct"),
        F.round(clamp(dec(health * dec(5.5, 4, 1) + 300, 12, 4), 300, 850), 0).alias("credit_score"),
        category.alias("risk_category"), nz("days_past_due").alias("days_past_due"),
        ((arr > 500000) & (health < 20)).alias("aml_alert"))


def portfolio_rollup(risk: DataFrame) -> DataFrame:
    return risk.groupBy("org_id", "segment", "risk_category").agg(
        F.count(F.lit(1)).alias("customer_count"), F.sum("exposure_usd").alias("total_exposure_usd"),
        F.round(mean("credit_score"), 0).alias("avg_credit_score"),
        F.round(mean(dec("concentration_pct", 7, 2)), 2).alias("avg_concentration_pct"),
        F.count_if("aml_alert").alias("aml_alerts"), F.count_if(F.col("days_past_due") > 30).alias("overdue_30d"))


# -- health -------------------------------------------------------------------
def patient_engagement(c360: DataFrame, tickets: DataFrame, *, as_of=AS_OF) -> DataFrame:
    gaps = tickets.filter((F.col("status") == "open") & (F.col("created_at") >= ago(as_of, days=90))) \
        .groupBy(*CO).agg(F.count(F.lit(1)).alias("care_gap_count"))
    health, risk = F.col("health_score"), F.col("churn_risk_level")
    readmission = dec((F.lit(100) - health) * dec(0.006, 6, 4), 12, 4) + F.when(risk == "HIGH", dec(0.3, 4, 2)).otherwise(dec(0, 4, 2))
    return c360.join(gaps, CO, "left").select(
        F.col("customer_id").alias("patient_id"), "org_id", health.alias("engagement_score"),
        mapped(risk, {"LOW": dec(85, 5, 1), "MEDIUM": dec(60, 5, 1), "HIGH": dec(35, 5, 1)}, dec(50, 5, 1)).alias("appointment_adherence"),
        nz("care_gap_count").alias("care_gap_count"),
        F.least(F.greatest(readmission, dec(0, 4, 2)), dec(0.99, 4, 2)).alias("readmission_risk"),
        bands(health, [(80, "WELL"), (60, "CHRONIC"), (40, "HIGH_RISK")], "COMPLEX").alias("population_segment"),
        day(as_of).alias("profile_date"))


def population_health(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("org_id", "population_segment", "profile_date").agg(
        F.count(F.lit(1)).alias("patient_count"), F.round(mean("engagement_score"), 1).alias("avg_engagement"),
        F.round(mean("appointment_adherence"), 1).alias("avg_adherence_pct"),
        F.round(mean("readmission_risk") * 100, 1).alias("avg_readmission_risk_pct"),
        F.sum("care_gap_count").alias("total_care_gaps"))


# -- hospitality --------------------------------------------------------------
def guest_profile(c360: DataFrame, *, as_of=AS_OF) -> DataFrame:
    arr, risk = F.col("arr"), F.col("churn_risk_level")
    bonus = F.when(risk == "LOW", dec(0.3, 4, 2)).otherwise(dec(0, 4, 2)) + F.when(arr > 10000, dec(0.1, 4, 2)).otherwise(dec(0, 4, 2))
    propensity = dec(F.col("health_score") * dec(0.006, 6, 4), 12, 4) + bonus
    return c360.select(
        F.col("customer_id").alias("guest_id"), "org_id", F.col("customer_name").alias("guest_name"), arr.alias("lifetime_value_usd"),
        bands(arr, [(50000, "ELITE"), (20000, "PLATINUM"), (10000, "GOLD"), (5000, "SILVER")], "BRONZE").alias("loyalty_tier"),
        F.greatest(F.lit(1), F.round(arr / 200, 0).cast("long")).alias("stays_count"),
        bands(arr, [(20000, 300), (10000, 200)], 120).alias("avg_daily_rate_usd"),
        risk.alias("churn_risk"),
        F.round(F.least(F.greatest(propensity, dec(0, 4, 2)), dec(0.95, 4, 2)), 4).alias("upsell_propensity"), "nps_score")


def property_revpar(performance: DataFrame, *, as_of=AS_OF) -> DataFrame:
    recent = performance.filter(F.col("performance_date") >= days_ago(as_of, 30))
    return recent.groupBy("org_id", "property_id").agg(
        F.round(mean("occupancy_rate"), 1).alias("avg_occupancy_pct"), F.round(mean("adr_usd"), 2).alias("avg_adr_usd"),
        F.round(mean("revpar_usd"), 2).alias("avg_revpar_usd"), F.round(mean("trevpar_usd"), 2).alias("avg_trevpar_usd"),
        F.round(mean("cancellation_rate"), 1).alias("avg_cancellation_pct"), F.round(mean("avg_los_nights"), 1).alias("avg_los_nights"),
        F.sum("ancillary_revenue").alias("total_ancillary_revenue"), F.max("performance_date").alias("last_updated"))


def vvip_at_risk(guests: DataFrame) -> DataFrame:
    return guests.filter(F.col("loyalty_tier").isin("PLATINUM", "ELITE", "GOLD") & F.col("churn_risk").isin("HIGH", "MEDIUM")).select(
        "org_id", "guest_id", "guest_name", "loyalty_tier", "lifetime_value_usd", "stays_count", "churn_risk", "upsell_propensity",
        "nps_score", F.round(F.col("lifetime_value_usd") * dec(0.3, 4, 2), 0).alias("estimated_loss_if_churned"))


# -- manufacturing ------------------------------------------------------------
def _pct(part: str, whole: str, default: float) -> Column:
    ratio = dec(F.col(part), 18, 4) * 100 / F.nullif(dec(F.col(whole), 18, 4), dec(0, 18, 4))
    return F.coalesce(ratio.cast("decimal(18,6)"), dec(default, 18, 6))


def oee(equipment: DataFrame, *, as_of=AS_OF) -> DataFrame:
    """Overall equipment effectiveness with defaults for missing denominators."""
    avail, perf, qual = _pct("uptime_hours", "planned_hours", 95), _pct("actual_units", "ideal_units", 90), _pct("good_units", "total_units", 98)
    due = F.date_add("last_maintenance_date", nz("maintenance_interval_days", 90))
    scrap = F.coalesce(dec("good_units", 18, 4) / F.nullif(dec("total_units", 18, 4), dec(0, 18, 4)), F.lit(1)) < 0.95
    tenth = lambda cond, w: F.when(cond, w).otherwise(0)  # noqa: E731  integer tenths stay exact
    risk = tenth(F.col("mtbf_hours") < 100, 4) + tenth(scrap, 3) + tenth(due < day(as_of), 4)
    product = avail.cast("decimal(12,6)") * perf.cast("decimal(12,6)") * qual.cast("decimal(12,6)") / 10000
    return equipment.filter("is_active").select(
        "org_id", "equipment_id", "plant_id", day(as_of).alias("measurement_date"),
        avail.alias("availability_pct"), perf.alias("performance_pct"), qual.alias("quality_pct"),
        F.round(product, 2).cast("decimal(10,2)").alias("oee_score"), "mtbf_hours", "mttr_hours", due.alias("maintenance_due"),
        F.least(dec(risk, 4, 0) / 10, dec(0.99, 4, 2)).cast("decimal(5,4)").alias("failure_risk_score"))


def maintenance_alerts(oee_rows: DataFrame, *, as_of=AS_OF) -> DataFrame:
    risk, score, due = F.col("failure_risk_score"), F.col("oee_score"), F.col("maintenance_due")
    hours = nz("mttr_hours", 8)
    return oee_rows.filter((risk >= 0.5) | (score < 65) | (due <= day(as_of))).select(
        "org_id", "equipment_id", "plant_id",
        F.when(due <= day(as_of), "CORRECTIVE").when(risk >= 0.7, "PREDICTIVE").otherwise("PREVENTIVE").alias("alert_type"),
        F.when((risk >= 0.8) | (due < day(as_of)), "CRITICAL").when(risk >= 0.5, "HIGH").otherwise("MEDIUM").alias("severity"),
        hours.alias("estimated_downtime_hours"), (hours * 5000).alias("cost_if_ignored_usd"),
        F.lit("open").alias("status"))


def oee_dashboard(oee_rows: DataFrame, alerts: DataFrame, *, as_of=AS_OF) -> DataFrame:
    keys = ["equipment_id", "org_id"]
    counts = alerts.filter(F.col("status") == "open").groupBy(*keys).agg(F.count(F.lit(1)).alias("open_alerts"))
    return oee_rows.join(counts, keys, "left").select(
        "org_id", "equipment_id", "plant_id", "oee_score", "availability_pct", "performance_pct", "quality_pct", "failure_risk_score",
        "maintenance_due", days_between(F.col("maintenance_due"), day(as_of)).alias("days_overdue"),
        nz("open_alerts").alias("open_alerts"),
        bands(F.col("oee_score"), [(85, "WORLD_CLASS"), (70, "GOOD"), (60, "ACCEPTABLE")], "POOR").alias("oee_tier"))


# -- retail -------------------------------------------------------------------
def moving_average(sales: DataFrame, *, rows: int = 7) -> DataFrame:
    """Average over the last ``rows`` sale days; history holds one row per day, so partitions stay small."""
    w = Window.partitionBy(*SKU).orderBy("sale_date").rowsBetween(-(rows - 1), 0)
    avg = F.sum("qty_sold").over(w) / F.count("qty_sold").over(w)
    return sales.withColumn("moving_avg", avg.cast("decimal(18,6)"))


def demand_forecast(sales: DataFrame, *, horizon_days: int = 30, lookback_days: int = 90, as_of=AS_OF) -> DataFrame:
    """Last moving average per SKU and location, repeated over the horizon.

    The latest day is picked before the horizon is generated, so the window
    sees history rows only, never history x horizon.
    """
    recent = sales.filter(F.col("sale_date") >= days_ago(as_of, lookback_days))
    last = top_per(moving_average(recent), SKU, [F.col("sale_date").desc()])
    days = F.sequence(day(as_of), day(as_of + dt.timedelta(days=horizon_days - 1)))
    avg = F.col("moving_avg")
    return last.select(
        *SKU, F.explode(days).alias("forecast_date"), F.round(avg, 0).alias("forecast_qty"),
        F.round(avg * dec(0.85, 4, 2), 0).alias("lower_bound_qty"), F.round(avg * dec(1.15, 4, 2), 0).alias("upper_bound_qty"))


def inventory_alerts(inventory: DataFrame, forecast: DataFrame, *, as_of=AS_OF) -> DataFrame:
    """Stock alerts where cover is below 14 or above 90 days."""
    window = F.col("forecast_date").between(day(as_of), day(as_of + dt.timedelta(days=30)))
    demand = forecast.filter(window).groupBy(*SKU).agg(F.round(mean("forecast_qty"), 0).cast("decimal(18,0)").alias("avg_daily_demand"))
    stock, need = F.col("current_stock"), F.col("avg_daily_demand")
    cover = dec(stock, 18, 4) / F.nullif(need, dec(0, 18, 0))
    return inventory.join(demand, SKU).withColumn("cover", cover).filter((F.col("cover") < 14) | (F.col("cover") > 90)).select(
        *SKU,
        F.when((stock == 0) | (F.col("cover") < 7), "STOCKOUT_RISK").when(F.col("cover") > 90, "OVERSTOCK").otherwise("SLOW_MOVER").alias("alert_type"),
        F.when(stock == 0, "CRITICAL").when(F.col("cover") < 3, "HIGH").when(F.col("cover") < 7, "MEDIUM").otherwise("LOW").alias("alert_severity"),
        "current_stock", (need * 14).alias("reorder_point"), F.round("cover", 1).alias("days_of_cover"),
        F.greatest(F.lit(0), need * 30 - stock).alias("recommended_qty"), F.lit("open").alias("status"), ts(as_of).alias("created_at"))


def auto_close(alerts: DataFrame, *, days: int = 2, as_of=AS_OF) -> DataFrame:
    stale = (F.col("status") == "open") & (F.col("created_at") < ago(as_of, days=days))
    return alerts.withColumn("status", F.when(stale, "auto_closed").otherwise(F.col("status")))


def inventory_dashboard(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("status") == "open").groupBy("org_id", "alert_type", "alert_severity").agg(
        F.count(F.lit(1)).alias("alert_count"), F.sum("recommended_qty").alias("total_recommended_qty"),
        F.round(mean("days_of_cover"), 1).alias("avg_days_of_cover"), F.max("created_at").alias("latest_alert"))


def promotion_performance(promotions: DataFrame, sales: DataFrame) -> DataFrame:
    """Revenue and units per promotion; sales are summed per promotion before the join."""
    sold = sales.groupBy("promotion_id").agg(F.sum("revenue_usd").alias("revenue_usd"), F.sum("qty_sold").alias("units_sold"))
    return promotions.join(sold, "promotion_id", "left").select(
        "promotion_id", "name", "start_date", "end_date", "discount_pct", nz("revenue_usd").alias("revenue_usd"),
        nz("units_sold").alias("units_sold"), nz("cost_usd").alias("cost_usd"))


# -- telecom ------------------------------------------------------------------
def telecom_quality(c360: DataFrame, network: DataFrame, *, as_of=AS_OF) -> DataFrame:
    """QoS score, ARPU and churn probability per customer.

    Network rows are reduced to one 30-day row per customer first; the source
    joins the raw rows.
    """
    def avg(c):
        return mean(c).cast("decimal(18,6)").alias(c)

    recent = network.filter(F.col("event_date") >= days_ago(as_of, 30)).groupBy(*CO).agg(
        avg("avg_latency_ms"), avg("avg_packet_loss_pct"), avg("avg_downtime_hours"), F.sum("complaints_30d").alias("complaints_30d"))
    j = c360.join(recent, CO, "left").withColumns({
        "avg_latency_ms": F.coalesce("avg_latency_ms", dec(20, 18, 6)), "avg_packet_loss_pct": F.coalesce("avg_packet_loss_pct", dec(0, 18, 6)),
        "avg_downtime_hours": F.coalesce("avg_downtime_hours", dec(0, 18, 6)), "complaints_30d": nz("complaints_30d")})
    lat = F.greatest(dec(0, 18, 6), F.col("avg_latency_ms") - 20) * dec(0.5, 4, 2)
    qos = F.lit(100) - lat - F.col("avg_packet_loss_pct") * 10 - F.col("avg_downtime_hours") * 5 - F.col("complaints_30d") * 3
    bump = mapped(F.col("churn_risk_level"), {"HIGH": dec(0.3, 4, 2), "MEDIUM": dec(0.15, 4, 2)}, dec(0, 4, 2))
    churn = dec((F.lit(100) - F.col("health_score")) * dec(0.005, 6, 4), 12, 4) + dec(F.col("complaints_30d") * dec(0.03, 4, 2), 12, 4) + bump
    return j.select(
        *CO, "customer_name", "segment", dec(F.col("arr") / 12, 20, 2).alias("arpu_usd"),
        F.greatest(F.lit(0), F.least(F.lit(100), F.round(qos, 4))).alias("qos_score"),
        *[F.round(c, 4).alias(c) for c in ("avg_latency_ms", "avg_packet_loss_pct", "avg_downtime_hours")], "complaints_30d",
        F.round(F.least(dec(0.99, 4, 2), churn), 4).alias("churn_probability"), day(as_of).alias("profile_date"))


def churn_arpu_matrix(quality: DataFrame) -> DataFrame:
    p, arpu = F.col("churn_probability"), F.col("arpu_usd")
    urgency = F.when((p >= 0.7) & (arpu >= 1000), "CRITICAL").otherwise(bands(p, [(0.5, "HIGH"), (0.3, "MEDIUM")], "LOW"))
    return quality.select(
        *CO, "customer_name", "segment", "arpu_usd", "qos_score", "churn_probability",
        F.round(arpu * 12 * p, 0).alias("arr_at_risk_usd"), "complaints_30d", "avg_downtime_hours", urgency.alias("intervention_priority"))

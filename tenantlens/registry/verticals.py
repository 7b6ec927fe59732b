"""Industry-pack queries."""

from pyspark.sql import functions as F

from tenantlens.functions.columns import ago
from tenantlens.plans import verticals as v
from tenantlens.registry.core import define, exact_avg, query
from tenantlens.registry.oracle_tables import D0, T0
from tenantlens.registry.profile import c360
from tenantlens.sources.sinks import materialize
from tenantlens.settings import AS_OF

define("m_portfolio", f"""
SELECT c.customer_id, c.org_id, c.segment, arr AS exposure_usd, round(arr::DOUBLE * 100 / nullif(org_arr, 0)::DOUBLE, 2) AS concentration_pct,
  round(greatest(300, least(850, 300 + health_score * 5.5)), 0) AS credit_score,
  CASE WHEN churn_risk_level = 'HIGH' AND health_score < 30 THEN 'CRITICAL' WHEN churn_risk_level = 'HIGH' THEN 'HIGH'
    WHEN churn_risk_level = 'MEDIUM' AND health_score < 50 THEN 'HIGH' WHEN churn_risk_level = 'MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS risk_category,
  coalesce(days_past_due, 0) AS days_past_due, arr > 500000 AND health_score < 20 AS aml_alert
FROM m_c360 c JOIN (SELECT org_id, sum(arr) AS org_arr FROM m_c360 GROUP BY 1) s ON c.org_id = s.org_id
LEFT JOIN (SELECT customer_id, max(date_diff('day', created_at, {T0})) AS days_past_due FROM b_tickets
  WHERE category = 'billing' AND status = 'open' GROUP BY 1) t ON c.customer_id = t.customer_id""")


def portfolio(t):
    mart = materialize(c360(t).select("customer_id", "org_id", "segment", "arr", "health_score", "churn_risk_level"))
    return v.portfolio_risk(mart, t.tickets)


@query("e40_portfolio_risk", "SELECT * FROM m_portfolio", nums="exposure_usd credit_score")
def _(t):
    return portfolio(t)


@query("e41_portfolio_rollup", f"""
SELECT org_id, segment, risk_category, count(*) AS customer_count, sum(exposure_usd) AS total_exposure_usd,
  round(avg(credit_score), 0) AS avg_credit_score, {exact_avg('CAST(concentration_pct AS DECIMAL(7,2))', 2)} AS avg_concentration_pct,
  count(*) FILTER (aml_alert) AS aml_alerts, count(*) FILTER (days_past_due > 30) AS overdue_30d
FROM m_portfolio GROUP BY 1, 2, 3""", nums="total_exposure_usd")
def _(t):
    return v.portfolio_rollup(portfolio(t))


define("m_patients", f"""
SELECT c.customer_id AS patient_id, c.org_id, health_score AS engagement_score,
  CASE churn_risk_level WHEN 'LOW' THEN 85.0 WHEN 'MEDIUM' THEN 60.0 WHEN 'HIGH' THEN 35.0 ELSE 50.0 END AS appointment_adherence,
  coalesce(n, 0) AS care_gap_count,
  least(0.99, greatest(0, (100 - health_score) * 0.006 + CASE WHEN churn_risk_level = 'HIGH' THEN 0.3 ELSE 0 END)) AS readmission_risk,
  CASE WHEN health_score >= 80 THEN 'WELL' WHEN health_score >= 60 THEN 'CHRONIC' WHEN health_score >= 40 THEN 'HIGH_RISK' ELSE 'COMPLEX' END AS population_segment,
  {D0} AS profile_date
FROM m_c360 c LEFT JOIN (SELECT customer_id, count(*) AS n FROM b_tickets WHERE status = 'open' AND created_at >= {D0} - 90 GROUP BY 1) t
  ON c.customer_id = t.customer_id""")


def patients(t):
    return v.patient_engagement(c360(t), t.tickets)


@query("e42_patient_engagement", "SELECT * FROM m_patients", dates="profile_date", nums="engagement_score appointment_adherence readmission_risk")
def _(t):
    return patients(t)


@query("e43_population_health", """
SELECT org_id, population_segment, profile_date, count(*) AS patient_count, round(avg(engagement_score), 1) AS avg_engagement,
  round(avg(appointment_adherence), 1) AS avg_adherence_pct, round(avg(readmission_risk) * 100, 1) AS avg_readmission_risk_pct,
  CAST(sum(care_gap_count) AS BIGINT) AS total_care_gaps FROM m_patients GROUP BY 1, 2, 3""", dates="profile_date")
def _(t):
    return v.population_health(patients(t))


define("m_guests", """
SELECT customer_id AS guest_id, org_id, customer_name AS guest_name, arr AS lifetime_value_usd,
  CASE WHEN arr >= 50000 THEN 'ELITE' WHEN arr >= 20000 THEN 'PLATINUM' WHEN arr >= 10000 THEN 'GOLD' WHEN arr >= 5000 THEN 'SILVER' ELSE 'BRONZE' END AS loyalty_tier,
  greatest(1, CAST(round(arr * 0.005, 0) AS BIGINT)) AS stays_count,
  CASE WHEN arr >= 20000 THEN 300 WHEN arr >= 10000 THEN 200 ELSE 120 END::BIGINT AS avg_daily_rate_usd, churn_risk_level AS churn_risk,
  round(least(0.95, greatest(0, health_score * 0.006 + CASE WHEN churn_risk_level = 'LOW' THEN 0.3 ELSE 0 END + CASE WHEN arr > 10000 THEN 0.1 ELSE 0 END)), 4) AS upsell_propensity,
  nps_score FROM m_c360""")


@query("e44_guest_profile", "SELECT * FROM m_guests", nums="lifetime_value_usd upsell_propensity")
def _(t):
    return v.guest_profile(c360(t))


@query("e45_property_revpar", f"""
SELECT org_id, property_id, {exact_avg('occupancy_rate', 1)} AS avg_occupancy_pct, {exact_avg('adr_usd', 2)} AS avg_adr_usd,
  {exact_avg('revpar_usd', 2)} AS avg_revpar_usd, {exact_avg('trevpar_usd', 2)} AS avg_trevpar_usd, {exact_avg('cancellation_rate', 1)} AS avg_cancellation_pct,
  {exact_avg('avg_los_nights', 1)} AS avg_los_nights, sum(ancillary_revenue) AS total_ancillary_revenue, max(performance_date) AS last_updated
FROM b_property_performance WHERE performance_date >= {D0} - 30 GROUP BY 1, 2""", dates="last_updated", nums="total_ancillary_revenue")
def _(t):
    return v.property_revpar(t.property_performance)


@query("e46_vvip_at_risk", """
SELECT org_id, guest_id, guest_name, loyalty_tier, lifetime_value_usd, stays_count, churn_risk, upsell_propensity, nps_score,
  round(lifetime_value_usd * 0.3, 0) AS estimated_loss_if_churned FROM m_guests
WHERE loyalty_tier IN ('GOLD', 'PLATINUM', 'ELITE') AND churn_risk IN ('HIGH', 'MEDIUM')""", nums="lifetime_value_usd upsell_propensity estimated_loss_if_churned")
def _(t):
    return v.vvip_at_risk(v.guest_profile(c360(t)))


define("m_oee", f"""
SELECT org_id, equipment_id, plant_id, {D0} AS measurement_date, a AS availability_pct, f AS performance_pct, q AS quality_pct,
  CAST(round(a::DECIMAL(12,6) * f::DECIMAL(12,6) * q::DECIMAL(12,6), -2) AS DECIMAL(18,2)) / 10000 AS oee_score, mtbf_hours, mttr_hours, due AS maintenance_due,
  least(0.99, (CASE WHEN mtbf_hours < 100 THEN 4 ELSE 0 END + CASE WHEN coalesce(good_units / nullif(total_units, 0), 1) < 0.95 THEN 3 ELSE 0 END
    + CASE WHEN due < {D0} THEN 4 ELSE 0 END) * 0.1) AS failure_risk_score
FROM (SELECT *, CAST(coalesce(uptime_hours * 100 / nullif(planned_hours, 0), 95) AS DECIMAL(18,6)) AS a,
    CAST(coalesce(actual_units * 100 / nullif(ideal_units, 0), 90) AS DECIMAL(18,6)) AS f,
    CAST(coalesce(good_units * 100 / nullif(total_units, 0), 98) AS DECIMAL(18,6)) AS q,
    last_maintenance_date + coalesce(maintenance_interval_days, 90) AS due FROM b_equipment WHERE is_active)""")
define("m_maintenance", f"""
SELECT org_id, equipment_id, plant_id,
  CASE WHEN maintenance_due <= {D0} THEN 'CORRECTIVE' WHEN failure_risk_score >= 0.7 THEN 'PREDICTIVE' ELSE 'PREVENTIVE' END AS alert_type,
  CASE WHEN failure_risk_score >= 0.8 OR maintenance_due < {D0} THEN 'CRITICAL' WHEN failure_risk_score >= 0.5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  mttr_hours AS estimated_downtime_hours, mttr_hours * 5000 AS cost_if_ignored_usd, 'open' AS status
FROM m_oee WHERE failure_risk_score >= 0.5 OR oee_score < 65 OR maintenance_due <= {D0}""")


@query("e47_oee", "SELECT * FROM m_oee", dates="measurement_date maintenance_due", nums="availability_pct performance_pct quality_pct failure_risk_score")
def _(t):
    return v.oee(t.equipment)


@query("e48_maintenance_alerts", "SELECT * FROM m_maintenance")
def _(t):
    return v.maintenance_alerts(v.oee(t.equipment))


@query("e49_oee_dashboard", f"""
SELECT o.org_id, o.equipment_id, o.plant_id, oee_score, availability_pct, performance_pct, quality_pct, failure_risk_score, maintenance_due,
  date_diff('day', maintenance_due, {D0}) AS days_overdue, count(a.alert_type) AS open_alerts,
  CASE WHEN oee_score >= 85 THEN 'WORLD_CLASS' WHEN oee_score >= 70 THEN 'GOOD' WHEN oee_score >= 60 THEN 'ACCEPTABLE' ELSE 'POOR' END AS oee_tier
FROM m_oee o LEFT JOIN m_maintenance a ON o.equipment_id = a.equipment_id AND o.org_id = a.org_id GROUP BY ALL""",
       dates="maintenance_due", nums="availability_pct performance_pct quality_pct failure_risk_score")
def _(t):
    rows = v.oee(t.equipment)
    return v.oee_dashboard(rows, v.maintenance_alerts(rows))


define("m_moving", """
SELECT *, CAST(avg(qty_sold) OVER (PARTITION BY org_id, sku_id, location_id ORDER BY sale_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS DECIMAL(18,6)) AS moving_avg
FROM b_sales_history""")
define("m_demand", f"""
SELECT org_id, sku_id, location_id, CAST(d AS DATE) AS forecast_date, round(m, 0) AS forecast_qty, round(m * 0.85, 0) AS lower_bound_qty, round(m * 1.15, 0) AS upper_bound_qty
FROM (SELECT org_id, sku_id, location_id, sale_date, CAST(avg(qty_sold) OVER (PARTITION BY org_id, sku_id, location_id ORDER BY sale_date
      ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS DECIMAL(18,6)) AS m,
    row_number() OVER (PARTITION BY org_id, sku_id, location_id ORDER BY sale_date DESC) AS rn
  FROM b_sales_history WHERE sale_date >= {D0} - 90), generate_series({D0}::TIMESTAMP, {D0}::TIMESTAMP + INTERVAL 29 DAYS, INTERVAL 1 DAY) AS g(d) WHERE rn = 1""")
define("m_inventory_alerts", f"""
SELECT org_id, sku_id, location_id, CASE WHEN current_stock = 0 OR cover < 7 THEN 'STOCKOUT_RISK' WHEN cover > 90 THEN 'OVERSTOCK' ELSE 'SLOW_MOVER' END AS alert_type,
  CASE WHEN current_stock = 0 THEN 'CRITICAL' WHEN cover < 3 THEN 'HIGH' WHEN cover < 7 THEN 'MEDIUM' ELSE 'LOW' END AS alert_severity,
  current_stock, need * 14 AS reorder_point, round(cover, 1) AS days_of_cover, greatest(0, need * 30 - current_stock) AS recommended_qty,
  'open' AS status, {T0} AS created_at
FROM (SELECT i.*, need, current_stock / nullif(need, 0) AS cover FROM b_inventory i
  JOIN (SELECT org_id, sku_id, location_id, round(avg(forecast_qty), 0) AS need FROM m_demand GROUP BY 1, 2, 3) f USING (org_id, sku_id, location_id))
WHERE cover < 14 OR cover > 90""")


def alerts(t):
    return v.inventory_alerts(t.inventory, v.demand_forecast(t.sales_history))


@query("f3_moving_average", "SELECT org_id, sku_id, location_id, sale_date, moving_avg FROM m_moving", dates="sale_date", nums="moving_avg")
def _(t):
    return v.moving_average(t.sales_history).select(*v.SKU, "sale_date", "moving_avg")


@query("e50_demand_forecast", "SELECT * FROM m_demand", dates="forecast_date", nums="forecast_qty lower_bound_qty upper_bound_qty")
def _(t):
    return v.demand_forecast(t.sales_history)


@query("e51_inventory_alerts", "SELECT * FROM m_inventory_alerts", times="created_at", nums="reorder_point recommended_qty")
def _(t):
    return alerts(t)


@query("e52_auto_close_alerts", f"""
SELECT recommendation_id, CASE WHEN status = 'pending' AND created_at < {T0} - INTERVAL 2 DAYS THEN 'auto_closed'
  WHEN status = 'pending' THEN 'open' ELSE status END AS status FROM b_recommendations""")
def _(t):
    rows = t.recommendations.withColumn("status", F.when(F.col("status") == "pending", "open").otherwise(F.col("status")))
    return v.auto_close(rows).select("recommendation_id", "status")


@query("e53_inventory_dashboard", """
SELECT org_id, alert_type, alert_severity, count(*) AS alert_count, sum(recommended_qty) AS total_recommended_qty,
  round(avg(days_of_cover::DECIMAL(18,1)), 1) AS avg_days_of_cover, max(created_at) AS latest_alert FROM m_inventory_alerts GROUP BY 1, 2, 3""",
       times="latest_alert", nums="total_recommended_qty")
def _(t):
    return v.inventory_dashboard(alerts(t))


@query("e54_promotion_performance", """
SELECT promotion_id, name, start_date, end_date, discount_pct, coalesce(sum(revenue_usd), 0) AS revenue_usd, coalesce(sum(qty_sold), 0) AS units_sold,
  cost_usd FROM b_promotions LEFT JOIN b_sales_history ON sku_id = promotion_id GROUP BY ALL""",
       dates="start_date end_date", nums="revenue_usd units_sold cost_usd")
def _(t):
    sales = t.sales_history.withColumn("promotion_id", F.col("sku_id"))
    return v.promotion_performance(t.promotions, sales)


define("m_telecom", f"""
SELECT customer_id, org_id, customer_name, segment, CAST(arr / 12 AS DECIMAL(20,2)) AS arpu_usd,
  greatest(0, least(100, round(100 - greatest(0, lat - 20) * 0.5 - loss * 10 - down * 5 - complaints * 3, 4))) AS qos_score,
  round(lat, 4) AS avg_latency_ms, round(loss, 4) AS avg_packet_loss_pct, round(down, 4) AS avg_downtime_hours, complaints AS complaints_30d,
  round(least(0.99, (100 - health_score) * 0.005 + complaints * 0.03
    + CASE churn_risk_level WHEN 'HIGH' THEN 0.3 WHEN 'MEDIUM' THEN 0.15 ELSE 0 END), 4) AS churn_probability, {D0} AS profile_date
FROM (SELECT c.*, coalesce(lat, 20)::DECIMAL(18,6) AS lat, coalesce(loss, 0)::DECIMAL(18,6) AS loss, coalesce(down, 0)::DECIMAL(18,6) AS down,
    CAST(coalesce(complaints, 0) AS BIGINT) AS complaints
  FROM m_c360 c LEFT JOIN (SELECT customer_id, org_id, CAST(avg(avg_latency_ms) AS DECIMAL(18,6)) AS lat,
    CAST(avg(avg_packet_loss_pct) AS DECIMAL(18,6)) AS loss, CAST(avg(avg_downtime_hours) AS DECIMAL(18,6)) AS down, sum(complaints_30d) AS complaints
    FROM b_network_events WHERE event_date >= {D0} - 30 GROUP BY 1, 2) n ON c.customer_id = n.customer_id AND c.org_id = n.org_id)""")
_TEL = "arpu_usd qos_score avg_latency_ms avg_packet_loss_pct avg_downtime_hours churn_probability"


def quality(t):
    return v.telecom_quality(c360(t), t.network_events)


@query("e55_telecom_quality", "SELECT * FROM m_telecom", dates="profile_date", nums=_TEL)
def _(t):
    return quality(t)


@query("e56_churn_arpu_matrix", """
SELECT customer_id, org_id, customer_name, segment, arpu_usd, qos_score, churn_probability, round(arpu_usd * 12 * churn_probability, 0) AS arr_at_risk_usd,
  complaints_30d, avg_downtime_hours, CASE WHEN churn_probability >= 0.7 AND arpu_usd >= 1000 THEN 'CRITICAL' WHEN churn_probability >= 0.5 THEN 'HIGH'
    WHEN churn_probability >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS intervention_priority FROM m_telecom""",
       nums="arpu_usd qos_score churn_probability arr_at_risk_usd avg_downtime_hours")
def _(t):
    return v.churn_arpu_matrix(quality(t))

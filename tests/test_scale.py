"""Results must not move when a side repeats, and must hold with one hot key."""

import datetime as dt

import __spark_entry__ as entry
from conftest import SF_DIR, rows
from pyspark.sql import functions as F

from tenantlens.operators import staging as st
from tenantlens.plans import kpis, profile as p, revenue as rv
from tenantlens.settings import AS_OF
from tenantlens.sources.bindings import Tables


def c360(t, **swap):
    args = {n: getattr(t, n) for n in ("customers", "subscriptions", "tickets", "product_events", "churn_scores")}
    args.update(swap)
    return p.customer_360_weighted(args["customers"], args["subscriptions"], args["tickets"], args["product_events"], args["churn_scores"])


def totals(df):
    r = df.agg(F.count(F.lit(1)), F.sum("arr"), F.sum("total_seats"), F.sum("events_30d")).first()
    return tuple(r)


def test_repeated_scores_and_tickets_do_not_multiply_customers(spark):
    t = Tables(spark, SF_DIR)
    base = totals(c360(t))
    assert base[0] == t.customers.count()
    assert totals(c360(t, churn_scores=t.churn_scores.unionByName(t.churn_scores))) == base
    assert totals(c360(t, tickets=t.tickets.unionByName(t.tickets))) == base


def test_kpi_totals_ignore_ticket_fan_out(spark):
    t = Tables(spark, SF_DIR)
    once = rows(kpis.executive_kpis_risk(t.customers, t.churn_scores, t.tickets), "org_id", "total_arr", "total_customers")
    twice = rows(kpis.executive_kpis_risk(t.customers, t.churn_scores, t.tickets.unionByName(t.tickets)), "org_id", "total_arr", "total_customers")
    assert once == twice


def test_two_runs_agree(spark):
    def run():
        return rows(c360(Tables(spark, SF_DIR)), "customer_id", "health_score", "primary_plan_tier", "sentiment_label", "usage_trend")

    assert run() == run()


def test_hot_customer_usage_matches_brute_force(spark):
    n = 30000
    i = F.col("id")
    events = spark.range(n).select(
        F.concat(F.lit("e"), i).alias("event_id"), F.lit("o").alias("org_id"),
        F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), i % 97)).alias("customer_id"),
        F.concat(F.lit("t"), i % 5).alias("event_type"), F.concat(F.lit("f"), i % 13).alias("feature_name"),
        F.lit(1).alias("event_value"), F.lit(None).cast("string").alias("platform"),
        (F.lit(AS_OF) - F.make_dt_interval((i % 60).cast("int"))).alias("occurred_at"))
    got = p.usage_metrics(st.stg_product_events(events)).filter("customer_id = 'hot'").first()
    ids = [k for k in range(n) if k % 3 == 0]
    ages = [k % 60 for k in ids]
    assert got.total_events == len(ids) and got.features_used == 13 and got.unique_event_types == 5
    assert got.events_30d == sum(a <= 30 for a in ages) and got.events_7d == sum(a <= 7 for a in ages)
    assert got.active_days_30d == len({a for a in ages if a <= 30}) and got.active_days_7d == len({a for a in ages if a <= 7})


def test_aggregates_are_partial_before_the_exchange(spark):
    t = Tables(spark, SF_DIR)
    plan = rv.support_intelligence(t.tickets)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("functions=[partial_") > plan.index("Exchange hashpartitioning(org_id")


def test_date_filters_reach_the_scan(spark):
    t = Tables(spark, SF_DIR)
    plan = p.usage_windows(t.product_events)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    scan = [line for line in plan.splitlines() if "FileScan" in line and "ts#" in line][0]
    assert "event_id" not in scan.split("Batched")[0]


def test_trailing_window_recomputes_only_recent_days(spark):
    t = Tables(spark, SF_DIR)
    since = (AS_OF - dt.timedelta(days=30)).date()
    days = rv.revenue_daily(st.stg_transactions(t.transactions), since=since)
    assert days.agg(F.min("revenue_date")).first()[0] >= since


def optimized(spark, key):
    return entry.queries()[key](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()


def test_revenue_is_not_expanded(spark):
    for key in ("e12_revenue_daily", "e13_revenue_movement"):
        assert "Expand" not in optimized(spark, key), key


def test_each_text_is_split_once(spark):
    assert optimized(spark, "m6_sentiment").count("regexp_extract_all") == 1
    assert optimized(spark, "m11_classify").count("regexp_extract_all") == 2  # two branches of a union


def test_texts_stay_where_they_are(spark):
    for key in ("m6_sentiment", "m7_paragraph_chunks", "m8_window_chunks", "m12_summary"):
        plan = entry.queries()[key](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan, key


"""Boundary values of the row rules."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import Observation, functions as F

from tenantlens.functions import columns as cb, masks as mk
from tenantlens.operators import churn as ch, staging as st
from tenantlens.plans import actions as ac, content as co, profile as p
from tenantlens.settings import AS_OF


@pytest.mark.parametrize("prob,level", [(0.70, "HIGH"), (0.99, "HIGH"), (0.65, "HIGH"), (0.50, "MEDIUM"), (0.35, "MEDIUM"), (0.34, "LOW"), (0.0, "LOW")])
def test_risk_level(frame, prob, level):
    assert frame([(prob,)], "p double").select(cb.risk_level(F.col("p"))).first()[0] == level


def test_crossed_boundaries(frame):
    t = dt.datetime
    df = frame([(t(2024, 1, 1, 0, 59), t(2024, 1, 1, 1, 1)), (t(2024, 1, 1, 1, 0), t(2024, 1, 1, 1, 59)), (t(2024, 1, 1, 23, 59), t(2024, 1, 2, 0, 1))], "a timestamp, b timestamp")
    got = df.select(cb.hours_between(F.col("a"), F.col("b")), cb.days_between(F.col("a"), F.col("b")), cb.minutes_between(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(1, 0, 2), (0, 0, 59), (1, 1, 2)]


def test_null_propagating_extremes(frame):
    df = frame([(None, 5), (1, 5)], "a int, b int")
    assert rows(df.select(F.coalesce(cb.null_greatest(F.col("a"), F.col("b")), F.lit(-1)), F.coalesce(cb.null_least(F.col("a"), F.col("b")), F.lit(-1)))) == [(-1, -1), (5, 1)]
    assert df.select(cb.clamp(F.col("a"), 0, 100)).first()[0] is None


@pytest.mark.parametrize("week,month,trend", [(0, 0, "no_data"), (7, 20, "up"), (6, 20, "stable"), (4, 20, "stable"), (3, 20, "down")])
def test_usage_trend(frame, week, month, trend):
    assert frame([(week, month)], "a long, b long").select(cb.usage_trend(F.col("a"), F.col("b"))).first()[0] == trend


FEATURES = "health_score double, nps_score int, active_days_30d int, days_since_last_activity int, sla_breaches int, open_tickets int, mrr double, customer_id string, org_id string"


def test_drivers_are_ranked_and_limited(frame):
    df = frame([(35.0, -30, 3, 20, 3, 5, 500.0, "c", "o"), (90.0, 50, 25, 0, 0, 0, 900.0, "d", "o")], FEATURES)
    got = {r[0]: r[1] for r in df.select("customer_id", ch.top_drivers()).collect()}
    assert got == {"c": ["critical_health_score", "very_low_nps", "low_engagement"], "d": [ch.DEFAULT_DRIVER]}


@pytest.mark.parametrize("risk,drivers,action", [
    ("HIGH", ["low_engagement"], "low_engagement"), ("HIGH", ["low_mrr", "repeated_sla_breaches"], "repeated_sla_breaches"), ("HIGH", ["low_mrr"], "any"),
    ("MEDIUM", ["low_mrr", "very_low_nps"], "very_low_nps"), ("MEDIUM", ["low_mrr"], "any"), ("LOW", ["very_low_nps"], "any"), ("HIGH", [], "any")])
def test_actions(frame, risk, drivers, action):
    df = frame([(risk, drivers)], "r string, d array<string>")
    assert df.select(ch.recommended_action(F.col("r"), F.col("d"))).first()[0] == ch.ACTIONS[risk, action]


def test_score_rows_clamps_and_prices(frame):
    df = frame([(50.0, 0, 10, 1, 0, 0, 100.0, "c", "o")], FEATURES)
    r = ch.score_rows(df, F.lit(1.7)).first()
    assert (float(r.churn_probability), r.risk_level, float(r.expected_revenue_at_risk)) == (1.0, "HIGH", 1200.0)


def test_null_subscription_status_is_dropped(frame):
    schema = ("subscription_id string, org_id string, customer_id string, product_id string, plan_name string, plan_tier string, status string, seats int, "
              "mrr decimal(18,2), arr decimal(18,2), trial_end_date date, current_period_start date, current_period_end date, cancel_at date, canceled_at timestamp, created_at timestamp")
    base = ("o", "c", "p", "plan", None, None, None, None, None, None, None, None, None, None, None)
    made = [("s1", *base[:5], None, *base[6:]), ("s2", *base[:5], "active", *base[6:]), ("s3", *base[:5], "deleted", *base[6:])]
    out = st.stg_subscriptions(frame(made, schema)).collect()
    assert [(r.subscription_id, r.seats, float(r.arr), r.plan_tier) for r in out] == [("s2", 1, 0.0, "standard")]


@pytest.mark.parametrize("days,state", [(-1, "EXPIRED"), (0, "EXPIRING_SOON"), (30, "EXPIRING_SOON"), (31, "RENEW_WATCH"), (90, "RENEW_WATCH"), (91, "ACTIVE"), (None, "ACTIVE")])
def test_renewal_status(frame, days, state):
    end = None if days is None else (AS_OF + dt.timedelta(days=days)).date()
    docs = frame([("d", "o", "n", "contract", "c", end, True, ["x"], AS_OF)],
                 "document_id string, org_id string, document_name string, document_type string, entity_id string, end_date date, auto_renewal boolean, risk_flags array<string>, created_at timestamp")
    c360 = frame([("c", "o", "Name")], "customer_id string, org_id string, customer_name string")
    assert co.contract_intelligence(docs, c360).first().renewal_status == state


@pytest.mark.parametrize("days,points", [(20, 100), (10, 70), (5, 40), (4, 10)])
def test_usage_points(frame, days, points):
    assert frame([(days,)], "d int").select(cb.bands(F.col("d"), [(20, 100), (10, 70), (5, 40)], 10)).first()[0] == points


def test_opportunity_without_score_falls_to_last_band(frame):
    customers = frame([("c", "o", "N", "active", 90000, AS_OF.date())], "customer_id string, org_id string, name string, lifecycle_stage string, arr int, contract_end_date date")
    customers = customers.withColumn("arr", cb.dec("arr"))
    scores = frame([], "customer_id string, org_id string, churn_probability decimal(5,4), scored_at timestamp, score_id string")
    r = ac.opportunity_score(customers, scores).first()
    assert (float(r.opportunity_score), r.opportunity_type, r.confidence, r.reasoning) == (0.1, "renewal", None, None)


def test_usage_days_ignore_the_future_and_count_bits(frame):
    def at(d):
        return AS_OF - dt.timedelta(days=d)

    made = [("e%d" % i, "o", "c", "t", "f", at(d)) for i, d in enumerate([0, 0, 6, 7, 8, 29, 30, 31, -2])]
    events = frame(made, "event_id string, org_id string, customer_id string, event_type string, feature_name string, occurred_at timestamp")
    events = events.withColumns({"occurred_date": F.to_date("occurred_at"), "is_ai_event": F.lit(False), "is_error_event": F.lit(False)})
    r = p.usage_metrics(events).first()
    assert (r.total_events, r.active_days_30d, r.active_days_7d, r.events_30d, r.events_7d) == (8, 6, 3, 7, 4)
    w = p.usage_windows(events).first()
    assert (w.events_30d, w.active_days_30d, w.events_7d, w.active_days_7d) == (7, 6, 4, 3)


def test_masks(frame):
    df = frame([("john@x.com", "5511987654321", "Ann Lee Ray"), ("a@x.com", "123", "Bo"), (None, None, None)], "e string, p string, n string")
    got = [tuple(r) for r in df.select(mk.mask_email("e"), mk.mask_phone("p"), mk.mask_name("n")).collect()]
    assert got == [("jo***@x.com", "55****21", "Ann ****"), ("a***@x.com", "123", "Bo ****"), (None, None, None)]


def test_plan_names_are_distinct_and_ordered(frame):
    subs = frame([("c", "o", "basic", 5), ("c", "o", "pro", 50), ("c", "o", "basic", 7), ("c", "o", "add", 7)], "customer_id string, org_id string, plan_name string, arr int")
    assert p.plan_names(subs).first().plan_names == "pro | add | basic"


def test_dominant_tier_and_sentiment_ties(frame):
    subs = frame([("c", "o", "active", "b", 1, 1, 1, None), ("c", "o", "active", "a", 1, 1, 1, None), ("c", "o", "cancelled", "0", 1, 1, 1, None), ("d", "o", "paused", "a", 1, 1, 1, None)],
                 "customer_id string, org_id string, status string, plan_tier string, mrr int, arr int, seats int, renewal_date date")
    got = {x.customer_id: (x.primary_plan_tier, x.active_subscriptions, x.cancelled_subs) for x in p.subscription_metrics(subs).collect()}
    assert got == {"c": ("a", 2, 1), "d": (None, 0, 0)}
    tickets = frame([("c", "o", x, "open", "low", False, 0.1, None, AS_OF) for x in ("positive", "neutral", "neutral", "positive")] + [("d", "o", "positive", "open", "low", True, 0.5, 3, AS_OF)],
                    "customer_id string, org_id string, sentiment_label string, status string, priority string, sla_breached boolean, sentiment_score double, resolution_hours int, created_at timestamp")
    assert {x.customer_id: x.dominant_sentiment for x in p.ticket_metrics(tickets).collect()} == {"c": "neutral", "d": "positive"}


def test_model_scores_after_an_observation(spark, frame):
    """A fitted model must not drag the session into its tasks: an observed one does not serialise."""
    made = [(f"c{i}", "o", "churned" if i % 2 else "active", 30.0 + 40 * (i % 2 == 0) + i, 0, 0.5, 10, 5, 3, 1, 0, 100.0) for i in range(12)]
    features = frame(made, "customer_id string, org_id string, lifecycle_stage string, health_score double, nps_score int, churn_probability double, events_30d int, "
                           "active_days_30d int, days_since_last_activity int, open_tickets int, sla_breaches int, mrr double")
    seen = Observation()
    features.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 12}
    assert len(ch.score_churn(ch.fit_churn(features), features).collect()) == 6

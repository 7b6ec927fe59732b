"""Series, quality, governance, workflow, streaming and skew."""

import datetime as dt
import json
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tenantlens import schemas as sc
from tenantlens.operators import governance as gv, latest as la, quality as dq, series as se, workflow as wf
from tenantlens.plans import reads as r, verticals as v
from tenantlens.settings import AS_OF, checkpoint_root, size_shuffles
from tenantlens.sources import landing as ld
from tenantlens.streaming import jobs

DAY = dt.timedelta(days=1)


def history(frame, n, value=1000.0):
    made = [("o", (AS_OF - DAY * i).date(), value) for i in range(n)]
    return frame(made, "org_id string, revenue_date date, y double").withColumn("total_revenue_booked", F.col("y").cast("decimal(18,2)"))


def test_short_history_repeats_the_mean(frame):
    got = se.forecast(history(frame, 13), ["org_id"]).orderBy("forecast_date").collect()
    assert len(got) == 30 and {x.method for x in got} == {"mean7"}
    assert (got[0].forecast_value, got[0].lower_bound, got[0].upper_bound) == (1000.0, 800.0, 1200.0)
    assert got[0].forecast_date == (AS_OF + DAY).date()


def test_short_history_without_recent_days_is_zero(frame):
    old = history(frame, 3).withColumn("revenue_date", F.date_sub("revenue_date", 100))
    assert {x.forecast_value for x in se.forecast(old, ["org_id"]).collect()} == {0.0}


def test_long_history_follows_trend_and_weekday(frame):
    made = [("o", (AS_OF - DAY * i).date(), 500.0 - 2.0 * i + (70.0 if (AS_OF - DAY * i).weekday() == 5 else 0.0)) for i in range(70)]
    h = frame(made, "org_id string, revenue_date date, total_revenue_booked double")
    got = se.forecast(h, ["org_id"]).collect()
    for x in got:
        ahead = (x.forecast_date - AS_OF.date()).days
        want = 500.0 + 2.0 * ahead + (70.0 if x.forecast_date.weekday() == 5 else 0.0)
        assert abs(x.forecast_value - want) < 6 and x.lower_bound <= x.forecast_value <= x.upper_bound


def test_anomalies_need_points_and_spread(frame):
    made = [("o", (AS_OF - DAY * i).date(), 100.0 + (i % 3)) for i in range(1, 20)] + [("o", AS_OF.date(), 200.0)]
    s = frame(made, "org_id string, metric_date date, metric_value double")
    got = se.anomalies(s, ["org_id"]).collect()
    assert [(x.metric_date, x.severity) for x in got] == [(AS_OF.date(), "HIGH")]
    assert se.anomalies(s, ["org_id"], min_points=25).count() == 0


def test_oee_defaults(frame):
    e = frame([("o", "e", "p", 160, 0, 90, 100, 0, 0, 50, 4, None, (AS_OF - DAY * 91).date(), True)],
              "org_id string, equipment_id string, plant_id string, uptime_hours int, planned_hours int, actual_units int, ideal_units int, good_units int, total_units int, "
              "mtbf_hours int, mttr_hours int, maintenance_interval_days int, last_maintenance_date date, is_active boolean")
    x = v.oee(e).first()
    assert (float(x.availability_pct), float(x.performance_pct), float(x.quality_pct), float(x.failure_risk_score)) == (95.0, 90.0, 98.0, 0.8)
    assert float(x.oee_score) == round(95 * 90 * 98 / 10000, 2)


def test_zero_demand_has_no_cover(frame):
    inv = frame([("o", 1, 1, 50)], "org_id string, sku_id int, location_id int, current_stock int")
    fc = frame([("o", 1, 1, AS_OF.date(), 0)], "org_id string, sku_id int, location_id int, forecast_date date, forecast_qty int")
    assert v.inventory_alerts(inv, fc).count() == 0


def test_contract_check_and_rules(frame):
    df = frame([("a", None), ("a", "x")], "id string, Email string")
    out = ld.check_contract(df, ["ID", "email", "phone"]).first()
    assert (out.valid, out.missing_columns, out.row_count, out.null_counts) == (False, ["phone"], 2, ["id=0", "Email=1"])
    rules = [dq.Rule("t", "nulls", lambda: dq.null_rate("Email"), 30.0, "soft"), dq.Rule("t", "dups", lambda: dq.duplicate_count("id"), 0.0), dq.Rule("t", "n", lambda: F.count(F.lit(1)), 3.0, "min")]
    assert rows(dq.run_rules({"t": df}, rules), "metric_name", "metric_value", "status") == [("dups", 1.0, "FAIL"), ("n", 2.0, "FAIL"), ("nulls", 50.0, "WARN")]


def test_tenant_filter(frame):
    data = frame([("A", 1), ("B", 2), ("C", 3)], "org_id string, x int")
    users = frame([("u", "A"), ("u", "B"), ("w", None)], "user_name string, org_id string")
    assert gv.tenant_filter(data, users, "u").count() == 2
    assert gv.tenant_filter(data, users, "w").count() == 0
    assert gv.tenant_filter(data, users, "nobody", is_admin=True).count() == 3
    assert gv.tenant_filter(data, users.filter("false"), "u").count() == 0
    assert gv.tenant_filter(data, users.filter("false"), "u", open_without_map=True).count() == 3


def test_masks_depend_on_role(frame):
    df = frame([("Ann Lee", "ann@x.com", "5511987654")], "name string, email string, phone string")
    assert gv.apply_masks(df, "customers", "ADMIN").first().name == "Ann Lee"
    assert tuple(gv.apply_masks(df, "customers", "ANALYST").first()) == ("Ann ****", "an***@x.com", "55****54")


def at(h):
    return AS_OF + dt.timedelta(hours=h)


def test_status_events_fold(frame):
    recs = frame([("r1", "o", "pending", True), ("r2", "o", "pending", True), ("r3", "o", "completed", False), ("r4", "o", "pending", True)],
                 "recommendation_id string, org_id string, status string, is_active boolean")
    ev = frame([(1, "r1", "in_progress", "u", at(-5)), (2, "r1", "completed", "u", at(-4)), (3, "r1", "pending", "u", at(-3)), (4, "r2", "bogus", "u", at(-2)),
                (5, "r2", "snoozed", "u", at(-1)), (6, "r3", "pending", "u", at(-1))], "event_id int, recommendation_id string, new_status string, acted_by string, at timestamp")
    got = {x.recommendation_id: (x.status, x.is_active) for x in wf.apply_status_events(recs, ev).collect()}
    assert got == {"r1": ("completed", False), "r2": ("snoozed", True), "r3": ("completed", False), "r4": ("pending", True)}
    assert [x[0] for x in rows(wf.action_log(recs, ev), "event_id")] == [1, 2, 5]


def test_approval_lifecycle(frame):
    queue = wf.submit(frame([(i, "o", at(-60)) for i in ("a", "b", "c")] + [("d", "o", at(-10)), ("e", "o", at(-48)), ("f", "o", at(-60))], "approval_id string, org_id string, created_at timestamp"))
    ev = frame([("a", "approve", "m", "x", at(-20)), ("a", "reject", "m", "y", at(-19)), ("b", "approve", "m", "x", at(-12)), ("c", "reject", "m", "late", at(-11.5)),
                ("f", "reject", "m", "too late", at(-11))], "approval_id string, action string, actor string, reason string, at timestamp")
    got = {x.approval_id: x.status for x in wf.apply_approval_events(queue, ev).collect()}
    assert got == {"a": "approved", "b": "expired", "c": "rejected", "d": "pending", "e": "pending", "f": "expired"}
    assert wf.approval_log(wf.apply_approval_events(queue, ev)).count() == 2


def test_ties_are_kept_and_broken_as_asked(frame):
    df = frame([("c", 1, "a"), ("c", 2, "b"), ("c", 2, "d")], "k string, t int, id string")
    assert la.latest_with_ties(df, ["k"], "t").count() == 2
    assert la.latest_by(df, ["k"], "t", ["id"]).first().id == "b"


def test_filters(frame):
    df = frame([("a", "x", AS_OF), ("b", "y", AS_OF - DAY * 9)], "p string, q string, created_at timestamp")
    assert r.where(df, p=["a", "b"], q=None).count() == 2
    assert r.where(df, q="y", days_back=5).count() == 0


def test_hot_key_is_limited_before_the_exchange(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("t"))
    out = la.latest_by(df, ["k"], "t")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert out.filter("k = 'hot'").first().t == 29997 and out.count() == 20001


def test_salted_top_equals_plain_top(spark):
    df = spark.range(9000).select((F.col("id") % 2).cast("string").alias("org_id"), (F.col("id") * 7919 % 1000).alias("v"), "id")
    order = [F.col("v").desc(), F.col("id")]
    assert rows(la.top_per(df, ["org_id"], order, 25, "rank", salt=8)) == rows(la.top_per(df, ["org_id"], order, 25, "rank"))


def test_shuffle_sizing(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert size_shuffles(spark, 100 * 2 ** 40) == 409600
    spark.conf.set("spark.sql.shuffle.partitions", before)


def write_lines(folder, name, events):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.writelines(json.dumps(e) + "\n" for e in events)


@pytest.fixture
def stream_dir(spark):
    return f"{checkpoint_root(spark)}/stream-{dt.datetime.now().timestamp()}"


def event(i, minute, user="u1"):
    return {"event_id": f"e{i}", "org_id": "o", "customer_id": "c", "user_id": user, "session_id": "s", "event_type": "login", "client_ts": "bad",
            "server_ts": f"2024-01-01 {10 + minute // 60:02d}:{minute % 60:02d}:00"}


def test_stream_usage_over_several_runs_equals_batch(spark, stream_dir):
    src, out, ck = f"{stream_dir}/in", f"{stream_dir}/out", f"{stream_dir}/ck"

    def run():
        jobs.run(jobs.start_feature_usage(ld.read_event_stream(spark, src, sc.RAW_PRODUCT_EVENT), out, ck))
        return rows(jobs.read_updates(spark, out, ["org_id", "customer_id", "event_hour", "event_type"]), "event_hour", "event_count", "unique_users")

    write_lines(src, "1.json", [event(1, 0), event(2, 30)])
    run()
    write_lines(src, "2.json", [event(3, 40, "u2"), event(4, 70)])
    got = run()
    hour = dt.datetime(2024, 1, 1, 10)
    assert got == [(hour, 3, 2), (hour + dt.timedelta(hours=1), 1, 1)]
    assert run() == got  # nothing new: nothing changes


def test_late_events_are_dropped_after_the_watermark(spark, stream_dir):
    src, out, ck = f"{stream_dir}/in", f"{stream_dir}/out", f"{stream_dir}/ck"

    def run():
        jobs.run(jobs.start_feature_usage(ld.read_event_stream(spark, src, sc.RAW_PRODUCT_EVENT), out, ck, "1 hour"))
        return jobs.read_updates(spark, out, ["org_id", "customer_id", "event_hour", "event_type"]).agg(F.sum("event_count")).first()[0]

    write_lines(src, "1.json", [event(1, 0), event(2, 400)])
    assert run() == 2
    write_lines(src, "2.json", [event(3, 5)])
    assert run() == 2


def test_landing_dedupes_and_keeps_malformed_records(spark, stream_dir):
    src, out, ck = f"{stream_dir}/in", f"{stream_dir}/out", f"{stream_dir}/ck"
    write_lines(src, "1.json", [event(1, 0), event(1, 0), event(2, 5)])
    events = jobs.dedupe_events(ld.read_event_stream(spark, src, sc.RAW_PRODUCT_EVENT), "server_ts")
    jobs.run(jobs.start_landing(ld.land_product_events(events), out, ck))
    landed = spark.read.parquet(out)
    assert landed.count() == 2 and landed.filter("client_ts is not null").count() == 0
    broken = ld.parse_events(spark.createDataFrame([("{oops",)], "_raw string"), sc.RAW_PRODUCT_EVENT).first()
    assert broken.event_id is None and broken._metadata_json == "{oops"

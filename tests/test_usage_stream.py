"""Exact streaming counts, and late rows that are kept for the backfill."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tenantlens.plans.usage import feature_usage
from tenantlens.streaming import jobs, usage as su

T = dt.datetime(2024, 1, 10)
FEED = "event_id string, org_id string, customer_id string, user_id string, session_id string, event_type string, server_ts timestamp"


def events(rand, n, low, high, first):
    return [(f"E{first + i}", f"O{rand.randrange(2)}", rand.choice(["c1", "c2", None]), rand.choice(["u1", "u2", "u3", None]),
             rand.choice(["s1", "s2", "s3", "s4", None]), rand.choice(["a", "b"]), T + dt.timedelta(minutes=rand.randrange(low, high))) for i in range(n)]


def run(spark, path, rows):
    spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").parquet(f"{path}/feed")
    feed = spark.readStream.schema(FEED).parquet(f"{path}/feed")
    jobs.run(su.start_routing(feed, f"{path}/routed", f"{path}/ck1"))
    jobs.run(su.start_exact_usage(spark, f"{path}/routed", feed.schema, f"{path}/out", f"{path}/ck2"))
    return feed.schema


def bag(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def test_exact_counts_and_late_rows(spark, tmp_path):
    """Several users and sessions an hour, late rows in three runs, a row without a time, restarts between all runs."""
    rand, path, everything = random.Random(4), str(tmp_path), []
    spans = [(0, 300), (0, 600), (200, 900), (0, 900)]
    for i, (low, high) in enumerate(spans):
        rows = events(rand, 400, low, high, 1000 * i) + ([("E9999", "O1", "c1", "u1", "s1", "a", None)] if i == 2 else [])
        everything += rows
        schema = run(spark, path, rows)
    for hours in (40, 400):  # a later event closes the last hours; another run lets the second aggregate see it
        closing = [(f"end{hours}", "end", None, None, None, None, T + dt.timedelta(hours=hours))]
        run(spark, path, closing)
    routed = su.read_routed(spark, f"{path}/routed", schema)
    late = routed.where("late").count()
    assert 100 < late < 1000 and routed.count() == len(everything) + 2 and routed.where("late and server_ts is null").count() == 1
    emitted = spark.read.parquet(f"{path}/out").where("org_id != 'end'")
    assert bag(emitted) == bag(feature_usage(routed.where("not late and org_id != 'end'"), lookback_days=None))  # none dropped in the stream
    want = feature_usage(spark.createDataFrame(everything, FEED), lookback_days=None)
    assert want.agg(F.max("unique_users")).first()[0] == 3 and want.agg(F.max("unique_sessions")).first()[0] == 4
    assert bag(su.with_late(emitted, routed)) == bag(want)


def test_a_repeated_batch_is_written_once(spark, tmp_path):
    """A batch whose commit was lost after its rows were written is not written again."""
    import shutil
    path = str(tmp_path)
    schema = run(spark, path, events(random.Random(1), 50, 0, 300, 0))
    before = bag(su.read_routed(spark, f"{path}/routed", schema))
    copy = tmp_path / "ck3"
    shutil.copytree(f"{path}/ck1", copy, ignore=lambda folder, names: [n for n in names if folder.endswith("commits")])
    feed = spark.readStream.schema(FEED).parquet(f"{path}/feed")
    jobs.run(su.start_routing(feed, f"{path}/routed", str(copy)))
    assert bag(su.read_routed(spark, f"{path}/routed", schema)) == before

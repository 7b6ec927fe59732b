"""Merge, incremental and sink behaviour."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tenantlens.operators import merge as mg, normalize as no
from tenantlens.settings import AS_OF, checkpoint_root
from tenantlens.sources import sinks

T = [AS_OF + dt.timedelta(hours=h) for h in range(4)]
SCHEMA = "id string, a int, b string"


@pytest.fixture
def target(frame):
    return frame([("1", 1, "x"), ("2", 2, "y"), ("3", None, "z")], SCHEMA)


@pytest.fixture
def batch(frame):
    return frame([("2", 20, "n", T[0]), ("2", 21, "m", T[1]), ("4", 40, "w", T[0]), ("3", 30, None, T[0]), (None, 9, "q", T[0])], SCHEMA + ", loaded_at timestamp")


def test_upsert_takes_last_version_and_keeps_the_rest(target, batch):
    assert rows(mg.merge_upsert(target, batch, ["id"]).na.fill("-")) == [("1", 1, "x"), ("2", 21, "m"), ("3", 30, "-"), ("4", 40, "w")]


def test_upsert_update_subset(target, batch):
    out = mg.merge_upsert(target, batch, ["id"], ["a"], on_insert={"b": F.lit("new")})
    assert rows(out) == [("1", 1, "x"), ("2", 21, "y"), ("3", 30, "z"), ("4", 40, "new")]


def test_merge_twice_equals_once(target, batch):
    once = mg.merge_upsert(target, batch, ["id"]).na.fill("-")
    assert rows(mg.merge_upsert(once, batch, ["id"]).na.fill("-")) == rows(once)


def test_insert_absent_leaves_matches(target, batch):
    assert rows(mg.insert_absent(target, batch, ["id"]).na.fill(0)) == [("1", 1, "x"), ("2", 2, "y"), ("3", 0, "z"), ("4", 40, "w")]


def test_equal_load_times_have_one_stable_winner(frame, target):
    tied = frame([("2", n, "t", T[0]) for n in range(50)], SCHEMA + ", loaded_at timestamp")
    first = rows(mg.merge_upsert(target, tied, ["id"]).na.fill(0))
    assert first == rows(mg.merge_upsert(target, tied.repartition(7), ["id"]).na.fill(0)) and len(first) == 3


def test_rejects(batch):
    assert tuple(mg.rejected(batch, ["id"]).first()) == (1, 1)


def test_bucketed_merge_equals_pure_merge(spark, target, batch):
    path = f"{checkpoint_root(spark)}/merge-{dt.datetime.now().timestamp()}"
    sinks.create_merge_table(target, path, ["id"], rows_per_bucket=1)
    sinks.merge_into(spark, path, batch)
    want = rows(mg.merge_upsert(target, batch, ["id"]).na.fill("-"))
    assert rows(sinks.read_merge_table(spark, path).select("id", "a", "b").na.fill("-")) == want
    sinks.merge_into(spark, path, batch)
    assert rows(sinks.read_merge_table(spark, path).select("id", "a", "b").na.fill("-")) == want


def test_many_small_merges_never_repeat_a_key(spark):
    path = f"{checkpoint_root(spark)}/merge-{dt.datetime.now().timestamp()}"
    rows_of = lambda a, b, v: spark.range(a, b).selectExpr("id", "'o' || id % 3 AS org_id", f"{v} AS x", "1 AS loaded_at")
    sinks.create_merge_table(rows_of(0, 200, 0), path, ["id", "org_id"], rows_per_bucket=3)
    for k in range(3):
        sinks.merge_into(spark, path, rows_of(150 + 20 * k, 200 + 20 * k, k + 1))
    got = sinks.read_merge_table(spark, path)
    assert got.count() == got.select("id", "org_id").distinct().count() == 240 and "buckets" not in got.columns


def test_tenants_with_one_source_id_stay_apart(spark):
    load = lambda org, name, hour: (org, f'{{"CustomerID": 1, "Name": "{name}", "Email": "{name}@x"}}', dt.datetime(2024, 1, 30, hour))
    frame = lambda *r: spark.createDataFrame(r, "org_id string, raw_data string, loaded_at timestamp")
    stamp = F.lit(dt.datetime(2024, 1, 31))
    first = no.merge_feed(None, frame(load("A", "a1", 1), load("B", "b1", 2)), "sap_customers", stamp=stamp)
    assert rows(first, "customer_id", "org_id", "name") == [("SAP-1", "A", "a1"), ("SAP-1", "B", "b1")]
    later = frame(load("B", "b2", 3))
    assert rows(no.merge_feed(first, later, "sap_customers", stamp=stamp), "customer_id", "org_id", "name") == [("SAP-1", "A", "a1"), ("SAP-1", "B", "b2")]
    path = f"{checkpoint_root(spark)}/merge-{dt.datetime.now().timestamp()}"
    sinks.create_merge_table(first, path, ["customer_id", "org_id"])
    sinks.merge_into(spark, path, no.project(later, "sap_customers"), ["name", "email"])
    assert rows(sinks.read_merge_table(spark, path), "org_id", "name") == [("A", "a1"), ("B", "b2")]


def test_empty_batch_changes_nothing(spark, target, batch):
    path = f"{checkpoint_root(spark)}/merge-{dt.datetime.now().timestamp()}"
    sinks.create_merge_table(target, path, ["id"], rows_per_bucket=1)
    sinks.merge_into(spark, path, batch.filter("false"))
    assert sinks.read_merge_table(spark, path).count() == 3


def test_target_is_not_shuffled_for_a_small_batch(target, batch):
    big = target.sparkSession.range(200000).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("a"), F.lit("x").alias("b"))
    df = mg.merge_upsert(big, F.broadcast(batch), ["id"], order_by=())
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_replace_window_and_reload(frame):
    stored = frame([(1, "old"), (5, "old")], "d int, v string")
    fresh = frame([(1, "new"), (5, "new"), (6, "new")], "d int, v string")
    assert rows(mg.replace_window(stored, fresh, "d", F.lit(5))) == [(1, "old"), (5, "new"), (6, "new")]
    assert rows(mg.reload_groups(stored, fresh.filter("d = 5"), ["d"])) == [(1, "old"), (5, "new")]


def test_retain_keeps_unknown(frame):
    df = frame([(1,), (9,), (None,)], "age int")
    assert mg.retain(df, F.col("age") > 8).count() == 2


def test_rebalance_hint_reaches_the_plan(frame):
    df = frame([(1, "a")], "x int, k string").hint("rebalance", "k")
    assert "RebalancePartitions" in df._jdf.queryExecution().analyzed().toString()


def test_jdbc_reader_options(monkeypatch):
    seen = {}

    class Reader:
        def format(self, kind):
            seen["format"] = kind
            return self

        def options(self, **kw):
            seen.update(kw)
            return self

        def load(self):
            return self

        def filter(self, cond):
            seen["since"] = cond
            return self

        def select(self, *cols):
            seen["columns"] = cols
            return self

    class Session:
        read = Reader()

    sinks.read_jdbc(Session(), "jdbc:x", "orders", partition_column="id", lower=0, upper=100, partitions=8, columns=["id"], since="d > 1")
    assert (seen["format"], seen["partitionColumn"], seen["numPartitions"], seen["since"], seen["columns"]) == ("jdbc", "id", 8, "d > 1", ("id",))


def test_failed_merge_loses_and_repeats_nothing(spark, tmp_path, monkeypatch):
    """A job lost between writing and publishing leaves the old state; its rerun gives the new one once."""
    path = str(tmp_path / "t")
    make = lambda lo, hi, v: spark.createDataFrame([(i, f"o{i % 2}", v, dt.datetime(2024, 1, 1 + v)) for i in range(lo, hi)], "id long, org_id string, v int, loaded_at timestamp")
    sinks.create_merge_table(make(0, 60, 0), path, ["id", "org_id"], rows_per_bucket=10)
    before = rows(sinks.read_merge_table(spark, path), "id", "v")
    publish = sinks._publish

    def lost(*_):
        raise RuntimeError("driver lost")
    monkeypatch.setattr(sinks, "_publish", lost)
    with pytest.raises(RuntimeError):
        sinks.merge_into(spark, path, make(50, 80, 1))
    assert rows(sinks.read_merge_table(spark, path), "id", "v") == before
    # a pointer that was begun but not finished does not count
    spark.createDataFrame([(0, "vnowhere")], "bucket int, version string").write.parquet(f"{path}/{sinks.POINTERS}/2")
    (tmp_path / "t" / sinks.POINTERS / "2" / "_SUCCESS").unlink()
    assert rows(sinks.read_merge_table(spark, path), "id", "v") == before
    monkeypatch.setattr(sinks, "_publish", publish)
    for _ in range(2):  # and a replay after success changes nothing
        sinks.merge_into(spark, path, make(50, 80, 1))
        assert rows(sinks.read_merge_table(spark, path), "id", "v") == [(i, int(i >= 50)) for i in range(80)]
    assert sinks.drop_old_versions(spark, path) > 0 and sinks.drop_old_versions(spark, path) == 0
    assert rows(sinks.read_merge_table(spark, path), "id", "v") == [(i, int(i >= 50)) for i in range(80)]


def test_merge_table_without_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    none = spark.createDataFrame([], "id long, v int, loaded_at timestamp")
    sinks.create_merge_table(none, path, ["id"])
    assert sinks.read_merge_table(spark, path).count() == 0
    sinks.merge_into(spark, path, spark.createDataFrame([(1, 2, dt.datetime(2024, 1, 1))], none.schema))
    assert rows(sinks.read_merge_table(spark, path), "id", "v") == [(1, 2)]

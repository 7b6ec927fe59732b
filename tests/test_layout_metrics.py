"""Clustered layout, measured by the rows that scans read; measures of several models in one call."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenantlens.plans import metrics as me
from tenantlens.sources import sinks


def rows_read(df):
    """Rows that the scan of an executed filter handed on: whole row groups that statistics did not rule out."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.apply(0).metrics().apply("numOutputRows").value()


@pytest.mark.parametrize("columns, bits", [(1, 5), (2, 1), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_and_moves_one_step(columns, bits):
    cells = np.array(np.meshgrid(*[range(1 << bits)] * columns, indexing="ij")).reshape(columns, -1).T
    places = sinks.curve_places(cells, bits)
    assert sorted(places) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(places)], axis=0)).sum(axis=1) == 1).all()


def test_two_filters_read_a_quarter(spark, tmp_path):
    rand = random.Random(3)
    rows = [(i, rand.randrange(1_000_000), dt.date(2020, 1, 1) + dt.timedelta(days=rand.randrange(1500)), rand.choice("abc")) for i in range(40_000)]
    rows += [(-1, None, None, None), (-2, 5, None, "a")]
    df = spark.createDataFrame(rows, "id long, amount long, day date, kind string").repartition(4)
    plain, laid = str(tmp_path / "plain"), str(tmp_path / "laid")
    df.repartition(64).write.parquet(plain)
    sinks.write_clustered(df, laid, ["amount", "day"], rows_per_file=len(rows) // 64)
    one, two = F.col("amount").between(400_000, 420_000), F.col("day").between(dt.date(2021, 1, 1), dt.date(2021, 1, 20))
    for keep in (one, two):
        before, after = (rows_read(spark.read.parquet(p).where(keep)) for p in (plain, laid))
        assert after <= before / 4, (before, after)
    assert spark.read.parquet(laid).exceptAll(df).isEmpty() and spark.read.parquet(laid).count() == len(rows)


def test_layout_of_nothing_and_of_one_value(spark, tmp_path):
    none = spark.createDataFrame([], "a int, b string")
    sinks.write_clustered(none, str(tmp_path / "none"), ["a", "b"])
    assert spark.read.schema(none.schema).parquet(str(tmp_path / "none")).count() == 0
    hot = spark.range(4000).select(F.lit(7).alias("a"), F.col("id").cast("string").alias("b"))
    sinks.write_clustered(hot, str(tmp_path / "hot"), ["a"], rows_per_file=500)  # one place, still several files
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "hot")).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) > 4 and max(sizes) < 1500


@pytest.fixture
def frames(frame):
    health = frame([("c1", "O1", "SMB", "HIGH", 1), ("c1", "O2", "ENT", "LOW", 2), ("c2", "O1", None, "LOW", 0)],
                   "customer_id string, org_id string, segment string, risk_level string, open_ticket_count int")
    c360 = frame([("c1", "O1", "SMB", 10.0), ("c1", "O2", "ENT", 20.0), ("c2", "O1", None, 30.0), ("c9", "O1", "MID", 5.0)],
                 "customer_id string, org_id string, segment string, arr double")
    tickets = frame([("t1", "c1", "O1", "open", "urgent"), ("t2", "c1", "O1", "open", "low"), ("t3", "c1", "O2", "closed", "low"),
                     ("t4", "c2", "O1", "open", "low"), ("t5", "zz", "O1", "open", "low")], "ticket_id string, customer_id string, org_id string, status string, priority string")
    paid = frame([("c1", "O1", 5.0), ("c1", "O1", 6.0), ("c1", "O2", 7.0), (None, "O1", 1.0)], "customer_id string, org_id string, amount double")
    return {"customer_health": health, "customer_360": c360, "tickets": tickets, "transactions": paid}


def test_drill_across_does_not_multiply(frames):
    """One customer id in two tenants, a ticket of an unknown customer, a NULL segment, a segment without facts."""
    got = me.drill_across(frames, ["tickets.ticket_count", "transactions.total_revenue", "customer_360.total_arr"], ["org_id", "segment"])
    assert {(r.org_id, r.segment): tuple(r)[2:] for r in got.collect()} == {
        ("O1", "SMB"): (2, 11.0, 10.0), ("O1", None): (2, 1.0, 30.0), ("O2", "ENT"): (1, 7.0, 20.0), ("O1", "MID"): (None, None, 5.0)}
    only = me.drill_across(frames, ["tickets.ticket_count"], ["segment"], {"tickets": "priority = 'urgent'"})
    assert [tuple(r) for r in only.collect()] == [("SMB", 1)]


def test_equal_measure_names_of_two_models(frames):
    got = me.drill_across(frames, ["customer_360.total_arr", "transactions.transaction_count", "customer_360.total_customers"], ["org_id"])
    assert sorted(tuple(r) for r in got.collect()) == [("O1", 45.0, 3, 3), ("O2", 20.0, 1, 1)]


@pytest.mark.parametrize("measures, dims", [
    (["products.product_count", "tickets.ticket_count"], ["org_id"]),  # products know no tenant
    (["executive_kpis.total_arr"], ["segment"]), (["revenue_movement.transaction_count"], ["segment"]),  # coarser than the dimension
    (["tickets.ticket_count", "transactions.total_revenue"], ["status"]),  # same name, other meaning
    (["tickets.nothing"], []), (["nowhere.total"], [])])
def test_measures_that_would_fan_out_are_rejected(frames, measures, dims):
    with pytest.raises(KeyError):
        me.drill_across(frames, measures, dims)

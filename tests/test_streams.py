"""Stateful streams over several runs, and the vector index."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenantlens.operators import search as se, vector_index as vi
from tenantlens.streaming import approvals as sa, jobs

T = dt.datetime(2024, 1, 10)


def at(hours):
    return T + dt.timedelta(hours=hours)


def test_approvals_over_restarts(spark, tmp_path):
    """Early, contradicting and late decisions; each request ends once, whatever run its events come in."""
    submit = lambda i, h: (i, "submit", at(h), None, None, 48)
    act = lambda i, kind, h, who="m", why="w": (i, kind, at(h), who, why, None)
    runs = [
        [submit("a", 0), submit("b", 0), submit("c", 0.5), submit("d", 1), act("e", "approve", 3), act("nobody", "approve", 2), (None, "approve", at(1), "x", None, None)],
        [act("a", "approve", 5), act("a", "reject", 4.5, "first"), submit("e", 2.5), act("b", "comment", 6)],
        [act("d", "approve", 60), act("c", "reject", 48.9, "late"), act("c", "approve", 48.7)],
        [(sa.TICK, "tick", at(400), None, None, None)], [(sa.TICK, "tick", at(401), None, None, None)]]
    path = str(tmp_path)
    for rows in runs:
        spark.createDataFrame(rows, sa.FEED).coalesce(1).write.mode("append").parquet(f"{path}/feed")
        jobs.run(sa.start_approvals(spark.readStream.schema(sa.FEED).parquet(f"{path}/feed"), f"{path}/out", f"{path}/ck", "100 hours"))
    got = sorted(tuple(r) for r in spark.read.parquet(f"{path}/out").collect())
    assert got == [("a", "rejected", "first", at(4.5), "w"), ("b", "expired", None, None, None), ("c", "rejected", "late", at(48.9), "w"),
                   ("d", "expired", None, None, None), ("e", "approved", "m", at(3), None)]


def test_approval_state_goes_by_bucket(spark, tmp_path):
    """More approvals than buckets: the state holds a row per bucket, not per approval; a time that equals the watermark is due."""
    path, n = str(tmp_path), 2 * sa.BUCKETS
    rows = [(f"r{i}", "submit", at(i % 3), None, None, 48) for i in range(n)] + [(f"r{i}", "reject", at(60), "m", "late", None) for i in range(1, n, 2)]
    rows += [(f"r{i}", "approve", at(5 + i % 2), "m", None, None) for i in range(0, n, 4)]
    runs, held = [rows, [(sa.TICK, "tick", at(50), None, None, None)], [(sa.TICK, "tick", at(53), None, None, None)]], []
    for part in runs:
        spark.createDataFrame(part, sa.FEED).write.mode("append").parquet(f"{path}/feed")
        q = sa.start_approvals(spark.readStream.schema(sa.FEED).parquet(f"{path}/feed"), f"{path}/out", f"{path}/ck", "100 hours" if not held else "2 hours")
        jobs.run(q)
        held.append(max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress))
    assert max(held) <= sa.BUCKETS
    got = {r.approval_id: (r.status, r.decided_at) for r in spark.read.parquet(f"{path}/out").collect()}
    assert got == {f"r{i}": ("approved", at(5 + i % 2)) if i % 4 == 0 else ("expired", None) for i in range(n)}


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 16))
    rows = [(i, f"ORG-{i % 3}", [float(x) for x in centres[i % 40] * r.uniform(.5, 3) + r.normal(size=16) * .35]) for i in range(4000)]
    rows += [(5000, "ORG-1", None), (5001, "ORG-1", [0.0] * 16)] + [(6000 + i, "ORG-2", rows[7][2]) for i in range(30)]  # no direction; copies
    vectors = spark.createDataFrame(rows, "chunk_id long, org_id string, embedding array<double>").repartition(4)
    path = str(tmp_path_factory.mktemp("index"))
    vi.build_index(vectors, path, lists=40, sample=1500)
    queries = vectors.where("chunk_id % 97 = 0 or chunk_id >= 5000").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors, queries, path, {i: np.array(v) for i, _, v in rows if v is not None and any(v)}, {i: o for i, o, _ in rows}


def nearest(vecs, q, k, keep=lambda i: True):
    unit = lambda v: v / np.linalg.norm(v)
    scores = sorted((-round(float(unit(v) @ unit(q)), 6), i) for i, v in vecs.items() if keep(i))
    return [i for _, i in scores[:k]]


def test_index_recall_and_exact_mode(spark, indexed):
    vectors, queries, path, vecs, _ = indexed
    ids = [r.query_id for r in queries.collect() if r.query_id in vecs]
    want = {i: nearest(vecs, vecs[i], 10) for i in ids}
    near, exact = ({}, {})
    for out, mode in ((near, False), (exact, True)):
        for r in vi.search_index(spark, path, queries, k=10, probes=4, exact=mode).orderBy("rank").collect():
            out.setdefault(r.query_id, []).append(r.chunk_id)
    assert set(exact) == set(ids) and exact == want
    recall = np.mean([len(set(near[i]) & set(want[i])) / 10 for i in ids])
    share = vi.scanned_share(spark, path, queries, probes=4)
    assert recall >= 0.95 and share < 0.35, (recall, share)


def test_index_filters_reach_the_scan(spark, indexed):
    _, queries, path, vecs, org = indexed
    some = queries.where("query_id in (0, 97, 194)")
    out = vi.search_index(spark, path, some, k=5, probes=2, exact=True, filters={"org_id": "ORG-2"})
    got = {}
    for r in out.orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {i: nearest(vecs, vecs[i], 5, lambda j: org[j] == "ORG-2") for i in (0, 97, 194)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(org_id,ORG-2)" in plan


def test_search_with_filters(spark, indexed):
    vectors, _, _, vecs, org = indexed
    got = [r.chunk_id for r in se.search(vectors, vecs[5].tolist(), k=7, filters={"org_id": "ORG-0"}).collect()]
    assert got == nearest(vecs, vecs[5], 7, lambda j: org[j] == "ORG-0")


def test_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id long, org_id string, embedding array<double>")
    vi.build_index(none, str(tmp_path), lists=4)
    assert spark.read.parquet(f"{tmp_path}/lists").agg(F.sum("n")).first()[0] == 0


def test_block_search_equals_rows(spark, indexed, monkeypatch):
    """Shards smaller than a list and copies at the cut: the rows of a full scan, by one product for each pair of shards."""
    vectors, queries, path, vecs, _ = indexed
    monkeypatch.setattr(vi, "SHARD", 20)
    some = queries.where("query_id in (97, 194, 6000, 6029)")
    some = some.unionByName(vectors.where("chunk_id = 7").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query")))
    out = vi.search_index(spark, path, some, k=10, probes=4, exact=True)
    got = {}
    for r in out.orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {i: nearest(vecs, vecs[i], 10) for i in (7, 97, 194, 6000, 6029)}
    assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().optimizedPlan().toString()

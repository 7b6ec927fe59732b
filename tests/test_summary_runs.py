"""Graph summaries against a dense matrix; run figures observed on the load itself."""

import datetime as dt
import random
import time

import numpy as np
from pyspark.sql import functions as F

from tenantlens.operators import summary as sm
from tenantlens.sources import landing as la
from tenantlens.streaming import jobs

T = dt.datetime(2024, 1, 10)


def dense(parts):
    """Centrality by the whole similarity matrix and its eigenvector."""
    bags = [sm._WORD.findall(p.lower()) for p in parts]
    words = sorted({w for b in bags for w in b})
    idf = {w: 1 + np.log(len(parts) / sum(w in b for b in bags)) for w in words}
    m = np.array([[b.count(w) * idf[w] for w in words] for b in bags])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    step = sm.DAMPING / len(parts) + (1 - sm.DAMPING) * (s / s.sum(axis=1, keepdims=True)).T
    values, vectors = np.linalg.eig(step)
    v = np.real(vectors[:, np.argmax(np.real(values))])
    return v / v.sum()


def test_centrality_equals_the_dense_graph():
    rand = random.Random(6)
    for _ in range(60):
        parts = [" ".join(rand.choice("abcdefghij") * rand.randrange(1, 3) for _ in range(rand.randrange(1, 8))) for _ in range(rand.randrange(1, 12))]
        assert np.allclose(sm.centrality(parts), dense(parts), atol=1e-7)


def test_summary_rows(frame):
    text = "Cats chase mice. The weather was fine. Cats and mice live here. Cats chase small mice here. Unrelated."
    out = {r.document_id: r.summary for r in sm.summarize_graph(frame(
        [("a", "O", text), ("n", "O", None), ("e", "O", " .. "), ("s", "O", "One only"), ("t", "O", "x y. x y. x y. x y.")],
        "document_id string, org_id string, extracted_text string"), k=2).collect()}
    parts = sm.sentences(text)
    best = " ".join(parts[i] for i in sorted(np.argsort(-dense(parts), kind="stable")[:2]))
    assert "Unrelated" not in best and out == {"a": best, "n": None, "e": None, "s": "One only", "t": "x y. x y."}


def test_long_texts_stay_linear():
    def took(n):
        parts = [f"common words w{i % 50} v{i}" for i in range(n)]
        start = time.perf_counter()
        sm.centrality(parts)
        return time.perf_counter() - start
    took(100)
    assert took(40_000) < 200 * max(took(2_000), 0.005)  # every pair shares a word: a matrix would cost 400 times


def test_load_observes_its_rows(spark, tmp_path):
    rows = [("O1", "a", T), ("O1", None, T + dt.timedelta(hours=1)), ("O2", "b", None), (None, "c", T - dt.timedelta(hours=5))]
    env = spark.createDataFrame(rows, "org_id string, raw_data string, loaded_at timestamp")
    path, src = str(tmp_path / "out"), str(tmp_path / "in")
    env.repartition(3).write.parquet(src)
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(len(b))
            yield b
    watched = spark.read.parquet(src).mapInPandas(count, env.schema)
    got = la.load_observed(watched, path, "crm", F.col("raw_data").isNotNull()).first()
    assert tuple(got) == ("crm", 3, 1, "partial", T + dt.timedelta(hours=1))
    assert reads.value == 4 and spark.read.parquet(path).count() == 3  # each row was read once
    assert tuple(la.load_observed(env.limit(0), path, "crm", F.col("raw_data").isNotNull()).first())[1:4] == (0, 0, "success")
    assert la.load_observed(env, path, "crm", F.col("raw_data") == "z").first().status == "failed"


def test_stream_runs_report_their_rows(spark, tmp_path):
    schema = "event_id string, server_ts timestamp"
    log = la.RunLog("landing")
    spark.streams.addListener(log)
    try:
        for run in range(2):
            rows = [(f"e{run}{i}", T + dt.timedelta(hours=run, minutes=i)) for i in range(30)]
            spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/feed")
            feed = la.observed(spark.readStream.schema(schema).parquet(f"{tmp_path}/feed"), "landing", "server_ts")
            jobs.run(jobs.start_landing(feed, f"{tmp_path}/out", f"{tmp_path}/ck"))
        end = time.time() + 20
        while log.total()[0] < 60 and time.time() < end:  # events reach a listener a little later
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    written = spark.read.parquet(f"{tmp_path}/out").agg(F.count(F.lit(1)), F.max("server_ts")).first()
    assert log.total() == tuple(written) == (60, T + dt.timedelta(hours=1, minutes=29))

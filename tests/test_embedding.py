"""The randomised SVD against numpy's, and its vectors in the index."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenantlens.operators import documents as do, embedding as em, vector_index as vi

TEXT = "document_id string, org_id string, extracted_text string"
THEMES = ["invoice payment refund amount bank due", "server outage latency error restart cluster", "renewal contract clause term notice party",
          "training course lesson teacher exam school"]


@pytest.fixture(scope="module")
def docs(spark):
    r = np.random.default_rng(2)
    rows = []
    for i in range(120):
        words = THEMES[i % 4].split()
        text = " ".join([words[j] for j in r.integers(0, 6, 12)] + ["common"] * 3 + [f"rare{k}" for k in r.integers(0, 60, 3)])
        rows.append((f"d{i}", f"O{i % 2}", text))
    rows += [("d0", "O0", rows[0][2]), ("none", "O1", None), ("empty", "O1", " ., "), ("long", "O1", "invoice bank " * 20_000)]
    return spark.createDataFrame(rows, TEXT).repartition(3)


def dense(weights):
    rows = weights.groupBy("document_id", "org_id", "term").agg(F.sum("weight").alias("w")).collect()
    ids, terms = sorted({(r[0], r[1]) for r in rows}), sorted({r.term for r in rows})
    at, to, a = {d: i for i, d in enumerate(ids)}, {t: i for i, t in enumerate(terms)}, np.zeros((len(ids), len(terms)))
    for r in rows:
        a[at[r[0], r[1]], to[r.term]] = r.w
    return ids, a


def same_signs(vectors):
    """Coordinates with the first large entry of each positive: the turn of a singular vector depends on rounding."""
    first = np.argmax(np.abs(vectors) > 0.5 * np.abs(vectors).max(axis=0), axis=0)
    return vectors * np.sign(vectors[first, np.arange(vectors.shape[1])])


def test_error_within_two_percent_of_numpy(spark, docs):
    some = docs.where("document_id != 'long'")  # one huge document would make the other values look small
    weights = do.term_weights(some)
    ids, a = dense(weights)
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    got = em.decompose(weights, dims=8, oversample=8)
    best = np.sqrt(1 - (s[:8] ** 2).sum() / (s ** 2).sum())
    assert best <= got.error() + 1e-9 <= best * 1.02 and np.allclose(got.values[:4], s[:4], rtol=0.01)
    vectors = {(r.document_id, r.org_id): np.array(r.embedding) for r in got.vectors.collect()}
    ours = np.stack([vectors[d] for d in ids])
    left = a - ours @ np.linalg.lstsq(ours, a, rcond=None)[0]  # what no mixture of the coordinates gives back
    assert np.linalg.norm(left) / np.linalg.norm(a) <= best * 1.02


def test_rare_words_meet_once_a_block(spark, docs, monkeypatch):
    weights = do.term_weights(docs.where("document_id != 'long'"))
    want = em.decompose(weights, dims=6, oversample=6, turns=2)
    monkeypatch.setattr(em, "BLOCK", 16)
    sent, parts = [], em._rare_parts
    monkeypatch.setattr(em, "_rare_parts", lambda *a: sent.append((parts(*a), a[0])) or parts(*a))
    got = em.decompose(weights, dims=6, oversample=6, turns=2, frequent=5)
    assert len(sent) == 3 and np.allclose(got.values, want.values, rtol=1e-9) and abs(got.energy - want.energy) < 1e-9 * want.energy
    ours, theirs = ({(r.document_id, r.org_id): r.embedding for r in x.vectors.collect()} for x in (got, want))
    assert ours.keys() == theirs.keys() and np.allclose(*(same_signs(np.array([x[k] for k in ours])) for x in (ours, theirs)), atol=1e-6)
    exchanged, cells = sent[0]
    pairs = cells.selectExpr("inline(arrays_zip(ids, ws))").groupBy("ids").count().collect()
    assert all(r["count"] > 1 for r in pairs)  # a word of one document is not exchanged
    held = [(r.id, r.block) for r in exchanged.collect()]
    assert len(held) == len(set(held)) < sum(r["count"] for r in pairs) and {i for i, _ in held} == {r.ids for r in pairs}


def test_keys_may_repeat_and_organisations_be_null(spark):
    rows = [(f"d{i % 37}", "O" if i % 3 else None, " ".join(f"w{i * j % 23}" for j in range(1, 9)) + f" only{i}") for i in range(60)]
    frames = [spark.createDataFrame([(d, o if keep else o or "none", t) for d, o, t in rows], TEXT) for keep in (True, False)]
    null, filled = ({(r.document_id, r.org_id or "none"): r.embedding for r in em.embed_dense(f, dims=4, oversample=4, frequent=3).collect()} for f in frames)
    assert null.keys() == filled.keys() and np.allclose(*(same_signs(np.array([x[k] for k in null])) for x in (null, filled)), atol=1e-6)
    ids, a = dense(do.term_weights(frames[1]))
    _, s, _ = np.linalg.svd(a, full_matrices=False)
    terms, vocabulary = do.document_terms(frames[0])
    got = em._decompose(terms, vocabulary, dims=4, oversample=len(ids), frequent=3)
    assert len(null) == len(ids) and np.allclose(got.values, s[:4], rtol=1e-6) and abs(got.energy - (s ** 2).sum()) < 1e-9 * got.energy


def test_vectors_feed_the_index(spark, docs, tmp_path):
    out = em.embed_dense(docs, dims=6, oversample=6)
    rows = {r.document_id: r.embedding for r in out.collect()}
    assert rows["none"] is None and rows["empty"] is None and len(rows) == 123 and out.count() == 123
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in rows.values() if v)
    vectors = out.select(F.col("document_id").alias("chunk_id"), "org_id", "embedding")
    vi.build_index(vectors, str(tmp_path), lists=4)
    queries = vectors.where("chunk_id in ('d1', 'd2', 'd7')").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    for r in vi.search_index(spark, str(tmp_path), queries, k=5, probes=2, exact=True).collect():
        if r.chunk_id != "long":
            assert int(r.chunk_id[1:]) % 4 == int(r.query_id[1:]) % 4  # neighbours share the theme


def test_sparse_features(docs):
    got = {r.document_id: r.embedding for r in do.embed(docs.where("extracted_text is not null"), dims=256).collect()}
    assert abs(got["d5"].norm(2) - 1) < 1e-9 and got["d5"].dot(got["d9"]) > got["d5"].dot(got["d6"])


def test_nothing_and_one_document(spark):
    none = spark.createDataFrame([], TEXT)
    assert em.embed_dense(none, dims=3).count() == 0
    one = em.embed_dense(spark.createDataFrame([("a", "O", "x y y"), ("b", "O", "z")], TEXT), dims=3).collect()
    assert len(one) == 2


def test_weights_equal_plain_counts(spark):
    rows = [("a", "O", "x x y, Zeta"), ("a", "O", "x w"), ("a", "P", "x"), ("b", "O", "y y-y x"), (None, "O", "w x"), (None, "O", "w"), ("c", "O", None), ("d", "O", " .,")]
    counts = {}
    for d, o, text in rows:
        counts.setdefault((d, o), Counter()).update((text or "").lower().replace(",", " ").replace("-", " ").replace(".", " ").split())
    df = Counter(w for c in counts.values() for w in c)
    want = {(*k, w): tf * np.log((len(rows) + 1) / (df[w] + 1)) for k, c in counts.items() for w, tf in c.items()}
    docs = spark.createDataFrame(rows, TEXT).repartition(3)
    for frequent in (1, 2, 100):
        got = do.term_weights(docs, frequent=frequent).collect()
        assert len(got) == len(want) and all(abs(want[r.document_id, r.org_id, r.term] - r.weight) < 1e-12 for r in got)


def test_words_are_counted_where_the_texts_are(docs):
    plan = do.term_frequencies(docs.where("document_id != 'd0'"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan

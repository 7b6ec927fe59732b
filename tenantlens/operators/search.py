"""Top-k search over vectors and text."""

from __future__ import annotations


from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from tenantlens.functions.text import words
from tenantlens.operators.latest import top_per, top_per_tenant
from tenantlens.sources.sinks import materialize


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    a, b = a.cast("array<double>"), b.cast("array<double>")
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.nullif(norm, F.lit(0.0))


def search(vectors: DataFrame, query: list[float], *, k: int = 5, filters: dict | None = None, id_col: str = "chunk_id") -> DataFrame:
    """Exact top-k by cosine for one query vector with equality filters.

    The query is a literal, so this is one filtered scan plus a top-k.
    """
    for column, value in (filters or {}).items():
        vectors = vectors.filter(F.col(column) == value)
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("score", F.round(cosine(F.col("embedding"), literal), 6))
    return scored.orderBy(F.col("score").desc_nulls_last(), id_col).limit(k)


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    """Mean vector per group, summed partition-side."""
    vec = array_to_vector(F.col("embedding").cast("array<double>"))
    return vectors.select(by, vec.alias("v")).groupBy(by).agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("query"))


def search_by_group(vectors: DataFrame, queries: DataFrame, on: str, *, k: int = 5, id_col: str = "chunk_id") -> DataFrame:
    """Top-k per query where each query carries its own equality filter.

    Joined on the filter attribute: a vector meets only the query it may
    answer, never all of them. The queries are staged, so that their size is
    known and the vectors need not move to a few labels.
    """
    scored = vectors.join(materialize(queries), on).select(id_col, on, F.round(cosine(F.col("embedding"), F.col("query")), 6).alias("score"))
    return top_per(scored, [on], [F.col("score").desc_nulls_last(), F.col(id_col)], k, "rank", salt=16)


def lexical_search(docs: DataFrame, terms: list[str], *, k: int = 5, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 top-k documents per tenant for a list of terms, over whole texts.

    Term counts are row-local and staged as a narrow table, so the texts are
    read once. Corpus statistics are one row per tenant, written before the
    join so that its size is known and the documents stay where they are.
    """
    tokens = words("extracted_text")
    tf = {i: F.size(tokens) - F.size(F.array_remove(tokens, term)) for i, term in enumerate(terms)}
    counted = materialize(docs.select("document_id", "org_id", F.size(tokens).alias("dl"), *[c.alias(f"tf{i}") for i, c in tf.items()]))
    stats = materialize(counted.groupBy("org_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in tf]))
    joined = counted.join(stats, "org_id")
    score = F.lit(0.0)
    for i in tf:
        f, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(F.lit(1.0) + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * f * (k1 + 1) / (f + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avgdl")))
    hits = joined.withColumn("score", F.round(score, 6)).filter(F.col("score") > 0)
    return top_per_tenant(hits.select("document_id", "org_id", "score"), [F.col("score").desc(), F.col("document_id")], k)

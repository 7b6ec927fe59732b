"""Inverted-list index over vectors: approximate search by cosine, and exact search with the same lists.

Vectors are kept as unit vectors in a table partitioned by list. A query reads
the lists with the nearest centroids; in exact mode it also reads every list
that the angle between query and centroid and the list's radius cannot rule out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tenantlens.operators.latest import top_per
from tenantlens.operators.search import dot
from tenantlens.sources.sinks import full_refresh, materialize

LISTS = 64
SAMPLE = 50_000  # vectors the centroids are fitted on
PROBES = 8
SLACK = 2e-6  # scores are rounded to six places
SHARD = 1 << 14  # vectors of a list, or queries that read it, that meet in one task
_SLAB = 256  # queries of a matrix product


def unit(v: Column) -> Column:
    """The vector at length one; null where it has no direction."""
    d = v.cast("array<double>")
    norm = F.nullif(F.sqrt(dot(d, d)), F.lit(0.0))
    return F.when(norm.isNotNull(), F.transform(d, lambda x: x / norm))


def _nearest(centroids: np.ndarray, n: int | None = None):
    """UDF: all lists of a vector, or the nearest ``n``, as (list_id, angle), nearest first. The centroids are LISTS rows, whatever the table's size."""
    @F.pandas_udf("array<struct<list_id:int,angle:double>>")
    def near(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        angles = np.arccos(np.clip(np.stack(vectors.to_list()) @ centroids.T, -1, 1))
        order = np.argsort(angles, axis=1, kind="stable")[:, :n]
        return pd.Series([[{"list_id": int(i), "angle": float(a[i])} for i in o] for o, a in zip(order, angles)])
    return near


def build_index(vectors: DataFrame, path: str, *, id_col: str = "chunk_id", lists: int = LISTS, sample: int = SAMPLE, seed: int = 7) -> None:
    """Write the index of ``vectors`` (id, embedding, filter columns) to ``path``.

    Centroids are fitted on at most ``sample`` vectors; every vector with a
    direction is indexed. A list that holds much of the data is written by
    several tasks. Beside the vectors, one row per list keeps its centroid,
    size and radius (its widest angle).
    """
    spark = vectors.sparkSession
    ready = materialize(vectors.withColumn("_unit", unit(F.col("embedding"))).where("_unit is not null"))
    rows = ready.count()
    share = min(1.0, 1.2 * sample / max(1, rows))
    chosen = ready.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(share * (1 << 30))).limit(sample).select(array_to_vector("_unit").alias("features"))
    if rows:
        model = KMeans(k=lists, distanceMeasure="cosine", maxIter=10, seed=seed).fit(chosen)
        centres = np.stack([c / np.linalg.norm(c) for c in model.clusterCenters()])
    else:
        centres = np.ones((1, 1))
    placed = ready.withColumn("_near", _nearest(centres, 1)(F.col("_unit"))[0])
    placed = placed.select(*[c for c in vectors.columns if c != "embedding"], F.col("_unit").alias("embedding"),
                           F.col("_near.angle").alias("angle"), F.col("_near.list_id").alias("list_id"))
    full_refresh(placed, f"{path}/vectors", ["list_id"])
    found = spark.read.parquet(f"{path}/vectors") if rows else placed.limit(0)
    sizes = found.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
    named = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list_id int, centroid array<double>")
    named.join(sizes, "list_id", "left").na.fill(0, ["n"]).na.fill(0.0, ["radius"]).coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")


def _probed(queries: DataFrame, lists: pd.DataFrame) -> DataFrame:
    centres = np.stack(lists["centroid"].to_list())
    rows = queries.select("query_id", unit(F.col("query")).alias("q")).where("q is not null")
    return materialize(rows.withColumn("near", _nearest(centres)(F.col("q"))))


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    return vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _best(held: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """(query_id, id, score): the best ``k`` of ``held`` for each row of ``asked``, equal scores by rising id."""
    if not held.num_rows or not asked.num_rows:
        held, asked = held.slice(0, 0), asked.slice(0, 0)
    held = held.take(pc.sort_indices(held["id"], null_placement="at_start"))
    parts = []
    if held.num_rows:
        vectors, queries, cut = _matrix(held["embedding"]), _matrix(asked["q"]), max(0, held.num_rows - k)
        for a in range(0, len(queries), _SLAB):
            scores = queries[a:a + _SLAB] @ vectors.T
            floor = np.partition(scores, cut, axis=1)[:, cut]
            row, at = np.nonzero(scores >= floor[:, None] - SLACK)
            found = np.round(scores[row, at], 6) + 0.0
            order = np.lexsort((at, -found, row))
            row, at, found = row[order], at[order], found[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            parts.append((row[rank < k] + a, at[rank < k], found[rank < k]))
    row, at, found = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return pa.table({"query_id": asked["query_id"].take(pa.array(row)), "id": held["id"].take(pa.array(at)), "score": pa.array(found)})


def _scored(spark: SparkSession, path: str, asked: DataFrame, k: int, filters: dict, id_col: str) -> DataFrame:
    """Best ``k`` per query among the lists of ``asked`` (query_id, q, list_id); filters reach the scan.

    Vectors of a list meet the queries that read it in shards of at most some
    SHARD each, as one matrix product that hands on ``k`` rows a query.
    """
    held = spark.read.parquet(f"{path}/vectors")
    for column, value in filters.items():
        held = held.where(F.col(column) == value)
    asked = materialize(asked)
    cut = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(SHARD))).cast("int")
    sizes = spark.read.parquet(f"{path}/lists").select("list_id", cut("n").alias("vs"))
    sizes = materialize(sizes.join(asked.groupBy("list_id").agg(F.count(F.lit(1)).alias("m")), "list_id").select("list_id", "vs", cut("m").alias("qs")))

    def dealt(rows: DataFrame, key: str, own: str, other: str, far: str, near: str) -> DataFrame:
        """Each row in one shard of its own side, for every shard of the other."""
        return rows.join(F.broadcast(sizes), "list_id").withColumn(own, F.pmod(F.xxhash64(key), F.col(near)).cast("int")) \
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(far) - 1))).drop("vs", "qs")

    left = dealt(held.select(F.col(id_col).alias("id"), "list_id", "embedding"), "embedding", "v", "w", "qs", "vs")
    right = dealt(asked.select("query_id", "list_id", "q"), "q", "w", "v", "vs", "qs")
    schema = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("id", held.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    met = left.groupBy("list_id", "v", "w").cogroup(right.groupBy("list_id", "v", "w")).applyInArrow(lambda a, b: _best(a, b, k), schema)
    return top_per(met.withColumnRenamed("id", id_col), ["query_id"], [F.col("score").desc(), F.col(id_col)], k, "rank", salt=16)


def search_index(spark: SparkSession, path: str, queries: DataFrame, *, k: int = 10, probes: int = PROBES, filters: dict | None = None,
                 exact: bool = False, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, id, score, rank): the ``k`` nearest vectors by cosine of each query (query_id, query).

    Reads the ``probes`` lists with the nearest centroids. With ``exact``, the
    k-th score found there rules out lists: a vector in a list is at least
    angle(query, centroid) - radius away. The lists left are read too, and the
    result is that of a full scan. Queries and vectors without direction have
    no neighbours. ``filters`` are equalities on columns of the index.
    """
    filters = filters or {}
    lists = spark.read.parquet(f"{path}/lists").orderBy("list_id").toPandas()
    asked = _probed(queries, lists)
    first = asked.select("query_id", "q", F.explode(F.slice("near", 1, probes)).alias("at")).select("query_id", "q", "at.list_id")
    best = _scored(spark, path, first, k, filters, id_col)
    if not exact:
        return best
    best = materialize(best)
    floor = best.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
    floor = floor.select("query_id", F.when(F.col("n") == k, F.col("floor")).otherwise(-2.0).alias("floor"))
    radius = materialize(spark.read.parquet(f"{path}/lists").where("n > 0").select("list_id", "radius"))
    rest = asked.select("query_id", "q", F.explode(F.slice("near", probes + 1, max(1, len(lists)))).alias("at")).select("query_id", "q", "at.list_id", "at.angle")
    reach = F.cos(F.greatest(F.lit(0.0), F.col("angle") - F.col("radius")))
    more = rest.join(radius, "list_id").join(floor, "query_id", "left").where(reach >= F.coalesce("floor", F.lit(-2.0)) - SLACK).select("query_id", "q", "list_id")
    both = best.drop("rank").unionByName(_scored(spark, path, more, k, filters, id_col).drop("rank"))
    return top_per(both, ["query_id"], [F.col("score").desc(), F.col(id_col)], k, "rank")


def scanned_share(spark: SparkSession, path: str, queries: DataFrame, *, probes: int = PROBES) -> float:
    """Mean share of the indexed vectors that a query's lists hold."""
    lists = spark.read.parquet(f"{path}/lists").orderBy("list_id").toPandas()
    sizes = spark.createDataFrame(lists[["list_id", "n"]])
    met = _probed(queries, lists).select("query_id", F.explode(F.slice("near", 1, probes)).alias("at")).select("query_id", "at.list_id").join(sizes, "list_id")
    asked, read = met.agg(F.count_distinct("query_id"), F.sum("n")).first()
    return (read or 0) / max(1, (asked or 0) * int(lists["n"].sum()))

"""Table sinks on plain Parquet."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tenantlens.operators.merge import dedupe, merge_upsert
from tenantlens.settings import run_folder

BUCKET = "_bucket"
LAYOUT = "_layout"  # bucket count, keys and schema of a merge table
DATA, POINTERS = "data", "_pointers"
ROWS_PER_BUCKET = 500_000


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    For results that several branches of a plan use: column pruning makes the
    branches differ, so Spark would compute each of them from the sources.
    """
    path = f"{run_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def full_refresh(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """Overwrite a table.

    ``rebalance`` lets adaptive execution split a partition value that holds
    much of the data over several writers instead of one.
    """
    out = df.hint("rebalance", *partition_by) if partition_by else df
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    out = df.hint("rebalance", *partition_by) if partition_by else df
    writer = out.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_layout(df: DataFrame, path: str, partition_by: list[str], sort_by: list[str]) -> None:
    """Partitioned files sorted inside, so row-group statistics prune on ``sort_by``."""
    laid = df.hint("rebalance", *partition_by).sortWithinPartitions(*partition_by, *sort_by)
    laid.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def _code(value: Column, bounds: list) -> Column:
    """Number of ``bounds`` (ascending) not above the value, as a tree of comparisons."""
    if not bounds:
        return F.lit(0)
    mid = len(bounds) // 2
    return F.when(value < F.lit(bounds[mid]), _code(value, bounds[:mid])).otherwise(F.lit(mid + 1) + _code(value, bounds[mid + 1:]))


def curve_places(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of cells (one row each, ``bits`` bits a column) on a Hilbert curve: neighbours on it are neighbours in one column.

    From the highest bit down, each column either flips the lower bits of the
    first one or swaps them with it; then a Gray code over the columns.
    """
    x = cells.astype(np.int64).T.copy()
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(len(x)):
            high = (x[i] >> bit & 1).astype(bool)
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for column in x ^ flip:
            place = place << 1 | column >> bit & 1
    return place


def curve_key(df: DataFrame, columns: list[str], *, bits: int = 6) -> tuple[Column, int]:
    """Place of a row on a space-filling curve over ``columns``, and the number of rows.

    Numbers, dates and times are normalised to 2^bits ranges of about equal
    row counts; other types by hash, so only equality filters gain from them.
    One scan finds all bounds. NULL lies in the first range.
    """
    if bits * len(columns) > 62:
        raise ValueError("bits * columns must not exceed 62")
    kinds = dict(df.dtypes)
    ranged = [c for c in columns if kinds[c].startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp"))]
    steps = F.lit([i / (1 << bits) for i in range(1, 1 << bits)])
    found = df.agg(F.count(F.lit(1)).alias("_n"), *[F.percentile_approx(c, steps, 10_000).alias(c) for c in ranged]).first()
    codes = []
    for c in columns:
        if c in ranged:
            codes.append(F.when(F.col(c).isNull(), 0).otherwise(_code(F.col(c), sorted(set(found[c] or [])))))
        else:
            codes.append(F.pmod(F.xxhash64(c), F.lit(1 << bits)).cast("int"))

    @F.pandas_udf("long")
    def place(cells: pd.Series) -> pd.Series:
        return pd.Series(curve_places(np.array(cells.tolist(), dtype=np.int64).reshape(-1, len(columns)), bits))

    return place(F.array(*codes)), found["_n"]


def write_clustered(df: DataFrame, path: str, columns: list[str], *, bits: int = 6, rows_per_file: int = 4_000_000) -> None:
    """Files and row groups that are narrow in every one of ``columns`` at once.

    A sort by several columns serves filters on the first one only; ranges of
    the curve serve each. Places with many rows are split by a hash of the row.
    """
    place, rows = curve_key(df, columns, bits=bits)
    salt = F.xxhash64(*df.columns)
    laid = df.withColumn("_place", place).withColumn("_salt", salt).repartitionByRange(max(1, -(-rows // rows_per_file)), "_place", "_salt")
    laid.sortWithinPartitions("_place").drop("_place", "_salt").write.mode("overwrite").parquet(path)


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; none where it does not exist."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(place) if f.isDirectory()] if fs.exists(place) else []


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _pointer(spark: SparkSession, path: str) -> int:
    """Number of the newest finished pointer, 0 without one."""
    numbers = sorted((int(n) for n in _folders(spark, f"{path}/{POINTERS}")), reverse=True)
    return next((n for n in numbers if exists(spark, f"{path}/{POINTERS}/{n}/_SUCCESS")), 0)


def _versions(spark: SparkSession, path: str) -> dict[int, str]:
    """Which version holds each bucket: one entry per bucket that has rows."""
    now = _pointer(spark, path)
    return {r.bucket: r.version for r in spark.read.parquet(f"{path}/{POINTERS}/{now}").collect()} if now else {}


def _write_version(df: DataFrame, path: str) -> dict[int, str]:
    """Write bucketed rows as a new version, which no reader sees yet; the buckets it has."""
    version = f"v{uuid.uuid4().hex}"
    df.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/{DATA}/version={version}")
    found = (n.split("=") for n in _folders(df.sparkSession, f"{path}/{DATA}/version={version}"))
    return {int(n): version for name, n in found if name == BUCKET}


def _publish(spark: SparkSession, path: str, versions: dict[int, str]) -> None:
    """Make ``versions`` what readers see: the success marker of the next pointer is the one change that counts."""
    rows = spark.createDataFrame(list(versions.items()), "bucket int, version string")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/{POINTERS}/{_pointer(spark, path) + 1}")


def _read_buckets(spark: SparkSession, path: str, versions: dict[int, str]) -> DataFrame:
    if not versions:
        schema = T.StructType.fromJson(json.loads(spark.read.parquet(f"{path}/{LAYOUT}").first().schema))
        return spark.createDataFrame([], schema.add(BUCKET, T.IntegerType()))
    places = [f"{path}/{DATA}/version={v}/{BUCKET}={b}" for b, v in sorted(versions.items())]
    return spark.read.option("basePath", f"{path}/{DATA}").parquet(*places).drop("version")


def with_bucket(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def create_merge_table(df: DataFrame, path: str, keys: list[str], *, rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
    """Write a table that ``merge_into`` can update.

    The number of buckets follows the number of rows, and is stored with the
    keys beside the table, so every later merge uses the same ones.
    """
    spark, rows = df.sparkSession, materialize(df)
    buckets = max(1, -(-rows.count() // rows_per_bucket))
    layout = spark.createDataFrame([(buckets, list(keys), df.schema.json())], "buckets int, keys array<string>, schema string")
    layout.coalesce(1).write.mode("overwrite").parquet(f"{path}/{LAYOUT}")
    _publish(spark, path, _write_version(with_bucket(rows, keys, buckets), path))


def merge_into(spark: SparkSession, path: str, batch: DataFrame, update_cols: list[str] | None = None, *,
               order_by: tuple[str, ...] = ("loaded_at",), on_update=None, on_insert=None) -> None:
    """Merge a batch into a table made by ``create_merge_table``.

    Only the buckets the batch touches are read, and written as a new version
    beside the old one; then one small pointer makes it the current one. A job
    that fails before that changes nothing, and its rerun merges into the same
    rows as the first run. One job at a time may write a table. The bucket
    numbers are the one thing collected; there are at most as many as the table
    has. The deduplicated batch is staged once because the merge refers to it
    three times. ``drop_old_versions`` frees what no pointer names.
    """
    buckets, keys = spark.read.parquet(f"{path}/{LAYOUT}").select("buckets", "keys").first()
    source = materialize(with_bucket(dedupe(batch, keys, order_by), keys, buckets))
    touched = [r[0] for r in source.select(BUCKET).distinct().collect()]
    if not touched:
        return
    versions = _versions(spark, path)
    target = _read_buckets(spark, path, {b: versions[b] for b in touched if b in versions})
    merged = merge_upsert(target, source, [*keys, BUCKET], update_cols, order_by=(), on_update=on_update, on_insert=on_insert)
    _publish(spark, path, versions | _write_version(merged, path))


def read_merge_table(spark: SparkSession, path: str) -> DataFrame:
    return _read_buckets(spark, path, _versions(spark, path)).drop(BUCKET)


def drop_old_versions(spark: SparkSession, path: str) -> int:
    """Remove the buckets and pointers that the current pointer does not need; the number of folders removed.

    Call it when no reader of an older state and no merge is at work.
    """
    now, held = _pointer(spark, path), _versions(spark, path)
    wanted = {f"{DATA}/version={v}/{BUCKET}={b}" for b, v in held.items()} | {f"{POINTERS}/{now}"}
    old = [f"{POINTERS}/{n}" for n in _folders(spark, f"{path}/{POINTERS}")]
    for version in _folders(spark, f"{path}/{DATA}"):
        inside = [f"{DATA}/{version}/{b}" for b in _folders(spark, f"{path}/{DATA}/{version}")]
        old += inside if wanted & set(inside) else [f"{DATA}/{version}"]
    gone = [name for name in old if name not in wanted]
    for name in gone:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return len(gone)


def read_jdbc(spark: SparkSession, url: str, table: str, *, partition_column: str, lower: int, upper: int, partitions: int,
              columns: list[str] | None = None, since: str | None = None, **options) -> DataFrame:
    """Partitioned relational extract; column list and date filter are pushed to the database."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=partition_column, lowerBound=lower, upperBound=upper,
        numPartitions=partitions, fetchsize=10000, **options)
    df = reader.load()
    if since is not None:
        df = df.filter(since)
    return df if columns is None else df.select(*columns)

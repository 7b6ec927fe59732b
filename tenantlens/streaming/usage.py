"""Hourly usage as a stream with exact distinct counts; rows behind the watermark are kept and merged by a backfill.

Two queries run in turn. ``start_routing`` splits arriving events into rows on
time and late rows, by the same rule as Spark's watermark, and writes both.
``start_exact_usage`` counts the rows on time. Rows on time are never dropped
there: its watermark follows rows of earlier batches only, as the split does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import BooleanType, IntegerType, StructType

from tenantlens.plans.usage import feature_usage
from tenantlens.sources.sinks import exists

KEYS = ["org_id", "customer_id", "event_hour", "event_type"]


def start_routing(events: DataFrame, path: str, checkpoint: str, delay: str = "2 hours") -> StreamingQuery:
    """Write every event once, with ``late`` true if its hour had ended ``delay`` before the newest event of earlier batches.

    Rows without a time are late. A batch that was written and then repeated
    after a failure is left as it is, so readers see each row once. ``path``
    belongs to one checkpoint.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, here = batch.sparkSession, f"{path}/rows/batch={batch_id}"
        before = spark.read.parquet(f"{path}/marks/{batch_id - 1}").first().high if batch_id else None
        high = F.lit(before).cast("timestamp")
        if not exists(spark, f"{here}/_SUCCESS"):
            ends = F.date_trunc("hour", "server_ts") + F.expr("INTERVAL 1 HOUR")
            late = F.col("server_ts").isNull() | F.coalesce(ends <= high - F.expr(f"INTERVAL {delay}"), F.lit(False))
            batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(here)
        newest = spark.read.schema(batch.schema).parquet(here).agg(F.max("server_ts").alias("newest"))
        newest.select(F.greatest("newest", high).alias("high")).coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/{batch_id}")

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def _routed_schema(schema: StructType) -> StructType:
    return StructType(schema.fields).add("batch", IntegerType()).add("late", BooleanType())


def read_routed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All routed rows with ``late``."""
    return spark.read.schema(_routed_schema(schema)).parquet(f"{path}/rows").drop("batch")


def exact_usage_windows(events: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """Counts per hour with exact distinct users and sessions, emitted once an hour is closed.

    Two chained aggregates: the first has one row per user and one per session
    of an hour, the second counts those rows.
    """
    ids = F.array(F.struct(F.lit("user").alias("kind"), F.col("user_id").cast("string").alias("id")),
                  F.struct(F.lit("session").alias("kind"), F.col("session_id").cast("string").alias("id")))
    each = events.withWatermark("server_ts", watermark).select("org_id", "customer_id", "event_type", "server_ts", F.inline(ids))
    seen = each.groupBy("org_id", "customer_id", "event_type", F.window("server_ts", "1 hour").alias("hour"), "kind", "id").agg(
        F.count(F.lit(1)).alias("n"), F.max("server_ts").alias("last"))
    counted = seen.groupBy("org_id", "customer_id", "event_type", F.window("hour", "1 hour").alias("hour")).agg(
        F.sum(F.when(F.col("kind") == "user", F.col("n"))).alias("event_count"),
        F.count_if((F.col("kind") == "user") & F.col("id").isNotNull()).alias("unique_users"),
        F.count_if((F.col("kind") == "session") & F.col("id").isNotNull()).alias("unique_sessions"), F.max("last").alias("last_seen"))
    return counted.select("org_id", "customer_id", F.col("hour.start").alias("event_hour"), "event_type", "event_count", "unique_users",
                          "unique_sessions", "last_seen")


def start_exact_usage(spark: SparkSession, routed: str, schema: StructType, path: str, checkpoint: str, delay: str = "2 hours") -> StreamingQuery:
    """Append closed hours of the rows on time; ``delay`` is that of the routing."""
    on_time = spark.readStream.schema(_routed_schema(schema)).parquet(f"{routed}/rows").where("NOT late").drop("batch", "late")
    return (exact_usage_windows(on_time, delay).writeStream.format("parquet").option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start(path))


def with_late(emitted: DataFrame, routed: DataFrame) -> DataFrame:
    """Hours that a late row falls in, counted again from all rows; the other hours as emitted. NULL keys count as values."""
    rows = routed.withColumn("event_hour", F.date_trunc("hour", "server_ts"))
    touched = rows.where("late").select(*[F.col(k).alias(f"_{k}") for k in KEYS]).distinct()

    def same(side: DataFrame):
        return reduce(lambda a, b: a & b, [side[k].eqNullSafe(touched[f"_{k}"]) for k in KEYS])

    again = feature_usage(rows.join(touched, same(rows), "left_semi"), lookback_days=None)
    return emitted.join(touched, same(emitted), "left_anti").unionByName(again)

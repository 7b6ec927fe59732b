"""Structured Streaming jobs over landed event files.

All jobs run with ``availableNow``: they take what has arrived and stop, and
a restart on the same checkpoint continues after the last finished batch.
Aggregates are written in update mode, one folder per batch; readers take the
newest row per key, so a replayed batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tenantlens.operators.latest import top_per
from tenantlens.plans.usage import api_cost_measures
from tenantlens.sources.sinks import merge_into


def start_landing(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append events to Parquet exactly once per input file."""
    return events.writeStream.format("parquet").option("checkpointLocation", checkpoint) \
        .outputMode("append").trigger(availableNow=True).start(path)


def dedupe_events(events: DataFrame, time: str, watermark: str = "2 hours") -> DataFrame:
    """First arrival of each event id within the watermark."""
    return events.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["event_id"])


def _write_updates(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def _start_updates(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.outputMode("update").option("checkpointLocation", checkpoint) \
        .foreachBatch(_write_updates(path)).trigger(availableNow=True).start()


def read_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest emitted row per key."""
    rows = spark.read.parquet(path).drop("batch")
    return top_per(rows, keys, [F.col("_batch").desc()]).drop("_batch")


def usage_windows(events: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """Hourly usage; distinct counts are approximate because exact ones are not supported on streams."""
    return events.withWatermark("server_ts", watermark).groupBy("org_id", "customer_id", F.window("server_ts", "1 hour"), "event_type").agg(
        F.count(F.lit(1)).alias("event_count"), F.approx_count_distinct("user_id").alias("unique_users"),
        F.approx_count_distinct("session_id").alias("unique_sessions"), F.max("server_ts").alias("last_seen"),
    ).select("org_id", "customer_id", F.col("window.start").alias("event_hour"), "event_type", "event_count", "unique_users",
             "unique_sessions", "last_seen")


def start_feature_usage(events: DataFrame, path: str, checkpoint: str, watermark: str = "2 hours") -> StreamingQuery:
    return _start_updates(usage_windows(events, watermark), path, checkpoint)


def start_api_cost(events: DataFrame, path: str, checkpoint: str, watermark: str = "2 hours") -> StreamingQuery:
    daily = events.withWatermark("request_ts", watermark).groupBy("org_id", F.window("request_ts", "1 day"), "model_name").agg(*api_cost_measures())
    out = daily.withColumn("usage_date", F.to_date("window.start")).drop("window")
    return _start_updates(out, path, checkpoint)


def start_latest_health(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Latest score per customer; state is one row per customer."""
    last = events.groupBy("customer_id", "org_id").agg(
        F.max(F.struct("event_ts", "event_id", "new_score", "score_driver")).alias("m"))
    return _start_updates(last.select("customer_id", "org_id", "m.event_ts", "m.new_score", "m.score_driver"), path, checkpoint)


def start_merge(rows: DataFrame, path: str, checkpoint: str, update_cols: list[str], *,
                order_by: tuple[str, ...] = ("loaded_at",), on_update=None, on_insert=None) -> StreamingQuery:
    """CDC upsert: merge every micro-batch into a bucketed Parquet table."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        merge_into(batch.sparkSession, path, batch, update_cols, order_by=order_by,
                   on_update=on_update, on_insert=on_insert)

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(upsert).trigger(availableNow=True).start()


def run(query: StreamingQuery) -> None:
    """Wait until everything available has been processed."""
    query.awaitTermination()

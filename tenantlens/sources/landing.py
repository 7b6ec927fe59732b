"""Event landing, file discovery, input contracts and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

FILES_PER_TRIGGER = 1000


def read_event_stream(spark: SparkSession, path: str, schema: str, *, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """JSON lines as a stream, with the untouched record kept in ``_metadata_json``; a backlog is read in bounded batches."""
    reader = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger)
    return parse_events(reader.load(path).withColumnRenamed("value", "_raw"), schema)


def parse_events(lines: DataFrame, schema: str, raw: str = "_raw") -> DataFrame:
    """Typed columns from JSON lines; malformed fields become NULL and the record is kept."""
    rec = F.from_json(raw, schema, {"mode": "PERMISSIVE"})
    return lines.select(rec.alias("_r"), F.col(raw).alias("_metadata_json")).select("_r.*", "_metadata_json")


def land_product_events(events: DataFrame) -> DataFrame:
    """Landed shape of a product event: client time parsed leniently, payload as VARIANT-ready JSON."""
    return events.withColumn("client_ts", F.try_to_timestamp("client_ts"))


def copy_customers(files: DataFrame, mapping: dict[str, Column]) -> DataFrame:
    """Typed copy of landed Parquet into the customer shape."""
    return files.select(*[c.alias(n) for n, c in mapping.items()])


def discover_files(spark: SparkSession, path: str, processed: DataFrame, *, pattern: str = "*", limit: int | None = None) -> DataFrame:
    """Files under ``path`` that no document row refers to yet.

    Only file metadata is read; the content column is pruned.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("relative_path"), F.col("length").alias("size_bytes"))
    new = files.join(processed.select("relative_path"), "relative_path", "left_anti")
    return new if limit is None else new.orderBy("relative_path").limit(limit)


def check_contract(df: DataFrame, required: list[str], name: str = "") -> DataFrame:
    """One row: are the required columns present (any case), row count, NULLs per required column."""
    have = {c.lower(): c for c in df.columns}
    missing = [c for c in required if c.lower() not in have]
    present = [have[c.lower()] for c in required if c.lower() in have]
    nulls = F.array(*[F.concat(F.lit(f"{c}="), F.count_if(F.col(c).isNull())) for c in present]) if present else F.array().cast("array<string>")
    return df.agg(F.count(F.lit(1)).alias("row_count"), nulls.alias("null_counts")).select(
        F.lit(name).alias("table_name"), F.lit(not missing).alias("valid"),
        F.array(*[F.lit(c) for c in missing]).cast("array<string>").alias("missing_columns"), "row_count", "null_counts")


def run_summary(envelope: DataFrame, source: str, ok: Column) -> DataFrame:
    """Ingest log row per tenant: rows loaded, rows failed, status."""
    good = F.count_if(ok)
    total = F.count(F.lit(1))
    status = F.when(good == total, "success").when(good > 0, "partial").otherwise("failed")
    return envelope.groupBy("org_id").agg(
        F.lit(source).alias("source"), good.alias("rows_loaded"), (total - good).alias("rows_failed"), status.alias("status"),
        F.max("loaded_at").alias("loaded_at"))


def load_observed(envelope: DataFrame, path: str, source: str, ok: Column) -> DataFrame:
    """Append the good rows to ``path``; one summary row of the run, counted on the rows as they are written, without another scan.

    Counts are those of all tenants; ``run_summary`` has them by tenant at
    the price of a second scan. A run without rows is a success. ``ok`` reads
    columns: with a constant condition the optimizer removes the observed plan.
    """
    seen = Observation()
    good = F.coalesce(ok, F.lit(False))
    watched = envelope.observe(seen, F.count_if(good).alias("rows_loaded"), F.count_if(~good).alias("rows_failed"), F.max("loaded_at").alias("loaded_at"))
    watched.filter(good).write.mode("append").parquet(path)
    loaded, failed, newest = (seen.get[k] for k in ("rows_loaded", "rows_failed", "loaded_at"))
    status = "success" if not failed else "partial" if loaded else "failed"
    return envelope.sparkSession.createDataFrame(
        [(source, loaded, failed, status, newest)], "source string, rows_loaded long, rows_failed long, status string, loaded_at timestamp")


class RunLog(StreamingQueryListener):
    """Rows and newest time of each batch of the streams that observe ``name``; kept by (query id, batch), so a replay counts once."""

    def __init__(self, name: str):
        self.name, self.batches = name, {}

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def onQueryProgress(self, event):
        row = event.progress.observedMetrics.get(self.name)
        if row is not None and row.rows:
            self.batches[str(event.progress.id), event.progress.batchId] = (row.rows, row.newest)

    def total(self) -> tuple:
        """(rows, newest time) of all batches."""
        return sum(n for n, _ in self.batches.values()), max((t for _, t in self.batches.values() if t is not None), default=None)


def observed(events: DataFrame, name: str, time: str) -> DataFrame:
    """A stream whose batches report to a ``RunLog`` of that name."""
    return events.observe(name, F.count(F.lit(1)).alias("rows"), F.max(time).alias("newest"))

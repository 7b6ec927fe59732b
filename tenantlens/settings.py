"""Session settings and the fixed reference time used by every job.

Jobs never read the clock: each takes ``as_of`` explicitly and defaults to
``AS_OF`` so that repeated runs, and the SQL they are compared with, agree.
"""

from __future__ import annotations

import atexit
import datetime as dt
import shutil
import tempfile

from pyspark.sql import SparkSession

AS_OF = dt.datetime(2024, 1, 31)

# Days added to the star-schema dates so that the newest order falls on AS_OF.
SHIFT_DAYS = 8218

# Settings that must be given when the session is created.
AT_START = {
    # Building a plan is twice as fast without a stack capture per column call.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
}

_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Read zone-less Parquet timestamps as UTC instants, so that range filters
    # compare without a cast and are pushed into the scan.
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Streaming state on local disk instead of the executor heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

TARGET_PARTITION_BYTES = 256 * 1024 * 1024


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the jobs rely on."""
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; a temporary folder is
    used only where nothing is configured, i.e. in local tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="tenantlens-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def run_folder(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables below ``checkpoint_root``."""
    return f"{checkpoint_root(spark)}/tables/{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application. Call it when no result is read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def size_shuffles(spark: SparkSession, input_bytes: int, *, minimum: int = 200) -> int:
    """Shuffle partitions for a job that reads ``input_bytes``.

    Adaptive execution merges small partitions but never splits an ordinary
    large one, so the starting number has to fit the data: about one partition
    per 256 MB, i.e. some 400,000 for 100 TB before column pruning.
    """
    wanted = max(minimum, -(-input_bytes // TARGET_PARTITION_BYTES))
    spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TARGET_PARTITION_BYTES))
    return wanted

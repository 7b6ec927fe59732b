"""Helpers the operators share: staging, keys, folds, grouped streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenantlens.sources.sinks import materialize as stage  # noqa: F401  written to spark.checkpoint.dir and read back

HELD_OUT = 2  # remainder of crc32(doc_id) modulo FOLDS that no model learns from
FOLDS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """128-bit key of a text; null and empty texts share one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text modulo FOLDS; a null id falls in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0))


def partitions_for(rows: int, per_task: int) -> int:
    return max(1, -(-rows // per_task))


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Frames of whole groups from batches sorted by ``keys``, with the bounds of each group; holds one group and one batch."""
    rest = None
    for batch in batches:
        if not len(batch):
            continue
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        starts = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
        if len(starts) > 1:
            yield batch.iloc[:starts[-1]], starts
        rest = batch.iloc[starts[-1]:]
    if rest is not None:
        yield rest, [0, len(rest)]


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups from batches sorted by ``keys``; holds one group and one batch."""
    for frame, starts in whole_groups(batches, keys):
        for a, b in zip(starts, starts[1:]):
            yield frame.iloc[a:b]

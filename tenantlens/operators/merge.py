"""Keyed merge, insert-if-absent, trailing reprocessing and reload."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tenantlens.operators.latest import top_per


def dedupe(source: DataFrame, keys: list[str], order_by: tuple[str, ...]) -> DataFrame:
    """Last row per key; rows with a NULL key cannot match and are rejected.

    A hash of the row breaks ties, so equal load times still give one answer.
    """
    known = source.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    order = [F.col(c).desc_nulls_last() for c in order_by] + [F.xxhash64(*source.columns).asc()]
    return top_per(known, keys, order)


def rejected(source: DataFrame, keys: list[str]) -> DataFrame:
    """How many source rows a merge ignores: repeats of a key, and NULL keys."""
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    per_key = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first(missing).alias("missing"))
    return per_key.agg(
        F.coalesce(F.sum(F.when(~F.col("missing"), F.col("n") - 1)), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(F.col("missing"), F.col("n"))), F.lit(0)).alias("null_key_rows"))


def merge_upsert(target: DataFrame, source: DataFrame, keys: list[str], update_cols: list[str] | None = None, *,
                 insert_only: bool = False, order_by: tuple[str, ...] = ("loaded_at",),
                 on_update: dict[str, Column] | None = None, on_insert: dict[str, Column] | None = None) -> DataFrame:
    """New state of ``target`` after merging ``source`` by key.

    Matched rows take ``update_cols`` (default: every shared column) and
    ``on_update``; unmatched source rows are appended with ``on_insert``.

    A batch is usually far smaller than its target. The target is therefore
    only ever the streamed side: one left join for the updates, and one
    semi join on the key columns to find which source keys exist. When the
    batch fits a broadcast, no target row is shuffled.
    """
    on_update, on_insert = on_update or {}, on_insert or {}
    src = dedupe(source, keys, order_by) if order_by else source
    shared = [c for c in target.columns if c in src.columns and c not in keys]
    inserts = src.join(target.select(*keys).join(src.select(*keys), keys, "left_semi"), keys, "left_anti")
    new = inserts.select(*[
        (on_insert[c] if c in on_insert else F.col(c) if c in keys + shared else F.lit(None)).cast(target.schema[c].dataType).alias(c)
        for c in target.columns])
    if insert_only:
        return target.unionByName(new)
    updates = [c for c in (shared if update_cols is None else update_cols)]
    side = src.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in updates], F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull()

    def value(c: str) -> Column:
        if c in on_update:
            return F.when(hit, on_update[c]).otherwise(F.col(c))
        if c in updates:
            return F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c))
        return F.col(c)

    kept = target.join(side, keys, "left").select(*[value(c).cast(target.schema[c].dataType).alias(c) for c in target.columns])
    return kept.unionByName(new)


def insert_absent(target: DataFrame, source: DataFrame, keys: list[str], order_by: tuple[str, ...] = ("loaded_at",)) -> DataFrame:
    return merge_upsert(target, source, keys, insert_only=True, order_by=order_by)


def changes_since(staging: DataFrame, watermark: Column) -> DataFrame:
    """Batch form of an append-only change stream: rows loaded after the watermark."""
    return staging.filter(F.col("loaded_at") > watermark)


def replace_window(stored: DataFrame, recomputed: DataFrame, column: str, since: Column) -> DataFrame:
    """Stored rows before ``since`` plus the recomputed rows from ``since`` on."""
    return stored.filter(F.col(column) < since).unionByName(recomputed.filter(F.col(column) >= since))


def reload_groups(stored: DataFrame, fresh: DataFrame, by: list[str]) -> DataFrame:
    """Delete every stored row of the groups in ``fresh``, then add ``fresh``."""
    return stored.join(fresh.select(*by).distinct(), by, "left_anti").unionByName(fresh)


def retain(df: DataFrame, expired: Column) -> DataFrame:
    """Rows that are not expired; an unknown expiry keeps the row."""
    return df.filter(~F.coalesce(expired, F.lit(False)))

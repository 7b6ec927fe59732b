"""Latest-row selection.

``row_number() <= 1`` is planned with a partial group limit in front of the
exchange, so a key that owns a third of the rows still ships one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _cols(names):
    return [F.col(n) if isinstance(n, str) else n for n in names]


_HASHABLE = ("string", "bigint", "int", "double", "float", "boolean", "date", "timestamp", "decimal")


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank_col: str | None = None, *, salt: int = 0) -> DataFrame:
    """First ``n`` rows per key in a total order.

    ``salt`` is for few, large keys such as tenants: the first ``n`` of each of
    ``salt`` slices of a key are found in parallel, and only those meet in the
    task that ranks the whole key.
    """
    if salt:
        plain = [c for c, kind in df.dtypes if kind.startswith(_HASHABLE)]
        sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*plain), F.lit(salt)))
        df = top_per(sliced, [*keys, "_slice"], order, n).drop("_slice")
    rank = rank_col or "_rn"
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*_cols(keys)).orderBy(*order)))
    kept = ranked.filter(F.col(rank) <= n)
    return kept if rank_col else kept.drop(rank)


def top_per_tenant(df: DataFrame, order: list[Column], n: int, rank_col: str = "rank") -> DataFrame:
    return top_per(df, ["org_id"], order, n, rank_col, salt=16)


def latest_by(df: DataFrame, keys: list[str], time: str, tiebreak: list[str] = ()) -> DataFrame:
    order = [F.col(time).desc_nulls_last()] + [F.col(c).asc() for c in tiebreak]
    return top_per(df, keys, order)


def latest_with_ties(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Every row whose time equals the key's maximum.

    Rank 1 is also group-limited before the exchange; rows tied at the
    maximum are all kept.
    """
    ranked = df.withColumn("_rk", F.rank().over(Window.partitionBy(*_cols(keys)).orderBy(F.col(time).desc_nulls_last())))
    return ranked.filter("_rk = 1").drop("_rk")


def latest_scores(churn_scores: DataFrame) -> DataFrame:
    """One churn score per customer and tenant."""
    return latest_by(churn_scores, ["customer_id", "org_id"], "scored_at", ["score_id"])

"""Masking by policy, tenant isolation, tags and PII scans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from tenantlens.functions.masks import MASKS


@dataclass(frozen=True)
class MaskRule:
    table: str
    column: str
    mask: str
    allowed: tuple[str, ...] = ("ADMIN",)


POLICY = (
    MaskRule("customers", "email", "email"), MaskRule("customers", "phone", "phone"), MaskRule("customers", "name", "name"),
    MaskRule("prompt_log", "user_name", "name"), MaskRule("prompt_log", "prompt_text", "text"),
    MaskRule("interactions", "body", "text"), MaskRule("patient_engagement", "patient_id", "patient_id", ("ADMIN", "HEALTH_ANALYST")),
)


@dataclass(frozen=True)
class Tag:
    table: str
    column: str
    level: str
    regime: str = ""


# Personal-data level and regime per column.
TAGS = (
    Tag("customers", "email", "DIRECT", "LGPD"), Tag("customers", "phone", "DIRECT", "LGPD"), Tag("customers", "name", "DIRECT"),
    Tag("prompt_log", "user_name", "QUASI"), Tag("prompt_log", "prompt_text", "SENSITIVE", "LGPD"),
)
DOMAINS = {"customers": ("CUSTOMER", 2555), "prompt_log": ("AUDIT", 2555), "churn_scores": ("AI_OUTPUT", None), "recommendations": ("AI_OUTPUT", None)}

# Detection patterns for the column scan.
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z.]+",
    "phone": r"(^|[^0-9])[0-9]{10,13}([^0-9]|$)",
    "ip": r"(^|[^0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}([^0-9.]|$)",
}


def apply_masks(df: DataFrame, table: str, role: str, policy=POLICY) -> DataFrame:
    """Replace the masked columns of a table unless the role is allowed to see them."""
    masked = {r.column: MASKS[r.mask](r.column) for r in policy if r.table == table and role not in r.allowed and r.column in df.columns}
    return df.withColumns(masked) if masked else df


def tenant_filter(df: DataFrame, user_org_map: DataFrame, user: str, *, is_admin: bool = False, open_without_map: bool = False) -> DataFrame:
    """Rows of the tenants mapped to ``user``; administrators see everything.

    An empty map opens nothing unless ``open_without_map`` says so.
    """
    mapping = user_org_map.filter(F.col("org_id").isNotNull())
    if is_admin or user == "SYSTEM" or (open_without_map and mapping.isEmpty()):
        return df
    mine = mapping.filter(F.col("user_name") == user).select("org_id").distinct()
    return df.join(mine, "org_id", "left_semi")


def visible_rows(df: DataFrame, user_org_map: DataFrame) -> DataFrame:
    """Row counts each mapped user may see: the isolation rule for all users at once."""
    per_org = df.groupBy("org_id").agg(F.count(F.lit(1)).alias("n"))
    everything = per_org.agg(F.sum("n").alias("n")).select(F.lit("*").alias("scope"), "n")
    scopes = per_org.withColumnRenamed("org_id", "scope").unionByName(everything)
    users = user_org_map.withColumn("scope", F.when(F.col("role") == "ADMIN", "*").otherwise(F.col("org_id")))
    return users.join(scopes, "scope", "left").groupBy("user_name", "role").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("visible"))


def kb_policy(docs: DataFrame, access: DataFrame, role: str) -> DataFrame:
    return docs.join(access.filter(F.col("role") == role).select("kb_name").distinct(), "kb_name", "left_semi")


def classify_columns(df: DataFrame, table: str, *, threshold: float = 0.5) -> DataFrame:
    """Share of values per string column that look like personal data: one aggregate over all rows."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    aggs = [F.count(c).alias(f"{c}__n") for c in strings]
    aggs += [F.count_if(F.col(c).rlike(p)).alias(f"{c}__{kind}") for c in strings for kind, p in PII_PATTERNS.items()]
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__n").alias("non_null"), *[F.col(f"{c}__{k}").alias(f"{k}_hits") for k in PII_PATTERNS])
        for c in strings])
    long = df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")
    kind = None
    for k in PII_PATTERNS:
        cond = F.col(f"{k}_hits") > F.col("non_null") * threshold
        kind = F.when(cond, k) if kind is None else kind.when(cond, k)
    return long.select(F.lit(table).alias("table_name"), "*", kind.otherwise("none").alias("detected"))


def pii_inventory(scan: DataFrame, tags=TAGS) -> DataFrame:
    """Scan result with the declared tag of each column, and whether the two agree."""
    level, regime = F.lit("NONE"), F.lit("")
    for t in tags:
        hit = (F.col("table_name") == t.table) & (F.col("column_name") == t.column)
        level, regime = F.when(hit, t.level).otherwise(level), F.when(hit, t.regime).otherwise(regime)
    out = scan.withColumns({"pii_level": level, "compliance": regime})
    return out.withColumn("untagged_hit", (F.col("detected") != "none") & (F.col("pii_level") == "NONE"))

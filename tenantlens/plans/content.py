"""Document and contract views."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tenantlens.functions.columns import day, days_between, nz
from tenantlens.operators.documents import chunk_window
from tenantlens.settings import AS_OF

CONTRACT_LIKE = ("contract", "sla", "amendment", "addendum")


def contract_intelligence(documents: DataFrame, c360: DataFrame, *, as_of=AS_OF) -> DataFrame:
    """Contract documents with days to expiry and renewal state; no end date counts as ACTIVE."""
    left = days_between(day(as_of), F.col("end_date"))
    state = F.when(left < 0, "EXPIRED").when(left <= 30, "EXPIRING_SOON").when(left <= 90, "RENEW_WATCH").otherwise("ACTIVE")
    names = c360.select(F.col("customer_id").alias("entity_id"), "org_id", "customer_name")
    docs = documents.filter(F.col("document_type") == "contract")
    return docs.join(names, ["entity_id", "org_id"], "left").select(
        "document_id", "org_id", F.col("document_name").alias("contract_name"), F.col("entity_id").alias("customer_id"), "customer_name",
        "end_date", left.alias("days_to_expiry"), state.alias("renewal_status"), "auto_renewal",
        F.size("risk_flags").alias("risk_flag_count"), F.to_date("created_at").alias("uploaded_at"))


def _chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"))


def document_chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    docs = documents.filter(F.col("document_type").isin(*CONTRACT_LIKE))
    return docs.join(_chunk_counts(chunks), "document_id", "left").select(
        "document_id", "org_id", "document_name", "document_type", "processing_status", "created_at", nz("chunk_count").alias("chunk_count"))


def contract_chunks(documents: DataFrame, customers: DataFrame) -> DataFrame:
    """Chunk rows of contract-like documents with contract and customer context.

    The names are joined to the documents before they are cut, so a text moves
    at most once.
    """
    docs = documents.filter(F.col("document_type").isin(*CONTRACT_LIKE)).select(
        "document_id", "org_id", F.col("document_name").alias("contract_name"), "document_type", F.col("entity_id").alias("customer_id"),
        "end_date", "auto_renewal", "extracted_text")
    names = customers.select("customer_id", "org_id", F.col("name").alias("customer_name"))
    return chunk_window(docs.join(names, ["customer_id", "org_id"], "left"), all_columns=True).drop("char_count")


def document_library(documents: DataFrame, customers: DataFrame, chunks: DataFrame) -> DataFrame:
    names = customers.select(F.col("customer_id").alias("entity_id"), "org_id", F.col("name").alias("_name"))
    return documents.join(names, ["entity_id", "org_id"], "left").join(_chunk_counts(chunks), "document_id", "left").select(
        "document_id", "org_id", "document_name", "document_type", "entity_type", F.coalesce("_name", "entity_id").alias("entity_name"),
        "processing_status", nz("chunk_count").alias("chunks"), "created_at")


def library_totals(library: DataFrame) -> DataFrame:
    return library.groupBy("org_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("processing_status") == "completed").alias("completed"),
        F.count_if(F.col("processing_status") == "pending").alias("pending"), F.sum("chunks").alias("chunks"))

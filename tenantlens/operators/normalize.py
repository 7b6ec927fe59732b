"""Source payloads to canonical rows, and the CDC merge table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tenantlens.functions.columns import ago, dec, mapped, nz
from tenantlens.operators.latest import top_per
from tenantlens.operators.merge import dedupe, merge_upsert
from tenantlens.settings import AS_OF
from tenantlens.sources.sinks import materialize

# Source vocabulary -> canonical vocabulary.
TICKET_STATUS = {"new": "open", "open": "open", "pending": "open", "hold": "open", "solved": "resolved", "closed": "resolved"}
TICKET_PRIORITY = {"low": "low", "normal": "medium", "high": "high", "urgent": "critical"}
SUBSCRIPTION_STATUS = {"active": "active", "trialing": "trial", "past_due": "active", "canceled": "cancelled", "unpaid": "cancelled"}
INVOICE_KIND = {"subscription_create": "new_contract", "subscription_update": "upsell"}
INVOICE_KIND_STAGED = {"subscription_create": "new_business", "subscription_cycle": "renewal", "subscription_update": "expansion"}

_TICKET = ("id STRING, requester_id STRING, subject STRING, status STRING, priority STRING, "
           "metric_set STRUCT<first_reply_time_in_minutes: STRUCT<breached: BOOLEAN>>, created_at STRING")
_SUBSCRIPTION = ("id STRING, customer STRING, status STRING, current_period_end BIGINT, "
                 "items STRUCT<data: ARRAY<STRUCT<plan: STRUCT<amount: BIGINT, nickname: STRING>>>>")
_INVOICE = "id STRING, customer STRING, status STRING, billing_reason STRING, amount_paid BIGINT, currency STRING, created BIGINT"
_ACCOUNT = "Id STRING, Name STRING, BillingEmail STRING, Industry STRING, BillingCountry STRING"


def _parsed(envelope: DataFrame, schema: str) -> DataFrame:
    return envelope.select("org_id", "loaded_at", F.from_json("raw_data", schema).alias("r")).select("org_id", "loaded_at", "r.*")


def _epoch_day(col: str) -> Column:
    return F.to_date(F.timestamp_seconds(F.col(col)))


def support_tickets(envelope: DataFrame) -> DataFrame:
    """Desk tickets; unknown or missing codes fall back to open / medium."""
    rows = _parsed(envelope, _TICKET)
    return rows.filter(F.col("id").isNotNull()).select(
        F.col("id").alias("ticket_id"), "org_id", nz("requester_id", "").alias("customer_id"),
        nz("subject", "").alias("subject"),
        mapped(nz("status", "open"), TICKET_STATUS, "open").alias("status"),
        mapped(nz("priority", "normal"), TICKET_PRIORITY, "medium").alias("priority"),
        nz(F.col("metric_set.first_reply_time_in_minutes.breached"), False).alias("sla_breached"),
        F.to_timestamp("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), "loaded_at")


def latest_tickets(envelope: DataFrame) -> DataFrame:
    """Last loaded version per ticket and tenant."""
    return top_per(support_tickets(envelope), ["org_id", "ticket_id"], [F.col("loaded_at").desc(), F.col("status")])


def billing_subscriptions(envelope: DataFrame) -> DataFrame:
    """MRR is the sum of the item amounts, summed inside the row."""
    rows = _parsed(envelope, _SUBSCRIPTION)
    cents = F.aggregate(F.col("items.data"), F.lit(0).cast("bigint"), lambda acc, i: acc + i["plan"]["amount"])
    mrr = dec(dec(cents, 20, 0) / 100)
    return rows.select(
        F.col("id").alias("subscription_id"), "org_id", F.col("customer").alias("customer_id"),
        nz(F.get(F.col("items.data"), F.lit(0))["plan"]["nickname"], "unknown").alias("plan_name"),
        mapped(F.col("status"), SUBSCRIPTION_STATUS, "active").alias("status"),
        mrr.alias("mrr"), dec(mrr * 12).alias("arr"), _epoch_day("current_period_end").alias("renewal_date"))


def billing_transactions(envelope: DataFrame) -> DataFrame:
    paid = _parsed(envelope, _INVOICE).filter(F.col("status") == "paid")
    return paid.select(
        F.col("id").alias("transaction_id"), "org_id", F.col("customer").alias("customer_id"),
        dec(dec("amount_paid", 20, 0) / 100).alias("amount"), F.upper(nz("currency", "usd")).alias("currency"),
        mapped(nz("billing_reason", ""), INVOICE_KIND, "renewal").alias("transaction_type"),
        F.lit("completed").alias("status"), _epoch_day("created").alias("transaction_date"))


def _field(path: str, kind: str) -> Column:
    return F.try_variant_get("v", path, kind)


def _variant(envelope: DataFrame, as_of, hours: int | None) -> DataFrame:
    recent = envelope if hours is None else envelope.filter(F.col("loaded_at") >= ago(as_of, hours=hours))
    return recent.select("org_id", "loaded_at", F.try_parse_json("raw_data").alias("v"))


def staged_subscriptions(envelope: DataFrame, *, hours: int = 25, as_of=AS_OF) -> DataFrame:
    """Open-shape variant of the subscription load over a trailing window."""
    return _variant(envelope, as_of, hours).select(
        _field("$.id", "string").alias("external_id"), "org_id", _field("$.status", "string").alias("status"),
        dec(_field("$.plan.amount", "decimal(20,0)") / 100).alias("mrr"), _field("$.plan.interval", "string").alias("billing_interval"),
        F.timestamp_seconds(_field("$.current_period_start", "bigint")).alias("current_period_start"),
        F.timestamp_seconds(_field("$.current_period_end", "bigint")).alias("current_period_end"))


def staged_transactions(envelope: DataFrame, *, hours: int = 25, as_of=AS_OF) -> DataFrame:
    rows = _variant(envelope, as_of, hours).filter(_field("$.status", "string") == "paid")
    return rows.select(
        _field("$.id", "string").alias("external_id"), "org_id", dec(_field("$.amount_paid", "decimal(20,0)") / 100).alias("amount"),
        _field("$.currency", "string").alias("currency"), _field("$.status", "string").alias("status"),
        mapped(nz(_field("$.billing_reason", "string"), ""), INVOICE_KIND_STAGED, "other").alias("transaction_type"),
        F.timestamp_seconds(_field("$.created", "bigint")).alias("transaction_date"))


def crm_customers(envelope: DataFrame) -> DataFrame:
    """CRM accounts; the industry also serves as segment."""
    return _parsed(envelope, _ACCOUNT).select(
        F.col("Id").alias("customer_id"), "org_id", nz("Name", "").alias("name"), nz("BillingEmail", "").alias("email"),
        nz("Industry", "SMB").alias("segment"), nz("BillingCountry", "").alias("region"), nz("Industry", "").alias("industry"),
        F.lit("active").alias("lifecycle_stage"), F.lit("salesforce").alias("source_system"))


# -- change-data capture -------------------------------------------------------
@dataclass(frozen=True)
class Feed:
    """One source object: id prefix, id path, target key and value columns (name -> path, type)."""

    prefix: str
    id_path: str
    key: str
    fields: dict[str, tuple[str, str]]
    customer_path: str | None = None
    constants: dict[str, str] | None = None
    updates: tuple[str, ...] = ()


def _people(prefix, id_path, name, email):
    return Feed(prefix, id_path, "customer_id", {"name": (name, "string"), "email": (email, "string")}, updates=("name", "email"))


def _bookings(prefix, id_path, customer, amount, date, kind, currency=None):
    fields = {"amount": (amount, "decimal(18,2)"), "transaction_date": (date, "date")}
    if currency:
        fields["currency"] = (currency, "string")
    return Feed(prefix, id_path, "transaction_id", fields, customer, {"transaction_type": kind}, ("amount",))


FEEDS = {
    "sap_customers": _people("SAP-", "$.CustomerID", "$.Name", "$.Email"),
    "oracle_customers": _people("ORCL-", "$.CUSTOMER_ID", "$.NAME", "$.EMAIL"),
    "hubspot_contacts": _people("HS-", "$.id", "$.properties", "$.properties.email"),
    "sap_invoices": _bookings("SAP-", "$.InvoiceID", "$.CustomerID", "$.Amount", "$.InvoiceDate", "invoice", "$.Currency"),
    "sap_orders": _bookings("SAP-", "$.OrderID", "$.CustomerID", "$.Amount", "$.OrderDate", "order", "$.Currency"),
    "oracle_orders": _bookings("ORCL-", "$.ORDER_ID", "$.CUSTOMER_ID", "$.AMOUNT", "$.ORDER_DATE", "order"),
    "oracle_invoices": _bookings("ORCL-", "$.INVOICE_ID", "$.CUSTOMER_ID", "$.AMOUNT", "$.INVOICE_DATE", "invoice"),
    "hubspot_deals": _bookings("HS-", "$.id", "$.properties.associated_contact_id", "$.properties.amount", "$.properties.closedate", "deal"),
    "hubspot_companies": Feed("HS-", "$.id", "account_id", {
        "account_name": ("$.properties.name", "string"), "industry": ("$.properties.industry", "string"),
        "employee_count": ("$.properties.numberofemployees", "int"), "annual_revenue": ("$.properties.annualrevenue", "decimal(18,2)"),
        "website": ("$.properties.domain", "string")},
        updates=("account_name", "industry", "employee_count", "annual_revenue", "website")),
}


def project(envelope: DataFrame, feed: str, *, as_of=AS_OF) -> DataFrame:
    """Typed rows of one feed; payloads without an id are dropped."""
    f = FEEDS[feed]
    rows = _variant(envelope, as_of, None).withColumn("_id", _field(f.id_path, "string")).filter(F.col("_id").isNotNull())
    cols = {name: _field(path, kind) for name, (path, kind) in f.fields.items()}
    if feed == "hubspot_contacts":
        first, last = (nz(_field(f"$.properties.{p}", "string"), "") for p in ("firstname", "lastname"))
        cols["name"] = F.trim(F.concat(first, F.lit(" "), last))
    if f.customer_path:
        cols["customer_id"] = F.concat(F.lit(f.prefix), _field(f.customer_path, "string"))
    for name, value in (f.constants or {}).items():
        cols[name] = F.lit(value)
    return rows.select(
        F.concat(F.lit(f.prefix), "_id").alias(f.key), "org_id", *[c.alias(n) for n, c in cols.items()], "loaded_at")


def merge_feed(target: DataFrame | None, envelope: DataFrame, feed: str, *, stamp: Column, as_of=AS_OF) -> DataFrame:
    """Merge one load of a feed into its core table; ``None`` starts the table.

    The parsed, deduplicated load is staged once: the merge refers to it three
    times and would otherwise parse the JSON as often.
    """
    f = FEEDS[feed]
    keys = [f.key, "org_id"]  # two tenants may use one source id
    rows = dedupe(project(envelope, feed, as_of=as_of), keys, ("loaded_at",))
    extra = {"status": F.lit("completed")} if f.key == "transaction_id" else {}
    always = {**extra, "updated_at": stamp}
    if target is None:
        return rows.drop("loaded_at").withColumns(always)
    return merge_upsert(target, materialize(rows), keys, list(f.updates), order_by=(), on_update=always, on_insert=always)

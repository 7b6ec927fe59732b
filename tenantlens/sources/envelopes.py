"""Raw source payloads derived from the supplied tables.

Each source object is a JSON string in an ``(org_id, raw_data, loaded_at)``
envelope, in two loads: a first one, and a later one that updates some keys,
adds new ones, repeats a few and contains rows without an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tenantlens.functions.columns import ago, dec
from tenantlens.sources.bindings import Tables, shifted

FIRST_LOAD_HOURS = 3  # loads happen 3, 2 and 1 hours before as_of


def to_envelope(rows: DataFrame, org_id, loaded_at: Column, payload: Column | None = None) -> DataFrame:
    """Wrap rows as ``(org_id, raw_data, loaded_at)``; the payload defaults to the whole row."""
    org = F.col(org_id) if isinstance(org_id, str) and org_id in rows.columns else F.lit(org_id) if isinstance(org_id, str) else org_id
    body = F.struct(*[F.col(c) for c in rows.columns]) if payload is None else payload
    return rows.select(org.alias("org_id"), F.to_json(body).alias("raw_data"), loaded_at.alias("loaded_at"))


def read_envelopes(spark, path: str, org_id: str, loaded_at: Column) -> DataFrame:
    """Line-delimited JSON files as envelopes, untouched."""
    return spark.read.text(path).select(F.lit(org_id).alias("org_id"), F.col("value").alias("raw_data"), loaded_at.alias("loaded_at"))


def _versions(df: DataFrame, k: Column) -> DataFrame:
    """One row per key and load: 0 first load, 1 second, 2 repeated, 3 without id."""
    loads = F.array_compact(F.array(
        F.when(k % 10 != 9, 0), F.when((k % 10).isin(0, 9), 1), F.when(k % 100 == 0, 2), F.when(k % 50 == 5, 3)))
    return df.withColumn("v", F.explode(loads))


def _loaded_at(t: Tables) -> Column:
    v = F.col("v")
    return F.when(v == 0, ago(t.as_of, hours=3)).when(v == 2, ago(t.as_of, hours=1)).otherwise(ago(t.as_of, hours=2))


def _customer_rows(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t._with_tenant(_versions(t.raw("customer"), k), "c_custkey").withColumn("key", F.when(F.col("v") != 3, k))


def _order_rows(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t._with_tenant(_versions(t.raw("orders"), k), "o_custkey").withColumn("key", F.when(F.col("v") != 3, k))


def _props(**fields) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def source_objects() -> dict[str, tuple]:
    """Object name -> (row builder, payload)."""
    name = F.concat(F.col("c_name"), F.lit(" v"), F.col("v"))
    email = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))
    amount = dec("o_totalprice") + F.col("v")
    date = F.date_format(shifted("o_orderdate"), "yyyy-MM-dd")
    cust, key = F.col("o_custkey"), F.col("key")
    return {
        "sap_customers": (_customer_rows, _props(CustomerID=key, Name=name, Email=email)),
        "oracle_customers": (_customer_rows, _props(CUSTOMER_ID=key, NAME=name, EMAIL=email)),
        "hubspot_contacts": (_customer_rows, _props(id=key, properties=_props(
            firstname=F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")), lastname=F.concat(F.lit("v"), F.col("v")), email=email))),
        "hubspot_companies": (_customer_rows, _props(id=key, properties=_props(
            name=name, industry=F.col("c_mktsegment"), numberofemployees=F.col("c_custkey") % 1000 + F.col("v"),
            annualrevenue=dec(F.abs("c_acctbal") * 100), domain=F.concat(F.lit("www"), F.col("c_custkey"), F.lit(".example.com"))))),
        "sap_invoices": (_order_rows, _props(InvoiceID=key, CustomerID=cust, Amount=amount, Currency=F.lit("EUR"), InvoiceDate=date)),
        "sap_orders": (_order_rows, _props(OrderID=key, CustomerID=cust, Amount=amount, Currency=F.lit("EUR"), OrderDate=date)),
        "oracle_orders": (_order_rows, _props(ORDER_ID=key, CUSTOMER_ID=cust, AMOUNT=amount, ORDER_DATE=date)),
        "oracle_invoices": (_order_rows, _props(INVOICE_ID=key, CUSTOMER_ID=cust, AMOUNT=amount, INVOICE_DATE=date)),
        "hubspot_deals": (_order_rows, _props(id=key, properties=_props(associated_contact_id=cust, amount=amount, closedate=date))),
    }


def envelopes(t: Tables, name: str) -> DataFrame:
    rows, payload = source_objects()[name]
    return to_envelope(rows(t), F.col("org_id"), _loaded_at(t), payload)


def _pick(k: Column, values: list) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int"))


def support_tickets(t: Tables) -> DataFrame:
    """Support-desk tickets: one per order, some updated in a later load."""
    k = F.col("o_orderkey")
    breached = _props(first_reply_time_in_minutes=_props(breached=k % 3 == 0))
    status = F.when(F.col("v") == 0, _pick(k, ["new", "open", "pending", "hold", "solved", "closed", "odd"])).otherwise("solved")
    payload = _props(
        id=F.col("key"), requester_id=F.col("o_custkey"), subject=F.concat(F.lit("Order "), k, F.lit(" "), F.repeat(F.lit("x"), (k % 700).cast("int"))),
        status=status, priority=_pick(k, ["low", "normal", "high", "urgent", None]), metric_set=F.when(k % 4 != 0, breached),
        created_at=F.date_format(F.col("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return to_envelope(_order_rows(t), F.col("org_id"), _loaded_at(t), payload)


def billing_subscriptions(t: Tables) -> DataFrame:
    """Billing subscriptions with one to three priced items, amounts in cents."""
    k = F.col("o_orderkey")
    cents = F.floor(F.col("o_totalprice")).cast("long")
    items = F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: F.struct(
        F.struct((cents + i).alias("amount"), F.concat(F.lit("plan-"), i).alias("nickname")).alias("plan")))
    start = F.unix_timestamp("o_orderdate")
    payload = _props(
        id=F.concat(F.lit("sub_"), k), customer=F.concat(F.lit("cus_"), F.col("o_custkey")),
        status=_pick(k, ["active", "trialing", "past_due", "canceled", "unpaid", "unknown"]), items=F.struct(items.alias("data")),
        plan=_props(amount=cents, interval=F.when(k % 2 == 0, "month").otherwise("year")),
        current_period_start=start, current_period_end=start + 365 * 86400, created=start)
    rows = t._with_tenant(t.raw("orders"), "o_custkey")
    return to_envelope(rows, F.col("org_id"), _recent(t, k), payload)


def billing_invoices(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    payload = _props(
        id=F.concat(F.lit("in_"), k), customer=F.concat(F.lit("cus_"), F.col("o_custkey")), status=_pick(k, ["paid", "paid", "open", "void"]),
        billing_reason=_pick(k, ["subscription_create", "subscription_cycle", "subscription_update", "manual", None]),
        amount_paid=F.floor(F.col("o_totalprice") * 10).cast("long"), currency=_pick(k, ["usd", "eur", None]), created=F.unix_timestamp("o_orderdate"))
    rows = t._with_tenant(t.raw("orders"), "o_custkey")
    return to_envelope(rows, F.col("org_id"), _recent(t, k), payload)


def _recent(t: Tables, k: Column) -> Column:
    """Three quarters of the rows were loaded inside the 25-hour window."""
    return F.when(k % 4 == 3, ago(t.as_of, hours=26)).otherwise(ago(t.as_of, hours=1))


def crm_accounts(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    payload = _props(Id=F.concat(F.lit("001"), k), Name=F.col("c_name"), BillingEmail=F.when(k % 5 != 0, F.concat(F.lit("b"), k, F.lit("@example.com"))),
                     Industry=F.when(k % 6 != 0, F.col("c_mktsegment")), BillingCountry=F.concat(F.lit("C"), F.col("c_nationkey")))
    return to_envelope(t._with_tenant(t.raw("customer"), "c_custkey"), F.col("org_id"), ago(t.as_of, hours=1), payload)

"""Bind the supplied star-schema tables to the customer/revenue entities.

Each entity is a lazy DataFrame attribute of :class:`Tables`. Only the columns
an entity needs are read, dates are shifted by a literal, and the tenant comes
from customer -> nation -> region. Nothing here is materialised: a job that
uses two columns of ``tickets`` scans just those.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenantlens.functions.columns import ago, day, days_ago, dec, mapped, risk_level, sentiment_label, ts
from tenantlens.schemas import SOURCES
from tenantlens.settings import AS_OF, SHIFT_DAYS, configure

_PRIORITY = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium"}
_TIER = {"1-URGENT": "enterprise", "2-HIGH": "business", "3-MEDIUM": "standard"}
_LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def shifted(column: str):
    """Star-schema date moved onto the reference calendar."""
    return F.date_add(F.to_date(column), SHIFT_DAYS)


def shifted_ts(column: str):
    return F.col(column) + F.expr(f"INTERVAL {SHIFT_DAYS} DAYS")


def span(days, hours=None):
    """Day-time interval from integer columns."""
    hours = F.lit(0) if hours is None else hours
    return F.make_dt_interval(days.cast("int"), hours.cast("int"))


def line_id():
    """Order lines have no unique (order, line) pair, so six columns are hashed."""
    parts = [
        dec(c, 18, 2).cast("string") if c == "l_extendedprice"
        else F.date_format(c, "yyyy-MM-dd") if c == "l_shipdate"
        else F.col(c).cast("string")
        for c in _LINE_KEY
    ]
    return F.md5(F.concat_ws("|", *parts))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str, as_of=AS_OF):
        self.spark = configure(spark)
        self.dir = sf_dir
        self.as_of = as_of
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.schema(SOURCES[name]).parquet(f"{self.dir}/{name}.parquet")
        return self._raw[name]

    # -- tenancy ---------------------------------------------------------
    def _with_tenant(self, df: DataFrame, key: str) -> DataFrame:
        """Add customer_id and org_id by customer key.

        Customers are joined first, on two narrow columns, and the 25-row
        nation table last: the size estimate of each build side stays that of
        the table itself, so a small one is broadcast and a large one is not.
        """
        customer = self.raw("customer").select("c_custkey", "c_nationkey")
        nation = self.raw("nation").select("n_nationkey", "n_regionkey")
        return (
            df.join(customer, F.col(key) == F.col("c_custkey")) if "c_custkey" not in df.columns else df
        ).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumns({
            "customer_id": F.concat(F.lit("CUST-"), F.col("c_custkey")),
            "org_id": F.concat(F.lit("ORG-"), F.col("n_regionkey")),
        })

    @cached_property
    def _tenant_orders(self) -> DataFrame:
        """Orders with their tenant: resolved before lines are joined, so lines move once."""
        orders = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
        return self._with_tenant(orders, "o_custkey").select("o_orderkey", "o_orderstatus", "o_orderpriority", "customer_id", "org_id")

    @cached_property
    def user_org_map(self) -> DataFrame:
        """One analyst per nation; every 7th is an admin, every 9th has no tenant."""
        k = F.col("n_nationkey")
        return self.raw("nation").select(
            F.lower("n_name").alias("user_name"),
            F.when(k % 9 != 8, F.concat(F.lit("ORG-"), F.col("n_regionkey"))).alias("org_id"),
            F.when(k % 7 == 0, "ADMIN").otherwise("ANALYST").alias("role"),
        )

    # -- core entities -----------------------------------------------------
    @cached_property
    def customers(self) -> DataFrame:
        k = F.col("c_custkey")
        nation, region = self.raw("nation"), self.raw("region")
        stage = F.when(k % 10 == 0, "churned").when((k % 10).isin(1, 2), "at_risk") \
            .when(k % 10 == 3, "onboarding").otherwise("active")
        mrr = dec(F.abs("c_acctbal"))
        end = F.date_add(days_ago(self.as_of, 60), ((k * 13) % 400).cast("int"))
        return (
            self.raw("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.concat(F.lit("CUST-"), k).alias("customer_id"),
                F.concat(F.lit("ORG-"), F.col("r_regionkey")).alias("org_id"),
                F.col("c_name").alias("name"),
                F.when(k % 17 != 0, F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))).alias("email"),
                F.concat(F.lit("55"), F.lit(1000000) + k, F.lit("99")).alias("phone"),
                F.when(k % 23 != 0, F.col("c_mktsegment")).alias("segment"),
                F.col("r_name").alias("region"),
                F.lower("c_mktsegment").alias("industry"),
                stage.alias("lifecycle_stage"),
                F.when(k % 11 != 0, (k * 37) % 201 - 100).cast("int").alias("nps_score"),
                mrr.alias("mrr"),
                dec(mrr * 12).alias("arr"),
                F.date_sub(end, 365).alias("contract_start_date"),
                end.alias("contract_end_date"),
                F.lit("crm").alias("source_system"),
                (ts(self.as_of) - span((k * 7) % 900)).alias("created_at"),
                (ts(self.as_of) - span(F.lit(0), k % 120)).alias("updated_at"),
            )
        )

    @cached_property
    def subscriptions(self) -> DataFrame:
        k = F.col("o_orderkey")
        mrr = dec(dec("o_totalprice") / 100)
        status = (
            F.when(k % 97 == 0, F.lit(None).cast("string")).when(k % 89 == 0, "deleted")
            .otherwise(mapped(F.col("o_orderstatus"), {"O": "active", "F": "cancelled"}, "paused"))
        )
        tier = mapped(F.col("o_orderpriority"), _TIER)
        return self._with_tenant(self.raw("orders"), "o_custkey").select(
            F.concat(F.lit("SUB-"), k).alias("subscription_id"), "org_id", "customer_id",
            F.concat(F.lit("PROD-"), k % 12).alias("product_id"),
            F.concat(F.lit("plan-"), F.coalesce(tier, F.lit("base"))).alias("plan_name"),
            tier.alias("plan_tier"), status.alias("status"),
            (F.lit(1) + k % 50).cast("int").alias("seats"),
            mrr.alias("mrr"),
            F.when(k % 5 != 0, dec(mrr * 12)).alias("arr"),
            shifted("o_orderdate").alias("current_period_start"),
            F.date_add(shifted("o_orderdate"), 365).alias("current_period_end"),
            F.lit(None).cast("date").alias("trial_end_date"),
            F.lit(None).cast("date").alias("cancel_at"),
            F.lit(None).cast("timestamp").alias("canceled_at"),
            shifted_ts("o_orderdate").alias("created_at"),
        )

    @cached_property
    def contracts(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self._with_tenant(self.raw("orders"), "o_custkey").select(
            F.concat(F.lit("CTR-"), k).alias("contract_id"), "org_id", "customer_id",
            F.concat(F.lit("Contract "), k).alias("contract_name"),
            dec("o_totalprice").alias("contract_value"),
            shifted("o_orderdate").alias("start_date"),
            F.date_add(days_ago(self.as_of, 120), ((k * 7) % 700).cast("int")).alias("end_date"),
            (k % 2 == 0).alias("auto_renewal"),
            mapped(F.col("o_orderstatus"), {"F": "expired", "O": "active"}, "pending").alias("status"),
        )

    @cached_property
    def opportunities(self) -> DataFrame:
        k = F.col("o_orderkey")
        stages = ["prospecting", "qualification", "proposal", "negotiation", "closed_won", "closed_lost"]
        stage = mapped(k % 6, dict(enumerate(stages)))
        kind = mapped(k % 5, dict(enumerate(["new_business", "expansion", "renewal", "upsell", "cross_sell"])))
        return self._with_tenant(self.raw("orders"), "o_custkey").select(
            F.concat(F.lit("OPP-"), k).alias("opportunity_id"), "org_id", "customer_id",
            F.concat(F.lit(" Deal "), k).alias("opportunity_name"),
            kind.alias("opportunity_type"), stage.alias("stage"),
            F.when(k % 13 != 0, dec(dec("o_totalprice") / 5)).alias("amount_usd"),
            ((k * 17) % 101).cast("int").alias("probability_pct"),
            F.date_add(days_ago(self.as_of, 30), (k % 120).cast("int")).alias("close_date"),
        )

    @cached_property
    def _lines(self) -> DataFrame:
        """Order lines with the columns any line-level entity derives from."""
        return self.raw("lineitem").join(self._tenant_orders, F.col("l_orderkey") == F.col("o_orderkey"))

    @cached_property
    def transactions(self) -> DataFrame:
        kinds = dict(enumerate(["new_contract", "upsell", "renewal", "downgrade", "churn", "refund"]))
        return self._lines.select(
            line_id().alias("transaction_id"), "org_id", "customer_id",
            dec(dec("l_extendedprice", 12, 2) * (F.lit(1) - dec("l_discount", 4, 2))).alias("amount"),
            F.lit("usd").alias("currency"),
            mapped(F.col("l_linenumber") % 6, kinds).alias("transaction_type"),
            F.when(F.col("l_linestatus") == "F", "completed").otherwise("pending").alias("status"),
            shifted("l_shipdate").alias("transaction_date"),
        )

    @cached_property
    def tickets(self) -> DataFrame:
        """One per order line; a line shipped after ``as_of`` is a ticket of that moment."""
        lines = self.raw("lineitem")
        score = dec(F.lit(20) * dec("l_discount", 4, 2) - 1, 4, 3)
        status = mapped(F.col("o_orderstatus"), {"F": "resolved", "O": "open"}, "pending")
        created = F.least(shifted_ts("l_shipdate"), ts(self.as_of))
        return lines.join(self._tenant_orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            line_id().alias("ticket_id"), "org_id", "customer_id",
            F.concat(F.lit("Order "), F.col("l_orderkey")).alias("subject"),
            status.alias("status"),
            mapped(F.col("o_orderpriority"), _PRIORITY, "low").alias("priority"),
            F.when(F.col("l_returnflag") == "R", "return").when(F.col("l_linenumber") == 1, "billing").otherwise("support").alias("category"),
            (dec("l_tax", 4, 2) > dec(0.06, 4, 2)).alias("sla_breach"),
            score.alias("sentiment_score"),
            sentiment_label(score, 0.2).alias("sentiment_label"),
            created.alias("created_at"),
            F.when(status == "resolved", created + span(F.lit(0), F.col("l_quantity"))).alias("resolved_at"),
        )

    @cached_property
    def _user_events(self) -> DataFrame:
        return self._with_tenant(self.raw("events"), "user_id")

    @cached_property
    def product_events(self) -> DataFrame:
        kinds = {"signup": "login", "purchase": "ai_agent_invocation", "click": "feature_used",
                 "view": "page_view", "error": "api_error"}
        return self._user_events.select(
            F.concat(F.lit("EV-"), F.col("event_id")).alias("event_id"), "org_id", "customer_id",
            F.lit(None).cast("string").alias("subscription_id"),
            mapped(F.col("event_type"), kinds).alias("event_type"),
            F.concat(F.lit("f"), F.get_json_object("props", "$.k").cast("int") % 10).alias("feature_name"),
            dec("value", 18, 4).alias("event_value"),
            F.lit(None).cast("string").alias("platform"),
            F.concat("user_id", F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"),
            F.col("user_id").cast("string").alias("user_id"),
            F.col("ts").alias("occurred_at"),
        )

    @cached_property
    def raw_product_events(self) -> DataFrame:
        """Landed event rows: client and server time plus the JSON payload."""
        return self.product_events.select(
            "event_id", "org_id", "customer_id", "user_id", "session_id", "event_type",
            F.to_json(F.struct("feature_name", "event_value")).alias("event_payload"),
            F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss").alias("client_ts"),
            F.col("occurred_at").alias("server_ts"),
        )

    @cached_property
    def api_usage_events(self) -> DataFrame:
        return self._user_events.select(
            F.concat(F.lit("AP-"), F.col("event_id")).alias("event_id"), "org_id",
            F.concat(F.lit("/"), F.col("event_type")).alias("endpoint"),
            F.lit("POST").alias("method"),
            F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
            F.round(dec("value", 12, 2) * 10).cast("int").alias("latency_ms"),
            F.round(dec("value", 12, 2) * 100).cast("int").alias("tokens_used"),
            F.concat(F.lit("model-"), F.col("user_id") % 3).alias("model_name"),
            F.col("ts").alias("request_ts"),
        )

    @cached_property
    def health_score_events(self) -> DataFrame:
        clicks = self._user_events
        value = dec("value", 12, 2)
        return clicks.select(
            F.concat(F.lit("HS-"), F.col("event_id")).alias("event_id"), "org_id", "customer_id",
            dec(value % 10 - 5, 5, 2).alias("score_delta"),
            dec(value % 100, 5, 2).alias("new_score"),
            F.col("event_type").alias("score_driver"),
            F.col("ts").alias("event_ts"),
        )

    @cached_property
    def access_log(self) -> DataFrame:
        kinds = {"view": "APP_SESSION", "click": "DOC_SEARCH", "purchase": "MODEL_CALL", "signup": "AGENT_SESSION"}
        return self._user_events.select(
            F.concat(F.lit("LOG-"), F.col("event_id")).alias("log_id"), "org_id",
            F.concat(F.lit("user-"), F.col("user_id")).alias("user_name"),
            mapped(F.col("event_type"), kinds, "OTHER").alias("resource_type"),
            (F.col("event_type") != "error").alias("success"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def agent_sessions(self) -> DataFrame:
        """Conversations as agent sessions, one row per conversation."""
        turns = self.raw("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("message_count"))
        agents = dict(enumerate(["customer", "document", "operations"]))
        c = F.col("conv_id")
        return self._with_tenant(turns, "conv_id").select(
            F.concat(F.lit("SES-"), c).alias("session_id"), "org_id",
            F.concat(F.lit("user-"), c % 20).alias("user_name"),
            mapped(c % 3, agents).alias("agent_type"),
            "message_count",
            (ts(self.as_of) - span(c % 10, F.lit(1))).alias("started_at"),
        )

    @cached_property
    def churn_scores(self) -> DataFrame:
        k, v = F.col("k"), F.col("v")
        base = self.customers.select(
            "customer_id", "org_id", "arr",
            F.substring("customer_id", 6, 20).cast("long").alias("k"),
        )
        p = dec(((k * 7919 + v * 13) % 1000) / F.lit(1000), 5, 4)
        rows = base.withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
        return rows.select(
            F.concat(F.lit("SC-"), k, F.lit("-"), v).alias("score_id"), "org_id", "customer_id",
            p.alias("churn_probability"),
            risk_level(p).alias("risk_level"),
            F.array(F.concat(F.lit("driver_"), k % 4)).alias("top_drivers"),
            F.concat(F.lit("action_"), k % 3).alias("recommended_action"),
            dec(F.col("arr") * p).alias("expected_revenue_at_risk"),
            F.lit("1.0").alias("model_version"),
            (ts(self.as_of) - span(F.lit(11) - v * 10)).alias("scored_at"),
        )

    @cached_property
    def recommendations(self) -> DataFrame:
        k = F.col("k")
        kinds = ["churn_prevention", "upsell", "renewal", "health_improvement", "support_escalation"]
        status = mapped(k % 6, {3: "in_progress", 4: "completed", 5: "dismissed"}, "pending")
        base = self.customers.select(
            "customer_id", "org_id", "arr",
            F.substring("customer_id", 6, 20).cast("long").alias("k"),
        )
        created = ts(self.as_of) - span(k % 20)
        return base.select(
            F.concat(F.lit("REC-"), k).alias("recommendation_id"), "org_id",
            F.col("customer_id").alias("entity_id"),
            F.lit("customer").alias("entity_type"),
            mapped(k % 5, dict(enumerate(kinds))).alias("recommendation_type"),
            mapped(k % 4, {0: "HIGH", 1: "MEDIUM"}, "LOW").alias("priority"),
            F.concat(F.lit("Do step "), k % 7).alias("recommendation_text"),
            F.when(k % 21 != 0, dec(F.col("arr") * dec(0.1, 4, 2))).alias("expected_impact_usd"),
            dec((k % 100) / F.lit(100), 4, 3).alias("confidence_score"),
            F.concat(F.lit("role-"), k % 3).alias("owner_role"),
            status.alias("status"),
            (~status.isin("completed", "dismissed")).alias("is_active"),
            created.alias("created_at"),
            (created + F.expr("INTERVAL 30 DAYS")).alias("expires_at"),
        )

    @cached_property
    def interactions(self) -> DataFrame:
        c, t = F.col("conv_id"), F.col("turn")
        channels = dict(enumerate(["email", "call", "chat", "meeting", "sms"]))
        turns = self.raw("conversations").select("conv_id", "turn", "role", "text")
        return self._with_tenant(turns, "conv_id").select(
            F.concat(c, F.lit("-"), t).alias("interaction_id"), "org_id", "customer_id",
            mapped(c % 5, channels).alias("channel"),
            F.when(F.col("role") == "user", "inbound").otherwise("outbound").alias("direction"),
            F.col("text").alias("body"),
            dec(((c * 31 + t * 17) % 201 - 100) / F.lit(100), 4, 2).alias("sentiment_score"),
            (ts(self.as_of) - span(c % 60)).alias("occurred_at"),
        )

    # -- documents -----------------------------------------------------------
    @cached_property
    def _document_owners(self) -> DataFrame:
        """The 150 customers that own documents, staged so that their size is known and texts need not move."""
        from tenantlens.sources.sinks import materialize

        owners = self._with_tenant(self.raw("customer").filter(F.col("c_custkey") < 150), "c_custkey")
        return materialize(owners.select(F.col("c_custkey").alias("entity"), "customer_id", "org_id"))

    @cached_property
    def documents(self) -> DataFrame:
        k = F.col("doc_id")
        kinds = dict(enumerate(["contract", "sla", "amendment", "invoice", "proposal", "nda", "other"]))
        docs = self.raw("documents").withColumn("entity", k % 150)
        return docs.join(self._document_owners, "entity").select(
            F.concat(F.lit("DOC-"), k).alias("document_id"), "org_id",
            F.col("customer_id").alias("entity_id"),
            F.lit("customer").alias("entity_type"),
            F.concat(F.lit("doc_"), k, F.lit(".pdf")).alias("document_name"),
            mapped(k % 7, kinds).alias("document_type"),
            F.col("text").alias("extracted_text"),
            F.when(k % 9 == 0, "pending").otherwise("completed").alias("processing_status"),
            F.when(k % 4 == 0, F.array().cast("array<string>"))
            .otherwise(F.transform(F.sequence(F.lit(1), (k % 4).cast("int")), lambda i: F.concat(F.lit("flag"), i)))
            .alias("risk_flags"),
            F.when(k % 13 != 0, F.date_add(days_ago(self.as_of, 100), ((k * 11) % 365).cast("int"))).alias("end_date"),
            (k % 2 == 0).alias("auto_renewal"),
            (ts(self.as_of) - span(k % 30)).alias("created_at"),
        )

    @cached_property
    def contract_texts(self) -> DataFrame:
        """Contract wording composed from the order, its customer and tenant.

        Some texts lack a clause, carry an impossible date, or have no
        readable wording at all.
        """
        k = F.col("o_orderkey")
        names = self.customers.select("customer_id", F.col("name").alias("customer_name"), "region")
        rows = self._with_tenant(self.raw("orders"), "o_custkey").join(names, "customer_id")
        start = F.date_format(shifted("o_orderdate"), "yyyy-MM-dd")
        end = F.when(k % 6 == 0, "2024-13-45").otherwise(F.date_format(F.date_add(shifted("o_orderdate"), 730), "yyyy-MM-dd"))
        currency = F.when(k % 3 == 0, "EUR").otherwise("USD")
        value = dec("o_totalprice").cast("string")
        parts = F.concat(
            F.lit("Service agreement between "), F.col("customer_name"), F.lit(", and Vendor "), k % 50, F.lit(".\nEffective date: "), start,
            F.lit(". Expiration date: "), end, F.lit(".\nTotal value: "), currency, F.lit(" "), value, F.lit(". Payment terms: net "),
            (k % 4 + 1) * 15, F.lit(" days."),
            F.when(k % 4 == 0, " The contract renews automatically.").when(k % 4 == 1, F.concat(F.lit(" The contract renews automatically with notice of "), k % 90 + 1, F.lit(" days.")))
            .when(k % 4 == 2, " The contract does not renew.").otherwise(""),
            F.concat(F.lit(" This contract is governed by the laws of "), F.col("region"), F.lit(".")),
            F.when(k % 5 == 0, " Uptime of 99.5% with a response target and a resolution target; availability is reported.").otherwise(""),
            F.when(k % 11 == 0, " The vendor accepts unlimited liability.").otherwise(""),
        )
        kind = mapped(k % 3, {0: "contract", 1: "sla"}, "amendment")
        return rows.select(
            F.concat(F.lit("TXT-"), F.col("o_orderkey")).alias("document_id"), "org_id", kind.alias("document_type"),
            F.when(k % 7 == 3, "scanned page without a text layer").otherwise(parts).alias("extracted_text"),
        )

    @cached_property
    def pages(self) -> DataFrame:
        return self.raw("pages")

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").alias("chunk_id"),
            F.concat(F.lit("ORG-"), F.col("vec_id") % 5).alias("org_id"),
            "embedding", "label",
        )

    # -- vertical packs ------------------------------------------------------
    @cached_property
    def sales_history(self) -> DataFrame:
        """One row per sku, location and day."""
        revenue = dec("l_extendedprice", 12, 2) * (F.lit(1) - dec("l_discount", 4, 2))
        return (
            self.raw("lineitem")
            .groupBy("l_suppkey", "l_partkey", shifted("l_shipdate").alias("sale_date"))
            .agg(F.sum(dec("l_quantity")).alias("qty_sold"), F.sum(dec(revenue, 20, 4)).alias("revenue_usd"))
            .select(
                F.concat(F.lit("ORG-"), F.col("l_suppkey") % 5).alias("org_id"),
                F.col("l_partkey").alias("sku_id"), F.col("l_suppkey").alias("location_id"),
                "sale_date", "qty_sold", dec("revenue_usd", 20, 2).alias("revenue_usd"),
            )
        )

    @cached_property
    def inventory(self) -> DataFrame:
        p, s = F.col("l_partkey"), F.col("l_suppkey")
        return self.raw("lineitem").select("l_partkey", "l_suppkey").distinct().select(
            F.concat(F.lit("ORG-"), s % 5).alias("org_id"), p.alias("sku_id"), s.alias("location_id"),
            ((p * 31 + s * 7) % 500).alias("current_stock"),
        )

    @cached_property
    def promotions(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("promotion_id"), F.col("p_name").alias("name"),
            days_ago(self.as_of, 30).alias("start_date"), day(self.as_of).alias("end_date"),
            F.col("p_size").alias("discount_pct"), dec("p_retailprice").alias("cost_usd"),
        )

    @cached_property
    def products(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.raw("part").select(
            F.concat(F.lit("PROD-"), k).alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("product_category"),
            dec("p_retailprice").alias("unit_price"), (k % 5 != 0).alias("is_active"))

    @cached_property
    def equipment(self) -> DataFrame:
        k, size = F.col("p_partkey"), F.col("p_size")
        actual = F.lit(1000) - size * 5
        return self.raw("part").select(
            F.concat(F.lit("ORG-"), k % 5).alias("org_id"),
            F.concat(F.lit("EQ-"), k).alias("equipment_id"), F.col("p_brand").alias("plant_id"),
            (F.lit(168) - size).cast("int").alias("uptime_hours"),
            F.when(k % 113 == 0, 0).otherwise(168).alias("planned_hours"),
            actual.cast("int").alias("actual_units"), F.lit(1000).alias("ideal_units"),
            F.when(k % 101 == 0, 0).otherwise(actual - k % 60).cast("int").alias("good_units"),
            F.when(k % 101 == 0, 0).otherwise(actual).cast("int").alias("total_units"),
            (F.lit(50) + k % 200).cast("int").alias("mtbf_hours"),
            (F.lit(1) + size % 12).cast("int").alias("mttr_hours"),
            F.when(k % 7 != 0, 90).alias("maintenance_interval_days"),
            F.date_sub(day(self.as_of), (k % 150).cast("int")).alias("last_maintenance_date"),
            (k % 37 != 0).alias("is_active"),
        )

    @cached_property
    def network_events(self) -> DataFrame:
        """One row per customer and day."""
        errors = F.count_if(F.col("event_type") == "error")
        return self._user_events.groupBy("customer_id", "org_id", F.to_date("ts").alias("event_date")).agg(
            (F.sum(dec("value", 12, 2)) / F.count(F.lit(1))).cast("decimal(18,6)").alias("avg_latency_ms"),
            (errors / F.count(F.lit(1))).cast("decimal(18,6)").alias("avg_packet_loss_pct"),
            (errors / F.lit(10)).cast("decimal(18,6)").alias("avg_downtime_hours"),
            errors.alias("complaints_30d"),
        )

    @cached_property
    def property_performance(self) -> DataFrame:
        """One row per property and day."""
        n = F.count(F.lit(1))
        base = self.raw("lineitem").groupBy("l_suppkey", shifted("l_shipdate").alias("performance_date")).agg(
            (F.sum(dec("l_discount", 4, 2)) / n).cast("decimal(18,6)").alias("disc"),
            (F.sum(dec("l_extendedprice")) / n).cast("decimal(18,6)").alias("price"),
            F.sum(dec("l_tax", 4, 2) * dec("l_extendedprice", 12, 2)).cast("decimal(20,2)").alias("ancillary_revenue"),
            (F.count_if(F.col("l_returnflag") == "R") * 100 / n).cast("decimal(18,6)").alias("cancellation_rate"),
            (F.sum(dec("l_quantity")) / n).cast("decimal(18,6)").alias("qty"),
        )
        occ = dec(F.col("disc") * 500 + 50, 10, 2)
        adr = dec(F.col("price") / 100, 12, 2)
        revpar = dec(occ * adr / 100, 14, 2)
        return base.select(
            F.concat(F.lit("ORG-"), F.col("l_suppkey") % 5).alias("org_id"),
            F.col("l_suppkey").alias("property_id"), "performance_date",
            occ.alias("occupancy_rate"), adr.alias("adr_usd"), revpar.alias("revpar_usd"),
            dec(revpar * dec(1.2, 4, 2), 14, 2).alias("trevpar_usd"), "ancillary_revenue",
            dec("cancellation_rate", 10, 2).alias("cancellation_rate"),
            dec(F.col("qty") / 10, 10, 2).alias("avg_los_nights"),
        )

    # -- workflow ------------------------------------------------------------
    @cached_property
    def approvals(self) -> DataFrame:
        k = F.col("o_orderkey")
        rows = self._with_tenant(self.raw("orders"), "o_custkey")
        created = ago(self.as_of, days=4) + span(F.lit(0), k % 96)
        return rows.select(
            F.concat(F.lit("APR-"), k).alias("approval_id"), "org_id",
            mapped(k % 3, {0: "send_offer", 1: "apply_discount"}, "escalate").alias("action_type"),
            F.col("customer_id").alias("target_entity_id"),
            mapped(k % 4, dict(enumerate(["LOW", "MEDIUM", "HIGH", "CRITICAL"]))).alias("risk_level"),
            created.alias("created_at"),
        )

    @cached_property
    def approval_events(self) -> DataFrame:
        """Decisions, some of them late, repeated or contradicting."""
        k = F.col("o_orderkey")
        rows = self.raw("orders").select(k, F.explode(F.array(F.lit(0), F.lit(1))).alias("v"))
        created = ago(self.as_of, days=4) + span(F.lit(0), k % 96)
        decision = F.when((k % 3 + F.col("v")) % 2 == 0, "approve").otherwise("reject")
        flip = F.when(k % 3 == 2, "comment").otherwise(decision)
        return rows.select(
            F.concat(F.lit("APR-"), k).alias("approval_id"), flip.alias("action"),
            F.concat(F.lit("mgr-"), k % 5).alias("actor"),
            F.concat(F.lit("reason "), F.col("v")).alias("reason"),
            (created + span(F.lit(0), (k * 7) % 60 + F.col("v") * 5)).alias("at"),
        )

    @cached_property
    def model_log(self) -> DataFrame:
        """Model metric log: two metrics per model and day out of the API events."""
        daily = self.raw("events").groupBy(
            (F.col("user_id") % 3).alias("m"), F.to_date("ts").alias("run_date")
        ).agg(
            (F.count_if(F.col("event_type") != "error") / F.count(F.lit(1))).cast("decimal(18,6)").alias("accuracy"),
            (F.sum(dec("value", 12, 2)) / F.count(F.lit(1))).cast("decimal(18,6)").alias("mape"),
        )
        version = F.concat(F.lit("1."), F.dayofmonth("run_date") % 2)
        long = daily.select(
            F.concat(F.lit("model-"), "m").alias("model_name"), version.alias("model_version"), "run_date",
            F.expr("stack(2, 'accuracy', accuracy, 'mape', mape) as (metric_name, metric_value)"),
        )
        return long.withColumn("dataset_split", F.when(F.dayofmonth("run_date") % 3 == 0, "test").otherwise("production")) \
            .withColumn("created_at", F.col("run_date").cast("timestamp"))

    @cached_property
    def status_events(self) -> DataFrame:
        """Status changes requested for recommendations, some of them invalid or after the end."""
        wanted = {"click": "in_progress", "view": "snoozed", "purchase": "completed", "signup": "dismissed"}
        return self.raw("events").select(
            F.col("event_id"), F.concat(F.lit("REC-"), F.col("user_id")).alias("recommendation_id"),
            mapped(F.col("event_type"), wanted, "archived").alias("new_status"),
            F.concat(F.lit("user-"), F.col("event_id") % 9).alias("acted_by"), F.col("ts").alias("at"),
        )

    @cached_property
    def prompt_log(self) -> DataFrame:
        """User turns paired with the answer that follows them."""
        turns = self.raw("conversations")
        c, n = F.col("conv_id"), F.col("turn")
        asked = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
        answered = turns.filter(F.col("role") != "user").select("conv_id", (n - 1).alias("turn"), F.col("text").alias("answer"))
        pairs = self._with_tenant(asked.join(answered, ["conv_id", "turn"], "left"), "conv_id")
        agents = dict(enumerate(["customer", "document", "operations"]))
        return pairs.select(
            F.concat(F.lit("P-"), c, F.lit("-"), n).alias("log_id"), F.concat(F.lit("SES-"), c).alias("session_id"), "org_id",
            F.concat(F.lit("user-"), c % 20).alias("user_name"), mapped(c % 3, agents).alias("agent_id"), "prompt", "answer",
            ((c * 7 + n * 13) % 900).alias("tokens_used"), ((c * 31 + n * 17) % 2000).alias("latency_ms"),
            (ts(self.as_of) - span(c % 10, n)).alias("created_at"),
        )

    @cached_property
    def quality_results(self) -> DataFrame:
        """Hourly check results per tenant: error rate and event volume."""
        hourly = self._user_events.groupBy("org_id", F.date_trunc("hour", "ts").alias("measured_at")).agg(
            F.round(F.count_if(F.col("event_type") == "error") * 100 / F.count(F.lit(1)), 2).alias("error_rate"),
            F.count(F.lit(1)).cast("double").alias("volume"))
        long = hourly.select("org_id", "measured_at", F.expr("stack(2, 'error_rate', error_rate, 'volume', volume) as (metric_name, metric_value)"))
        rate = F.when(F.col("metric_value") <= 20, "PASS").when(F.col("metric_value") <= 40, "WARN").otherwise("FAIL")
        return long.select(
            "org_id", F.lit("product_events").alias("table_name"), "metric_name", "metric_value",
            F.when(F.col("metric_name") == "error_rate", 20.0).otherwise(1.0).alias("threshold"),
            F.when(F.col("metric_name") == "error_rate", rate).otherwise(F.when(F.col("metric_value") >= 1, "PASS").otherwise("FAIL")).alias("status"),
            "measured_at")

    @cached_property
    def kb_access(self) -> DataFrame:
        """Which role may read which knowledge base, from the pages' own bases and the users' roles."""
        names = F.array(F.lit("product_docs"), F.lit("support_articles"), F.lit("release_notes"))
        bases = self.raw("pages").select(F.get(names, (F.col("page_id") % 3).cast("int")).alias("kb_name")).distinct()
        return bases.select("kb_name", F.explode(F.when(F.col("kb_name") == "release_notes", F.array(F.lit("ADMIN")))
                                                 .otherwise(F.array(F.lit("ADMIN"), F.lit("ANALYST")))).alias("role"))

"""Products, orders and requests read from a star schema of parts, orders, lines and events.

Keys stay integers, as stored; the operators do not care.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfline.schemas import MONEY
from shelfline.session import is_folder


EXACT = "decimal(38,10)"

# Stored times carry no zone and are UTC; reading them as instants keeps date filters in the scan.
TABLES = {
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp,"
        " o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
        " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
        " l_shipdate timestamp"
    ),
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


@dataclass(frozen=True)
class StarSchema:
    spark: SparkSession
    folder: str
    streaming: bool = False

    def table(self, name: str) -> DataFrame:
        """A table stored as one file or as a folder of them. The session's time zone must be UTC."""
        path = f"{self.folder}/{name}.parquet"
        if not self.streaming:
            return self.spark.read.schema(TABLES[name]).parquet(path)
        files = self.spark.readStream.schema(TABLES[name])
        if is_folder(self.spark, path):
            return files.parquet(path)
        return files.option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)

    def products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("description"),
            F.col("p_retailprice").cast(MONEY).alias("price"),
            F.lit("USD").alias("currency"),
            (F.col("p_size") - 1).alias("stock"),
            F.col("p_type").alias("category"),
            F.timestamp_seconds(F.col("p_partkey")).alias("created_at"),
            F.lit(0).cast("bigint").alias("version"),
        )

    def _status(self) -> Column:
        # Nested and null-safe, so that a test for CONFIRMED folds to a plain comparison the scan can use.
        others = F.when(F.col("o_orderstatus") == "O", "PENDING").otherwise("FAILED")
        return F.when(F.col("o_orderstatus").eqNullSafe("F"), "CONFIRMED").otherwise(others)

    def orders(self) -> DataFrame:
        """One row per order line. The id is the order's, so it repeats."""
        return (
            self.table("lineitem")
            .join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.col("l_orderkey").alias("id"),
                F.col("o_custkey").alias("customer_id"),
                F.col("l_partkey").alias("product_id"),
                F.col("l_quantity").cast("int").alias("quantity"),
                F.col("l_extendedprice").cast(MONEY).alias("amount"),
                F.lit("USD").alias("currency"),
                self._status().alias("status"),
                F.lit(None).cast("string").alias("payment_ref"),
                F.col("o_orderdate").alias("created_at"),
                F.lit(0).cast("bigint").alias("version"),
            )
        )

    def order_headers(self) -> DataFrame:
        """One row per order, with unique ids."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_totalprice").cast(MONEY).alias("amount"),
            self._status().alias("status"),
            F.col("o_orderdate").alias("created_at"),
        )

    def _events(self) -> DataFrame:
        return self.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))

    def _event_request(self) -> dict[str, Column]:
        return {
            "request_id": F.col("event_id"),
            "seq": F.col("event_id"),
            "product_id": F.when(F.col("k") == 99, F.lit(-1).cast("bigint")).otherwise(F.col("user_id")),
            "quantity": F.when(F.col("event_type") == "error", F.lit(0)).otherwise(1 + F.col("k") % 5).cast("int"),
        }

    def stock_requests(self) -> DataFrame:
        op = F.when(F.col("event_type") == "signup", "RELEASE").otherwise("RESERVE")
        columns = {**self._event_request(), "op": op}
        return self._events().select(*[c.alias(n) for n, c in columns.items()])

    def order_requests(self) -> DataFrame:
        method = (
            F.when(F.col("event_type") == "view", "STRIPE")
            .when(F.col("event_type") == "click", "PAYPAL")
            .when(F.col("event_type") == "purchase", "CRYPTO")
            .when(F.col("event_type") == "signup", " ")
            .otherwise("CASH")
        )
        columns = {
            **self._event_request(),
            "customer_id": F.concat(F.lit("c"), F.col("user_id").cast("string")),
            "quantity": F.when(F.col("event_type") == "error", F.lit(0)).otherwise(1 + F.col("k") % 15).cast("int"),
            "payment_method": method,
        }
        return self._events().select(*[c.alias(n) for n, c in columns.items()])

    def create_requests(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(
            key.cast("string").alias("request_id"),
            key.alias("seq"),
            F.when(key % 7 == 0, "").otherwise(F.col("p_name")).alias("name"),
            F.when(key % 11 != 0, F.col("p_brand")).alias("description"),
            (F.col("p_retailprice").cast(MONEY) - 910 + F.lit("0.005").cast("decimal(4,3)")).cast(EXACT).alias("price"),
            (F.col("p_size") - 3).alias("stock"),
            F.when(key % 13 == 0, "X").otherwise(F.col("p_type")).alias("category"),
        )

    def update_requests(self) -> DataFrame:
        """About two updates in three hit a product; each product gets several."""
        key = F.col("o_orderkey")
        return self.table("orders").select(
            key.alias("request_id"),
            key.alias("seq"),
            (F.col("o_custkey") * 2).alias("id"),
            F.concat(F.lit("Item "), F.col("o_orderpriority")).alias("name"),
            F.col("o_orderpriority").alias("description"),
            (F.col("o_totalprice").cast(MONEY) * F.lit("0.125").cast("decimal(4,3)")).cast(EXACT).alias("price"),
            (key % 100 - 5).cast("int").alias("stock"),
            F.concat(F.lit("C"), F.col("o_orderstatus")).alias("category"),
        )

    def versioned_requests(self) -> DataFrame:
        """The updates with the version that each was made from."""
        return self.update_requests().withColumn("version", F.col("seq") % 4)

    def delete_requests(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("request_id"), F.col("o_orderkey").alias("seq"), (F.col("o_custkey") * 2).alias("id")
        )

    def status_history(self) -> DataFrame:
        status = (
            F.when(F.col("event_type") == "signup", "PENDING")
            .when(F.col("event_type") == "click", "PAYMENT_CONFIRMED")
            .when(F.col("event_type") == "view", "STOCK_RESERVED")
            .when(F.col("event_type") == "purchase", "CONFIRMED")
            .otherwise("FAILED")
        )
        return self.table("events").select(
            F.col("user_id").alias("order_id"), F.col("event_id").alias("seq"), status.alias("status")
        )

    def event_messages(self) -> DataFrame:
        """Raw product-event messages; users stand for messages, so each is delivered several times."""
        kind = (
            F.when(F.col("event_type") == "signup", "PRODUCT_CREATED")
            .when(F.col("event_type") == "click", "PRODUCT_UPDATED")
            .when(F.col("event_type") == "purchase", "PRODUCT_DELETED")
            .otherwise("PRODUCT_VIEWED")
        )
        payload = F.when(F.col("event_type") != "purchase", F.struct(F.col("value").alias("price")))
        envelope = F.to_json(
            F.struct(kind.alias("eventType"), F.col("event_id").cast("string").alias("entityId"), payload.alias("payload")),
            {"ignoreNullFields": "false"},
        )
        raw = F.when(F.col("event_type") == "error", F.concat(F.lit("{broken "), F.col("props"))).otherwise(envelope)
        return self.table("events").select(
            F.col("user_id").cast("string").alias("message_id"), raw.alias("raw"), F.col("event_id")
        )

    def redelivered_messages(self) -> DataFrame:
        """The messages under ids of their own, every third delivered three times and every other even one twice."""
        times = F.when(F.col("event_id") % 3 == 0, 3).when(F.col("event_id") % 2 == 0, 2).otherwise(1)
        sent = self.event_messages().withColumn("message_id", F.col("event_id").cast("string"))
        return sent.withColumn("delivery", F.explode(F.sequence(F.lit(1), times)))

    def delivery_log(self) -> DataFrame:
        """Deliveries and their answers; users stand for messages."""
        kind = F.when(F.col("event_type") == "view", "DELIVERED").when(F.col("event_type") == "purchase", "ACKED").otherwise("FAILED")
        return self.table("events").select(
            F.col("user_id").cast("string").alias("message_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind")
        )

    def out_of_order(self, rows: DataFrame) -> tuple[DataFrame, int]:
        """``rows`` with the time ``at`` of their ``seq`` and the delivery, 0 to 2, in which they arrive; and by how many seconds they may be late."""
        late = max((rows.agg(F.max("seq")).first()[0] or 0) // 2 + 1, 1)
        arrival = F.floor((F.col("seq") + F.pmod(F.xxhash64("seq"), F.lit(late))) / late)
        return rows.withColumns({"at": F.timestamp_seconds("seq"), "arrival": F.least(arrival, F.lit(2))}), late

    def counters(self) -> DataFrame:
        """Stock counters as a second store knows them: events per user, spread over the product ids."""
        return (
            self.table("events")
            .groupBy((F.col("user_id") * 20).alias("product_id"))
            .agg((F.count(F.lit(1)) % 50).cast("int").alias("counter"))
        )

    def notify_requests(self) -> DataFrame:
        kinds = F.array(*[F.lit(c) for c in ("email", "sms", "push", "slack", "fax")])
        return self.table("conversations").select(
            "turn",
            F.col("conv_id").cast("string").alias("userId"),
            F.col("text").alias("message"),
            F.get(kinds, (F.col("conv_id") % 5).cast("int")).alias("channel"),
        )

    def replies(self) -> DataFrame:
        """Model replies of several shapes around the conversation texts."""
        fields = F.struct(
            F.substring("text", 1, 70).alias("subject"),
            F.col("text").alias("body"),
            F.when(F.col("conv_id") % 2 == 0, "email").otherwise("pager").alias("channel"),
        )
        plain = F.to_json(fields)
        shape = F.col("turn") % 5
        reply = (
            F.when(shape == 0, plain)
            .when(shape == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
            .when(shape == 2, F.col("text"))
            .when(shape == 3, F.to_json(F.struct(F.col("text").alias("subject"), F.lit("").alias("body"))))
            .otherwise(F.concat(plain, F.lit(" as asked.")))
        )
        return self.table("conversations").select("conv_id", "turn", reply.alias("reply"))

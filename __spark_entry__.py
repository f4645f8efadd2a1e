
from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import shelfline  # noqa: E402
from oracle_queries import ORACLES  # noqa: E402
from shelfline.functions import rules  # noqa: E402
from shelfline.functions.money import combine_money, money_error  # noqa: E402
from shelfline.operators import catalog, deliveries, events, filters, notifications, ordering, paging, quality, reconcile, versions  # noqa: E402
from shelfline.operators.reservation import remaining_stock, reserve_stock  # noqa: E402
from shelfline.plans import refreshed, reports  # noqa: E402
from shelfline.session import work_folder  # noqa: E402
from shelfline.sources import clustered, seek  # noqa: E402
from shelfline.sources.star_schema import StarSchema  # noqa: E402
from shelfline.sources.events import read_product_events  # noqa: E402
from shelfline.sources.tables import (  # noqa: E402
    materialize_report,
    normalize_currency,
    read_orders,
    read_products,
    read_report,
    write_orders_by_month,
)
from shelfline.streaming import deliveries as delivery_stream, fanout, reservation as stock_stream, routing, transitions  # noqa: E402
from shelfline.streaming.state import stateful  # noqa: E402

# Workers need not have the package installed.
cloudpickle.register_pickle_by_value(shelfline)

Query = Callable[[StarSchema], DataFrame]

AS_OF = "2001-08-01"
NOW = "2001-08-01 00:00:00"

_QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    _QUERIES[run.__name__] = run
    return run


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and times without zone, as the SQL side returns them."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def joined(df: DataFrame, column: str = "reasons") -> DataFrame:
    return df.withColumn(column, F.concat_ws("; ", column))


# Reports


@query
def top_products_by_category(t: StarSchema) -> DataFrame:
    return reports.top_products_by_category(t.products(), t.orders())


@query
def top_products_api(t: StarSchema) -> DataFrame:
    return reports.top_products_api(t.products(), t.orders())


@query
def monthly_revenue_trend(t: StarSchema) -> DataFrame:
    return reports.monthly_revenue_trend(t.orders())


@query
def monthly_revenue_trend_sparse(t: StarSchema) -> DataFrame:
    return reports.monthly_revenue_trend(t.orders(), fill_gaps=False)


@query
def monthly_revenue_api(t: StarSchema) -> DataFrame:
    return reports.monthly_revenue_api(t.orders())


@query
def customer_order_summary(t: StarSchema) -> DataFrame:
    return reports.customer_order_summary(t.orders(), t.products())


@query
def low_stock_alerts(t: StarSchema) -> DataFrame:
    return reports.low_stock_alerts(t.products())


@query
def low_stock_api(t: StarSchema) -> DataFrame:
    return reports.low_stock_api(t.products())


@query
def top_customers(t: StarSchema) -> DataFrame:
    return reports.top_customers(t.orders(), AS_OF)


@query
def daily_sales(t: StarSchema) -> DataFrame:
    return reports.daily_sales(t.orders(), t.products(), AS_OF)


@query
def critical_stock(t: StarSchema) -> DataFrame:
    return reports.critical_stock(t.orders(), t.products(), AS_OF, days=365)


@query
def critical_stock_clustered(t: StarSchema) -> DataFrame:
    """From a fact table whose files are clustered by day and product."""
    path = work_folder(t.spark, "clustered")
    lines = t.orders()
    clustered.write_clustered(lines, t.products(), path, rows_per_file=max(lines.count() // 16, 50))
    return reports.critical_stock(clustered.read_clustered(t.spark, path, AS_OF, 365), t.products(), AS_OF, days=365)


@query
def category_sales_clustered(t: StarSchema) -> DataFrame:
    """Units of one category's products since a day, by a read of the clustered files that hold them."""
    path = work_folder(t.spark, "clustered")
    lines = t.orders()
    clustered.write_clustered(lines, t.products(), path, rows_per_file=max(lines.count() // 16, 50))
    first = t.products().agg(F.min("category")).first()[0]
    rows = filters.confirmed(clustered.read_clustered(t.spark, path, AS_OF, 365, first))
    return rows.groupBy("product_id").agg(F.sum("quantity").alias("units_sold"), F.count("id").alias("order_count"))


@query
def order_count_report(t: StarSchema) -> DataFrame:
    return reports.order_count_report(t.orders())


@query
def materialized_report(t: StarSchema) -> DataFrame:
    path = work_folder(t.spark, "low_stock_report")
    materialize_report(reports.low_stock_alerts(t.products()), path)
    return read_report(t.spark, path)


# Filters, lookups, pages


@query
def confirmed_orders(t: StarSchema) -> DataFrame:
    return filters.confirmed(t.orders()).select("id", "customer_id", "product_id", "quantity", "amount", "created_at")


@query
def recent_orders(t: StarSchema) -> DataFrame:
    return filters.since(t.orders(), AS_OF, 30).select("id", "product_id", "amount", "status", "created_at")


@query
def low_stock(t: StarSchema) -> DataFrame:
    return filters.low_stock(t.products()).select("id", "stock")


@query
def product_response(t: StarSchema) -> DataFrame:
    return filters.product_response(t.products())


@query
def order_response(t: StarSchema) -> DataFrame:
    return filters.order_response(t.orders())


def _ids(t: StarSchema) -> DataFrame:
    return t.delete_requests().select("id")


@query
def find_by_ids(t: StarSchema) -> DataFrame:
    return filters.find_by_ids(t.products(), _ids(t)).hits.select("id", "name", "stock")


@query
def find_missing(t: StarSchema) -> DataFrame:
    return filters.find_by_ids(t.products(), _ids(t)).misses


@query
def exists(t: StarSchema) -> DataFrame:
    return filters.exists_by_ids(t.products(), _ids(t))


@query
def availability(t: StarSchema) -> DataFrame:
    return filters.availability(t.stock_requests(), t.products()).select("request_id", "product_id", "available")


@query
def order_page(t: StarSchema) -> DataFrame:
    return paging.page_rows(t.order_headers(), page=3)


@query
def product_page(t: StarSchema) -> DataFrame:
    return paging.page_rows(t.products(), page=1).select("id", "name", "created_at")


@query
def order_line_page(t: StarSchema) -> DataFrame:
    """Far enough in to be approached by counting; the ids repeat."""
    lines = paging.page_rows(t.orders(), page=200, shallow_rows=2_000)
    return lines.select("id", "customer_id", "status", "created_at")


@query
def order_line_total(t: StarSchema) -> DataFrame:
    found = paging.page(t.orders().select("id", "created_at"), page=2)
    return found.rows.withColumn("total", F.lit(found.total).cast("bigint"))


@query
def order_page_by_seek(t: StarSchema) -> DataFrame:
    """The same page as ``order_line_page``, from a stored order whose blocks are small enough for the page to lie in a late one."""
    lines = t.orders()
    path = work_folder(t.spark, "ordered")
    seek.write_ordered(lines, path, rows_per_file=max(lines.count() // 20, 50))
    return seek.read_page(t.spark, path, page=200).select("id", "customer_id", "status", "created_at")


@query
def order_positions_by_seek(t: StarSchema) -> DataFrame:
    path = work_folder(t.spark, "ordered")
    seek.write_ordered(t.order_headers(), path, rows_per_file=max(t.order_headers().count() // 20, 50))
    return seek.positions(t.spark, path).select("id", (F.col("position") + 1).alias("position"))


@query
def order_positions(t: StarSchema) -> DataFrame:
    return paging.row_positions(t.order_headers(), "created_at", "id")


@query
def normalized_currency(t: StarSchema) -> DataFrame:
    line = F.col("l_linenumber")
    padded = t.table("lineitem").select("l_orderkey", "l_linenumber", F.rpad(F.lit("USD"), 3 + line % 3, " ").alias("currency"))
    return normalize_currency(padded).withColumn("width", F.length("currency"))


# Data quality


@query
def duplicate_keys(t: StarSchema) -> DataFrame:
    return quality.duplicate_keys(t.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query
def orphan_orders(t: StarSchema) -> DataFrame:
    """Requests for products that don't exist."""
    return quality.orphan_orders(t.stock_requests(), t.products()).select("request_id", "product_id", "quantity")


@query
def check_violations(t: StarSchema) -> DataFrame:
    drafts = t.create_requests().select(
        F.col("request_id").alias("id"), "name", "description", "price", F.lit("USD").alias("currency"), "stock",
        "category", F.lit(NOW).cast("timestamp").alias("created_at"), F.lit(0).cast("bigint").alias("version"),
    )
    return joined(quality.check_violations(drafts, rules.product_table_rules()).select("id", "reasons"))


@query
def order_violations(t: StarSchema) -> DataFrame:
    requests = t.order_requests().select(
        F.col("request_id").alias("id"), "customer_id", "product_id", "quantity",
        (F.col("quantity") * 10 - 5).cast("decimal(19,2)").alias("amount"), F.lit("USD").alias("currency"),
        F.lit("PENDING").alias("status"), F.lit(NOW).cast("timestamp").alias("created_at"),
        F.lit(0).cast("bigint").alias("version"),
    )
    return joined(quality.check_violations(requests, rules.order_table_rules()).select("id", "reasons"))


@query
def invalid_requests(t: StarSchema) -> DataFrame:
    return joined(quality.invalid_requests(t.stock_requests(), rules.stock_request_rules()).select("request_id", "reasons"))


@query
def invalid_events(t: StarSchema) -> DataFrame:
    parsed = events.parse_events(t.event_messages())
    return joined(quality.invalid_requests(parsed, rules.event_rules()).select("event_id", "reasons"))


@query
def stock_drift(t: StarSchema) -> DataFrame:
    return quality.stock_drift(t.products(), t.counters())


@query
def stock_drift_by_digest(t: StarSchema) -> DataFrame:
    return reconcile.stock_drift_by_digest(t.products(), t.counters(), ranges=64)


# Catalog


@query
def create_products(t: StarSchema) -> DataFrame:
    return catalog.create_products(t.create_requests(), NOW).accepted


@query
def update_products(t: StarSchema) -> DataFrame:
    updated = catalog.update_products(t.products(), t.update_requests()).accepted
    return updated.select("id", "name", "description", "price", "stock", "category")


@query
def stock_adjustments(t: StarSchema) -> DataFrame:
    return catalog.stock_adjustments(t.products(), catalog.update_products(t.products(), t.update_requests()).accepted)


@query
def update_rejects(t: StarSchema) -> DataFrame:
    return joined(catalog.update_products(t.products(), t.update_requests()).rejects.select("request_id", "id", "reasons"))


@query
def versioned_updates(t: StarSchema) -> DataFrame:
    updated = versions.versioned_updates(t.products(), t.versioned_requests()).accepted
    return updated.select("id", "name", "price", "stock", "category", "version")


@query
def versioned_update_errors(t: StarSchema) -> DataFrame:
    rejects = versions.versioned_updates(t.products(), t.versioned_requests(), chunk_rows=_chunk_rows(t.update_requests())).rejects
    return ordering.error_status(rejects).select("request_id", "id", "status", "message")


@query
def delete_products(t: StarSchema) -> DataFrame:
    return catalog.delete_products(t.products(), t.delete_requests()).accepted.select("id", "name")


@query
def delete_unordered_products(t: StarSchema) -> DataFrame:
    """With the orders given, a product that has some stays."""
    return catalog.delete_products(t.products(), t.delete_requests(), t.orders()).accepted.select("id", "name")


@query
def delete_unordered_rejects(t: StarSchema) -> DataFrame:
    return joined(catalog.delete_products(t.products(), t.delete_requests(), t.orders()).rejects)


@query
def delete_rejects(t: StarSchema) -> DataFrame:
    return joined(catalog.delete_products(t.products(), t.delete_requests()).rejects)


# Money


@query
def combined_money(t: StarSchema) -> DataFrame:
    """Line price plus and minus the order total, in currencies that differ for some lines."""
    line = t.table("lineitem").join(t.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    price, total = F.col("l_extendedprice").cast("decimal(19,2)"), F.col("o_totalprice").cast("decimal(19,2)")
    usd, other = F.lit("USD"), F.when(F.col("l_returnflag") == "R", "EUR").otherwise("USD")
    return line.select(
        "l_orderkey", "l_linenumber",
        combine_money(price, usd, total, other).alias("added"),
        money_error(price, usd, total, other).alias("add_error"),
        combine_money(price, usd, total, other, sign=-1).alias("subtracted"),
        money_error(price, usd, total, other, sign=-1).alias("subtract_error"),
    )


# Reports from monthly partials: all months but a part of the last, then the whole of that one


def _text_ids(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in names})


def _refreshed(t: StarSchema) -> str:
    path, store = work_folder(t.spark, "months"), work_folder(t.spark, "partials")
    lines = _text_ids(t.orders(), "id", "customer_id", "product_id")
    month = F.trunc("created_at", "MM")
    last = F.lit(lines.agg(F.max(month)).first()[0])
    write_orders_by_month(lines.where((month < last) | (F.pmod(F.xxhash64("id"), F.lit(2)) == 0)), path)
    refreshed.refresh(t.spark, path, store)
    write_orders_by_month(lines.where(month == last), path, only_these=True)
    refreshed.refresh(t.spark, path, store)
    return store


@query
def refreshed_revenue_trend(t: StarSchema) -> DataFrame:
    return refreshed.refreshed_revenue_trend(t.spark, _refreshed(t))


@query
def refreshed_top_products(t: StarSchema) -> DataFrame:
    best = refreshed.refreshed_top_products(t.spark, _refreshed(t), _text_ids(t.products(), "id"))
    return best.withColumn("product_id", F.col("product_id").cast("bigint"))


@query
def refreshed_customer_summary(t: StarSchema) -> DataFrame:
    summary = refreshed.refreshed_customer_summary(t.spark, _refreshed(t), _text_ids(t.products(), "id"))
    return summary.withColumn("customer_id", F.col("customer_id").cast("bigint"))


# Reservation and orders


@query
def reserved_stock(t: StarSchema) -> DataFrame:
    return reserve_stock(t.products(), t.stock_requests())


def _chunk_rows(rows: DataFrame) -> int:
    """So few that the busier keys are cut, whatever the size of the table."""
    return max(rows.count() // 500, 20)


@query
def reserved_stock_split(t: StarSchema) -> DataFrame:
    """The same with every busier product cut into chunks."""
    return reserve_stock(t.products(), t.stock_requests(), chunk_rows=_chunk_rows(t.stock_requests()))


@query
def stock_after_reservation(t: StarSchema) -> DataFrame:
    outcomes = reserve_stock(t.products(), t.stock_requests())
    return remaining_stock(t.products(), outcomes).select("id", "stock")


@query
def price_orders(t: StarSchema) -> DataFrame:
    return ordering.price_orders(t.orders().select("id", "product_id", "quantity"))


@query
def price_orders_list(t: StarSchema) -> DataFrame:
    return ordering.price_orders(t.orders().select("id", "product_id", "quantity"), t.products())


@query
def route_payment(t: StarSchema) -> DataFrame:
    return ordering.route_payment(t.order_requests()).accepted.select("request_id", "payment_method", "payment_ref")


@query
def route_payment_rejects(t: StarSchema) -> DataFrame:
    return joined(ordering.route_payment(t.order_requests()).rejects.select("request_id", "reasons"))


@query
def place_orders(t: StarSchema) -> DataFrame:
    orders = ordering.place_orders(t.products(), t.order_requests(), NOW).orders
    return orders.drop("version")


@query
def place_orders_rejects(t: StarSchema) -> DataFrame:
    rejects = ordering.place_orders(t.products(), t.order_requests(), NOW).rejects
    return ordering.error_status(rejects).select("request_id", "status", "message")


@query
def place_orders_stock(t: StarSchema) -> DataFrame:
    return ordering.place_orders(t.products(), t.order_requests(), NOW).products.select("id", "stock")


@query
def check_order_transitions(t: StarSchema) -> DataFrame:
    return ordering.check_order_transitions(t.status_history())


@query
def check_order_transitions_split(t: StarSchema) -> DataFrame:
    return ordering.check_order_transitions(t.status_history(), chunk_rows=_chunk_rows(t.status_history()))


@query
def current_status(t: StarSchema) -> DataFrame:
    return ordering.current_status(t.status_history())


@query
def error_status(t: StarSchema) -> DataFrame:
    refused = catalog.create_products(t.create_requests(), NOW).rejects.select(
        F.concat(F.lit("create-"), F.col("request_id")).alias("request_id"), "reasons", F.lit("INVALID").alias("kind")
    )
    missing = catalog.delete_products(t.products(), t.delete_requests()).rejects.select(
        F.concat(F.lit("delete-"), F.col("request_id").cast("string")).alias("request_id"),
        "reasons",
        F.lit("NOT_FOUND").alias("kind"),
    )
    return ordering.error_status(refused.unionByName(missing)).select("request_id", "status", "message")


# Events


@query
def product_events(t: StarSchema) -> DataFrame:
    """Encoded and decoded again, so that values compare rather than JSON text."""
    encoded = events.product_events(t.products(), "PRODUCT_CREATED").withColumnRenamed("message", "raw")
    return events.parse_events(encoded).select(
        "eventType", "entityId",
        F.get_json_object("payload", "$.name").alias("name"),
        F.get_json_object("payload", "$.price.amount").cast("double").alias("price"),
        F.get_json_object("payload", "$.stock.quantity").cast("int").alias("stock"),
        F.get_json_object("payload", "$.lowStock").alias("low_stock"),
        F.get_json_object("payload", "$.createdAt").alias("created_at"),
    )


@query
def order_placed_events(t: StarSchema) -> DataFrame:
    fields = F.from_json("message", "orderId string, customerId string, status string")
    return events.order_placed_events(t.orders()).select(fields.alias("f")).select("f.*")


def _routed(t: StarSchema) -> DataFrame:
    return events.route_events(events.parse_events(t.event_messages()))


@query
def routed_events(t: StarSchema) -> DataFrame:
    return _routed(t).select("event_id", "eventType", "entityId", "outcome")


@query
def product_event_outcomes(t: StarSchema) -> DataFrame:
    return events.event_outcome_counts(_routed(t))


@query
def delivery_counters(t: StarSchema) -> DataFrame:
    return events.delivery_counters(_routed(t))


@query
def dead_letter(t: StarSchema) -> DataFrame:
    return events.dead_letter(_routed(t).where("outcome = 'failed'"), order="event_id")


# Notifications


@query
def route_notifications(t: StarSchema) -> DataFrame:
    return notifications.route_notifications(t.notify_requests()).accepted.drop("message")


@query
def route_notifications_rejects(t: StarSchema) -> DataFrame:
    rejects = notifications.route_notifications(t.notify_requests()).rejects
    return joined(rejects.select("userId", "turn", "reasons"))


@query
def order_confirmations(t: StarSchema) -> DataFrame:
    orders = t.orders().withColumn("id", F.col("id").cast("string"))
    return notifications.order_confirmations(orders)


@query
def notification_prompts(t: StarSchema) -> DataFrame:
    parsed = events.parse_events(t.event_messages()).where(~F.col("malformed"))
    audience = F.when(F.col("event_id") % 3 == 0, "premium VIP customer")
    return notifications.notification_prompts(parsed, audience).select("event_id", "prompt")


@query
def parse_replies(t: StarSchema) -> DataFrame:
    return notifications.parse_replies(t.replies()).accepted.drop("reply")


@query
def parse_replies_rejects(t: StarSchema) -> DataFrame:
    return notifications.parse_replies(t.replies()).rejects.select("conv_id", "turn")


# Streams: run over all stored rows, then read back


def _finish(spark: SparkSession, writer, path: str, out: str | None = None) -> None:
    stream = writer.option("checkpointLocation", f"{path}/progress").trigger(availableNow=True)
    with stateful(spark):
        running = stream.start(out) if out else stream.start()
    running.awaitTermination()


def _stored(df: DataFrame, name: str) -> str:
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return path


@query
def stored_products(t: StarSchema) -> DataFrame:
    """The table in the library's own layout, written and read back."""
    return read_products(t.spark, _stored(t.products().withColumn("id", F.col("id").cast("string")), "products"))


@query
def stored_orders(t: StarSchema) -> DataFrame:
    lines = t.orders().withColumns({c: F.col(c).cast("string") for c in ("id", "customer_id", "product_id")})
    return read_orders(t.spark, _stored(lines, "orders")).drop("payment_ref", "version")


@query
def stored_event_stream(t: StarSchema) -> DataFrame:
    """All message files read as a stream."""
    path = work_folder(t.spark, "messages")
    messages = read_product_events(t.spark, _stored(t.event_messages().select("message_id", "raw"), "raw"))
    _finish(t.spark, messages.writeStream.format("parquet"), path, f"{path}/out")
    read = events.parse_events(t.spark.read.schema(messages.schema).parquet(f"{path}/out"))
    return read.select("message_id", "eventType", "entityId")


@query
def reserved_stock_stream(t: StarSchema) -> DataFrame:
    path = work_folder(t.spark, "reserved")
    live = StarSchema(t.spark, t.folder, streaming=True)
    outcomes = stock_stream.reserve_stock_stream(live.stock_requests(), t.products())
    _finish(t.spark, outcomes.writeStream.format("parquet"), path, f"{path}/out")
    return t.spark.read.schema(outcomes.schema).parquet(f"{path}/out")


@query
def reserved_stock_batches(t: StarSchema) -> DataFrame:
    path = work_folder(t.spark, "batches")
    live = StarSchema(t.spark, t.folder, streaming=True)
    writer = stock_stream.reserve_stock_batches(live.stock_requests(), t.products(), f"{path}/out", f"{path}/progress")
    _finish(t.spark, writer, path)
    schema = T.StructType([*t.stock_requests().schema, T.StructField("outcome", T.StringType()), T.StructField("remaining", T.LongType())])
    return t.spark.read.schema(schema).parquet(f"{path}/out/outcomes/batch_id=*")


# A key that no table holds.
_CLOSING = -(1 << 62)


def _delivered_late(t: StarSchema, rows: DataFrame, key: str, job: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Output of ``job`` over rows that arrive out of order, then two from much later that let all the others go."""
    path = work_folder(t.spark, "late")
    sent, late = t.out_of_order(rows)
    later = sent.limit(1).withColumns({key: F.lit(_CLOSING).cast(sent.schema[key].dataType), "at": F.lit("2100-01-01").cast("timestamp")})
    for part in (*(sent.where(F.col("arrival") == n) for n in range(3)), later, later.withColumn("seq", F.col("seq") + 1)):
        part.drop("arrival").write.mode("append").parquet(f"{path}/in")
        live = t.spark.readStream.schema(part.drop("arrival").schema).parquet(f"{path}/in")
        out = job(live, f"{late} seconds")
        _finish(t.spark, out.writeStream.format("parquet"), path, f"{path}/out")
    return t.spark.read.schema(out.schema).parquet(f"{path}/out").where(~F.col(key).eqNullSafe(F.lit(_CLOSING)))


@query
def reserved_stock_reordered(t: StarSchema) -> DataFrame:
    return _delivered_late(
        t, t.stock_requests(), "product_id", lambda live, late: stock_stream.reserve_stock_reordered(live, t.products(), late)
    )


@query
def check_order_transitions_stream(t: StarSchema) -> DataFrame:
    found = _delivered_late(t, t.status_history(), "order_id", transitions.check_order_transitions_stream)
    return found.drop("late")


@query
def delivery_states(t: StarSchema) -> DataFrame:
    return deliveries.delivery_states(t.delivery_log(), "2100-01-01", chunk_rows=_chunk_rows(t.delivery_log()))


@query
def delivery_states_stream(t: StarSchema) -> DataFrame:
    """The log, then two entries from much later that let all deadlines pass."""
    path = work_folder(t.spark, "deliveries")
    log = t.delivery_log()
    later = log.limit(1).select(F.lit("~").alias("message_id"), "seq", F.lit("2100-01-01").cast("timestamp").alias("at"), F.lit("ACKED").alias("kind"))
    for part in (log, later, later):
        part.write.mode("append").parquet(f"{path}/in")
        live = t.spark.readStream.schema(log.schema).parquet(f"{path}/in")
        _finish(t.spark, delivery_stream.delivery_states_stream(live).writeStream.format("parquet"), path, f"{path}/out")
    changes = t.spark.read.schema(delivery_stream.OUTPUT).parquet(f"{path}/out").where("message_id <> '~'")
    return delivery_stream.latest_states(changes)


@query
def deduplicated_events(t: StarSchema) -> DataFrame:
    once = events.acknowledged_once(events.route_events(events.parse_events(t.redelivered_messages())))
    return once.groupBy("message_id", "eventType", "outcome").agg(F.count(F.lit(1)).alias("deliveries"))


@query
def deduplicated_events_stream(t: StarSchema) -> DataFrame:
    """The source is delivered, and then delivered again to the same stream."""
    path = work_folder(t.spark, "once")
    sent = t.redelivered_messages()
    for half in ("delivery = 1", "delivery > 1"):
        sent.where(half).write.mode("append").parquet(f"{path}/in")
        live = t.spark.readStream.schema(sent.schema).parquet(f"{path}/in")
        _finish(t.spark, routing.routed_sinks(live, f"{path}/out", f"{path}/progress", once_for="7 days"), path)
    sink = t.spark.read.schema("message_id string, eventType string, batch_id bigint, outcome string").parquet(f"{path}/out")
    return sink.groupBy("message_id", "eventType", "outcome").agg(F.count(F.lit(1)).alias("deliveries"))


@query
def routed_events_stream(t: StarSchema) -> DataFrame:
    path = work_folder(t.spark, "routed")
    live = StarSchema(t.spark, t.folder, streaming=True)
    _finish(t.spark, routing.routed_sinks(live.event_messages(), f"{path}/out", f"{path}/progress"), path)
    schema = "event_id bigint, eventType string, entityId string, batch_id bigint, outcome string"
    return t.spark.read.schema(schema).parquet(f"{path}/out").drop("batch_id")


@query
def product_event_outcomes_stream(t: StarSchema) -> DataFrame:
    path = work_folder(t.spark, "outcomes")
    live = StarSchema(t.spark, t.folder, streaming=True)
    _finish(t.spark, routing.outcome_counts_stream(_routed(live), f"{path}/out", f"{path}/progress"), path)
    return routing.latest_counts(t.spark, f"{path}/out")


@query
def dead_letter_stream(t: StarSchema) -> DataFrame:
    path = work_folder(t.spark, "letters")
    live = StarSchema(t.spark, t.folder, streaming=True)
    letters = routing.dead_letter_stream(_routed(live).where("outcome = 'failed'"), "event_id")
    _finish(t.spark, letters.writeStream.format("parquet"), path, f"{path}/out")
    return t.spark.read.schema(letters.schema).parquet(f"{path}/out")


@query
def post_order_fanout(t: StarSchema) -> DataFrame:
    path = work_folder(t.spark, "fanout")
    live = StarSchema(t.spark, t.folder, streaming=True)
    orders = live.order_headers().withColumn("id", F.col("id").cast("string"))
    for running in fanout.post_order_fanout(orders, f"{path}/out", f"{path}/progress").values():
        running.awaitTermination()
    mails = t.spark.read.schema("recipient string, order_id string, total decimal(19,2)").parquet(f"{path}/out/confirmations")
    fields = F.from_json("message", "orderId string, status string")
    sent = t.spark.read.schema("message string").parquet(f"{path}/out/events").select(fields.alias("f")).select("f.*")
    return mails.join(sent, F.col("order_id") == F.col("orderId")).select("order_id", "recipient", "total", "status")


def _training_data() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """The queries and SQL of the training-data operators and their pipeline, none if they are not there."""
    try:
        import corpus_pipeline
        from shelfline.llm.oracles import ORACLES as sql
        from shelfline.llm.queries import QUERIES
    except ImportError:
        return {}, {}

    cloudpickle.register_pickle_by_value(corpus_pipeline)
    pipeline_sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**QUERIES, "pipeline": corpus_pipeline.run}, {**sql, **pipeline_sql}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(run: Query) -> Callable[[SparkSession, str], DataFrame]:
        def called(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables' times are UTC
            return plain(run(StarSchema(spark, folder)))

        return called

    own = {name: bound(run) for name, run in _QUERIES.items()}
    return {**own, **_training_data()[0]}


def oracle_sql() -> dict[str, str]:
    return {**ORACLES, **_training_data()[1]}


def entry(spark: SparkSession) -> DataFrame:
    return queries()["top_products_by_category"](spark, "/root/testdata/sf0.001")

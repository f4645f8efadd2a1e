"""The sales and stock reports, as lazy DataFrames.

Reports aggregate the fact table before joining it wherever the result allows,
so a product or customer that holds a large share of the orders is reduced in
the map tasks. The customer summary has to join first; AQE splits the product
that dominates such a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfline.functions.money import half_up, mean, percent_change
from shelfline.operators.filters import LOW_STOCK, confirmed, low_stock, since, stock_tier
from shelfline.operators.ranking import top_k_with_ties
from shelfline.schemas import WIDE_MONEY


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).alias(name)


def top_products_by_category(products: DataFrame, orders: DataFrame, k: int = 5) -> DataFrame:
    """Best sellers per category by orders, then revenue; ties share a rank, unsold products count as 0."""
    sales = (
        confirmed(orders)
        .groupBy("product_id")
        .agg(F.count("id").alias("total_orders"), F.sum("amount").alias("total_revenue"))
    )
    return ranked_sales(products, sales, k)


def ranked_sales(products: DataFrame, sales: DataFrame, k: int) -> DataFrame:
    """The best sellers from ``sales`` (product_id, total_orders, total_revenue)."""
    scored = products.join(sales, products["id"] == sales["product_id"], "left").select(
        "category",
        products["id"].alias("product_id"),
        F.col("name").alias("product_name"),
        _or_zero("total_orders"),
        F.coalesce(F.col("total_revenue"), F.lit(0).cast(WIDE_MONEY)).alias("total_revenue"),
    )
    return top_k_with_ties(scored, ["category"], ["total_orders", "total_revenue"], k, "category_rank")


def monthly_revenue_trend(orders: DataFrame, fill_gaps: bool = True) -> DataFrame:
    """Revenue per month with growth over the month before.

    With ``fill_gaps`` months without sales appear with 0; without, growth is
    over the last month that had sales. The fact table is read once.
    """
    monthly = (
        confirmed(orders)
        .groupBy(F.trunc("created_at", "MM").alias("month_start"))
        .agg(F.sum("amount").cast(WIDE_MONEY).alias("total_revenue"))
    )
    return revenue_growth(monthly, fill_gaps)


def revenue_growth(monthly: DataFrame, fill_gaps: bool) -> DataFrame:
    """The trend from ``monthly`` (month_start, total_revenue).

    Gap months are generated between one sales month and the next, on a table of
    one row per calendar month, which is all the two windows sort.
    """
    by_month = Window.orderBy("month_start")
    if fill_gaps:
        upto = F.coalesce(F.add_months(F.lead("month_start").over(by_month), -1), F.col("month_start"))
        spine = F.sequence(F.col("month_start"), F.col("_upto"), F.expr("INTERVAL 1 MONTH"))
        monthly = (
            monthly.withColumn("_upto", upto)
            .withColumn("_month", F.explode(spine))
            .select(
                F.col("_month").alias("month_start"),
                F.when(F.col("_month") == F.col("month_start"), F.col("total_revenue"))
                .otherwise(F.lit(0).cast(WIDE_MONEY))
                .alias("total_revenue"),
            )
        )
    return (
        monthly.withColumn("prev_month_revenue", F.lag("total_revenue").over(by_month))
        .orderBy("month_start")
        .select(
            F.date_format("month_start", "yyyy-MM").alias("month"),
            "total_revenue",
            "prev_month_revenue",
            percent_change(F.col("total_revenue"), F.col("prev_month_revenue")).alias("growth_pct"),
        )
    )


def customer_order_summary(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Lifetime figures and bought categories per customer.

    Grouping by customer and category first makes the category list distinct
    and keeps every state fixed-size until the short final list.
    """
    per_category = (
        confirmed(orders)
        .join(products.select(F.col("id").alias("product_id"), "category"), "product_id")
        .groupBy("customer_id", "category")
        .agg(
            F.count(F.lit(1)).alias("_orders"),
            F.sum("amount").cast(WIDE_MONEY).alias("_spent"),
            F.min("created_at").alias("_first"),
            F.max("created_at").alias("_last"),
        )
    )
    return summed_customers(per_category)


def summed_customers(per_category: DataFrame) -> DataFrame:
    """The summary from rows distinct by (customer_id, category) with _orders, _spent, _first and _last."""
    orders_placed, spent = F.sum("_orders"), F.sum("_spent")
    return per_category.groupBy("customer_id").agg(
        orders_placed.alias("order_count"),
        spent.alias("lifetime_value"),
        mean(spent, orders_placed).cast("decimal(23,6)").alias("avg_order_value"),
        F.min("_first").alias("first_order_at"),
        F.max("_last").alias("last_order_at"),
        F.array_join(F.array_sort(F.collect_list("category")), ", ").alias("categories_purchased"),
    )


def low_stock_alerts(products: DataFrame) -> DataFrame:
    return (
        low_stock(products)
        .select(
            F.col("id").alias("product_id"),
            "name",
            "category",
            F.col("stock").alias("current_stock"),
            stock_tier(F.col("stock"), "CRITICAL", "HIGH", "MEDIUM").alias("urgency"),
        )
        .orderBy("current_stock", "category")
    )


def top_customers(orders: DataFrame, as_of: str, days: int = 30, k: int = 5) -> DataFrame:
    """Biggest spenders of the last ``days``; ties share a rank."""
    stats = (
        since(confirmed(orders), as_of, days)
        .groupBy("customer_id")
        .agg(F.sum("amount").alias("total_spent"), F.count(F.lit(1)).alias("order_count"))
    )
    placed = F.nullif(F.col("order_count"), F.lit(0).cast("bigint"))
    return (
        top_k_with_ties(stats, [], ["total_spent"], k, "spend_rank", row=placed)
        .select(
            "customer_id",
            "total_spent",
            "order_count",
            half_up(mean(F.col("total_spent"), F.col("order_count"))).alias("avg_ticket"),
            "spend_rank",
        )
        .orderBy("spend_rank")
    )


def daily_sales(orders: DataFrame, products: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Sales per day and category for ``days`` days up to ``as_of``; a row for every pair, zeros included."""
    as_of = as_of[: len("yyyy-mm-dd")]
    today = F.lit(as_of).cast("date")
    first = F.date_sub(today, days - 1)
    grid = products.select("category").distinct().withColumn("sale_day", F.explode(F.sequence(first, today)))
    per_product = (
        since(confirmed(orders), as_of, days - 1)
        .groupBy("product_id", F.to_date("created_at").alias("sale_day"))
        .agg(F.sum("amount").alias("revenue"), F.sum("quantity").alias("units_sold"), F.count("id").alias("order_count"))
    )
    sales = (
        per_product.join(products.select(F.col("id").alias("product_id"), "category"), "product_id")
        .groupBy("sale_day", "category")
        .agg(
            F.sum("revenue").cast(WIDE_MONEY).alias("revenue"),
            F.sum("units_sold").alias("units_sold"),
            F.sum("order_count").alias("order_count"),
        )
    )
    return (
        grid.join(sales, ["sale_day", "category"], "left")
        .select(
            "sale_day",
            "category",
            F.coalesce(F.col("revenue"), F.lit(0).cast(WIDE_MONEY)).alias("revenue"),
            _or_zero("units_sold"),
            _or_zero("order_count"),
        )
        .orderBy("sale_day", "category")
    )


def critical_stock(
    orders: DataFrame,
    products: DataFrame,
    as_of: str,
    days: int = 30,
    threshold: int = LOW_STOCK,
    min_sold: int = 50,
) -> DataFrame:
    """Products low on stock that sold more than ``min_sold`` units in the last ``days``."""
    sold = (
        since(confirmed(orders), as_of, days)
        .groupBy("product_id")
        .agg(F.sum("quantity").alias("sales_total"))
        .where(F.col("sales_total") > min_sold)
    )
    scarce = low_stock(products, threshold).select(
        F.col("id").alias("product_id"), "name", "category", F.col("stock").alias("current_stock")
    )
    urgency = stock_tier(F.col("current_stock"), "OUT_OF_STOCK", "CRITICAL", "LOW")
    most_urgent = F.when(urgency == "OUT_OF_STOCK", 1).when(urgency == "CRITICAL", 2).otherwise(3)
    return (
        scarce.join(sold, "product_id")
        .select("product_id", "name", "category", "current_stock", "sales_total", urgency.alias("urgency"))
        .orderBy(most_urgent, F.col("sales_total").desc())
    )


def top_products_api(products: DataFrame, orders: DataFrame) -> DataFrame:
    """Best sellers in the order they are served."""
    return top_products_by_category(products, orders).orderBy("category", "category_rank")


def monthly_revenue_api(orders: DataFrame) -> DataFrame:
    """Served trend: no previous month, and unknown growth reads 0."""
    growth = F.coalesce(F.col("growth_pct"), F.lit(0))
    return monthly_revenue_trend(orders).select("month", "total_revenue", growth.alias("growth_pct")).orderBy("month")


def low_stock_api(products: DataFrame) -> DataFrame:
    return low_stock_alerts(products).select("product_id", "name", "category", "current_stock", "urgency")


def order_count_report(orders: DataFrame) -> DataFrame:
    """One line telling how many orders were processed."""
    return orders.agg(F.format_string("Total orders processed: %d", F.count(F.lit(1))).alias("report"))

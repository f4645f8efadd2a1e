from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import orders, products, tuples
from shelfline.operators.filters import since
from shelfline.operators.ranking import top_k_with_ties
from shelfline.plans import reports

D = Decimal


def test_unsold_products_count_as_zero_and_tie(spark):
    catalog = products(spark, [("a", 1, "X"), ("b", 1, "X"), ("c", 1, "X")])
    sales = orders(spark, [("u", "a", 1, "5.00", "CONFIRMED", "2024-01-01"), ("u", "b", 1, "9.00", "FAILED", "2024-01-01")])
    got = sorted(tuples(reports.top_products_by_category(catalog, sales), "product_id", "total_orders", "total_revenue", "category_rank"))
    assert got == [("a", 1, D("5.00"), 1), ("b", 0, D("0.00"), 2), ("c", 0, D("0.00"), 2)]


def test_tie_at_rank_five_keeps_all_and_skips_on(spark):
    catalog = products(spark, [(f"p{i}", 1, "X") for i in range(9)])
    counts = [9, 8, 7, 6, 5, 5, 5, 4, 3]
    sales = orders(spark, [("u", f"p{i}", 1, "1.00", "CONFIRMED", "2024-01-01") for i, n in enumerate(counts) for _ in range(n)])
    ranks = sorted(r for (r,) in tuples(reports.top_products_by_category(catalog, sales), "category_rank"))
    assert ranks == [1, 2, 3, 4, 5, 5, 5]


def test_revenue_breaks_ties_of_order_count(spark):
    catalog = products(spark, [("a", 1, "X"), ("b", 1, "X")])
    sales = orders(spark, [("u", "a", 1, "1.00", "CONFIRMED", "2024-01-01"), ("u", "b", 1, "2.00", "CONFIRMED", "2024-01-01")])
    assert dict(tuples(reports.top_products_by_category(catalog, sales), "product_id", "category_rank")) == {"a": 2, "b": 1}


def test_early_tie_pushes_later_ranks_out(spark):
    scores = [10] * 4 + [9] * 3 + [8]
    df = spark.createDataFrame([("g", s) for s in scores], "g string, s int")
    got = sorted(tuples(top_k_with_ties(df, ["g"], ["s"], 5, "r"), "s", "r"))
    assert got == [(9, 5)] * 3 + [(10, 1)] * 4


def test_rank_equals_window_rank_on_random_rows_with_nulls(spark):
    from pyspark.sql import Window

    df = spark.range(500).select("id", (F.col("id") % 4).alias("g"), F.when(F.col("id") % 17 != 0, F.floor(F.rand(5) * 20)).alias("s"))
    df = spark.createDataFrame(df.collect(), df.schema)
    plain = df.withColumn("r", F.rank().over(Window.partitionBy("g").orderBy(F.col("s").desc_nulls_first()))).where("r <= 5")
    assert sorted(tuples(plain), key=repr) == sorted(tuples(top_k_with_ties(df, ["g"], ["s"], 5, "r")), key=repr)


def test_gap_month_is_zero_and_growth_after_it_unknown(spark):
    sales = orders(spark, [
        ("u", "a", 1, "100.00", "CONFIRMED", "2024-01-15"),
        ("u", "a", 1, "150.00", "CONFIRMED", "2024-02-01"),
        ("u", "a", 1, "999.00", "PENDING", "2024-03-01"),
        ("u", "a", 1, "30.00", "CONFIRMED", "2024-04-30T23:59:59"),
        ("u", "a", 1, "20.00", "CONFIRMED", "2024-05-01"),
    ])
    assert tuples(reports.monthly_revenue_trend(sales)) == [
        ("2024-01", D("100.00"), None, None),
        ("2024-02", D("150.00"), D("100.00"), D("50.00")),
        ("2024-03", D("0.00"), D("150.00"), D("-100.00")),
        ("2024-04", D("30.00"), D("0.00"), None),
        ("2024-05", D("20.00"), D("30.00"), D("-33.33")),
    ]
    sparse = tuples(reports.monthly_revenue_trend(sales, fill_gaps=False), "month", "prev_month_revenue", "growth_pct")
    assert sparse[2] == ("2024-04", D("150.00"), D("-80.00"))
    assert [g for _, _, g in tuples(reports.monthly_revenue_api(sales))] == [D("0.00"), D("50.00"), D("-100.00"), D("0.00"), D("-33.33")]


def test_trend_without_confirmed_orders_is_empty(spark):
    assert tuples(reports.monthly_revenue_trend(orders(spark, [("u", "a", 1, "1.00", "FAILED", "2024-01-01")]))) == []


@pytest.mark.parametrize(
    "before,after,growth",
    [
        ("8000.00", "7989.80", "-0.13"),  # -0.1275
        ("8000.00", "8010.20", "0.13"),
        ("131160992.57", "134302243.05", "2.39"),  # 2.394958: rounding it at four digits first would give 2.40
        ("0.01", "99999999999999.99", "999999999999999800.00"),
        ("3.00", "3.00", "0.00"),
    ],
)
def test_growth_rounds_once_half_away_from_zero(spark, before, after, growth):
    sales = orders(spark, [("u", "a", 1, before, "CONFIRMED", "2024-01-01"), ("u", "a", 1, after, "CONFIRMED", "2024-02-01")])
    assert tuples(reports.monthly_revenue_trend(sales), "growth_pct")[1] == (D(growth),)


def test_customer_summary(spark):
    catalog = products(spark, [("a", 1, "X"), ("b", 1, "B"), ("c", 1, "X")])
    sales = orders(spark, [
        ("u", "a", 1, "1.00", "CONFIRMED", "2024-01-03"),
        ("u", "b", 1, "2.00", "CONFIRMED", "2024-01-01"),
        ("u", "c", 1, "2.00", "CONFIRMED", "2024-01-02"),
        ("u", "gone", 1, "7.00", "CONFIRMED", "2024-01-09"),
        ("v", "a", 1, "7.00", "PENDING", "2024-01-09"),
    ])
    assert tuples(reports.customer_order_summary(sales, catalog).withColumn("first_order_at", F.date_format("first_order_at", "dd")).withColumn("last_order_at", F.date_format("last_order_at", "dd"))) == [
        ("u", 3, D("5.00"), D("1.666667"), "01", "03", "B, X")
    ]


def test_low_stock_tiers_and_order(spark):
    catalog = products(spark, [("a", 9, "B"), ("b", 10, "A"), ("c", 0, "B"), ("d", 0, "A"), ("e", 4, "A"), ("f", 5, "A")])
    assert tuples(reports.low_stock_alerts(catalog), "product_id", "urgency") == [
        ("d", "CRITICAL"), ("c", "CRITICAL"), ("e", "HIGH"), ("f", "MEDIUM"), ("a", "MEDIUM"),
    ]


def test_top_customers_window_and_ties(spark):
    def spend(customer, amount, day="2024-06-15"):
        return (customer, "a", 1, amount, "CONFIRMED", day)

    sales = orders(spark, [
        spend("a", "50.00", "2024-05-31"),  # exactly 30 days before: counted
        spend("b", "90.00", "2024-05-30T23:59:59"),  # older: not counted
        spend("c", "60.00", "2024-09-01"),  # later than as_of: counted, there is no upper bound
        spend("d", "10.01"), spend("d", "10.00"),
        spend("e", "20.01"), spend("f", "20.01"), spend("g", "5.00"),
    ])
    got = tuples(reports.top_customers(sales, "2024-06-30"), "customer_id", "order_count", "avg_ticket", "spend_rank")
    assert got[:2] == [("c", 1, D("60.00"), 1), ("a", 1, D("50.00"), 2)]
    assert sorted(got[2:]) == [("d", 2, D("10.01"), 3), ("e", 1, D("20.01"), 3), ("f", 1, D("20.01"), 3)]


def test_daily_sales_grid_is_dense(spark):
    catalog = products(spark, [("a", 1, "X"), ("b", 1, "Y")])
    sales = orders(spark, [
        ("u", "a", 2, "5.00", "CONFIRMED", "2024-06-24T00:00:00"),
        ("u", "a", 3, "6.00", "CONFIRMED", "2024-06-24T23:59:59"),
        ("u", "a", 3, "6.00", "CONFIRMED", "2024-06-23T23:59:59"),  # seventh day back: outside
        ("u", "b", 1, "8.00", "CONFIRMED", "2024-07-05"),  # after the last day: not in the grid
        ("u", "b", 1, "8.00", "PENDING", "2024-06-30"),
    ])
    got = tuples(reports.daily_sales(sales, catalog, "2024-06-30 13:00:00"))
    assert len(got) == 14 and got == sorted(got)
    assert [r[1:] for r in got if r[4]] == [("X", D("11.00"), 5, 2)]
    assert all(r[2:] == (D("0.00"), 0, 0) for r in got if not r[4])


@pytest.mark.parametrize("stock,label", [(0, "OUT_OF_STOCK"), (4, "CRITICAL"), (5, "LOW"), (9, "LOW"), (10, None)])
def test_critical_stock_tiers(spark, stock, label):
    sales = orders(spark, [("u", "a", 51, "1.00", "CONFIRMED", "2024-06-15")])
    got = tuples(reports.critical_stock(sales, products(spark, [("a", stock, "X")]), "2024-06-30"), "urgency")
    assert got == ([(label,)] if label else [])


def test_critical_stock_needs_more_than_fifty_sold(spark):
    catalog = products(spark, [("a", 5, "X"), ("b", 5, "X"), ("c", 0, "X"), ("d", 5, "X")])
    sales = orders(spark, [
        ("u", "a", 25, "1.00", "CONFIRMED", "2024-06-15"), ("u", "a", 25, "1.00", "CONFIRMED", "2024-06-15"),
        ("u", "b", 51, "1.00", "CONFIRMED", "2024-06-15"), ("u", "c", 51, "1.00", "CONFIRMED", "2024-06-15"),
        ("u", "d", 60, "1.00", "CONFIRMED", "2024-06-15"),
    ])
    assert tuples(reports.critical_stock(sales, catalog, "2024-06-30"), "product_id", "sales_total") == [("c", 51), ("d", 60), ("b", 51)]


def test_order_count_report(spark):
    sales = orders(spark, [("u", "a", 1, "1.00", "FAILED", "2024-06-15")] * 3)
    assert tuples(reports.order_count_report(sales)) == [("Total orders processed: 3",)]


def test_date_and_status_filters_reach_the_scan(spark, tmp_path):
    orders(spark, [("u", "a", 1, "1.00", "CONFIRMED", "2024-06-15")]).write.parquet(f"{tmp_path}/o")
    from shelfline.sources.tables import read_orders

    stored = read_orders(spark, f"{tmp_path}/o")
    plan = reports.top_customers(stored, "2024-06-30")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,CONFIRMED)" in plan and "GreaterThanOrEqual(created_" in plan
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert scans and all("payment_ref" not in line and "product_id" not in line for line in scans)
    assert since(stored, "2024-06-30", 15).count() == 1 and since(stored, "2024-06-30", 14).count() == 0

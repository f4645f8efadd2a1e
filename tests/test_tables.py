import pytest
from pyspark.sql import functions as F

from helpers import orders, products, tuples
from shelfline.functions.rules import order_table_rules, product_table_rules
from shelfline.operators import filters, paging, quality
from shelfline.plans import reports
from shelfline.sources import tables


def test_round_trip_keeps_schema(spark, tmp_path):
    made = products(spark, [("a", 1, "X")])
    made.write.parquet(f"{tmp_path}/p")
    assert tuples(tables.read_products(spark, f"{tmp_path}/p")) == tuples(made)


def test_month_partitions_are_pruned(spark, tmp_path):
    sales = orders(spark, [("u", "a", 1, "1.00", "CONFIRMED", day) for day in ("2024-01-31", "2024-02-01", "2024-03-15")])
    tables.write_orders_by_month(sales, f"{tmp_path}/o")
    recent = tables.read_orders_by_month(spark, f"{tmp_path}/o", since="2024-02-10")
    assert recent.columns == sales.columns and recent.count() == 2
    assert "PartitionFilters: [isnotnull(order_month" in recent._jdf.queryExecution().executedPlan().toString()
    assert tables.read_orders_by_month(spark, f"{tmp_path}/o").count() == 3


def test_currency_padding(spark):
    df = spark.createDataFrame([("US ",), ("EUR",), ("  X",)], "currency string")
    assert tuples(tables.normalize_currency(df)) == [("US",), ("EUR",), ("  X",)]


def test_empty_report_keeps_the_last_snapshot(spark, tmp_path):
    report = reports.low_stock_alerts(products(spark, [("a", 1, "X")]))
    assert tables.materialize_report(report, f"{tmp_path}/r")
    assert not tables.materialize_report(report.where("false"), f"{tmp_path}/r")
    assert tables.read_report(spark, f"{tmp_path}/r").count() == 1
    more = reports.low_stock_alerts(products(spark, [("a", 1, "X"), ("b", 2, "X")]))
    for _ in range(3):
        assert tables.materialize_report(more, f"{tmp_path}/r")
    assert tables.read_report(spark, f"{tmp_path}/r").count() == 2
    assert len(list((tmp_path / "r").glob("version-*"))) == 2  # the one before stays for its readers


def test_one_failing_report_does_not_stop_the_others(spark, tmp_path):
    good = products(spark, [("a", 1, "X")])
    bad = good.withColumn("stock", F.raise_error(F.lit("broken")))
    with pytest.raises(ExceptionGroup, match="bad"):
        tables.materialize_reports({"bad": bad, "good": good}, str(tmp_path))
    assert tables.read_report(spark, f"{tmp_path}/good").count() == 1


def test_pages(spark):
    df = spark.range(45).select((44 - F.col("id")).alias("id"), F.floor((44 - F.col("id")) / 10).alias("created_at"))
    first = paging.page(df, 0)
    assert [r.id for r in first.rows.collect()] == list(range(20)) and first.total == 45
    assert [r.id for r in paging.page_rows(df, 2).collect()] == list(range(40, 45))
    assert paging.page_rows(df, 3).isEmpty()


@pytest.mark.parametrize("kind", ["bigint", "string", "timestamp", "date"])
def test_deep_pages_equal_shallow_ones(spark, kind):
    """Sort values tie, and keys repeat and are null, also together."""
    at = {"timestamp": F.timestamp_seconds("n"), "date": F.date_from_unix_date(F.col("n").cast("int"))}.get(kind, F.col("n").cast(kind))
    df = spark.range(500).select(
        F.when(F.col("id") % 9 != 0, F.col("id") % 60).alias("id"),
        (F.xxhash64("id") % 7).alias("n"),
        (F.col("id") % 250).alias("other"),
    )
    df = df.withColumn("created_at", F.when(F.col("n") != 3, at)).repartition(3)
    everything = df.orderBy("created_at", "id", F.xxhash64(*[c for c in df.columns if c not in ("created_at", "id")]))
    want = tuples(everything)
    for n in (0, 1, 4, 7, 8, 9):
        shallow = tuples(paging.page_rows(df, n, 60))
        assert shallow == want[60 * n : 60 * n + 60]
        for limit in (0, 100, 200):
            assert tuples(paging.page_rows(df, n, 60, shallow_rows=limit)) == shallow


def test_deep_pages_of_rows_that_are_all_alike(spark):
    df = spark.range(300).select(F.lit(1).alias("id"), F.lit(2).alias("created_at"))
    assert [paging.page_rows(df, n, 40, shallow_rows=0).count() for n in (0, 3, 7, 8)] == [40, 40, 20, 0]


def test_a_deep_page_reads_its_rows_few_times(spark, monkeypatch):
    """Each round of counting made the whole table anew; here a place that half of the rows have comes on top."""
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    rows = 6_000
    df = spark.range(rows).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 1000 ELSE id END AS created_at", "id % 7 AS other").mapInArrow(counted, "id bigint, created_at bigint, other bigint")
    found = paging.page_rows(df.select(F.when(F.col("id") % 2 == 0, 4).otherwise(F.col("id")).alias("id"), "created_at", "other"), 190, 10, shallow_rows=50)
    expected = sorted((1000 if i % 2 == 0 else i, 4 if i % 2 == 0 else i) for i in range(rows))[1900:1910]
    assert sorted((r.created_at, r.id) for r in found.collect()) == expected
    assert reads.value <= 4 * rows



def test_lookups(spark):
    table = products(spark, [("a", 5, "X"), ("b", 5, "X")])
    ids = spark.createDataFrame([("a",), ("zz",), ("a",)], "id string")
    found = filters.find_by_ids(table, ids)
    assert tuples(found.hits, "id") == [("a",)] and tuples(found.misses) == [("zz",)]
    assert tuples(filters.exists_by_ids(table, ids)) == [("a",)]


def test_availability(spark):
    table = products(spark, [("a", 5, "X")])
    requests = spark.createDataFrame([("a", 5), ("a", 6), ("zz", 1)], "product_id string, quantity int")
    assert sorted(tuples(filters.availability(requests, table), "product_id", "quantity", "available")) == [
        ("a", 5, True), ("a", 6, False), ("zz", 1, False),
    ]


def test_responses(spark):
    assert filters.product_response(products(spark, [("a", 5, "X")])).columns == [
        "id", "name", "description", "price", "currency", "stock", "category", "createdAt",
    ]
    assert filters.order_response(orders(spark, [("u", "a", 1, "1.00", "FAILED", "2024-01-01")])).columns == [
        "id", "customerId", "productId", "quantity", "amount", "currency", "status", "paymentReference", "createdAt",
    ]


def test_table_checks(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES ('a','n','d',1.00BD,'USD',0,'X',timestamp'2024-01-01',0L), ('b',null,'d',0.00BD,'USD',-1,'X',null,0L)"
        " AS t(id,name,description,price,currency,stock,category,created_at,version)"
    )
    assert tuples(quality.check_violations(rows, product_table_rules()), "id", "reasons") == [
        ("b", ["name is null", "created_at is null", "price > 0", "stock >= 0"])
    ]
    lines = orders(spark, [("u", "a", 0, "-1.00", "FAILED", "2024-01-01"), ("u", "zz", 1, "0.00", "FAILED", "2024-01-01")])
    assert tuples(quality.check_violations(lines, order_table_rules()), "id", "reasons") == [("o0", ["quantity > 0", "amount >= 0"])]
    assert tuples(quality.orphan_orders(lines, rows), "product_id") == [("zz",)]
    assert tuples(quality.duplicate_keys(lines, ["customer_id"])) == [("u", 2)]


def test_stock_drift(spark):
    table = products(spark, [("same", 5, "X"), ("less", 5, "X"), ("only", 1, "X")])
    counters = spark.createDataFrame([("same", 5), ("less", 3), ("ghost", 2)], "product_id string, counter int")
    assert sorted(tuples(quality.stock_drift(table, counters)), key=repr) == [
        ("ghost", None, 2, None), ("less", 5, 3, -2), ("only", 1, None, None),
    ]

"""Plans and task shapes that matter once one key holds a large share of all rows."""

import contextlib
import os
import sys

import pytest
from pyspark.sql import functions as F

from helpers import tuples
from shelfline.operators import catalog, filters, ordering, quality
from shelfline.operators.ordered import cut_rows, hot_keys, key_sizes, with_previous
from shelfline.plans import reports

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@contextlib.contextmanager
def settings(spark, **values):
    names = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """Product 0 holds a third of 60,000 orders."""
    folder = tmp_path_factory.mktemp("skew")
    n = F.col("id")
    spark.range(60_000, numPartitions=8).select(
        n.cast("string").alias("id"),
        (n % 997).cast("string").alias("customer_id"),
        F.when(n % 3 == 0, "0").otherwise((F.abs(F.xxhash64(n)) % 2000).cast("string")).alias("product_id"),
        (1 + n % 5).cast("int").alias("quantity"),
        F.lit("9.99").cast("decimal(19,2)").alias("amount"),
        F.lit("USD").alias("currency"),
        F.lit("CONFIRMED").alias("status"),
        F.sha2(n.cast("string"), 256).alias("payment_ref"),
        F.timestamp_seconds(n * 60).alias("created_at"),
        F.lit(0).cast("bigint").alias("version"),
    ).write.parquet(f"{folder}/orders")
    spark.range(2000).select(
        n.cast("string").alias("id"), F.lit("n").alias("name"), F.lit("d").alias("description"),
        F.lit("9.99").cast("decimal(19,2)").alias("price"), F.lit("USD").alias("currency"), F.lit(5).alias("stock"),
        (n % 7).cast("string").alias("category"), F.timestamp_seconds(n).alias("created_at"), F.lit(0).cast("bigint").alias("version"),
    ).write.parquet(f"{folder}/products")
    return spark.read.parquet(f"{folder}/orders"), spark.read.parquet(f"{folder}/products")


AQE_SMALL = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "20KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "1.5",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "20KB",
    "spark__sql__adaptive__coalescePartitions__parallelismFirst": "false",
}


@pytest.mark.parametrize(
    "run",
    [
        lambda o, p: reports.customer_order_summary(o, p),
        lambda o, p: quality.orphan_orders(o, p),
        lambda o, p: ordering.price_orders(o, p),
        lambda o, p: filters.availability(o, p),
    ],
    ids=["customer_order_summary", "orphan_orders", "price_orders", "availability"],
)
def test_fact_joins_split_the_hot_product(spark, skewed, run):
    with settings(spark, **AQE_SMALL):
        assert "skew=true" in final_plan(run(*skewed))


def test_repeated_deletes_of_one_product_spread_over_tasks(spark, skewed):
    sales, catalog_table = skewed
    deletes = sales.select(F.col("product_id").alias("id"), F.col("id").alias("request_id"), F.col("id").cast("bigint").alias("seq"))
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false"):
        result = catalog.delete_products(catalog_table, deletes)
        assert result.accepted.isEmpty() and result.rejects.count() == 60_000 - 2000
        sizes = [r["count"] for r in result.rejects.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 0.3 * 60_000


def test_reports_shuffle_aggregates_not_facts(spark, skewed):
    """What crosses the product shuffle is one row per task and product, however hot a product is."""
    sales, catalog = skewed
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        for df in (
            reports.top_products_by_category(catalog, sales),
            reports.critical_stock(sales, catalog, "1970-02-01"),
            reports.daily_sales(sales, catalog, "1970-02-01"),
        ):
            plan = final_plan(df)
            lines = plan.splitlines()
            scans = [n for n, line in enumerate(lines) if "FileScan" in line and "status#" in line]
            assert scans
            for scan in scans:
                shuffle = max(n for n in range(scan) if " Exchange " in lines[n])
                assert any("partial_" in line for line in lines[shuffle:scan])


def test_fact_is_aggregated_once(spark, skewed):
    sales, catalog = skewed
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        for df, key in ((reports.top_products_by_category(catalog, sales), "product_id"), (reports.top_customers(sales, "1970-02-01"), "customer_id")):
            plan = final_plan(df)
            scans = [line for line in plan.splitlines() if "FileScan" in line and f"{key}#" in line]
            assert len(scans) == 1 and "ReusedExchange" in plan


def test_top_k_ties_do_not_pass_one_task(spark, skewed):
    """All 20,000 rows tie at rank 1; the window sees one row per score."""
    from shelfline.operators.ranking import top_k_with_ties

    df = spark.range(20_000, numPartitions=8).select(F.lit("g").alias("g"), F.lit(1).alias("s"), "id")
    ranked = top_k_with_ties(df, ["g"], ["s"], 5, "r")
    assert ranked.where("r = 1").count() == 20_000
    tasks = ranked.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1


@pytest.mark.parametrize("crowded", [False, True])
def test_chunks_are_bounded_and_complete(spark, crowded):
    """Crowded: a flash sale, 99.9 % of the hot key's rows in 0.01 % of its sequence numbers."""
    n = F.col("id")
    seq = F.when(n % 3000 == 0, n * 1_000_000).otherwise(n + 10**9) if crowded else n
    rows = spark.range(60_000).select(F.when(n % 3 == 0, "hot").otherwise((n % 500).cast("string")).alias("k"), seq.alias("seq"))
    hot = hot_keys(key_sizes(rows, "k"), "k", 1000)
    assert tuples(hot) == [("hot", 20_000)]
    cut = cut_rows(rows, "k", "seq", hot, 1000)
    sizes = cut.groupBy("k", "chunk").agg(F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high")).orderBy("chunk").collect()
    assert sum(r.n for r in sizes) == 20_000 and max(r.n for r in sizes) <= 2000 and len(sizes) >= 15
    assert all(a.high < b.low for a, b in zip(sizes, sizes[1:]))


def test_previous_value_across_chunks(spark):
    from pyspark.sql import Window

    n = F.col("id")
    rows = spark.range(3000).select(
        F.when(n % 3 == 0, "hot").otherwise((n % 50).cast("string")).alias("k"), (n * n).alias("seq"),
        F.when(n % 11 != 0, n.cast("string")).alias("v"),
    )
    plain = rows.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("seq")))
    split = with_previous(rows, "k", "seq", "v", "p", chunk_rows=100)
    assert plain.exceptAll(split.select(plain.columns)).isEmpty() and split.count() == 3000


def test_no_registered_query_uses_a_cross_join(spark, sf_dir):
    import __spark_entry__ as contract

    for name, run in contract.queries().items():
        if name not in contract._QUERIES or name.endswith("_stream") or name == "post_order_fanout":
            continue
        plan = run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan, name

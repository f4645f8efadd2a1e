"""Pages by seek, the clustered fact table, and reconciliation by digests."""

import glob
import random
from datetime import date, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from helpers import orders, products
from shelfline.operators import reconcile
from shelfline.operators.paging import page_rows
from shelfline.operators.quality import stock_drift
from shelfline.plans.reports import critical_stock
from shelfline.sources import clustered, seek


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def filters_of(df, capsys):
    df.explain("formatted")
    return "".join(line for line in capsys.readouterr().out.splitlines() if line.startswith("PushedFilters"))


# Pages


@pytest.fixture(scope="module")
def numbered(spark, tmp_path_factory):
    """2,000 rows with repeated sort values and keys, a third of them alike in both, and nulls; some wholly repeated."""
    draw = random.Random(4)
    made = [(7, 3, n) if draw.random() < 0.33 else (draw.choice([None, 1, 5, 9, 12]), draw.choice([None, 1, 2, 8]), n) for n in range(1990)]
    made += made[:10]
    df = spark.createDataFrame(made, "created_at int, id int, v int")
    path = str(tmp_path_factory.mktemp("seek"))
    seek.write_ordered(df, path, rows_per_file=150)
    return df, path


def test_pages_by_seek_equal_plain_pages(spark, numbered):
    df, path = numbered
    for page in (0, 1, 7, 50, 98, 99, 100, 1_000_000):
        assert list(map(tuple, seek.read_page(spark, path, page).collect())) == list(map(tuple, page_rows(df, page).collect())), page
    # Wider than a file.
    assert list(map(tuple, seek.read_page(spark, path, 1, 700).collect())) == list(map(tuple, page_rows(df, 1, 700).collect()))
    assert seek.page_total(spark, path) == 2000


def test_a_late_page_opens_few_files_and_few_rows(spark, numbered, capsys):
    _, path = numbered
    page = seek.read_page(spark, path, 80)
    assert len(page.inputFiles()) <= 2 < len(seek._stored(spark, path).inputFiles()) - 8
    assert "_row" in filters_of(page, capsys)


def test_positions_are_those_of_the_order(spark, numbered):
    df, path = numbered
    found = seek.positions(spark, path).orderBy("position").collect()
    assert [r.position for r in found] == list(range(2000))
    assert [tuple(r)[:3] for r in found] == list(map(tuple, page_rows(df, 0, 2000).collect()))


def test_an_empty_table_has_empty_pages(spark, numbered, tmp_path):
    df, _ = numbered
    seek.write_ordered(df.limit(0), str(tmp_path))
    assert rows(seek.read_page(spark, str(tmp_path), 0)) == [] and seek.page_total(spark, str(tmp_path)) == 0


# Clustered facts


def test_interleaved_bits(spark):
    pairs = [(0, 0), (1, 0), (0, 1), (5, 3), (65535, 0), (65535, 65535)]

    def plain(x, y):
        return sum(((x >> n & 1) << 2 * n + 1) + ((y >> n & 1) << 2 * n) for n in range(16))

    df = spark.createDataFrame(pairs, "x bigint, y bigint").select("x", "y", clustered.interleaved(F.col("x"), F.col("y")).alias("z"))
    assert [r.z for r in df.collect()] == [plain(x, y) for x, y in pairs]


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    draw = random.Random(9)
    stock = products(spark, [("hot", 3, "c0"), *((f"p{n}", n % 12, f"c{n % 8}") for n in range(40))])
    made = []
    for _ in range(4000):
        product = "hot" if draw.random() < 0.4 else draw.choice([f"p{draw.randrange(40)}", "gone"])
        day = date(2024, 1, 1) + timedelta(days=draw.randrange(400))
        made.append((f"c{draw.randrange(9)}", product, draw.randrange(1, 5), "2.00", draw.choice(["CONFIRMED", "FAILED"]), str(day)))
    lines = orders(spark, made)
    path = str(tmp_path_factory.mktemp("clustered"))
    clustered.write_clustered(lines, stock, path, rows_per_file=100)
    return lines, stock, path


def test_clustered_orders_are_the_orders(spark, facts):
    lines, stock, path = facts
    assert rows(clustered.read_clustered(spark, path)) == rows(lines)
    found = clustered.read_clustered(spark, path, "2025-02-01", 30)
    assert rows(critical_stock(found, stock, "2025-02-01", min_sold=1)) == rows(critical_stock(lines, stock, "2025-02-01", min_sold=1)) != []


def test_one_category_and_a_month_skip_most_row_groups(spark, facts, capsys):
    lines, stock, path = facts
    ranks = {r.product_id: r.product_rank for r in spark.read.parquet(f"{path}/ranks").where("category = 'c3'").collect()}
    found = clustered.read_clustered(spark, path, "2025-02-01", 30, "c3")
    expected = lines.where("created_at >= timestamp '2025-01-02'").join(stock.where("category = 'c3'").select(F.col("id").alias("product_id")), "product_id", "left_semi")
    assert rows(found) == rows(expected.select(found.columns)) != []
    pushed = filters_of(found, capsys)
    assert "product_rank" in pushed and "created_at" in pushed
    groups = hit = 0
    for name in glob.glob(f"{path}/rows/*.parquet"):
        meta = pq.read_metadata(name)
        columns = [meta.schema.column(n).name for n in range(meta.num_columns)]
        rank, at = columns.index("product_rank"), columns.index("created_at")
        data = pq.read_table(name, columns=["product_rank", "created_at"])
        for n in range(meta.num_row_groups):
            groups += 1
            group = meta.row_group(n)
            r = group.column(rank).statistics
            last = max(str(v)[:10] for v in data["created_at"].to_pylist())
            hit += r.min <= max(ranks.values()) and r.max >= min(ranks.values()) and last >= "2025-01-02"
    assert groups >= 30 and hit <= groups / 5


def test_a_hot_product_is_spread_over_bounded_files(spark, facts):
    lines, _, path = facts
    sizes = [pq.read_metadata(name).num_rows for name in glob.glob(f"{path}/rows/*.parquet")]
    assert len(sizes) <= -(-lines.count() // 100) and max(sizes) <= 300


def test_clustered_tables_without_rows(spark, facts, tmp_path):
    lines, stock, _ = facts
    clustered.write_clustered(lines.limit(0), stock.limit(0), str(tmp_path))
    assert rows(clustered.read_clustered(spark, str(tmp_path), "2025-01-01", 5, "c3")) == []


# Reconciliation


def test_drift_by_digest_equals_the_join(spark):
    draw = random.Random(6)
    stock = products(spark, [(f"p{n}", draw.randrange(9), "c") for n in range(300)])
    counted = [(f"p{n}", draw.randrange(9)) for n in range(20, 320)] + [(None, 4), ("p50", 1), ("p50", 1), ("p60", None)]
    counters = spark.createDataFrame(counted, "product_id string, counter int")
    for ranges in (1, 4, 64):
        assert rows(reconcile.stock_drift_by_digest(stock, counters, ranges)) == rows(stock_drift(stock, counters))


def test_one_wrong_counter_of_a_million_joins_one_range(spark):
    stock = spark.range(1_000_000).select("id", (F.col("id") % 50).cast("int").alias("stock"))
    counters = stock.select(F.col("id").alias("product_id"), F.when(F.col("id") == 777_777, 999).otherwise(F.col("stock")).alias("counter"))
    assert rows(reconcile.stock_drift_by_digest(stock, counters)) == rows(stock_drift(stock, counters)) == [(777_777, 27, 999, 972)]
    left, right = reconcile.suspects(stock.withColumnsRenamed({"id": "product_id", "stock": "v"}), counters.withColumnRenamed("counter", "v"), "product_id", "v")
    assert left.count() == right.count() <= 3


def test_tables_that_agree_join_nothing(spark):
    stock = products(spark, [("a", 1, "c"), ("b", 2, "c")])
    counters = spark.createDataFrame([("b", 2), ("a", 1)], "product_id string, counter int")
    assert rows(reconcile.stock_drift_by_digest(stock, counters)) == []
    assert rows(reconcile.stock_drift_by_digest(stock, counters.limit(0))) == rows(stock_drift(stock, counters.limit(0)))

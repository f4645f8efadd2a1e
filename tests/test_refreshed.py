"""Reports merged from monthly partials, and what a refresh reads."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import orders, products
from shelfline.plans import refreshed, reports
from shelfline.sources.tables import has_report, materialize_report, read_orders_by_month, read_report, write_orders_by_month
from shelfline.session import list_folders

STATUSES = ["CONFIRMED", "CONFIRMED", "PENDING", "FAILED"]


def sold(spark, draw, months, n=200):
    rows = []
    for _ in range(n):
        month, day = draw.choice(months), draw.randrange(1, 28)
        product = "hot" if draw.random() < 0.4 else f"p{draw.randrange(8)}"
        rows.append((f"c{draw.randrange(6)}", product, 1, f"{draw.randrange(1, 99)}.50", draw.choice(STATUSES), f"{month}-{day:02}"))
    return orders(spark, rows)


def goods(spark):
    return products(spark, [("hot", 5, "a"), *((f"p{n}", n, "ab"[n % 2]) for n in range(9))])


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def same_as_full(spark, path, store):
    facts, stock = read_orders_by_month(spark, path), goods(spark)
    assert rows(refreshed.refreshed_revenue_trend(spark, store)) == rows(reports.monthly_revenue_trend(facts))
    assert rows(refreshed.refreshed_top_products(spark, store, stock)) == rows(reports.top_products_by_category(stock, facts))
    assert rows(refreshed.refreshed_customer_summary(spark, store, stock)) == rows(reports.customer_order_summary(facts, stock))


def test_only_changed_months_are_read(spark, tmp_path, capsys):
    draw, path, store = random.Random(1), f"{tmp_path}/orders", f"{tmp_path}/store"
    write_orders_by_month(sold(spark, draw, ["2024-01", "2024-02", "2024-04"]), path)
    assert refreshed.refresh(spark, path, store).changed == ["2024-01-01", "2024-02-01", "2024-04-01"]
    same_as_full(spark, path, store)
    assert refreshed.refresh(spark, path, store) == ([], [])

    write_orders_by_month(sold(spark, draw, ["2024-02"], 40), path, only_these=True)
    assert refreshed.refresh(spark, path, store) == (["2024-02-01"], [])
    same_as_full(spark, path, store)
    read = refreshed.changed_orders(spark, path, ["2024-02-01"])
    opened = read.select(F.input_file_name().alias("f")).distinct().collect()
    assert opened and all("order_month=2024-02-01" in r.f for r in opened)
    read.explain("formatted")
    (filters,) = [line for line in capsys.readouterr().out.splitlines() if line.startswith("PartitionFilters")]
    assert "order_month" in filters

    write_orders_by_month(sold(spark, draw, ["2023-11"], 30), path, only_these=True)
    assert refreshed.refresh(spark, path, store).changed == ["2023-11-01"]
    same_as_full(spark, path, store)


def test_months_that_go_or_sell_nothing(spark, tmp_path):
    path, store = f"{tmp_path}/orders", f"{tmp_path}/store"
    write_orders_by_month(orders(spark, [("c", "p1", 1, "5.00", "CONFIRMED", "2024-01-03"), ("c", "p1", 1, "5.00", "FAILED", "2024-02-03")]), path)
    assert refreshed.refresh(spark, path, store).changed == ["2024-01-01", "2024-02-01"]
    same_as_full(spark, path, store)
    write_orders_by_month(orders(spark, [("c", "p1", 1, "5.00", "FAILED", "2024-02-03")]), path)
    assert refreshed.refresh(spark, path, store) == (["2024-02-01"], ["2024-01-01"])
    assert rows(refreshed.refreshed_revenue_trend(spark, store)) == []
    same_as_full(spark, path, store)


def test_an_interrupted_refresh_leaves_the_old_state(spark, tmp_path, monkeypatch):
    draw, path, store = random.Random(2), f"{tmp_path}/orders", f"{tmp_path}/store"
    write_orders_by_month(sold(spark, draw, ["2024-01"], 50), path)
    refreshed.refresh(spark, path, store)
    before = rows(refreshed.refreshed_revenue_trend(spark, store))
    write_orders_by_month(sold(spark, draw, ["2024-01"], 50), path, only_these=True)

    def stop(*_):
        raise InterruptedError

    with monkeypatch.context() as patch:
        patch.setattr(refreshed, "materialize_report", stop)
        with pytest.raises(InterruptedError):
            refreshed.refresh(spark, path, store)
    assert rows(refreshed.refreshed_revenue_trend(spark, store)) == before
    assert refreshed.refresh(spark, path, store, kept_seconds=0).changed == ["2024-01-01"]
    same_as_full(spark, path, store)
    # The interrupted one's partials have gone; those before stay for readers that have begun.
    assert len(list_folders(spark, f"{store}/{refreshed.BY_PRODUCT}")) == 2


def test_two_writers_at_once_lose_no_version(spark, tmp_path, monkeypatch):
    """A second writer finishes between the first one's data and its pointer."""
    from shelfline.sources import tables

    path, plain, between = str(tmp_path), tables.replace_file, []

    def interleaved(spark_, written, target):
        if not between:
            between.append(True)
            materialize_report(spark.range(3, 5), path)
            materialize_report(spark.range(5, 7), path)
        plain(spark_, written, target)

    monkeypatch.setattr(tables, "replace_file", interleaved)
    assert materialize_report(spark.range(2), path)
    assert rows(read_report(spark, path)) == [(0,), (1,)]
    assert len([f for f in list_folders(spark, path) if f.startswith("version-")]) == 3


def test_reading_no_report_says_so(spark, tmp_path):
    assert not has_report(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError, match="no report"):
        read_report(spark, str(tmp_path))


def test_month_files_do_not_grow_with_tasks(spark, tmp_path):
    facts = sold(spark, random.Random(3), [f"2024-{m:02}" for m in range(1, 13)], 400).repartition(16)
    write_orders_by_month(facts, f"{tmp_path}/o")
    files = read_orders_by_month(spark, f"{tmp_path}/o").inputFiles()
    assert len(files) <= 12 + int(spark.conf.get("spark.sql.shuffle.partitions"))

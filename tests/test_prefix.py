"""Ranks and running sums in ranges against plain windows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import SMALL, as_set
from tests.test_skew import plan
from tradeloom.operators import prefix
from tradeloom.operators.ordering import Order
from tradeloom.plans import customers
from tradeloom.sources import orderlines


def plain(df, order, summed):
    value = F.col(order.column)
    value = value.desc_nulls_last() if order.descending else value.asc_nulls_first()
    rows = Window.orderBy(value, F.col(order.tie_break).asc_nulls_first())
    return df.select(
        "*", F.row_number().over(rows).alias("row_number"), F.rank().over(Window.orderBy(value)).alias("rank"),
        F.dense_rank().over(Window.orderBy(value)).alias("dense_rank"),
        F.sum(summed).over(rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("running_sum"),
        F.sum(summed).over(Window.partitionBy()).alias("total_sum"),
    )


def frame(spark, kind, n):
    draw = random.Random(n)
    value = {
        "unique": lambda i: i * 7919 % 100_003, "few": lambda i: draw.randrange(4), "hot": lambda i: 5 if i % 3 else draw.randrange(50),
        "one": lambda i: 1, "nulls": lambda i: None if i % 2 else draw.randrange(9),
    }[kind]
    rows = [(f"id{i:05}" if i else None, value(i), None if i % 5 == 0 else draw.randrange(-9, 99)) for i in range(n)]
    draw.shuffle(rows)
    return spark.createDataFrame(rows, "id string, v int, x int").repartition(3)


@pytest.mark.parametrize("kind", ["unique", "few", "hot", "one", "nulls"])
@pytest.mark.parametrize("descending", [False, True])
def test_equals_windows(spark, kind, descending):
    df, order = frame(spark, kind, 700), Order("v", "id", descending)
    wanted = as_set(plain(df, order, "x"))
    for rows_per_part in (10**6, 60, 9):
        assert as_set(prefix.ranked(df, order, "x", rows_per_part)) == wanted


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    df, order = frame(spark, "few", n), Order("v", "id")
    assert as_set(prefix.ranked(df, order, "x", 1)) == as_set(plain(df, order, "x"))


def test_ranges_are_even_and_no_task_sees_all(spark, monkeypatch):
    df, order = frame(spark, "hot", 3000), Order("v", "id")
    seen = []
    original = prefix.written
    monkeypatch.setattr(prefix, "written", lambda df, name: seen.append(original(df, name)) or seen[-1])
    result = prefix.ranked(df, order, "x", 200)
    sizes = [r["count"] for r in seen[0].groupBy("_part").count().collect()]
    assert len(sizes) == 15 and max(sizes) < 400
    assert "SinglePartition" not in plan(seen[0]) and "SinglePartition" in plan(result)  # of ranges, not of rows


def test_customer_pareto_in_ranges(spark, monkeypatch):
    t = orderlines.load(spark, SMALL)
    wanted = as_set(customers.customer_pareto(t))
    monkeypatch.setattr(prefix, "ROWS_PER_PART", 10)
    monkeypatch.setattr(prefix.ranked, "__defaults__", (10,))
    assert as_set(customers.customer_pareto(orderlines.load(spark, SMALL))) == wanted and len(wanted) > 50

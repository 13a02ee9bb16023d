"""Exact ratios, independent tier limits and whole Pareto lists."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tradeloom.functions.columns import money_mean, money_percent, ratio
from tradeloom.plans import cohorts, pages, revenue, sellers


@pytest.mark.parametrize(
    ("n", "d", "places"),
    [(1, 3, 2), (1, 8, 2), (-1, 8, 2), (5, 2, 0), (-5, 2, 0), (2, 3, 0), (0, 7, 2), (7, 0, 2), (10**17 + 1, 3, 2), (1, -8, 2)],
)
def test_ratio(spark, n, d, places):
    df = spark.createDataFrame([(n, d)], "n long, d long")
    (row,) = df.select(ratio(F.col("n"), F.col("d"), places).alias("r")).collect()
    step = Decimal(1).scaleb(-places)
    assert row.r == ((Decimal(n) / Decimal(d)).quantize(step, ROUND_HALF_UP) if d else None)


def test_ratios_of_very_large_money(spark):
    df = spark.createDataFrame([(Decimal("100000000000000.93"), 1), (Decimal("90071992547409.93"), 2)], "m decimal(38,2), k long")
    found = [r.r for r in df.select(money_mean(F.col("m"), F.col("k")).alias("r")).collect()]
    assert found == [Decimal("100000000000000.93"), Decimal("45035996273704.97")]
    part = spark.createDataFrame([(Decimal("99994999999999.99"), Decimal("100000000000000.00"))], "a decimal(38,2), b decimal(38,2)")
    assert part.select(money_percent(F.col("a"), F.col("b")).alias("r")).first().r == Decimal("99.99")


@pytest.mark.parametrize(
    ("revenue_", "rating", "cancellation", "name"),
    [
        ("50000.01", "4.00", "4.99", "Top Performer"), ("50000.00", "4.00", "4.99", "Good Performer"),
        ("50000.01", "3.99", "4.99", "Good Performer"), ("50000.01", "4.00", "5.00", "Good Performer"),
        ("20000.00", "3.50", "0.00", "Average"), ("20000.00", "3.50", "15.01", "Underperformer"),
        ("1.00", "2.99", "0.00", "Underperformer"), ("1.00", "3.00", "15.00", "Average"),
    ],
)
def test_tier_limits(spark, revenue_, rating, cancellation, name):
    row = [(Decimal(revenue_), Decimal(rating), Decimal(cancellation))]
    schema = "total_revenue decimal(20,2), avg_rating decimal(20,2), cancellation_rate decimal(20,2)"
    assert spark.createDataFrame(row, schema).select(sellers.tier().alias("t")).first().t == name


def test_the_pareto_page_has_all_categories(shop):
    for i in range(40):
        shop.product(f"p{i}", f"c{i:02d}")
        shop.order(f"o{i}", items=((f"p{i}", "s", str(1 + i)),))
    t = shop.tables()
    assert len(rows(pages.page_revenue_pareto(t))) == 40 and len(rows(revenue.category_pareto(t))) == 30


def test_cohorts_need_no_sorted_aggregate(shop):
    shop.order("o1", bought="2020-01-05 10:00:00")
    shop.order("o2", bought="2020-03-05 10:00:00")
    t = shop.tables()
    for report in (cohorts.cohort_activity, cohorts.cohort_size, cohorts.cohort_retention, cohorts.avg_retention_by_month):
        plan = report(t)._jdf.queryExecution().executedPlan().toString()
        assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    assert [r["month_index"] for r in rows(cohorts.cohort_activity(t).orderBy("month_index"))] == [0, 2]

"""The plans for large, skewed inputs give what the small-data plans give."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL, all_limits_at_zero, as_set
from tradeloom.operators.sizing import tasks_for
from tradeloom.operators.skew import SALT, find_hot_keys, spread_join
from tradeloom.plans import catalog, cohorts, customers, delivery, exploration, revenue, sellers, star
from tradeloom.sources import orderlines
from tradeloom.tables import Tables


def skewed(spark) -> Tables:
    """A third of the lines in one order, of one product and of one seller; a third of the
    orders with one customer id and of the ids with one person."""
    t = orderlines.load(spark, SMALL)
    line = F.pmod(F.hash("order_id", "order_item_id", "product_id"), F.lit(9))
    items = t["order_items"].withColumn("line", line).select(
        F.when(F.col("line") < 3, F.lit(60).cast("long")).otherwise(F.col("order_id")).alias("order_id"),
        "order_item_id",
        F.when(F.col("line").between(2, 4), F.lit(5).cast("long"))
        .otherwise(F.col("product_id"))
        .alias("product_id"),
        F.when(F.col("line").between(1, 5), F.lit(3).cast("long"))
        .otherwise(F.col("seller_id"))
        .alias("seller_id"),
        "shipping_limit_date",
        "price",
        "freight_value",
    )
    hot = F.lit(8).cast("long")
    orders = t["orders"].withColumn(
        "customer_id",
        F.when(F.col("order_id") % 3 == 0, hot)
        .when(F.col("order_id") % 50 == 1, F.lit(None))
        .otherwise(F.col("customer_id")),
    )
    people = t["customers"].withColumn(
        "customer_unique_id",
        F.when(F.col("customer_id") % 3 == 1, hot).otherwise(F.col("customer_unique_id")),
    )
    products = t["products"].withColumn(
        "product_category_name",
        F.when(F.col("product_id") % 3 == 0, "Brand#7").otherwise(F.col("product_category_name")),
    )
    frames = {name: t[name] for name in t.names()}
    frames |= {"order_items": items, "orders": orders, "customers": people, "products": products}
    return Tables.of(spark, **frames)


# The reports whose plan depends on input sizes, each form once.
SIZED = (
    "top_categories_by_orders",
    "rfm_segments",
    "top_champions",
    "seller_metrics",
    "seller_scorecard",
    "seller_top_bottom",
    "flag_underperforming_sellers",
    "category_performance",
    "star_schema",
    "bi_retention_rate",
    "dim_product",
    "page_executive",
    "category_drill",
    "category_drill_sellers",
    "category_drill_rating",
    "category_drill_delivery",
)


@pytest.mark.parametrize("name", SIZED)
def test_plans_for_large_inputs_equal_plans_for_small_ones(spark, name):
    report = catalog.reports()[name]
    small = as_set(report(skewed(spark)))
    with all_limits_at_zero(spark):
        assert as_set(report(skewed(spark))) == small


def test_hot_keys_are_found(spark, forced):
    t = skewed(spark)
    assert 60 in {r.order_id for r in t.hot("order_items", "order_id").splits.collect()}
    assert 8 in {r.customer_id for r in t.hot("orders", "customer_id").splits.collect()}
    assert t.hot("orders", "customer_id").null_splits > 1


def test_small_inputs_are_not_searched(spark):
    assert not find_hot_keys(skewed(spark)["order_items"], "order_id")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_spread_join_equals_join(spark, forced, how):
    rows = spark.range(3000).selectExpr(
        "id", "IF(id % 3 = 0, 1, IF(id % 3 = 1 AND id % 2 = 0, NULL, id)) AS k"
    )
    side = spark.range(2500).selectExpr("id AS k", "id * 2 AS v")
    hot = find_hot_keys(rows, "k")
    assert hot
    found = spread_join(rows, side, "k", hot, ["id"], how).drop(SALT)
    assert as_set(found) == as_set(rows.join(side, "k", how))


def test_a_hot_key_is_split(spark, forced):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    rows = spark.range(8000).selectExpr("id", "IF(id % 2 = 0, 1, id) AS k")
    side = spark.range(8000).selectExpr("id AS k")
    joined = spread_join(rows, side, "k", find_hot_keys(rows, "k"), ["id"])
    salts = joined.where("k = 1").groupBy(SALT).count().collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(salts) >= 8
    assert max(r["count"] for r in salts) < 4000 / 4


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_have_no_single_task_window(spark, forced):
    t = orderlines.load(spark, SMALL)
    for df in (customers.rfm_scores(t), customers.rfm_segments(t)):
        assert "Window" not in plan(df) and "Exchange" not in plan(df)


def test_lines_are_shuffled_once_per_order_key(spark):
    """Lines, orders and reviews meet on the order; grouping by order needs no shuffle."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    text = plan(sellers.seller_metrics(orderlines.load(spark, SMALL)))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 4
    assert "Expand" not in text and "Window" not in text


@pytest.fixture
def small_tasks(spark):
    """Tasks of so few bytes that the small tables need more of them than the session has."""
    spark.conf.set("spark.tradeloom.taskBytes", "1000")
    yield
    spark.conf.unset("spark.tradeloom.taskBytes")


def held_by_tasks(df) -> set[int]:
    """How many tasks the shuffles by order have."""
    return {int(n) for n in re.findall(r"hashpartitioning\(order_id#\d+L?, (\d+)\)", plan(df))}


@pytest.mark.parametrize("report", [sellers.seller_metrics, sellers.category_metrics, star.fact_sales])
def test_tasks_of_the_order_lines_grow_with_the_input(spark, small_tasks, report):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    t = orderlines.load(spark, SMALL)
    tasks = held_by_tasks(report(t))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    needed = tasks_for(t["order_items"])
    assert needed > 2 * spark.sparkContext.defaultParallelism
    # Both sides of the join of lines and orders have them, whatever the session's number.
    assert max(tasks) >= needed
    assert max(tasks) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def few_lines(spark) -> Tables:
    """Lines in memory, far fewer than the orders and reviews."""
    t = orderlines.load(spark, SMALL)
    lines = t["order_items"].where("order_id % 100 = 0")
    items = spark.createDataFrame(lines.collect(), lines.schema)
    return Tables.of(spark, **({name: t[name] for name in t.names()} | {"order_items": items}))


@pytest.mark.parametrize(
    "name",
    [
        "page_sellers_scatter",
        "seller_tier_summary",
        "seller_top_bottom",
        "global_dense_rank",
        "seller_metrics",
        "seller_scorecard",
    ],
)
def test_tasks_of_the_sellers_grow_with_the_orders(spark, monkeypatch, name):
    """A task holds the orders and reviews of its keys even if few of them have lines."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.tradeloom.taskBytes", "2000")
    shared, read = Tables.shared, []

    def kept(self, name, make, always=False):
        read.append(make(self))
        return shared(self, name, make, always)

    monkeypatch.setattr(Tables, "shared", kept)
    t = few_lines(spark)
    catalog.reports()[name](t)
    both = t["orders"].select("order_id").join(t["order_reviews"].select("order_id"), "order_id")
    tasks, needed, by_lines = held_by_tasks(read[0]), tasks_for(both), tasks_for(t["order_items"])
    many = as_set(catalog.reports()[name](t))
    spark.conf.unset("spark.tradeloom.taskBytes")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Lines, orders and reviews all go to as many tasks as they need together.
    assert len(read) >= 1 and min(tasks) >= needed > 2 * (by_lines or 1)
    assert many == as_set(catalog.reports()[name](few_lines(spark)))


@pytest.mark.parametrize("name", ["seller_metrics", "category_performance", "bi_measures"])
def test_many_tasks_give_what_few_give(spark, name):
    report = catalog.reports()[name]
    few = as_set(report(skewed(spark)))
    spark.conf.set("spark.tradeloom.taskBytes", "4000")
    many = as_set(report(skewed(spark)))
    with all_limits_at_zero(spark):
        salted = as_set(report(skewed(spark)))
    spark.conf.unset("spark.tradeloom.taskBytes")
    assert many == few
    assert salted == few


@pytest.mark.parametrize(
    "report, key",
    [
        (exploration.top_categories_by_orders, "category#\\d+, order_id"),
        (exploration.payment_overview, "order_id"),
        (revenue.monthly_revenue_mom, "order_id"),
        (revenue.revenue_by_state, "customer_id"),
        (customers.rfm_base, "customer_id"),
        (delivery.delivery_by_state, "customer_id"),
        (delivery.late_vs_review, "order_id"),
        (cohorts.cohort_retention, "customer_id"),
    ],
)
def test_tasks_of_orders_and_customers_grow_with_the_input(spark, small_tasks, report, key):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    t = orderlines.load(spark, SMALL)
    tasks = [int(n) for n in re.findall(rf"hashpartitioning\({key}#\d+L?, (\d+)\)", plan(report(t)))]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert tasks
    # Of each key, no shuffle is left to the session's number of tasks.
    assert min(tasks) >= tasks_for(t["orders"]) > 2 * spark.sparkContext.defaultParallelism


def test_groups_of_large_inputs_are_made_after_their_shuffle(spark, small_tasks):
    """No task groups all rows of a file split by order before they are dealt."""
    text = plan(exploration.top_categories_by_orders(orderlines.load(spark, SMALL)))
    dealt_by_order = r"Exchange hashpartitioning\(category#\d+, order_id#\d+L?, \d+\).*\n"
    assert re.search(dealt_by_order, text)
    assert not re.search(dealt_by_order + r"\W*(\*\(\d+\) )?HashAggregate", text)


@pytest.mark.parametrize(
    "name",
    [
        "top_categories_by_orders",
        "payment_overview",
        "revenue_by_state",
        "rfm_segment_summary",
        "delivery_by_state",
        "late_vs_review",
        "cohort_retention",
    ],
)
def test_many_tasks_of_orders_and_customers_give_what_few_give(spark, name):
    report = catalog.reports()[name]
    few = as_set(report(skewed(spark)))
    spark.conf.set("spark.tradeloom.taskBytes", "4000")
    many = as_set(report(skewed(spark)))
    with all_limits_at_zero(spark):
        salted = as_set(report(skewed(spark)))
    spark.conf.unset("spark.tradeloom.taskBytes")
    assert many == few
    assert salted == few

"""Order-line totals that repeat a line once per review of its order.

The reports join reviews to order lines before summing, so an order with two reviews counts
its lines twice. Reviews are reduced to one row per order and the repetition becomes a
weight: the result is that of the join, without its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.functions.columns import CANCELED, is_late
from tradeloom.operators.sizing import dealt, tasks_for
from tradeloom.operators.skew import SALT, spread_join
from tradeloom.tables import Tables


def totals_per(t: Tables, rows: DataFrame, source: tuple[str, str], keys: list[str], tasks: int | None, *totals: Column) -> DataFrame:
    """One row per `keys`, dealt by them if a number of tasks is given.

    Dealt rows are grouped by the tasks that get them, so that no map of groups is larger than what a
    task is given. If the key of the `source` (table, column) is hot, its rows collapse where they are
    read, and what is left is dealt.
    """
    hot = tasks is not None and bool(t.hot(*source))
    grouped = dealt(rows, None if hot else tasks, *keys).groupBy(*keys).agg(*totals)
    return dealt(grouped, tasks, *keys) if hot else grouped


def reviews_per_order(t: Tables, tasks: int | None = None) -> DataFrame:
    """One row per order, dealt by the order if a number of tasks is given."""
    score = F.col("review_score").cast("int")
    return totals_per(
        t,
        t["order_reviews"].select("order_id", "review_score"),
        ("order_reviews", "order_id"),
        ["order_id"],
        tasks,
        F.count("*").alias("reviews"),
        F.sum(score).alias("score_sum"),
        F.count(score).alias("scores"),
    )


def payments_per_order(t: Tables, tasks: int | None, *totals: Column) -> DataFrame:
    """One row per order, dealt by the order if a number of tasks is given."""
    payments = t["order_payments"].select("order_id", "payment_value")
    return totals_per(t, payments, ("order_payments", "order_id"), ["order_id"], tasks, *totals)


def with_customer(t: Tables, orders: DataFrame, columns: list[str | Column], *totals: Column) -> DataFrame:
    """Orders reduced to customer ids, with columns of the customer, in tasks that grow with the orders."""
    tasks = tasks_for(orders)
    per_customer = totals_per(t, orders, ("orders", "customer_id"), ["customer_id"], tasks, *totals)
    return per_customer.join(dealt(t["customers"].select("customer_id", *columns), tasks, "customer_id"), "customer_id")


def order_flags(t: Tables, tasks: int | None = None) -> DataFrame:
    """One row per order: canceled and late flags, and what its reviews add up to."""
    orders = t["orders"].select(
        "order_id",
        F.coalesce(F.col("order_status") == CANCELED, F.lit(False)).cast("int").alias("canceled"),
        F.coalesce(is_late(), F.lit(False)).cast("int").alias("late"),
    )
    return dealt(orders, tasks, "order_id").join(reviews_per_order(t, tasks), "order_id", "left")


def line_totals(
    t: Tables, lines: DataFrame, by: str, orders_of: Callable[[Tables, int | None], DataFrame], how: str
) -> DataFrame:
    """Totals per `by` over lines (order_id, order_item_id, price, `by`).

    One shuffle on the order brings lines, orders and reviews together; grouping by order
    there needs no other. The number of its tasks grows with all that meets in them: orders and their
    reviews are held there whether or not they have lines. A hot order is spread over salts, and being counted once per salt,
    is counted again as a distinct id; there are at most as many as the hot-key list holds.
    """
    hot = t.hot("order_items", "order_id")
    tasks = tasks_for(lines, orders_of(t, None))
    orders = orders_of(t, tasks)
    joined = spread_join(lines, orders, "order_id", hot, ["order_item_id", by], how, tasks)
    keys = ["order_id", *([SALT] if hot else []), by]
    flags = [c for c in ("canceled", "late") if c in orders.columns]
    per_order = joined.groupBy(*keys).agg(
        F.sum("price").alias("price_sum"),
        F.count("price").alias("prices"),
        F.count("*").alias("lines"),
        *(F.max(c).alias(c) for c in ("reviews", "score_sum", "scores", *flags)),
    )
    weight = F.coalesce("reviews", F.lit(1))
    orders_counted: Column = F.count("order_id")
    if hot.splits is not None:
        split_orders = hot.splits.select("order_id", F.lit(True).alias("split"))
        per_order = per_order.join(F.broadcast(split_orders), "order_id", "left")
        orders_counted = F.count(F.when(F.col("split").isNull(), F.col("order_id"))) + (
            F.count_distinct(F.when(F.col("split"), F.col("order_id")))
        )
    return per_order.groupBy(by).agg(
        orders_counted.alias("total_orders"),
        F.sum(F.col("price_sum") * weight).alias("total_revenue"),
        F.sum(F.col("prices") * weight).alias("priced_lines"),
        F.sum(F.col("score_sum") * F.col("lines")).alias("score_sum"),
        F.sum(F.col("scores") * F.col("lines")).alias("scores"),
        *(F.sum(F.col(c) * F.col("lines") * weight).alias(c) for c in flags),
    )

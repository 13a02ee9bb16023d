"""Revenue over time, by category and by state."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.functions.columns import (
    DELIVERED,
    category_name,
    money_mean,
    money_percent,
    month_label,
    month_number,
    percent,
)
from tradeloom.operators.rollup import payments_per_order, with_customer
from tradeloom.operators.sizing import dealt, tasks_for
from tradeloom.sources.files import ORDER_MONTH
from tradeloom.tables import Tables

PARETO_LIMIT = 80


def paid_orders(t: Tables, *columns: str, where: Column | None = None) -> DataFrame:
    """Delivered orders with a payment: `paid` in total over `payments` valued rows.

    Payments are reduced to one row per order before the join, so counting orders is
    counting rows and no report needs a distinct count.
    """
    if where is None:
        paid = t.shared("paid_orders", lambda t: _paid_orders(t, *_PAID_COLUMNS))
        return paid.select("order_id", *columns, "paid", "payments")
    return _paid_orders(t, *columns, where=where)


_PAID_COLUMNS = ("customer_id", "order_purchase_timestamp")


def _paid_orders(t: Tables, *columns: str, where: Column | None = None) -> DataFrame:
    wanted = F.col("order_status") == DELIVERED
    if where is not None:
        wanted = wanted & where
    delivered = t["orders"].where(wanted).select("order_id", *columns)
    tasks = tasks_for(delivered.join(t["order_payments"].select("order_id"), "order_id"))
    payments = payments_per_order(
        t, tasks, F.sum("payment_value").alias("paid"), F.count("payment_value").alias("payments")
    )
    return dealt(delivered, tasks, "order_id").join(payments, "order_id")


def monthly_revenue_mom(t: Tables) -> DataFrame:
    """Growth against the previous month that has orders, which may not be the calendar one."""
    monthly = (
        paid_orders(t, "order_purchase_timestamp")
        .groupBy(month_number(F.col("order_purchase_timestamp")).alias("month_no"))
        .agg(F.sum("paid").alias("revenue"), F.count("*").alias("orders"))
    )
    previous = F.lag("revenue").over(Window.orderBy("month_no"))
    growth = F.col("revenue") - F.col("prev_month_revenue")
    return (
        monthly.withColumn("prev_month_revenue", previous)
        .select(
            month_label(F.col("month_no")).alias("month"),
            "revenue",
            "orders",
            "prev_month_revenue",
            money_percent(growth, F.col("prev_month_revenue")).alias("mom_growth_pct"),
        )
        .orderBy("month")
    )


def category_revenue(t: Tables) -> DataFrame:
    """Price total per category, reduced to products and to native names before each join."""
    per_product = t["order_items"].groupBy("product_id").agg(F.sum("price").alias("revenue"))
    per_name = (
        per_product.join(t["products"].select("product_id", "product_category_name"), "product_id")
        .groupBy("product_category_name")
        .agg(F.sum("revenue").alias("revenue"))
    )
    return (
        per_name.join(t["product_category_translation"], "product_category_name", "left")
        .groupBy(category_name().alias("category"))
        .agg(F.sum("revenue").alias("revenue"))
    )


def pareto_segment() -> Column:
    return F.when(F.col("cumulative_pct") <= PARETO_LIMIT, "TOP 80%").otherwise("TAIL 20%")


def category_shares(t: Tables) -> DataFrame:
    """Running share of revenue of every category; the one that crosses the limit is in the tail."""
    by_revenue = Window.orderBy(F.desc("revenue"))
    running = Window.orderBy(F.desc("revenue"), "category").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    cumulative = money_percent(
        F.sum("revenue").over(running), F.sum("revenue").over(Window.partitionBy())
    )
    return (
        category_revenue(t)
        .select(
            F.rank().over(by_revenue).alias("revenue_rank"),
            "category",
            "revenue",
            cumulative.alias("cumulative_pct"),
        )
        .withColumn("pareto_segment", pareto_segment())
        .orderBy("revenue_rank", "category")
    )


def category_pareto(t: Tables, top: int = 30) -> DataFrame:
    """The categories of most revenue."""
    return category_shares(t).limit(top)


def quarterly_revenue(t: Tables) -> DataFrame:
    purchase = F.col("order_purchase_timestamp")
    return (
        paid_orders(t, "order_purchase_timestamp")
        .groupBy(F.year(purchase).alias("year"), F.quarter(purchase).alias("quarter"))
        .agg(
            F.sum("paid").alias("revenue"),
            F.count("*").alias("orders"),
            money_mean(F.sum("paid"), F.count("*")).alias("avg_order_value"),
        )
        .orderBy("year", "quarter")
    )


def state_revenue(t: Tables) -> DataFrame:
    """All states, ranked; orders are reduced to customers before meeting their state."""
    per_customer = with_customer(
        t,
        paid_orders(t, "customer_id"),
        ["customer_state"],
        F.count("*").alias("orders"),
        F.sum("paid").alias("paid"),
        F.sum("payments").alias("payments"),
    )
    return (
        per_customer.groupBy(F.col("customer_state").alias("state"))
        .agg(
            F.sum("orders").alias("orders"),
            F.sum("paid").alias("revenue"),
            money_mean(F.sum("paid"), F.sum("payments")).alias("avg_order_value"),
        )
        .withColumn("revenue_rank", F.dense_rank().over(Window.orderBy(F.desc("revenue"))))
    )


def revenue_by_state(t: Tables, top: int = 10) -> DataFrame:
    return state_revenue(t).orderBy(F.desc("revenue"), "state").limit(top)


def weekend_weekday(t: Tables) -> DataFrame:
    weekend = F.dayofweek("order_purchase_timestamp").isin(1, 7)
    return (
        t["orders"]
        .groupBy(F.when(weekend, "Weekend").otherwise("Weekday").alias("day_type"))
        .agg(F.count("*").alias("order_count"))
        .withColumn(
            "pct",
            percent(F.col("order_count"), F.sum("order_count").over(Window.partitionBy())),
        )
    )


def peak_hours(t: Tables, top: int = 5) -> DataFrame:
    return (
        t["orders"]
        .groupBy(F.hour("order_purchase_timestamp").alias("hour_of_day"))
        .agg(F.count("*").alias("order_count"))
        .orderBy(F.desc("order_count"), "hour_of_day")
        .limit(top)
    )


def key_total_revenue(t: Tables) -> DataFrame:
    return t["order_payments"].agg(F.sum("payment_value").alias("total_revenue"))


def key_top3_categories(t: Tables) -> DataFrame:
    return category_revenue(t).orderBy(F.desc("revenue"), "category").limit(3)


def monthly_revenue_report(t: Tables, start_month: str, end_month: str) -> DataFrame:
    """Months 'YYYY-MM', both included.

    The bounds become a timestamp range, which reaches the scan; a comparison of formatted
    text would not. Customers are counted from (month, customer) groups, so that the query
    carries no distinct aggregate.
    """
    first, end = _month_start(start_month), _month_start(end_month, following=1)
    purchase = F.col("order_purchase_timestamp")
    in_range = (purchase >= F.lit(first).cast("timestamp_ntz")) & (
        purchase < F.lit(end).cast("timestamp_ntz")
    )
    if ORDER_MONTH in t["orders"].columns:  # a folder per month: read only those
        in_range = in_range & F.col(ORDER_MONTH).between(start_month, end_month)
    per_customer = (
        paid_orders(t, "order_purchase_timestamp", "customer_id", where=in_range)
        .groupBy(month_number(purchase).alias("month_no"), "customer_id")
        .agg(
            F.count("*").alias("orders"),
            F.sum("paid").alias("paid"),
            F.sum("payments").alias("payments"),
        )
    )
    return (
        per_customer.groupBy("month_no")
        .agg(
            F.sum("orders").alias("total_orders"),
            F.sum("paid").alias("total_revenue"),
            money_mean(F.sum("paid"), F.sum("payments")).alias("avg_order_value"),
            F.count("customer_id").alias("unique_customers"),
        )
        .select(
            month_label(F.col("month_no")).alias("month"),
            "total_orders",
            "total_revenue",
            "avg_order_value",
            "unique_customers",
        )
        .orderBy("month")
    )


def _month_start(text: str, following: int = 0) -> date:
    number = date.fromisoformat(f"{text}-01").year * 12 + int(text[-2:]) - 1 + following
    return date(number // 12, number % 12 + 1, 1)

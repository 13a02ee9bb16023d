"""First look at the data: sizes, ranges, distributions, gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.functions.columns import category_name, count_where, money_mean, percent
from tradeloom.operators.rollup import payments_per_order, totals_per
from tradeloom.operators.sizing import tasks_for
from tradeloom.operators.skew import lookup_join
from tradeloom.tables import Tables

COUNTED_TABLES = (
    "orders",
    "customers",
    "order_items",
    "products",
    "sellers",
    "order_payments",
    "order_reviews",
)


def table_row_counts(t: Tables) -> DataFrame:
    """Stored tables know their rows: no file is read for them."""
    counts = (t.row_count(name).select(F.lit(name).alias("table_name"), "*") for name in COUNTED_TABLES)
    return reduce(DataFrame.unionByName, counts)


def order_date_range(t: Tables) -> DataFrame:
    purchase = F.col("order_purchase_timestamp")
    return (
        t["orders"]
        .agg(F.min(purchase).alias("earliest_order"), F.max(purchase).alias("latest_order"))
        .withColumn("days_of_data", F.date_diff("latest_order", "earliest_order"))
    )


def _distribution(df: DataFrame, key: str, count: str, share: str) -> DataFrame:
    total = F.sum(count).over(Window.partitionBy())
    return (
        df.groupBy(key)
        .agg(F.count("*").alias(count))
        .withColumn(share, percent(F.col(count), total))
    )


def order_status_distribution(t: Tables) -> DataFrame:
    return _distribution(t["orders"], "order_status", "order_count", "pct_of_total").orderBy(
        F.desc("order_count"), "order_status"
    )


def order_null_audit(t: Tables) -> DataFrame:
    return t["orders"].agg(
        count_where(F.col("order_delivered_customer_date").isNull()).alias(
            "missing_delivery_date"
        ),
        count_where(F.col("order_approved_at").isNull()).alias("missing_approval_date"),
        count_where(F.col("order_delivered_carrier_date").isNull()).alias("missing_carrier_date"),
    )


def payment_overview(t: Tables) -> DataFrame:
    """Reduced to one row per order first, so the distinct count needs no second shuffle."""
    paid = F.col("payment_value")
    per_order = payments_per_order(
        t,
        tasks_for(t["order_payments"]),
        F.sum(paid).alias("total"),
        F.count(paid).alias("rows"),
        F.min(paid).alias("least"),
        F.max(paid).alias("most"),
    )
    return per_order.agg(
        F.sum("total").alias("total_revenue"),
        money_mean(F.sum("total"), F.sum("rows")).alias("avg_order_value"),
        F.min("least").alias("min_order_value"),
        F.max("most").alias("max_order_value"),
        F.count("order_id").alias("total_orders"),
    )


def product_categories(t: Tables) -> DataFrame:
    """(product_id, category) with the English name where there is one."""
    return lookup_join(
        t["products"].select("product_id", "product_category_name"),
        t["product_category_translation"],
        "product_category_name",
        lambda: t.hot("products", "product_category_name"),
        ["product_id"],
        "left",
    ).select("product_id", category_name().alias("category"))


def lines_by_category(t: Tables, *columns: str) -> DataFrame:
    """Order lines with their category: a broadcast join, or one with hot products split."""
    return lookup_join(
        t["order_items"].select("product_id", "order_id", "order_item_id", "price", *columns),
        product_categories(t),
        "product_id",
        lambda: t.hot("order_items", "product_id"),
        ["order_id", "order_item_id"],
        sized=True,
    )


def top_categories_by_orders(t: Tables, top: int = 10) -> DataFrame:
    lines, keys = lines_by_category(t), ["category", "order_id"]
    price = F.sum("price").alias("price")
    per_order = totals_per(t, lines, ("order_items", "order_id"), keys, tasks_for(lines), price)
    return (
        per_order.groupBy("category")
        .agg(F.count("order_id").alias("order_count"), F.sum("price").alias("total_revenue"))
        .orderBy(F.desc("order_count"), "category")
        .limit(top)
    )


def payment_type_breakdown(t: Tables) -> DataFrame:
    paid = F.col("payment_value")
    return (
        t["order_payments"]
        .groupBy("payment_type")
        .agg(
            F.count("*").alias("usage_count"),
            money_mean(F.sum(paid), F.count(paid)).alias("avg_value"),
            F.sum(paid).alias("total_value"),
        )
        .orderBy(F.desc("usage_count"), "payment_type")
    )


def review_score_distribution(t: Tables) -> DataFrame:
    return _distribution(t["order_reviews"], "review_score", "review_count", "pct").orderBy(
        F.desc("review_score")
    )

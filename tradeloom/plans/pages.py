"""The data behind each dashboard page, and behind the drill-through of one category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.functions.columns import (
    count_where,
    is_late,
    money_mean,
    month_label,
    month_number,
    percent,
    ratio,
)
from tradeloom.operators.rollup import line_totals, reviews_per_order
from tradeloom.operators.skew import lookup_join
from tradeloom.plans.customers import rfm_segment_summary
from tradeloom.plans.delivery import delivered_orders, late_rate_trend, stage_breakdown, state_delivery
from tradeloom.plans.exploration import product_categories
from tradeloom.plans.revenue import category_shares, monthly_revenue_mom, state_revenue
from tradeloom.plans.sellers import seller_tier, seller_top_bottom
from tradeloom.plans.star import bi_mom_growth, sales
from tradeloom.tables import Tables


def page_executive(t: Tables) -> DataFrame:
    """The four cards, from one pass over the fact rows."""
    per_order = (
        sales(t)
        .groupBy("order_id")
        .agg(
            F.sum("revenue").alias("revenue"),
            F.count("*").alias("lines"),
            F.sum("is_late").alias("late"),
        )
    )
    return per_order.agg(
        F.sum("revenue").alias("total_revenue"),
        F.count("order_id").alias("orders"),
        money_mean(F.sum("revenue"), F.count("order_id")).alias("avg_order_value"),
        ratio(F.sum("late"), F.sum("lines"), 4).alias("late_rate"),
    )


def page_executive_trend(t: Tables) -> DataFrame:
    return bi_mom_growth(t)


def page_revenue(t: Tables) -> DataFrame:
    """Revenue of all states; the trend and the Pareto chart are reports of their own."""
    return state_revenue(t).orderBy(F.desc("revenue"), "state")


def page_revenue_trend(t: Tables) -> DataFrame:
    return monthly_revenue_mom(t)


def page_revenue_pareto(t: Tables) -> DataFrame:
    return category_shares(t)


def page_customers(t: Tables) -> DataFrame:
    return rfm_segment_summary(t).select(
        "customer_segment", "customer_count", "pct_customers", "total_revenue", "pct_revenue"
    )


def page_customers_compare(t: Tables) -> DataFrame:
    return rfm_segment_summary(t).where(F.col("customer_segment").isin("Champions", "At Risk"))


def page_delivery(t: Tables) -> DataFrame:
    return state_delivery(t)


def page_delivery_trend(t: Tables) -> DataFrame:
    return late_rate_trend(t)


def page_delivery_stages(t: Tables) -> DataFrame:
    return stage_breakdown(t)


def page_sellers(t: Tables) -> DataFrame:
    return seller_top_bottom(t)


def page_sellers_scatter(t: Tables) -> DataFrame:
    return seller_tier(t).select(
        "seller_id", "avg_rating", "total_revenue", "total_orders", "performance_tier"
    )


def _category_lines(t: Tables, category: str) -> DataFrame:
    products = product_categories(t).where(F.col("category") == category)
    return lookup_join(
        t["order_items"].select("product_id", "order_id", "order_item_id", "seller_id", "price"),
        products,
        "product_id",
        lambda: t.hot("order_items", "product_id"),
        ["order_id", "order_item_id"],
    )


def category_trend(t: Tables, category: str) -> DataFrame:
    orders = t["orders"].select(
        "order_id", month_number(F.col("order_purchase_timestamp")).alias("month_no")
    )
    per_order = (
        _category_lines(t, category).groupBy("order_id").agg(F.sum("price").alias("revenue"))
    )
    return (
        per_order.join(orders, "order_id")
        .groupBy("month_no")
        .agg(F.sum("revenue").alias("revenue"), F.count("*").alias("orders"))
        .select(month_label(F.col("month_no")).alias("month"), "revenue", "orders")
        .orderBy("month")
    )


def category_sellers(t: Tables, category: str, top: int = 10) -> DataFrame:
    per_order = (
        _category_lines(t, category)
        .groupBy("seller_id", "order_id")
        .agg(F.sum("price").alias("revenue"))
    )
    return (
        per_order.groupBy("seller_id")
        .agg(F.sum("revenue").alias("revenue"), F.count("order_id").alias("orders"))
        .orderBy(F.desc("revenue"), "seller_id")
        .limit(top)
    )


def category_rating(t: Tables, category: str) -> DataFrame:
    """Mean score as in the category report: a review counts once per line of its order."""
    lines = _category_lines(t, category)
    totals = line_totals(t, lines, "category", reviews_per_order, "left")
    return totals.select(
        "category",
        "total_orders",
        ratio(F.col("score_sum"), F.col("scores")).alias("avg_rating"),
    )


def category_delivery(t: Tables, category: str) -> DataFrame:
    """Delivery of the orders that hold a line of the category, each order once."""
    ordered = _category_lines(t, category).select("order_id").distinct()
    days = F.date_diff("order_delivered_customer_date", "order_purchase_timestamp")
    late = count_where(is_late())
    return (
        delivered_orders(t)
        .join(ordered, "order_id", "left_semi")
        .agg(
            F.count("*").alias("orders"),
            ratio(F.sum(days), F.count(days), 1).alias("avg_delivery_days"),
            late.alias("late_orders"),
            percent(late, F.count("*")).alias("late_rate_pct"),
        )
    )


def category_drill(t: Tables, category: str) -> dict[str, DataFrame]:
    return {
        "trend": category_trend(t, category),
        "sellers": category_sellers(t, category),
        "rating": category_rating(t, category),
        "delivery": category_delivery(t, category),
    }

"""Delivery times against promises, over delivered orders with a delivery time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.functions.columns import (
    DELIVERED,
    count_where,
    is_late,
    month_label,
    month_number,
    percent,
    ratio,
)
from tradeloom.operators.rollup import reviews_per_order, with_customer
from tradeloom.operators.sizing import dealt, tasks_for
from tradeloom.tables import Tables

_PURCHASE = "order_purchase_timestamp"
_APPROVED = "order_approved_at"
_CARRIER = "order_delivered_carrier_date"
_ARRIVED = "order_delivered_customer_date"
_ESTIMATE = "order_estimated_delivery_date"


def delivered_orders(t: Tables) -> DataFrame:
    return t["orders"].where((F.col("order_status") == DELIVERED) & F.col(_ARRIVED).isNotNull())


def _mean_days(end: str, start: str) -> Column:
    days = F.date_diff(end, start)
    return ratio(F.sum(days), F.count(days), 1)


def delivery_overall(t: Tables) -> DataFrame:
    late = count_where(is_late())
    return delivered_orders(t).agg(
        F.count("*").alias("total_delivered"),
        _mean_days(_ARRIVED, _PURCHASE).alias("avg_delivery_days"),
        _mean_days(_ESTIMATE, _ARRIVED).alias("avg_days_vs_estimate"),
        late.alias("late_orders"),
        percent(late, F.count("*")).alias("late_order_pct"),
    )


def key_delivery(t: Tables) -> DataFrame:
    return delivery_overall(t).select("avg_delivery_days", "late_order_pct")


def delivery_segments(t: Tables) -> DataFrame:
    """Late is decided to the second but graded by calendar days, so hours late is 0 days."""
    days_late = F.date_diff(_ARRIVED, _ESTIMATE)
    grade = (
        F.when(F.col(_ARRIVED) <= F.col(_ESTIMATE), "On Time")
        .when(days_late <= 3, "Slightly Late (1-3d)")
        .when(days_late <= 7, "Late (4-7d)")
        .otherwise("Very Late (7d+)")
    )
    count = F.col("order_count")
    return (
        delivered_orders(t)
        .groupBy(grade.alias("delivery_segment"))
        .agg(
            F.count("*").alias("order_count"),
            _mean_days(_ARRIVED, _PURCHASE).alias("avg_actual_days"),
        )
        .select(
            "delivery_segment",
            "order_count",
            percent(count, F.sum(count).over(Window.partitionBy())).alias("pct"),
            "avg_actual_days",
        )
        .orderBy(F.desc("order_count"), "delivery_segment")
    )


def state_delivery(t: Tables) -> DataFrame:
    """All states, ranked by the unrounded mean; orders meet their state as customer totals."""
    days = F.date_diff(_ARRIVED, _PURCHASE)
    per_customer = with_customer(
        t,
        delivered_orders(t),
        ["customer_state"],
        F.count("*").alias("orders"),
        F.sum(days).alias("days"),
        F.count(days).alias("timed"),
        count_where(is_late()).alias("late"),
    )
    mean = F.try_divide(F.col("days").cast("double"), F.col("timed").cast("double"))
    return (
        per_customer.groupBy(F.col("customer_state").alias("state"))
        .agg(*(F.sum(c).alias(c) for c in ("orders", "days", "timed", "late")))
        .select(
            "state",
            "orders",
            ratio(F.col("days"), F.col("timed"), 1).alias("avg_delivery_days"),
            F.col("late").alias("late_orders"),
            percent(F.col("late"), F.col("orders")).alias("late_rate_pct"),
            F.rank().over(Window.orderBy(mean.desc())).alias("worst_delivery_rank"),
        )
    )


def delivery_by_state(t: Tables, top: int = 15) -> DataFrame:
    return (
        state_delivery(t)
        .orderBy(F.desc("avg_delivery_days"), "worst_delivery_rank", "state")
        .limit(top)
    )


def stage_breakdown(t: Tables) -> DataFrame:
    return (
        delivered_orders(t)
        .where(F.col(_APPROVED).isNotNull() & F.col(_CARRIER).isNotNull())
        .agg(
            _mean_days(_APPROVED, _PURCHASE).alias("avg_approval_days"),
            _mean_days(_CARRIER, _APPROVED).alias("avg_warehouse_days"),
            _mean_days(_ARRIVED, _CARRIER).alias("avg_shipping_days"),
            _mean_days(_ARRIVED, _PURCHASE).alias("avg_total_days"),
        )
    )


def late_vs_review(t: Tables) -> DataFrame:
    """Mean score of late and of on-time orders; `order_count` counts reviews."""
    status = F.when(is_late(), "Late").otherwise("On Time").alias("delivery_status")
    orders = delivered_orders(t).select("order_id", status)
    tasks = tasks_for(orders)
    return (
        dealt(orders, tasks, "order_id")
        .join(reviews_per_order(t, tasks), "order_id")
        .groupBy("delivery_status")
        .agg(
            ratio(F.sum("score_sum"), F.sum("scores")).alias("avg_review_score"),
            F.sum("reviews").alias("order_count"),
        )
    )


def late_rate_trend(t: Tables) -> DataFrame:
    late = count_where(is_late())
    return (
        delivered_orders(t)
        .groupBy(month_number(F.col(_PURCHASE)).alias("month_no"))
        .agg(
            F.count("*").alias("orders"),
            late.alias("late_orders"),
            percent(late, F.count("*")).alias("late_rate_pct"),
        )
        .select(month_label(F.col("month_no")).alias("month"), "orders", "late_orders", "late_rate_pct")
        .orderBy("month")
    )

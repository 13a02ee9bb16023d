"""Recency / frequency / monetary scores and segments, per person."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.functions.columns import money_mean, money_percent, percent, ratio
from tradeloom.operators.ordering import Order, global_ntile
from tradeloom.operators.prefix import ranked
from tradeloom.operators.rollup import with_customer
from tradeloom.plans.revenue import paid_orders, pareto_segment
from tradeloom.tables import Tables

TILES = 5
SCORES = {
    "r_score": Order("recency_days", "customer_id", descending=True),
    "f_score": Order("frequency", "customer_id"),
    "m_score": Order("monetary", "customer_id"),
}

# Segment names with the lowest and highest scores they accept, first match wins.
SEGMENTS = (
    ("Champions", {"r_score": (4, 5), "f_score": (4, 5), "m_score": (4, 5)}),
    ("Loyal Customers", {"r_score": (3, 5), "f_score": (3, 5), "m_score": (3, 5)}),
    ("New Customers", {"r_score": (4, 5), "f_score": (1, 2)}),
    ("Potential Loyalists", {"r_score": (3, 5), "f_score": (2, 5), "m_score": (2, 5)}),
    ("At Risk", {"r_score": (1, 2), "f_score": (4, 5), "m_score": (4, 5)}),
    ("Cant Lose Them", {"r_score": (1, 2), "f_score": (3, 5)}),
    ("Lost", {"r_score": (1, 2), "f_score": (1, 2), "m_score": (1, 2)}),
)
OTHER_SEGMENT = "Needs Attention"
CHAMPION = SEGMENTS[0][0]


def rfm_base(t: Tables) -> DataFrame:
    """One row per person with a delivered and paid order.

    Recency counts from the latest order of all, whatever its status. Orders are reduced to
    customer ids first: a customer with many orders is one row when it meets its person.
    """
    purchase = F.col("order_purchase_timestamp")
    latest = t["orders"].agg(F.max(purchase)).scalar()
    per_customer = with_customer(
        t,
        paid_orders(t, "customer_id", "order_purchase_timestamp"),
        ["customer_unique_id"],
        F.max(purchase).alias("last_order"),
        F.count("*").alias("orders"),
        F.sum("paid").alias("paid"),
    )
    return (
        per_customer.groupBy(F.col("customer_unique_id").alias("customer_id"))
        .agg(
            F.date_diff(latest, F.max("last_order")).alias("recency_days"),
            F.sum("orders").alias("frequency"),
            F.sum("paid").alias("monetary"),
        )
    )


def rfm_scores(t: Tables) -> DataFrame:
    """Three quintile scores; 5 is best. Ties are broken by person id.

    The scores come from exact tile edges, at every size, with no task that sees all people.
    """
    return t.once("rfm_base", lambda t: global_ntile(t.shared("rfm_base", rfm_base, always=True), TILES, SCORES))


def _accepts(bounds: dict[str, tuple[int, int]]) -> Column:
    return reduce(and_, (F.col(score).between(*limits) for score, limits in bounds.items()))


def segment() -> Column:
    named: Column | None = None
    for name, bounds in SEGMENTS:
        step = _accepts(bounds)
        named = F.when(step, name) if named is None else named.when(step, name)
    return named.otherwise(OTHER_SEGMENT)


def rfm_code() -> Column:
    return F.concat(*(F.col(score).cast("string") for score in SCORES))


def rfm_segments(t: Tables) -> DataFrame:
    return rfm_scores(t).select(
        "*",
        rfm_code().alias("rfm_score"),
        sum((F.col(score) for score in SCORES), F.lit(0)).alias("total_score"),
        segment().alias("customer_segment"),
    )


def rfm_segment_summary(t: Tables) -> DataFrame:
    everyone = Window.partitionBy()
    people, revenue = F.col("customer_count"), F.col("total_revenue")
    return (
        rfm_segments(t)
        .groupBy("customer_segment")
        .agg(
            F.count("*").alias("customer_count"),
            F.sum("monetary").alias("total_revenue"),
            F.count("monetary").alias("paying"),
            F.sum("recency_days").alias("recency"),
            F.count("recency_days").alias("dated"),
            F.sum("frequency").alias("orders"),
        )
        .select(
            "customer_segment",
            "customer_count",
            percent(people, F.sum(people).over(everyone)).alias("pct_customers"),
            money_mean(revenue, F.col("paying")).alias("avg_revenue"),
            "total_revenue",
            money_percent(revenue, F.sum(revenue).over(everyone)).alias("pct_revenue"),
            ratio(F.col("recency"), F.col("dated"), 0).alias("avg_recency_days"),
            ratio(F.col("orders"), people).alias("avg_frequency"),
        )
        .orderBy(F.desc("total_revenue"), "customer_segment")
    )


def champions(t: Tables) -> DataFrame:
    return rfm_scores(t).where(_accepts(SEGMENTS[0][1]))


def top_champions(t: Tables, top: int = 20) -> DataFrame:
    """Limited first, so the numbering window sees only the rows it numbers."""
    best = (
        champions(t)
        .select("customer_id", "recency_days", "frequency", "monetary", rfm_code().alias("rfm_score"))
        .orderBy(F.desc("monetary"), "customer_id")
        .limit(top)
    )
    by_value = Window.orderBy(F.desc("monetary"), "customer_id")
    return best.withColumn("value_rank", F.row_number().over(by_value)).orderBy("value_rank")


def key_champion_count(t: Tables) -> DataFrame:
    return champions(t).agg(F.count("*").alias("champions"))


def customer_segment_report(t: Tables, segment_name: str) -> DataFrame:
    """People of one segment, scored among all people."""
    return (
        rfm_segments(t)
        .where(F.col("customer_segment") == segment_name)
        .drop("r_score", "f_score", "m_score", "total_score")
        .orderBy(F.desc("monetary"), "customer_id")
    )


def customer_pareto(t: Tables) -> DataFrame:
    """Every person's place by revenue and running share of it; who crosses the limit is in the tail.

    As `category_shares`, at a grain that has no bound: ranges of people are numbered and summed
    apart and shifted by what comes before them.
    """
    people = t.shared("rfm_base", rfm_base, always=True)
    placed = ranked(people, Order("monetary", "customer_id", descending=True), "monetary")
    return placed.select(
        "customer_id",
        "monetary",
        F.col("row_number").alias("place"),
        F.col("rank").alias("revenue_rank"),
        F.col("dense_rank").alias("revenue_level"),
        F.col("running_sum").alias("running_revenue"),
        money_percent(F.col("running_sum"), F.col("total_sum")).alias("cumulative_pct"),
    ).withColumn("pareto_segment", pareto_segment())

"""Every report by name, with the arguments its sample call uses."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeloom.plans import (
    cohorts,
    cube,
    customers,
    delivery,
    exploration,
    pages,
    revenue,
    sellers,
    star,
)
from tradeloom.tables import Tables

Report = Callable[[Tables], DataFrame]

# Arguments of the sample calls; the months lie inside the dates of the test data.
CALL_MONTHS = ("1997-01", "1997-12")
CALL_TOP = 10
CALL_SEGMENT = "Champions"
CALL_ALERT = (3.5, 10, 5)
CALL_CATEGORY = "cat_5"

# The files a full run writes: prefix -> reports in order.
REPORT_FILES: dict[str, tuple[Report, ...]] = {
    "02_exploration": (
        exploration.table_row_counts,
        exploration.order_date_range,
        exploration.order_status_distribution,
        exploration.order_null_audit,
        exploration.payment_overview,
        exploration.top_categories_by_orders,
        exploration.payment_type_breakdown,
        exploration.review_score_distribution,
    ),
    "03_revenue": (
        revenue.monthly_revenue_mom,
        revenue.category_pareto,
        revenue.quarterly_revenue,
        revenue.revenue_by_state,
        revenue.weekend_weekday,
        revenue.peak_hours,
    ),
    "04_rfm_segments": (customers.rfm_segment_summary, customers.top_champions),
    "05_delivery": (
        delivery.delivery_overall,
        delivery.delivery_segments,
        delivery.delivery_by_state,
        delivery.stage_breakdown,
        delivery.late_vs_review,
    ),
    "06_sellers": (
        sellers.seller_scorecard,
        sellers.seller_tier_summary,
        sellers.seller_top_bottom,
    ),
    "07_cohort": (cohorts.cohort_retention, cohorts.avg_retention_by_month),
}

SHARED: tuple[Report, ...] = (
    customers.rfm_base,
    customers.rfm_scores,
    customers.rfm_segments,
    customers.customer_pareto,
    cohorts.first_purchase,
    cohorts.cohort_activity,
    cohorts.cohort_size,
    revenue.category_shares,
    sellers.seller_metrics,
    sellers.seller_tier,
)

KEY_ANSWERS: tuple[Report, ...] = (
    revenue.key_total_revenue,
    revenue.key_top3_categories,
    customers.key_champion_count,
    delivery.key_delivery,
)

RUN: dict[str, tuple[Report, ...]] = REPORT_FILES | {"key_answers": KEY_ANSWERS}

# What the reports of a run share: frame -> its readers, other shared frames included. A frame
# with several readers is computed once and goes after the last one.
READERS: dict[str, tuple[str, ...]] = {
    "paid_orders": ("monthly_revenue_mom", "quarterly_revenue", "revenue_by_state", "rfm_base"),
    "rfm_base": ("rfm_segment_summary", "top_champions", "key_champion_count"),
    "seller_metrics": ("seller_scorecard", "seller_tier_summary", "seller_top_bottom"),
}

CALLS: dict[str, Report] = {
    "monthly_revenue_report": lambda t: revenue.monthly_revenue_report(t, *CALL_MONTHS),
    "category_performance": lambda t: sellers.category_performance(t, CALL_TOP),
    "customer_segment_report": lambda t: customers.customer_segment_report(t, CALL_SEGMENT),
    "flag_underperforming_sellers": lambda t: sellers.flag_underperforming_sellers(t, *CALL_ALERT),
}


def procedure_calls(t: Tables) -> DataFrame:
    """The sample calls, and how many rows each returns."""
    counts = (
        call(t).agg(F.count("*").alias("row_count")).select(F.lit(name).alias("call"), "*")
        for name, call in CALLS.items()
    )
    return reduce(DataFrame.unionByName, counts)


STAR: tuple[Report, ...] = (
    star.dim_customer,
    star.dim_product,
    star.dim_seller,
    star.dim_date,
    star.bi_total_revenue,
    star.bi_mom_growth,
    star.bi_mom_growth_by_state,
    star.bi_ytd_revenue,
    star.bi_ytd_revenue_by_category,
    star.bi_avg_order_value,
    star.bi_retention_rate,
    star.bi_late_rate,
)

PAGES: tuple[Report, ...] = (
    pages.page_executive,
    pages.page_executive_trend,
    pages.page_revenue,
    pages.page_revenue_trend,
    pages.page_revenue_pareto,
    pages.page_customers,
    pages.page_customers_compare,
    pages.page_delivery,
    pages.page_delivery_trend,
    pages.page_delivery_stages,
    pages.page_sellers,
    pages.page_sellers_scatter,
)

DRILL: dict[str, Report] = {
    "category_drill": lambda t: pages.category_trend(t, CALL_CATEGORY),
    "category_drill_sellers": lambda t: pages.category_sellers(t, CALL_CATEGORY),
    "category_drill_rating": lambda t: pages.category_rating(t, CALL_CATEGORY),
    "category_drill_delivery": lambda t: pages.category_delivery(t, CALL_CATEGORY),
    "bi_measures": lambda t: cube.bi_measures(t, CALL_CATEGORY),
}

# The operators behind the scores and ranks, under their own names.
DISTRIBUTED: dict[str, Report] = {
    "global_ntile": customers.rfm_scores,
    "global_dense_rank": sellers.seller_scorecard,
}


def reports() -> dict[str, Report]:
    filed = [r for group in REPORT_FILES.values() for r in group]
    named = {r.__name__: r for r in [*filed, *SHARED, *KEY_ANSWERS, *STAR, *PAGES, procedure_calls]}
    return named | CALLS | DRILL | {"star_schema": star.fact_sales} | DISTRIBUTED


def plain_types(df: DataFrame) -> DataFrame:
    """Counts as bigint and decimals as double, the types other SQL engines report."""

    def widened(field: T.StructField):
        if isinstance(field.dataType, T.DecimalType):
            return F.col(field.name).cast("double").alias(field.name)
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            return F.col(field.name).cast("bigint").alias(field.name)
        return F.col(field.name)

    return df.select(*(widened(f) for f in df.schema))

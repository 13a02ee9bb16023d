"""Hand-made cases for the rules that are easy to get wrong."""

from __future__ import annotations

import pytest

from tests.conftest import SMALL, as_set, rows
from tests.test_skew import plan
from tradeloom.plans import (
    catalog,
    cohorts,
    customers,
    delivery,
    exploration,
    pages,
    revenue,
    sellers,
    star,
)
from tradeloom.sources import files, orderlines


def test_growth_is_against_the_previous_row_but_bi_growth_against_the_calendar(shop):
    shop.product("x", "toys")
    for order, bought, price in (("a", "2016-10-03", "100.00"), ("b", "2016-12-09", "50.00")):
        shop.order(order, f"{bought} 09:00:00", paid=(price,), items=(("x", "s", price),))
    t = shop.tables()
    monthly = rows(revenue.monthly_revenue_mom(t))
    assert [m["month"] for m in monthly] == ["2016-10", "2016-12"]
    assert [m["prev_month_revenue"] for m in monthly] == [None, 100.0]
    assert [m["mom_growth_pct"] for m in monthly] == [None, -50.0]
    by_calendar = {m["month"]: m["mom_growth"] for m in rows(star.bi_mom_growth(t))}
    assert by_calendar == {"2016-10": 0.0, "2016-11": -1.0, "2016-12": 0.0}
    ytd = [m["ytd_revenue"] for m in rows(star.bi_ytd_revenue(t))]
    assert ytd == [100.0, 100.0, 150.0]


def test_growth_after_a_month_of_zero_revenue_is_null(shop):
    shop.order("a", "2020-01-01 00:00:00", paid=("0.00",))
    shop.order("b", "2020-02-01 00:00:00", paid=("5.00",))
    assert [m["mom_growth_pct"] for m in rows(revenue.monthly_revenue_mom(shop.tables()))] == [None, None]


def test_orders_without_payment_are_not_in_revenue_but_are_in_cohorts(shop):
    shop.order("a", "2020-01-01 00:00:00", person="p1")
    shop.order("b", "2020-02-01 00:00:00", person="p2", paid=("1.00", "2.00"))
    t = shop.tables()
    assert [m["month"] for m in rows(revenue.monthly_revenue_mom(t))] == ["2020-02"]
    assert [c["cohort_month"] for c in rows(cohorts.cohort_retention(t))] == ["2020-01", "2020-02"]
    overview = rows(exploration.payment_overview(t))[0]
    assert (overview["avg_order_value"], overview["total_orders"]) == (1.5, 1)


def test_late_by_hours_is_slightly_late(shop):
    shop.order("on", arrived="2020-01-10 00:00:00", due="2020-01-10 00:00:00")
    shop.order("hours", arrived="2020-01-10 18:00:00", due="2020-01-10 00:00:00")
    shop.order("four", arrived="2020-01-14 00:00:00", due="2020-01-10 00:00:00")
    shop.order("eight", arrived="2020-01-18 00:00:00", due="2020-01-10 00:00:00")
    shop.order("unknown", arrived="2020-01-18 00:00:00", due=None)
    t = shop.tables()
    found = {r["delivery_segment"]: r["order_count"] for r in rows(delivery.delivery_segments(t))}
    assert found == {
        "On Time": 1,
        "Slightly Late (1-3d)": 1,
        "Late (4-7d)": 1,
        "Very Late (7d+)": 2,
    }
    overall = rows(delivery.delivery_overall(t))[0]
    assert (overall["total_delivered"], overall["late_orders"]) == (5, 3)


def test_reviews_repeat_the_lines_of_their_order(shop):
    shop.product("x", "toys")
    shop.order("a", items=(("x", "s", "10.00"),), scores=(5, 2))
    t = shop.tables()
    seller = rows(sellers.seller_metrics(t))[0]
    assert (seller["total_orders"], seller["total_revenue"]) == (1, 20.0)
    assert (seller["avg_order_value"], seller["avg_rating"]) == (10.0, 3.5)
    category = rows(sellers.category_performance(t, 5))[0]
    assert (category["total_orders"], category["total_revenue"]) == (1, 20.0)
    assert rows(revenue.key_top3_categories(t))[0]["revenue"] == 10.0


def test_cancellation_counts_lines_and_can_exceed_100(shop):
    shop.order("a", status="canceled", items=tuple(("x", "s", "1.00") for _ in range(3)))
    seller = rows(sellers.seller_tier(shop.tables()))[0]
    assert seller["cancellation_rate"] == 300.0
    assert seller["performance_tier"] == "Underperformer"


def test_tiers_and_null_ratings(shop):
    for seller, price, scores in (
        ("unrated", "30.00", ()),
        ("top", "60000.00", (5, 4)),
        ("good", "25000.00", (4, 3)),
        ("bad", "10.00", (1,)),
    ):
        shop.add("sellers", seller_id=seller, seller_state="AA")
        halves = (("x", seller, price),)
        shop.order(f"o_{seller}", items=halves, scores=scores)
    found = {r["seller_id"]: r for r in rows(sellers.seller_scorecard(shop.tables()))}
    tiers = {s: r["performance_tier"] for s, r in found.items()}
    assert tiers == {
        "unrated": "Average",
        "top": "Top Performer",
        "good": "Good Performer",
        "bad": "Underperformer",
    }
    assert {s: r["rating_rank"] for s, r in found.items()} == {
        "top": 1,
        "good": 2,
        "bad": 3,
        "unrated": 4,
    }
    flagged = rows(sellers.flag_underperforming_sellers(shop.tables(), 3.5, 10, 1))
    assert [r["seller_id"] for r in flagged] == ["bad"]


def test_a_seller_in_both_groups_is_in_the_top(shop):
    for i in range(12):
        for n in range(10):
            shop.order(f"o{i}_{n}", items=(("x", f"s{i:02d}", f"{i + 1}.00"),))
    found = rows(sellers.seller_top_bottom(shop.tables()))
    groups = {r["seller_id"]: r["seller_group"] for r in found}
    assert len(found) == 12
    assert sorted(s for s, g in groups.items() if g == "Bottom 10") == ["s00", "s01"]


def test_category_that_crosses_80_percent_is_tail(shop):
    for name, price in (("a", "70.00"), ("b", "15.00"), ("c", "15.00")):
        shop.product(name, None if name == "c" else name)
        shop.order(name, items=((name, "s", price),))
    shop.add(
        "product_category_translation",
        product_category_name="a",
        product_category_name_english="apples",
    )
    found = rows(revenue.category_pareto(shop.tables()))
    assert [r["category"] for r in found] == ["apples", "Unknown", "b"]
    assert [r["revenue_rank"] for r in found] == [1, 2, 2]
    assert [r["cumulative_pct"] for r in found] == [70.0, 85.0, 100.0]
    assert [r["pareto_segment"] for r in found] == ["TOP 80%", "TAIL 20%", "TAIL 20%"]


def test_recency_is_from_the_latest_order_of_any_status(shop):
    shop.order("a", "2020-01-01 23:00:00", paid=("10.00",))
    shop.order("b", "2020-01-03 01:00:00", status="canceled")
    assert rows(customers.rfm_base(shop.tables()))[0]["recency_days"] == 2


@pytest.mark.parametrize(
    "scores, name",
    [
        ((4, 4, 4), "Champions"),
        ((5, 3, 5), "Loyal Customers"),
        ((4, 2, 5), "New Customers"),
        ((3, 2, 2), "Potential Loyalists"),
        ((2, 4, 4), "At Risk"),
        ((1, 3, 5), "Cant Lose Them"),
        ((2, 2, 2), "Lost"),
        ((2, 2, 3), "Needs Attention"),
        ((3, 2, 1), "Needs Attention"),
        ((3, 3, 2), "Potential Loyalists"),
    ],
)
def test_segments(spark, scores, name):
    df = spark.createDataFrame([scores], "r_score int, f_score int, m_score int")
    row = df.select(customers.segment().alias("s"), customers.rfm_code().alias("c")).first()
    assert (row.s, row.c) == (name, "".join(map(str, scores)))


def test_months_of_cohorts_over_word_borders_and_many_years(shop, spark):
    """Months on both sides of a bitmap word, people without a name, and a date far off."""
    bought = {"p1": ["2000-01", "2004-12", "2005-01", "2005-02"], "p2": ["2004-11", "2005-05"], None: ["2003-03", "2003-03", "2012-07"]}
    for person, months in bought.items():
        for i, month in enumerate(months):
            shop.order(f"{person}{i}", f"{month}-05 10:00:00", person=person)
    wanted: set = set()
    for person, months in bought.items():
        first = min(months)
        index = lambda m: 12 * (int(m[:4]) - int(first[:4])) + int(m[5:]) - int(first[5:])
        wanted |= {(person, first, m, index(m)) for m in months}
    shop.order("u1", None, person="p1")
    shop.order("u2", None, person="u")
    wanted |= {("p1", "2000-01", None, None), ("u", None, None, None)}
    near = shop.tables()
    activity = {tuple(r) for r in cohorts.cohort_activity(near).collect()}
    assert activity == wanted and near._facts["order_months"] == (2000 * 12, 2012 * 12 + 6)
    retention = as_set(cohorts.cohort_retention(near))
    shop.order("far", "9999-01-05 10:00:00", person="far", status="canceled")
    wide = shop.tables()
    assert {tuple(r) for r in cohorts.cohort_activity(wide).collect()} == wanted
    assert as_set(cohorts.cohort_retention(wide)) == retention
    assert as_set(cohorts.cohort_size(wide)) == as_set(cohorts.cohort_size(near))


def test_cohorts_shuffle_little(spark, tmp_path):
    t = orderlines.load(spark, SMALL)
    files.save(t, str(tmp_path))
    stored = files.load(spark, str(tmp_path))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for report, most in ((cohorts.cohort_activity, 3), (cohorts.cohort_retention, 4), (cohorts.avg_retention_by_month, 5)):
            text = plan(report(stored))
            hashed = text.count("Exchange hashpartitioning")
            assert hashed <= most and text.count("SortMergeJoin") == 1 and "SortAggregate" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_mean_retention_skips_cohorts_without_a_return(shop):
    for order, month, person in (
        ("a", "2020-01", "p1"),
        ("b", "2020-02", "p1"),
        ("c", "2020-01", "p2"),
        ("d", "2020-01", "p2"),
        ("e", "2020-03", "p3"),
        ("f", "2020-05", "p4"),
        ("g", "2021-01", "p4"),
    ):
        shop.order(order, f"{month}-10 00:00:00", person=person)
    t = shop.tables()
    assert rows(cohorts.avg_retention_by_month(t)) == [{"month_index": 1, "avg_retention_pct": 50.0}]
    activity = {(r["customer_id"], r["month_index"]) for r in rows(cohorts.cohort_activity(t))}
    assert ("p4", 8) in activity and ("p2", 1) not in activity


def test_star_counts_orders_with_lines(shop):
    shop.product("x", "toys")
    shop.order("a", person="p1", items=(("x", "s", "1.00"), ("x", "s", "2.00")))
    shop.order("b", person="p1", items=(("x", "s", "3.00"),), arrived="2020-02-01", due="2020-01-20")
    shop.order("c", person="p2", items=(("x", "s", "4.00"),))
    shop.order("d", person="p2")
    t = shop.tables()
    fact = rows(star.fact_sales(t))
    assert len(fact) == 4
    assert {r["order_id"]: r["order_count"] for r in fact} == {"a": 2, "b": 2, "c": 1}
    assert rows(star.bi_retention_rate(t)) == [{"retention_rate": 0.5}]
    assert rows(star.retention_rate(star.fact_sales(t))) == [{"retention_rate": 0.5}]
    assert rows(star.bi_late_rate(t)) == [{"late_rate": 0.25}]
    assert rows(star.bi_avg_order_value(t)) == [{"avg_order_value": 3.33}]
    assert set(pages.category_drill(t, "toys")) == {"trend", "sellers", "rating", "delivery"}


def test_month_range_is_inclusive_and_checked(shop):
    for i, month in enumerate(("2019-12", "2020-01", "2020-12", "2021-01")):
        shop.order(str(i), f"{month}-01 00:00:00", paid=("1.00",))
    t = shop.tables()
    found = rows(revenue.monthly_revenue_report(t, "2020-01", "2020-12"))
    assert [r["month"] for r in found] == ["2020-01", "2020-12"]
    assert rows(revenue.monthly_revenue_report(t, "2020-12", "2020-01")) == []
    with pytest.raises(ValueError):
        revenue.monthly_revenue_report(t, "2020-13", "2020-14")


def test_totals_agree_across_reports(spark):
    t = orderlines.load(spark, SMALL)
    monthly = rows(revenue.monthly_revenue_mom(t))
    quarterly = rows(revenue.quarterly_revenue(t))
    segments = rows(customers.rfm_segment_summary(t))
    total = round(sum(r["revenue"] for r in monthly), 2)
    assert total == round(sum(r["revenue"] for r in quarterly), 2)
    assert total == round(sum(r["total_revenue"] for r in segments), 2)
    assert sum(r["orders"] for r in monthly) == sum(r["orders"] for r in quarterly)
    counts = {r["table_name"]: r["row_count"] for r in rows(exploration.table_row_counts(t))}
    for report in (exploration.order_status_distribution, revenue.weekend_weekday):
        assert sum(r["order_count"] for r in rows(report(t))) == counts["orders"]
    overview = rows(exploration.payment_overview(t))[0]
    types = rows(exploration.payment_type_breakdown(t))
    assert sum(r["usage_count"] for r in types) == counts["order_payments"]
    assert round(sum(r["total_value"] for r in types), 2) == overview["total_revenue"]
    scores = rows(exploration.review_score_distribution(t))
    assert sum(r["review_count"] for r in scores) == counts["order_reviews"]
    overall = rows(delivery.delivery_overall(t))[0]
    graded = rows(delivery.delivery_segments(t))
    assert sum(r["order_count"] for r in graded) == overall["total_delivered"]
    on_time = sum(r["order_count"] for r in graded if r["delivery_segment"] == "On Time")
    assert overall["total_delivered"] - on_time == overall["late_orders"]
    assert sum(r["seller_count"] for r in rows(sellers.seller_tier_summary(t))) == counts["sellers"]


# The header of every report file, in order.
HEADERS = {
    "02_exploration": [
        "table_name,row_count",
        "earliest_order,latest_order,days_of_data",
        "order_status,order_count,pct_of_total",
        "missing_delivery_date,missing_approval_date,missing_carrier_date",
        "total_revenue,avg_order_value,min_order_value,max_order_value,total_orders",
        "category,order_count,total_revenue",
        "payment_type,usage_count,avg_value,total_value",
        "review_score,review_count,pct",
    ],
    "03_revenue": [
        "month,revenue,orders,prev_month_revenue,mom_growth_pct",
        "revenue_rank,category,revenue,cumulative_pct,pareto_segment",
        "year,quarter,revenue,orders,avg_order_value",
        "state,orders,revenue,avg_order_value,revenue_rank",
        "day_type,order_count,pct",
        "hour_of_day,order_count",
    ],
    "04_rfm_segments": [
        "customer_segment,customer_count,pct_customers,avg_revenue,total_revenue,pct_revenue,"
        "avg_recency_days,avg_frequency",
        "customer_id,recency_days,frequency,monetary,rfm_score,value_rank",
    ],
    "05_delivery": [
        "total_delivered,avg_delivery_days,avg_days_vs_estimate,late_orders,late_order_pct",
        "delivery_segment,order_count,pct,avg_actual_days",
        "state,orders,avg_delivery_days,late_orders,late_rate_pct,worst_delivery_rank",
        "avg_approval_days,avg_warehouse_days,avg_shipping_days,avg_total_days",
        "delivery_status,avg_review_score,order_count",
    ],
    "06_sellers": [
        "seller_id,seller_state,total_orders,total_revenue,avg_order_value,avg_rating,"
        "cancellation_rate,late_deliveries,revenue_rank,rating_rank,reliability_rank,performance_tier",
        "performance_tier,seller_count,avg_cancellation_rate,avg_review_score,total_revenue,pct_revenue",
        "seller_group,seller_id,revenue,orders,avg_rating,cancellation_rate",
    ],
    "07_cohort": [
        "cohort_month,cohort_customers,month_index,active_customers,retention_rate_pct",
        "month_index,avg_retention_pct",
    ],
}


def test_report_headers(shop):
    t = shop.tables()
    found = {p: [",".join(r(t).columns) for r in group] for p, group in catalog.REPORT_FILES.items()}
    assert found == HEADERS

"""Expected results of the report catalogue."""

from __future__ import annotations

from checks.base import days, mean_money, money, month, percent, rounded, statement, whole
from tradeloom.plans import catalog

_PAID = "x_paid AS (SELECT order_id, sum(paid_c) AS paid_c, count(paid_c) AS n FROM x_payments GROUP BY 1)"
_SALES = """x_sales AS (
  SELECT o.*, p.paid_c, p.n FROM x_orders o JOIN x_paid p USING (order_id)
  WHERE order_status = 'delivered')"""
_ARRIVED = """x_arrived AS (
  SELECT *, arrived_at > due_at AS late FROM x_orders
  WHERE order_status = 'delivered' AND arrived_at IS NOT NULL)"""
_CATEGORY = """x_category AS (
  SELECT category, sum(price_c) AS c FROM x_items JOIN x_labels USING (product_id) GROUP BY 1)"""


_PARETO = f"""
SELECT revenue_rank, category, {money("c")} AS revenue, share AS cumulative_pct,
       CASE WHEN share <= 80 THEN 'TOP 80%' ELSE 'TAIL 20%' END AS pareto_segment
FROM (SELECT category, c, rank() OVER (ORDER BY c DESC) AS revenue_rank,
             {percent("run", "(SELECT sum(c) FROM x_category)")} AS share
      FROM (SELECT *, sum(c) OVER (ORDER BY c DESC, category ROWS UNBOUNDED PRECEDING) AS run
            FROM x_category))
ORDER BY revenue_rank, category"""
# The segment rules, stated here apart from the engine.
_CHAMPION = "r_score BETWEEN 4 AND 5 AND f_score BETWEEN 4 AND 5 AND m_score BETWEEN 4 AND 5"
_SEGMENT = f"""CASE
  WHEN {_CHAMPION} THEN 'Champions'
  WHEN r_score BETWEEN 3 AND 5 AND f_score BETWEEN 3 AND 5 AND m_score BETWEEN 3 AND 5 THEN 'Loyal Customers'
  WHEN r_score BETWEEN 4 AND 5 AND f_score BETWEEN 1 AND 2 THEN 'New Customers'
  WHEN r_score BETWEEN 3 AND 5 AND f_score BETWEEN 2 AND 5 AND m_score BETWEEN 2 AND 5 THEN 'Potential Loyalists'
  WHEN r_score BETWEEN 1 AND 2 AND f_score BETWEEN 4 AND 5 AND m_score BETWEEN 4 AND 5 THEN 'At Risk'
  WHEN r_score BETWEEN 1 AND 2 AND f_score BETWEEN 3 AND 5 THEN 'Cant Lose Them'
  WHEN r_score BETWEEN 1 AND 2 AND f_score BETWEEN 1 AND 2 AND m_score BETWEEN 1 AND 2 THEN 'Lost'
  ELSE 'Needs Attention' END"""
_RFM = (
    _PAID,
    _SALES,
    f"""x_rfm AS (
  SELECT person AS customer_id, count(*) AS frequency, sum(paid_c) AS c,
         {days("max(bought_at)", "(SELECT max(bought_at) FROM x_orders)")} AS recency_days
  FROM x_sales JOIN x_customers USING (customer_id) GROUP BY 1)""",
    """x_scores AS (
  SELECT *, ntile(5) OVER (ORDER BY recency_days DESC NULLS LAST, customer_id) AS r_score,
         ntile(5) OVER (ORDER BY frequency NULLS FIRST, customer_id) AS f_score,
         ntile(5) OVER (ORDER BY c NULLS FIRST, customer_id) AS m_score
  FROM x_rfm)""",
    f"""x_segments AS (
  SELECT *, r_score::VARCHAR || f_score::VARCHAR || m_score::VARCHAR AS rfm_score,
         r_score + f_score + m_score AS total_score, {_SEGMENT} AS customer_segment
  FROM x_scores)""",
)
# The direct form: reviews joined to lines, one row per (line, review).
_FANNED = """x_fanned AS (
  SELECT i.*, o.order_status, o.arrived_at > o.due_at AS late, r.score
  FROM x_items i JOIN x_orders o USING (order_id) LEFT JOIN x_reviews r USING (order_id))"""
_SELLERS = f"""x_metrics AS (
  SELECT seller_id, count(DISTINCT order_id) AS total_orders, sum(price_c) AS c,
         {mean_money("sum(price_c)", "count(price_c)")} AS avg_order_value,
         {rounded("sum(score)", "count(score)")} AS avg_rating,
         count(*) FILTER (order_status = 'canceled') AS canceled_orders,
         {percent("count(*) FILTER (order_status = 'canceled')", "count(DISTINCT order_id)")}
           AS cancellation_rate,
         count(*) FILTER (late) AS late_deliveries
  FROM x_fanned GROUP BY 1)"""
# The tier rules, stated here apart from the engine.
_TIER = """CASE
  WHEN c / 100.0 > 50000 AND avg_rating >= 4.0 AND cancellation_rate < 5 THEN 'Top Performer'
  WHEN c / 100.0 > 20000 AND avg_rating >= 3.5 THEN 'Good Performer'
  WHEN cancellation_rate > 15 OR avg_rating < 3.0 THEN 'Underperformer'
  ELSE 'Average' END"""
_COHORTS = (
    """x_active AS (
  SELECT DISTINCT person, year(bought_at) * 12 + month(bought_at) - 1 AS m
  FROM x_orders JOIN x_customers USING (customer_id) WHERE order_status = 'delivered')""",
    "x_first AS (SELECT person, min(m) AS m0 FROM x_active GROUP BY 1)",
    "x_size AS (SELECT m0, count(*) AS size FROM x_first GROUP BY 1)",
    """x_back AS (
  SELECT m0, m - m0 AS month_index, count(*) AS active, any_value(size) AS size
  FROM x_active JOIN x_first USING (person) JOIN x_size USING (m0) GROUP BY 1, 2)""",
)


def _label(number: str) -> str:
    return f"lpad(({number} // 12)::VARCHAR, 4, '0') || '-' || lpad(({number} % 12 + 1)::VARCHAR, 2, '0')"


def _exploration() -> dict[str, str]:
    tables = {
        "orders": "x_orders",
        "customers": "x_customers",
        "order_items": "x_items",
        "products": "x_products",
        "sellers": "x_sellers",
        "order_payments": "x_payments",
        "order_reviews": "x_reviews",
    }
    counts = (f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {v}" for n, v in tables.items())
    return {
        "table_row_counts": statement("\nUNION ALL ".join(counts)),
        "order_date_range": statement(f"""
SELECT min(bought_at) AS earliest_order, max(bought_at) AS latest_order,
       {days("min(bought_at)", "max(bought_at)")} AS days_of_data FROM x_orders"""),
        "order_status_distribution": statement(f"""
SELECT order_status, n AS order_count, {percent("n", "(SELECT count(*) FROM x_orders)")} AS pct_of_total
FROM (SELECT order_status, count(*) AS n FROM x_orders GROUP BY 1)"""),
        "order_null_audit": statement("""
SELECT count(*) - count(arrived_at) AS missing_delivery_date,
       count(*) - count(approved_at) AS missing_approval_date,
       count(*) - count(carrier_at) AS missing_carrier_date FROM x_orders"""),
        "payment_overview": statement(f"""
SELECT {money("sum(paid_c)")} AS total_revenue,
       {mean_money("sum(paid_c)", "count(paid_c)")} AS avg_order_value,
       {money("min(paid_c)")} AS min_order_value, {money("max(paid_c)")} AS max_order_value,
       count(DISTINCT order_id) AS total_orders FROM x_payments"""),
        "top_categories_by_orders": statement(f"""
SELECT category, count(DISTINCT order_id) AS order_count, {money("sum(price_c)")} AS total_revenue
FROM x_items JOIN x_labels USING (product_id) GROUP BY 1
ORDER BY order_count DESC, category LIMIT 10"""),
        "payment_type_breakdown": statement(f"""
SELECT kind AS payment_type, count(*) AS usage_count,
       {mean_money("sum(paid_c)", "count(paid_c)")} AS avg_value, {money("sum(paid_c)")} AS total_value
FROM x_payments GROUP BY 1"""),
        "review_score_distribution": statement(f"""
SELECT score::BIGINT AS review_score, count(*) AS review_count,
       {percent("count(*)", "(SELECT count(*) FROM x_reviews)")} AS pct FROM x_reviews GROUP BY 1"""),
    }


def _revenue() -> dict[str, str]:
    return {
        "monthly_revenue_mom": statement(
            f"""
SELECT month, {money("c")} AS revenue, orders, {money("p")} AS prev_month_revenue,
       {percent("c - p", "p")} AS mom_growth_pct
FROM (SELECT *, lag(c) OVER (ORDER BY month) AS p FROM x_month)""",
            _PAID,
            _SALES,
            f"""x_month AS (
  SELECT {month("bought_at")} AS month, sum(paid_c) AS c, count(*) AS orders FROM x_sales GROUP BY 1)""",
        ),
        "category_pareto": statement(_PARETO + " LIMIT 30", _CATEGORY),
        "category_shares": statement(_PARETO, _CATEGORY),
        "quarterly_revenue": statement(
            f"""
SELECT year(bought_at) AS year, quarter(bought_at) AS quarter, {money("sum(paid_c)")} AS revenue,
       count(*) AS orders, {mean_money("sum(paid_c)", "count(*)")} AS avg_order_value
FROM x_sales GROUP BY 1, 2""",
            _PAID,
            _SALES,
        ),
        "revenue_by_state": statement(
            f"""
SELECT state, orders, {money("c")} AS revenue, avg_order_value,
       dense_rank() OVER (ORDER BY c DESC) AS revenue_rank
FROM (SELECT state, count(*) AS orders, sum(paid_c) AS c,
             {mean_money("sum(paid_c)", "sum(n)")} AS avg_order_value
      FROM x_sales JOIN x_customers USING (customer_id) GROUP BY 1)
ORDER BY revenue DESC, state LIMIT 10""",
            _PAID,
            _SALES,
        ),
        "weekend_weekday": statement(f"""
SELECT if(dayofweek(bought_at) IN (0, 6), 'Weekend', 'Weekday') AS day_type,
       count(*) AS order_count, {percent("count(*)", "(SELECT count(*) FROM x_orders)")} AS pct
FROM x_orders GROUP BY 1"""),
        "peak_hours": statement("""
SELECT hour(bought_at) AS hour_of_day, count(*) AS order_count FROM x_orders
GROUP BY 1 ORDER BY order_count DESC, hour_of_day LIMIT 5"""),
        "key_total_revenue": statement(f"SELECT {money('sum(paid_c)')} AS total_revenue FROM x_payments"),
        "key_top3_categories": statement(
            f"SELECT category, {money('c')} AS revenue FROM x_category ORDER BY c DESC, category LIMIT 3",
            _CATEGORY,
        ),
        "monthly_revenue_report": statement(
            f"""
SELECT {month("bought_at")} AS month, count(*) AS total_orders, {money("sum(paid_c)")} AS total_revenue,
       {mean_money("sum(paid_c)", "sum(n)")} AS avg_order_value,
       count(DISTINCT customer_id) AS unique_customers
FROM x_sales WHERE {month("bought_at")} BETWEEN '{catalog.CALL_MONTHS[0]}' AND '{catalog.CALL_MONTHS[1]}'
GROUP BY 1""",
            _PAID,
            _SALES,
        ),
    }


def _customers() -> dict[str, str]:
    base = f"customer_id, recency_days, frequency, {money('c')} AS monetary"
    scores = f"SELECT {base}, r_score, f_score, m_score FROM x_scores"
    is_champion = _CHAMPION
    return {
        "rfm_base": statement(f"SELECT {base} FROM x_rfm", *_RFM),
        "rfm_scores": statement(scores, *_RFM),
        "global_ntile": statement(scores, *_RFM),
        "rfm_segments": statement(
            f"SELECT {base}, r_score, f_score, m_score, rfm_score, total_score, customer_segment"
            " FROM x_segments",
            *_RFM,
        ),
        "customer_pareto": statement(
            f"""
SELECT customer_id, {money("c")} AS monetary, place, revenue_rank, revenue_level, {money("run")} AS running_revenue,
       share AS cumulative_pct, CASE WHEN share <= 80 THEN 'TOP 80%' ELSE 'TAIL 20%' END AS pareto_segment
FROM (SELECT *, {percent("run", "(SELECT sum(c) FROM x_rfm)")} AS share
      FROM (SELECT *, row_number() OVER (ORDER BY c DESC NULLS LAST, customer_id) AS place,
                   rank() OVER (ORDER BY c DESC NULLS LAST) AS revenue_rank,
                   dense_rank() OVER (ORDER BY c DESC NULLS LAST) AS revenue_level,
                   sum(c) OVER (ORDER BY c DESC NULLS LAST, customer_id ROWS UNBOUNDED PRECEDING) AS run
            FROM x_rfm))""",
            *_RFM,
        ),
        "rfm_segment_summary": statement(
            f"""
SELECT customer_segment, count(*) AS customer_count,
       {percent("count(*)", "(SELECT count(*) FROM x_rfm)")} AS pct_customers,
       {mean_money("sum(c)", "count(c)")} AS avg_revenue, {money("sum(c)")} AS total_revenue,
       {percent("sum(c)", "(SELECT sum(c) FROM x_rfm)")} AS pct_revenue,
       {rounded("sum(recency_days)", "count(recency_days)", 0)} AS avg_recency_days,
       {rounded("sum(frequency)", "count(*)")} AS avg_frequency
FROM x_segments GROUP BY 1""",
            *_RFM,
        ),
        "top_champions": statement(
            f"""
SELECT {base}, rfm_score, row_number() OVER (ORDER BY c DESC, customer_id) AS value_rank
FROM x_segments WHERE {is_champion} ORDER BY value_rank LIMIT 20""",
            *_RFM,
        ),
        "key_champion_count": statement(
            f"SELECT count(*) AS champions FROM x_scores WHERE {is_champion}", *_RFM
        ),
        "customer_segment_report": statement(
            f"""
SELECT {base}, rfm_score, customer_segment
FROM x_segments WHERE customer_segment = '{catalog.CALL_SEGMENT}'""",
            *_RFM,
        ),
    }


def _cohorts() -> dict[str, str]:
    share = "CAST(100.0 * active / size AS DECIMAL(20,10))"
    return {
        "first_purchase": statement(
            f"SELECT person AS customer_id, {_label('m0')} AS cohort_month FROM x_first", *_COHORTS
        ),
        "cohort_activity": statement(
            f"""
SELECT person AS customer_id, {_label("m0")} AS cohort_month, {_label("m")} AS order_month,
       m - m0 AS month_index FROM x_active JOIN x_first USING (person)""",
            *_COHORTS,
        ),
        "cohort_size": statement(
            f"SELECT {_label('m0')} AS cohort_month, size AS cohort_customers FROM x_size", *_COHORTS
        ),
        "cohort_retention": statement(
            f"""
SELECT {_label("m0")} AS cohort_month, size AS cohort_customers, month_index,
       active AS active_customers, {percent("active", "size")} AS retention_rate_pct
FROM x_back WHERE month_index <= 6""",
            *_COHORTS,
        ),
        "avg_retention_by_month": statement(
            f"""
SELECT month_index, {rounded(f"sum({share}) * 10000000000", "count(*) * 10000000000")} AS avg_retention_pct
FROM x_back WHERE month_index BETWEEN 1 AND 6 GROUP BY 1""",
            *_COHORTS,
        ),
    }


def _delivery() -> dict[str, str]:
    def mean(start: str, end: str) -> str:
        gap = days(start, end)
        return rounded(f"sum({gap})", f"count({gap})", 1)

    late = "count(*) FILTER (late)"
    overall = f"""{mean("bought_at", "arrived_at")} AS avg_delivery_days,
       {percent(late, "count(*)")} AS late_order_pct"""
    gap = days("due_at", "arrived_at")
    state = f"""
SELECT state, orders, {rounded("d", "orders", 1)} AS avg_delivery_days, late_orders,
       {percent("late_orders", "orders")} AS late_rate_pct,
       rank() OVER (ORDER BY d / orders DESC) AS worst_delivery_rank
FROM (SELECT state, count(*) AS orders, sum({days("bought_at", "arrived_at")}) AS d,
             {late} AS late_orders
      FROM x_arrived JOIN x_customers USING (customer_id) GROUP BY 1)"""
    stages = f"""
SELECT {mean("bought_at", "approved_at")} AS avg_approval_days,
       {mean("approved_at", "carrier_at")} AS avg_warehouse_days,
       {mean("carrier_at", "arrived_at")} AS avg_shipping_days,
       {mean("bought_at", "arrived_at")} AS avg_total_days
FROM x_arrived WHERE approved_at IS NOT NULL AND carrier_at IS NOT NULL"""
    return {
        "delivery_overall": statement(
            f"""
SELECT count(*) AS total_delivered, {mean("arrived_at", "due_at")} AS avg_days_vs_estimate,
       {late} AS late_orders, {overall} FROM x_arrived""",
            _ARRIVED,
        ),
        "key_delivery": statement(f"SELECT {overall} FROM x_arrived", _ARRIVED),
        "delivery_segments": statement(
            f"""
SELECT CASE WHEN NOT late THEN 'On Time' WHEN {gap} <= 3 THEN 'Slightly Late (1-3d)'
            WHEN {gap} <= 7 THEN 'Late (4-7d)' ELSE 'Very Late (7d+)' END AS delivery_segment,
       count(*) AS order_count, {percent("count(*)", "(SELECT count(*) FROM x_arrived)")} AS pct,
       {mean("bought_at", "arrived_at")} AS avg_actual_days
FROM x_arrived GROUP BY 1""",
            _ARRIVED,
        ),
        "delivery_by_state": statement(
            state + "\nORDER BY avg_delivery_days DESC, worst_delivery_rank, state LIMIT 15", _ARRIVED
        ),
        "page_delivery": statement(state, _ARRIVED),
        "stage_breakdown": statement(stages, _ARRIVED),
        "page_delivery_stages": statement(stages, _ARRIVED),
        "late_vs_review": statement(
            f"""
SELECT if(late, 'Late', 'On Time') AS delivery_status,
       {rounded("sum(score)", "count(score)")} AS avg_review_score, count(*) AS order_count
FROM x_arrived JOIN x_reviews USING (order_id) GROUP BY 1""",
            _ARRIVED,
        ),
        "page_delivery_trend": statement(
            f"""
SELECT {month("bought_at")} AS month, count(*) AS orders, {late} AS late_orders,
       {percent(late, "count(*)")} AS late_rate_pct FROM x_arrived GROUP BY 1""",
            _ARRIVED,
        ),
    }


def _sellers() -> dict[str, str]:
    views = (_FANNED, _SELLERS)
    revenue = f"{money('c')} AS total_revenue"
    scorecard = f"""
SELECT seller_id, state AS seller_state, total_orders, {revenue}, avg_order_value, avg_rating,
       cancellation_rate, late_deliveries, dense_rank() OVER (ORDER BY c DESC) AS revenue_rank,
       dense_rank() OVER (ORDER BY avg_rating DESC NULLS LAST) AS rating_rank,
       dense_rank() OVER (ORDER BY cancellation_rate) AS reliability_rank,
       {_TIER} AS performance_tier
FROM x_metrics JOIN x_sellers USING (seller_id) ORDER BY c DESC, seller_id LIMIT 50"""
    top_bottom = """
SELECT seller_group, seller_id, c / 100.0 AS revenue, total_orders AS orders, avg_rating, cancellation_rate
FROM (SELECT *, CASE WHEN hi <= 10 THEN 'Top 10' WHEN lo <= 10 THEN 'Bottom 10' END AS seller_group
      FROM (SELECT *, row_number() OVER (ORDER BY c DESC, seller_id) AS hi,
                   row_number() OVER (ORDER BY c, seller_id) AS lo
            FROM x_metrics WHERE total_orders >= 10))
WHERE seller_group IS NOT NULL"""
    rating, cancellation, orders = catalog.CALL_ALERT
    metrics = f"""
SELECT seller_id, total_orders, {revenue}, avg_order_value, avg_rating, canceled_orders,
       cancellation_rate, late_deliveries"""
    category = f"""
SELECT category, count(DISTINCT order_id) AS total_orders, {money("sum(price_c)")} AS total_revenue,
       {mean_money("sum(price_c)", "count(price_c)")} AS avg_price,
       {rounded("sum(score)", "count(score)")} AS avg_rating
FROM x_items JOIN x_labels USING (product_id) LEFT JOIN x_reviews USING (order_id)"""
    return {
        "seller_metrics": statement(f"{metrics} FROM x_metrics", *views),
        "seller_tier": statement(f"{metrics}, {_TIER} AS performance_tier FROM x_metrics", *views),
        "seller_scorecard": statement(scorecard, *views),
        "global_dense_rank": statement(scorecard, *views),
        "seller_tier_summary": statement(
            f"""
SELECT performance_tier, count(*) AS seller_count,
       {rounded("sum(round(cancellation_rate * 100)::BIGINT)", "100 * count(cancellation_rate)")}
         AS avg_cancellation_rate,
       {rounded("sum(round(avg_rating * 100)::BIGINT)", "100 * count(avg_rating)")} AS avg_review_score,
       {money("sum(c)")} AS total_revenue, {percent("sum(c)", "(SELECT sum(c) FROM x_metrics)")} AS pct_revenue
FROM (SELECT *, {_TIER} AS performance_tier FROM x_metrics) GROUP BY 1""",
            *views,
        ),
        "seller_top_bottom": statement(top_bottom, *views),
        "page_sellers": statement(top_bottom, *views),
        "page_sellers_scatter": statement(
            f"SELECT seller_id, avg_rating, {revenue}, total_orders, {_TIER} AS performance_tier"
            " FROM x_metrics",
            *views,
        ),
        "flag_underperforming_sellers": statement(
            f"""
SELECT seller_id, state AS seller_state, total_orders, avg_rating, cancellation_rate,
       'REVIEW REQUIRED' AS alert_status
FROM x_metrics JOIN x_sellers USING (seller_id)
WHERE total_orders >= {orders} AND (avg_rating < {rating} OR cancellation_rate > {cancellation})""",
            *views,
        ),
        "category_performance": statement(
            f"{category} GROUP BY 1 ORDER BY total_revenue DESC, category LIMIT {catalog.CALL_TOP}"
        ),
    }


def expected() -> dict[str, str]:
    found = _exploration() | _revenue() | _customers() | _cohorts() | _delivery() | _sellers()
    calls = (f"SELECT '{n}' AS call, count(*) AS row_count FROM ({found[n]})" for n in catalog.CALLS)
    return found | {"procedure_calls": "\nUNION ALL\n".join(calls)}

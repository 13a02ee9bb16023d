"""Expected results of the star schema, its measures and the dashboard pages."""

from __future__ import annotations

from checks.base import days, mean_money, money, month, percent, rounded, statement
from tradeloom.plans import catalog

_SALES = """x_fact AS (
  SELECT i.order_id, person AS customer_id, product_id, seller_id, price_c,
         bought_at::DATE AS order_date,
         if(coalesce(arrived_at > due_at, false), 1, 0)::BIGINT AS is_late
  FROM x_items i JOIN x_orders USING (order_id) JOIN x_customers USING (customer_id))"""
_COUNTS = """x_counts AS (
  SELECT customer_id, count(DISTINCT order_id) AS order_count FROM x_fact GROUP BY 1)"""
_DATES = """x_dates AS (
  SELECT unnest(generate_series(date_trunc('month', min(bought_at)), last_day(max(bought_at)),
                                INTERVAL 1 DAY))::DATE AS date FROM x_orders)"""
_MONTHS = """x_months AS (
  SELECT m, c, lag(c) OVER (ORDER BY m) AS p,
         sum(c) OVER (PARTITION BY year(m) ORDER BY m ROWS UNBOUNDED PRECEDING) AS ytd
  FROM (SELECT DISTINCT date_trunc('month', date) AS m FROM x_dates)
  LEFT JOIN (SELECT date_trunc('month', order_date) AS m, sum(price_c) AS c FROM x_fact GROUP BY 1)
       USING (m))"""


def _grouped(source: str, group: str) -> tuple[str, str]:
    """Monthly revenue per group over every month of the calendar."""
    return (
        f"""x_by AS (
  SELECT {group} AS g, date_trunc('month', order_date) AS m, sum(price_c) AS c
  FROM x_fact JOIN {source} GROUP BY 1, 2)""",
        """x_grid AS (
  SELECT g, m, c, lag(c) OVER (PARTITION BY g ORDER BY m) AS p,
         sum(c) OVER (PARTITION BY g, year(m) ORDER BY m ROWS UNBOUNDED PRECEDING) AS ytd
  FROM (SELECT DISTINCT g FROM x_by) CROSS JOIN (SELECT DISTINCT date_trunc('month', date) AS m FROM x_dates)
  LEFT JOIN x_by USING (g, m))""",
    )


_CELLS = """x_cells AS (
  SELECT f.*, category, state, order_count, strftime(order_date, '%Y-%m') AS order_month
  FROM x_fact f JOIN x_counts USING (customer_id) JOIN x_labels USING (product_id)
  JOIN (SELECT DISTINCT person AS customer_id, state FROM x_customers) USING (customer_id))"""


def _measures(context: str, by: dict[str, str], where: str = "true") -> str:
    """All measures of a context straight from the facts."""
    named = (f"{by.get(d, 'NULL::VARCHAR')} AS {d}" for d in ("order_month", "customer_state", "category"))
    group = f"GROUP BY {', '.join(by.values())}" if by else ""
    return f"""
SELECT '{context}' AS context, {', '.join(named)}, {money("sum(price_c)")} AS total_revenue,
       count(DISTINCT order_id) AS orders, count(DISTINCT customer_id) AS people,
       {mean_money("sum(price_c)", "count(DISTINCT order_id)")} AS avg_order_value,
       {rounded("count(DISTINCT customer_id) FILTER (order_count > 1)", "count(DISTINCT customer_id)", 4)} AS retention_rate,
       {rounded("sum(is_late)", "count(*)", 4)} AS late_rate
FROM x_cells WHERE {where} {group}"""


def expected(reports: dict[str, str]) -> dict[str, str]:
    revenue = f"{money('sum(price_c)')}"
    per_order = mean_money("sum(price_c)", "count(DISTINCT order_id)")
    late = rounded("sum(is_late)", "count(*)", 4)
    growth = statement(
        f"""
SELECT {month("m")} AS month, {money("coalesce(c, 0)")} AS total_revenue,
       coalesce({rounded("coalesce(c, 0) - coalesce(p, 0)", "coalesce(p, 0)", 4)}, 0) AS mom_growth
FROM x_months""",
        _SALES,
        _DATES,
        _MONTHS,
    )
    lines = f"""x_lines AS (
  SELECT * FROM x_items JOIN x_labels USING (product_id) WHERE category = '{catalog.CALL_CATEGORY}')"""
    gap = days("bought_at", "arrived_at")
    lates = "count(*) FILTER (arrived_at > due_at)"
    all_states = reports["revenue_by_state"].removesuffix("LIMIT 10")
    compared = "('Champions', 'At Risk')"
    return {
        "star_schema": statement(
            f"""
SELECT order_id, customer_id, product_id, seller_id, {money("price_c")} AS revenue, order_date,
       order_count, is_late FROM x_fact JOIN x_counts USING (customer_id)""",
            _SALES,
            _COUNTS,
        ),
        "dim_customer": statement("""
SELECT person AS customer_id, state AS customer_state, city AS customer_city, zip AS customer_zip_code
FROM (SELECT DISTINCT person, state, city, zip FROM x_customers)"""),
        "dim_product": statement("SELECT product_id, category FROM x_labels"),
        "dim_seller": statement("""
SELECT seller_id, state AS seller_state, city AS seller_city, zip AS seller_zip_code FROM x_sellers"""),
        "dim_date": statement(
            f"""
SELECT date, year(date) AS year, quarter(date) AS quarter, month(date) AS month,
       {month("date")} AS year_month FROM x_dates""",
            _DATES,
        ),
        "bi_total_revenue": statement(f"SELECT {revenue} AS total_revenue FROM x_fact", _SALES),
        "bi_mom_growth": growth,
        "bi_mom_growth_by_state": statement(
            f"""
SELECT g AS customer_state, {month("m")} AS month, {money("coalesce(c, 0)")} AS total_revenue,
       coalesce({rounded("coalesce(c, 0) - coalesce(p, 0)", "coalesce(p, 0)", 4)}, 0) AS mom_growth
FROM x_grid""",
            _SALES,
            _DATES,
            *_grouped("(SELECT DISTINCT person AS customer_id, state FROM x_customers) USING (customer_id)", "state"),
        ),
        "bi_ytd_revenue_by_category": statement(
            f"""
SELECT g AS category, {month("m")} AS month, {money("coalesce(ytd, 0)")} AS ytd_revenue FROM x_grid""",
            _SALES,
            _DATES,
            *_grouped("x_labels USING (product_id)", "category"),
        ),
        "bi_ytd_revenue": statement(
            f"SELECT {month('m')} AS month, {money('coalesce(ytd, 0)')} AS ytd_revenue FROM x_months",
            _SALES,
            _DATES,
            _MONTHS,
        ),
        "bi_avg_order_value": statement(f"SELECT {per_order} AS avg_order_value FROM x_fact", _SALES),
        "bi_retention_rate": statement(
            f"""
SELECT {rounded("count(*) FILTER (order_count > 1)", "count(*)", 4)} AS retention_rate FROM x_counts""",
            _SALES,
            _COUNTS,
        ),
        "bi_measures": statement(
            " UNION ALL ".join(
                (
                    _measures("overall", {}),
                    _measures("by category", {"category": "category"}),
                    _measures(
                        "one category",
                        {"customer_state": "state", "order_month": "order_month"},
                        f"category = '{catalog.CALL_CATEGORY}'",
                    ),
                )
            ),
            _SALES,
            _COUNTS,
            _CELLS,
        ),
        "bi_late_rate": statement(f"SELECT {late} AS late_rate FROM x_fact", _SALES),
        "page_executive": statement(
            f"""
SELECT {revenue} AS total_revenue, count(DISTINCT order_id) AS orders, {per_order} AS avg_order_value,
       {late} AS late_rate FROM x_fact""",
            _SALES,
        ),
        "page_executive_trend": growth,
        "page_revenue": all_states,
        "page_revenue_trend": reports["monthly_revenue_mom"],
        "page_revenue_pareto": reports["category_shares"],
        "page_customers": (
            "SELECT customer_segment, customer_count, pct_customers, total_revenue, pct_revenue"
            f" FROM ({reports['rfm_segment_summary']})"
        ),
        "page_customers_compare": (
            f"SELECT * FROM ({reports['rfm_segment_summary']}) WHERE customer_segment IN {compared}"
        ),
        "category_drill": statement(
            f"""
SELECT {month("bought_at")} AS month, {revenue} AS revenue, count(DISTINCT order_id) AS orders
FROM x_lines JOIN x_orders USING (order_id) GROUP BY 1""",
            lines,
        ),
        "category_drill_sellers": statement(
            f"""
SELECT seller_id, {revenue} AS revenue, count(DISTINCT order_id) AS orders
FROM x_lines GROUP BY 1 ORDER BY revenue DESC, seller_id LIMIT 10""",
            lines,
        ),
        "category_drill_rating": statement(
            f"""
SELECT category, count(DISTINCT order_id) AS total_orders, {rounded("sum(score)", "count(score)")} AS avg_rating
FROM x_lines LEFT JOIN x_reviews USING (order_id) GROUP BY 1""",
            lines,
        ),
        "category_drill_delivery": statement(
            f"""
SELECT count(*) AS orders, {rounded(f"sum({gap})", f"count({gap})", 1)} AS avg_delivery_days,
       {lates} AS late_orders, {percent(lates, "count(*)")} AS late_rate_pct
FROM x_orders WHERE order_status = 'delivered' AND arrived_at IS NOT NULL
  AND order_id IN (SELECT order_id FROM x_lines)""",
            lines,
        ),
    }

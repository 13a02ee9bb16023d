"""Shared pieces of the check SQL: the derived input tables and exact rounding.

Money is carried as whole cents (`..._c`) and every quotient is rounded half up in integer
arithmetic, so the expected values do not depend on floating-point rounding.
"""

from __future__ import annotations

_INPUT = """
x_orders AS (
  SELECT o_orderkey AS order_id, o_orderkey AS customer_id,
         CASE WHEN o_orderstatus <> 'P' THEN 'delivered'
              ELSE ['canceled', 'shipped', 'processing'][1 + (o_orderkey % 3)::INT]
         END AS order_status,
         bought AS bought_at,
         CASE WHEN o_orderkey % 157 <> 0
              THEN bought + to_hours((o_orderkey % 30)::INT) END AS approved_at,
         CASE WHEN o_orderkey % 53 <> 0
              THEN bought + to_hours((o_orderkey % 30)::INT)
                          + to_days((3 * o_orderkey % 7)::INT) END AS carrier_at,
         CASE WHEN o_orderkey % 97 <> 0
              THEN bought + to_days((3 + 7 * o_orderkey % 40)::INT) END AS arrived_at,
         o_orderdate + to_days((20 + o_orderkey % 15)::INT) AS due_at
  FROM (SELECT *, o_orderdate + to_hours((o_orderkey % 24)::INT) AS bought FROM orders)
),
x_customers AS (
  SELECT o_orderkey AS customer_id, o_custkey AS person, n_name AS state,
         lpad((o_custkey % 100000)::VARCHAR, 5, '0') AS zip, lower(c_mktsegment) AS city
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
),
x_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS item_no, l_partkey AS product_id,
         l_suppkey AS seller_id, l_shipdate AS ship_by,
         (CAST(l_quantity * (1 + l_suppkey % 4) AS DECIMAL(10,2)) * 100)::BIGINT AS price_c,
         l_linenumber * 100 AS freight_c
  FROM lineitem
),
x_products AS (
  SELECT p_partkey AS product_id, CASE WHEN p_partkey % 50 <> 0 THEN p_brand END AS native,
         length(p_name) AS name_length, length(p_type) AS description_length,
         p_partkey % 6 AS photos, p_size
  FROM part
),
x_translation AS (
  SELECT DISTINCT p_brand AS native, 'cat_' || regexp_extract(p_brand, '(\\d+)$', 1) AS english
  FROM part WHERE regexp_extract(p_brand, '(\\d+)$', 1)::INT <= 20
),
x_sellers AS (
  SELECT s_suppkey AS seller_id, n_name AS state, lower(s_name) AS city,
         lpad((s_suppkey % 100000)::VARCHAR, 5, '0') AS zip
  FROM supplier JOIN nation ON n_nationkey = s_nationkey
),
x_payments AS (
  SELECT o_orderkey AS order_id, 1 AS seq, 1 + o_orderkey % 10 AS installments,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'voucher' WHEN '2-HIGH' THEN 'boleto'
              ELSE 'credit_card' END AS kind,
         (CAST(o_totalprice AS DECIMAL(10,2)) * 100)::BIGINT AS paid_c
  FROM orders WHERE o_orderkey % 1000 <> 0
  UNION ALL
  SELECT o_orderkey, 2, 1 + o_orderkey % 10, 'voucher', (o_orderkey % 90) * 100
  FROM orders WHERE o_orderkey % 20 = 0 AND o_orderkey % 1000 <> 0
),
x_reviews AS (
  SELECT 2 * o_orderkey AS review_id, o_orderkey AS order_id,
         CASE WHEN m < 55 THEN 5 WHEN m < 75 THEN 4 WHEN m < 83 THEN 3 WHEN m < 90 THEN 2
              ELSE 1 END AS score
  FROM (SELECT *, 7919 * o_orderkey % 101 AS m FROM orders) WHERE o_orderkey % 50 <> 0
  UNION ALL
  SELECT 2 * o_orderkey + 1, o_orderkey, 1 + o_orderkey % 5
  FROM orders WHERE o_orderkey % 180 = 0
),
x_labels AS (
  SELECT product_id, coalesce(english, p.native, 'Unknown') AS category
  FROM x_products p LEFT JOIN x_translation t ON t.native = p.native
)"""


def statement(body: str, *views: str) -> str:
    """`views` are further CTEs, in order; `body` is the final SELECT."""
    return "WITH " + ",\n".join([_INPUT.strip(), *(v.strip() for v in views)]) + "\n" + body.strip()


def rounded(numerator: str, denominator: str, places: int = 2) -> str:
    """numerator / denominator, half away from zero; NULL on a zero denominator."""
    n, d, scale = f"({numerator})::HUGEINT", f"({denominator})::HUGEINT", 10**places
    return (
        f"(CASE WHEN {d} <> 0 THEN"
        f" sign({n}) * ((2 * abs({n}) * {scale} + {d}) // (2 * {d})) / {scale}.0 END)"
    )


def percent(part: str, whole: str) -> str:
    return rounded(f"100 * ({part})", whole)


def mean_money(cents: str, rows: str) -> str:
    return rounded(cents, f"100 * ({rows})")


def money(cents: str) -> str:
    return f"(({cents})::HUGEINT / 100.0)"


def whole(number: str) -> str:
    return f"({number})::BIGINT"


def month(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m')"


def days(start: str, end: str) -> str:
    return f"date_diff('day', {start}, {end})"

"""The report tables derived from a customer / orders / lineitem star schema.

Lets every report run on order-and-line-item data that has no payments, reviews or delivery
times of its own: those follow from the order key by integer rules (see FIXTURES.md).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tradeloom.tables import Tables

_schemas: dict[str, T.StructType] = {}


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The schema is looked up in the file once, not before every query."""
    path = f"{folder}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    orders = _read(spark, folder, "orders").selectExpr("o_orderkey", "o_custkey AS c_custkey")
    people = _read(spark, folder, "customer").selectExpr(
        "c_custkey", "c_nationkey AS n_nationkey", "c_mktsegment"
    )
    nations = _read(spark, folder, "nation").select("n_nationkey", "n_name")
    return orders.join(people.join(nations, "n_nationkey"), "c_custkey").selectExpr(
        "o_orderkey AS customer_id",
        "c_custkey AS customer_unique_id",
        "lpad(CAST(c_custkey % 100000 AS STRING), 5, '0') AS customer_zip_code",
        "lower(c_mktsegment) AS customer_city",
        "n_name AS customer_state",
    )


def _later(ts: str, days: str = "0", hours: str = "0") -> str:
    return f"{ts} + make_dt_interval(CAST({days} AS INT), CAST({hours} AS INT))"


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    bought = _later("o_orderdate", hours="o_orderkey % 24")
    approved = _later(bought, hours="o_orderkey % 30")
    carrier = _later(bought, "3 * o_orderkey % 7", "o_orderkey % 30")
    arrived = _later(bought, "3 + 7 * o_orderkey % 40")
    unfinished = "element_at(array('canceled', 'shipped', 'processing'), CAST(o_orderkey % 3 AS INT) + 1)"
    return _read(spark, folder, "orders").selectExpr(
        "o_orderkey AS order_id",
        "o_orderkey AS customer_id",
        f"IF(o_orderstatus = 'P', {unfinished}, 'delivered') AS order_status",
        f"{bought} AS order_purchase_timestamp",
        f"IF(o_orderkey % 157 <> 0, {approved}, NULL) AS order_approved_at",
        f"IF(o_orderkey % 53 <> 0, {carrier}, NULL) AS order_delivered_carrier_date",
        f"IF(o_orderkey % 97 <> 0, {arrived}, NULL) AS order_delivered_customer_date",
        f"{_later('o_orderdate', '20 + o_orderkey % 15')} AS order_estimated_delivery_date",
    )


def _order_items(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "lineitem").selectExpr(
        "l_orderkey AS order_id",
        "l_linenumber AS order_item_id",
        "l_partkey AS product_id",
        "l_suppkey AS seller_id",
        "l_shipdate AS shipping_limit_date",
        "CAST(l_quantity * (1 + l_suppkey % 4) AS DECIMAL(10,2)) AS price",
        "CAST(l_linenumber AS DECIMAL(10,2)) AS freight_value",
    )


def _products(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "part").selectExpr(
        "p_partkey AS product_id",
        "IF(p_partkey % 50 <> 0, p_brand, NULL) AS product_category_name",
        "length(p_name) AS product_name_length",
        "length(p_type) AS product_description_length",
        "CAST(p_partkey % 6 AS INT) AS product_photos_qty",
        "CAST(p_size * 100 AS INT) AS product_weight_g",
        "CAST(p_size AS INT) AS product_length_cm",
        "CAST(p_size AS INT) AS product_height_cm",
        "CAST(p_size AS INT) AS product_width_cm",
    )


def _translation(spark: SparkSession, folder: str) -> DataFrame:
    number = r"regexp_extract(p_brand, '(\\d+)$', 1)"
    brands = _read(spark, folder, "part").select("p_brand").distinct()
    return brands.where(f"CAST({number} AS INT) <= 20").selectExpr(
        "p_brand AS product_category_name",
        f"concat('cat_', {number}) AS product_category_name_english",
    )


def _sellers(spark: SparkSession, folder: str) -> DataFrame:
    nations = _read(spark, folder, "nation").selectExpr("n_nationkey AS s_nationkey", "n_name")
    return _read(spark, folder, "supplier").join(nations, "s_nationkey").selectExpr(
        "s_suppkey AS seller_id",
        "lpad(CAST(s_suppkey % 100000 AS STRING), 5, '0') AS seller_zip_code",
        "lower(s_name) AS seller_city",
        "n_name AS seller_state",
    )


def _order_payments(spark: SparkSession, folder: str) -> DataFrame:
    kind = (
        "CASE WHEN n = 2 OR o_orderpriority = '1-URGENT' THEN 'voucher'"
        " WHEN o_orderpriority = '2-HIGH' THEN 'boleto' ELSE 'credit_card' END"
    )
    return (
        _read(spark, folder, "orders")
        .where("o_orderkey % 1000 <> 0")
        .selectExpr("*", "explode(IF(o_orderkey % 20 = 0, array(1, 2), array(1))) AS n")
        .selectExpr(
            "o_orderkey AS order_id",
            "n AS payment_sequential",
            f"{kind} AS payment_type",
            "CAST(1 + o_orderkey % 10 AS INT) AS payment_installments",
            "CAST(IF(n = 1, o_totalprice, o_orderkey % 90) AS DECIMAL(10,2)) AS payment_value",
        )
    )


def _order_reviews(spark: SparkSession, folder: str) -> DataFrame:
    first = "IF(o_orderkey % 50 <> 0, array(0), array())"
    made = _later("o_orderdate", "25 + o_orderkey % 15")
    bucket = "7919 * o_orderkey % 101"
    score = (
        f"CASE WHEN n = 1 THEN 1 + o_orderkey % 5 WHEN {bucket} < 55 THEN 5"
        f" WHEN {bucket} < 75 THEN 4 WHEN {bucket} < 83 THEN 3 WHEN {bucket} < 90 THEN 2 ELSE 1 END"
    )
    message = "concat('It was \"fine\",\\nnumber ', o_orderkey)"
    return (
        _read(spark, folder, "orders")
        .selectExpr(
            "*", f"explode(IF(o_orderkey % 180 = 0, concat({first}, array(1)), {first})) AS n"
        )
        .selectExpr(
            "2 * o_orderkey + n AS review_id",
            "o_orderkey AS order_id",
            f"CAST({score} AS TINYINT) AS review_score",
            "IF(o_orderkey % 4 = 0, concat('Order ', o_orderkey), NULL) AS review_comment_title",
            f"IF(o_orderkey % 7 = 0, {message}, NULL) AS review_comment_message",
            f"{made} AS review_creation_date",
            f"{_later(made, '1', 'o_orderkey % 24')} AS review_answer_timestamp",
        )
    )


_LOADERS = {
    "customers": _customers,
    "orders": _orders,
    "order_items": _order_items,
    "products": _products,
    "product_category_translation": _translation,
    "sellers": _sellers,
    "order_payments": _order_payments,
    "order_reviews": _order_reviews,
}


def load(spark: SparkSession, folder: str) -> Tables:
    return Tables(
        spark, {name: (lambda f=f: f(spark, folder)) for name, f in _LOADERS.items()}
    )

"""Star schema at order-line grain, and the measures over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradeloom.functions.columns import (
    cents,
    is_late,
    money_mean,
    month_label,
    month_number,
    ratio,
)
from tradeloom.operators.scratch import discard, written
from tradeloom.operators.sizing import within
from tradeloom.operators.skew import (
    NO_HOT_KEYS,
    SALT,
    find_hot_keys,
    hot_keys_from_counts,
    lookup_join,
    spread_join,
)
from tradeloom.plans.exploration import product_categories
from tradeloom.sources import files
from tradeloom.tables import Tables


def _order_facts(t: Tables) -> DataFrame:
    """(order_id, person, order_date, is_late) per order."""
    orders = t["orders"].select(
        "order_id",
        "customer_id",
        F.col("order_purchase_timestamp").cast("date").alias("order_date"),
        F.coalesce(is_late(), F.lit(False)).cast("int").alias("is_late"),
    )
    people = t["customers"].select("customer_id", F.col("customer_unique_id").alias("person"))
    joined = lookup_join(
        orders, people, "customer_id", lambda: t.hot("orders", "customer_id"), ["order_id"]
    )
    return joined.select("order_id", F.col("person").alias("customer_id"), "order_date", "is_late")


def _lines_with(t: Tables, orders: DataFrame, few: bool = False) -> DataFrame:
    """Order lines with their orders' facts; `few` orders are broadcast and the lines not moved."""
    lines = t["order_items"].select(
        "order_id", "order_item_id", "product_id", "seller_id", F.col("price").alias("revenue")
    )
    if few:
        return lines.join(F.broadcast(orders), "order_id").drop("order_item_id")
    hot = t.hot("order_items", "order_id")
    joined = spread_join(lines, orders, "order_id", hot, ["order_item_id", "product_id"])
    return joined.drop(SALT, "order_item_id")


def sales(t: Tables) -> DataFrame:
    """The fact rows without `order_count`, for the measures that do not use it."""
    return _lines_with(t, _order_facts(t))


def orders_per_person(t: Tables) -> DataFrame:
    """Orders with at least one line, per person."""
    ordered = t["order_items"].select("order_id").distinct()
    facts = _order_facts(t).select("order_id", "customer_id")
    return (
        facts.join(ordered, "order_id", "left_semi")
        .groupBy("customer_id")
        .agg(F.count("*").alias("order_count"))
    )


def fact_sales(t: Tables) -> DataFrame:
    """One row per order line. `customer_id` is the person; `order_count` their orders."""
    counts, hot = orders_per_person(t), NO_HOT_KEYS
    if not within(t["orders"], "spark.tradeloom.skewMinBytes"):
        # Counted already, so a person with very many orders is known exactly.
        counts = written(counts, "orders_per_person")
        total = counts.agg(F.sum("order_count")).first()[0]
        hot = hot_keys_from_counts(counts, "customer_id", "order_count", total or 0)
    orders = spread_join(_order_facts(t), counts, "customer_id", hot, ["order_id"]).drop(SALT)
    return _lines_with(t, orders).select(
        "order_id",
        "customer_id",
        "product_id",
        "seller_id",
        "revenue",
        "order_date",
        "order_count",
        "is_late",
    )


def dim_customer(t: Tables) -> DataFrame:
    """One row per person; the least of each place, as a person may have several."""
    return (
        t["customers"]
        .groupBy(F.col("customer_unique_id").alias("customer_id"))
        .agg(
            F.min(F.struct("customer_state", "customer_city", "customer_zip_code")).alias("place")
        )
        .select("customer_id", "place.*")
    )


def dim_product(t: Tables) -> DataFrame:
    return product_categories(t)


def dim_seller(t: Tables) -> DataFrame:
    return t["sellers"].select("seller_id", "seller_state", "seller_city", "seller_zip_code")


def dim_date(t: Tables) -> DataFrame:
    """Every day of the months that hold orders, gaps included."""
    purchase = F.col("order_purchase_timestamp")
    span = t["orders"].agg(
        F.trunc(F.min(purchase), "month").alias("first"), F.last_day(F.max(purchase)).alias("last")
    )
    date = F.col("date")
    return (
        span.where(F.col("first").isNotNull())
        .select(F.explode(F.sequence("first", "last")).alias("date"))
        .select(
            "date",
            F.year(date).alias("year"),
            F.quarter(date).alias("quarter"),
            F.month(date).alias("month"),
            month_label(month_number(date)).alias("year_month"),
        )
    )


DIMENSIONS = (dim_customer, dim_product, dim_seller, dim_date)
_FACTS, _PERSON_ORDERS = "fact_lines", "person_orders"


def _write_months(spark: SparkSession, folder: str, sold: DataFrame, months: list[str] | None = None) -> None:
    """The facts `sold`, replacing the months that these have: `months`, or all that are stored.

    A person's number of orders changes with every month, so it is not part of the stored lines but
    of a table of orders per person and month: a month can be replaced without touching others.
    """
    month = month_label(month_number(F.col("order_date")))
    lines = sold.withColumn("order_month", month).hint("rebalance", "order_month")

    def write(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("order_month").parquet(f"{folder}/{name}")

    write(lines, _FACTS)
    own = F.col("order_month").isNotNull() if months is None else F.col("order_month").isin(months)
    written_lines = _stored(spark, folder, _FACTS).where(own)
    per_order = written_lines.select("order_month", "customer_id", "order_id").distinct()
    write(per_order.groupBy("order_month", "customer_id").agg(F.count("*").alias("orders")), _PERSON_ORDERS)


def _stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(f"{folder}/{name}")


def write_star(t: Tables, folder: str) -> None:
    """The whole star in `folder`, over whatever it holds."""
    for name in (_FACTS, _PERSON_ORDERS):
        discard(t.spark, f"{folder}/{name}")
    _write_months(t.spark, folder, sales(t))
    _write_dimensions(t, folder)


def _write_dimensions(t: Tables, folder: str) -> None:
    for dimension in DIMENSIONS:
        dimension(t).write.mode("overwrite").parquet(f"{folder}/{dimension.__name__}")


def refresh_star(spark: SparkSession, tables: str, folder: str, months: list[str]) -> Tables:
    """Bring some months ('YYYY-MM') of a stored star up to date with the stored tables.

    Reads the orders of these months alone, and of the order lines the loads and row groups whose
    key range can hold their ids. Returns the tables as they were read.
    """
    whole = files.load(spark, tables)
    orders = whole["orders"].where(F.col(files.ORDER_MONTH).isin(months))
    least, greatest = orders.agg(F.min("order_id"), F.max("order_id")).first()
    lines = files.read_between(spark, tables, "order_items", least, greatest)
    some = Tables.of(spark, orders=orders, order_items=lines, customers=whole["customers"])
    # Few orders are held against the lines by a lookup; neither is found out or joined twice.
    facts = written(_order_facts(some), "refreshed_orders")
    few = within(facts, "spark.tradeloom.broadcastBytes")
    sold = written(_lines_with(some, facts, few), "refreshed_lines")
    held = {r[0] for r in sold.select(month_label(month_number(F.col("order_date")))).distinct().collect()}
    _write_months(spark, folder, sold, sorted(held))
    for month in set(months) - held:  # nothing is left of them
        for name in (_FACTS, _PERSON_ORDERS):
            discard(spark, f"{folder}/{name}/order_month={month}")
    _write_dimensions(whole, folder)
    return some


def read_star(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The facts, with every person's orders added up over the months, and the dimensions."""
    lines = _stored(spark, folder, _FACTS).drop("order_month")
    counts = _stored(spark, folder, _PERSON_ORDERS).groupBy("customer_id").agg(F.sum("orders").alias("order_count"))
    fact = lookup_join(lines, counts, "customer_id", lambda: find_hot_keys(lines, "customer_id"), ["order_id", "product_id"])
    columns = ("order_id", "customer_id", "product_id", "seller_id", "revenue", "order_date", "order_count", "is_late")
    return {"fact_sales": fact.select(*columns)} | {d.__name__: spark.read.parquet(f"{folder}/{d.__name__}") for d in DIMENSIONS}


# Measures. `by` is the filter context: the columns the measure is shown by.


def total_revenue(fact: DataFrame, *by: str | Column) -> DataFrame:
    return fact.groupBy(*by).agg(F.sum("revenue").alias("total_revenue"))


def avg_order_value(fact: DataFrame, *by: str) -> DataFrame:
    per_order = fact.groupBy(*by, "order_id").agg(F.sum("revenue").alias("revenue"))
    value = money_mean(F.sum("revenue"), F.count("order_id"))
    return per_order.groupBy(*by).agg(value.alias("avg_order_value"))


def retention_rate(fact: DataFrame, *by: str) -> DataFrame:
    """Share of people with more than one order, to four places."""
    people = fact.groupBy(*by, "customer_id").agg(F.max("order_count").alias("order_count"))
    repeated = F.count_if(F.col("order_count") > 1)
    rate = ratio(repeated, F.count("customer_id"), 4)
    return people.groupBy(*by).agg(rate.alias("retention_rate"))


def late_rate(fact: DataFrame, *by: str) -> DataFrame:
    rate = ratio(F.count_if(F.col("is_late") == 1), F.count("*"), 4)
    return fact.groupBy(*by).agg(rate.alias("late_rate"))


def _revenue_by_month(fact: DataFrame, dates: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Every month of the calendar, for each value of `by`; NULL revenue where nothing was sold."""
    monthly = total_revenue(fact, *by, month_number(F.col("order_date")).alias("month_no"))
    if not by:
        months = dates.select(month_number(F.col("date")).alias("month_no")).distinct()
        return months.join(monthly, "month_no", "left")
    calendar = dates.agg(F.collect_set(month_number(F.col("date")))).scalar()
    grid = monthly.select(*by).distinct().select(*by, F.explode(calendar).alias("month_no"))
    same = [grid[c].eqNullSafe(monthly[c]) for c in (*by, "month_no")]
    return grid.join(monthly, same, "left").select(*(grid[c] for c in (*by, "month_no")), "total_revenue")


def mom_growth(fact: DataFrame, dates: DataFrame, *by: str) -> DataFrame:
    """Growth against the previous calendar month as a fraction; 0 if that had no revenue."""
    monthly = _revenue_by_month(fact, dates, by)
    current = F.coalesce("total_revenue", F.lit(0))
    before = Window.partitionBy(*by).orderBy("month_no")
    previous = F.coalesce(F.lag("total_revenue").over(before), F.lit(0))
    growth = ratio(cents(F.col("current") - F.col("previous")), cents(F.col("previous")), 4)
    return (
        monthly.select(*by, "month_no", current.alias("current"), previous.alias("previous"))
        .select(
            *by,
            month_label(F.col("month_no")).alias("month"),
            F.col("current").alias("total_revenue"),
            F.coalesce(growth, F.lit(0)).alias("mom_growth"),
        )
        .orderBy(*by, "month")
    )


def ytd_revenue(fact: DataFrame, dates: DataFrame, *by: str) -> DataFrame:
    year = F.floor(F.col("month_no") / 12)
    to_date = (
        Window.partitionBy(*by, year)
        .orderBy("month_no")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        _revenue_by_month(fact, dates, by)
        .select(
            *by,
            month_label(F.col("month_no")).alias("month"),
            F.coalesce(F.sum("total_revenue").over(to_date), F.lit(0)).alias("ytd_revenue"),
        )
        .orderBy(*by, "month")
    )


def _daily_by(fact: DataFrame, dimension: DataFrame, key: str, column: str) -> DataFrame:
    """Revenue per day and attribute; a hot key is one row per day when it meets its dimension."""
    daily = fact.groupBy(key, "order_date").agg(F.sum("revenue").alias("revenue"))
    return daily.join(dimension.select(key, column), key).select(column, "order_date", "revenue")


def bi_mom_growth_by_state(t: Tables) -> DataFrame:
    daily = _daily_by(sales(t), dim_customer(t), "customer_id", "customer_state")
    return mom_growth(daily, dim_date(t), "customer_state")


def bi_ytd_revenue_by_category(t: Tables) -> DataFrame:
    daily = _daily_by(sales(t), dim_product(t), "product_id", "category")
    return ytd_revenue(daily, dim_date(t), "category")


def bi_total_revenue(t: Tables) -> DataFrame:
    return total_revenue(sales(t))


def bi_mom_growth(t: Tables) -> DataFrame:
    return mom_growth(sales(t), dim_date(t))


def bi_ytd_revenue(t: Tables) -> DataFrame:
    return ytd_revenue(sales(t), dim_date(t))


def bi_avg_order_value(t: Tables) -> DataFrame:
    return avg_order_value(sales(t))


def bi_retention_rate(t: Tables) -> DataFrame:
    """From the person counts alone: the fact rows would only repeat them."""
    return retention_rate(orders_per_person(t))


def bi_late_rate(t: Tables) -> DataFrame:
    return late_rate(sales(t))

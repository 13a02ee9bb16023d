"""Column expressions shared by the reports."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

DELIVERED = "delivered"
CANCELED = "canceled"


def ratio(numerator: Column, denominator: Column, places: int = 2) -> Column:
    """Quotient of two whole numbers, rounded half up once; NULL if the denominator is 0.

    Whole decimals only, so it is exact for all totals: the shifted numerator is divided with
    a remainder, and the remainder decides the rounding.
    """
    whole = "decimal(38,0)"
    n, d = numerator.cast(whole), F.nullif(denominator.cast(whole), F.lit(0).cast(whole))
    shifted = (F.abs(n) * F.lit(10**places).cast("decimal(10,0)")).cast(whole)
    by = F.abs(d)
    quotient = F.call_function("div", shifted, by).cast("decimal(20,0)")
    rest = shifted - (quotient * by).cast(whole)
    up = F.when(rest >= by - rest, F.lit(1)).otherwise(F.lit(0))
    sign = F.when((n < 0) != (d < 0), F.lit(-1)).otherwise(F.lit(1))
    units = ((quotient + up) * sign).cast("decimal(20,0)")
    return F.when(d.isNotNull(), units * F.lit(Decimal(1).scaleb(-places))).cast(f"decimal(20,{places})")


def cents(money: Column) -> Column:
    return money * 100


def percent(part: Column, whole: Column) -> Column:
    return ratio(part * 100, whole)


def money_percent(part: Column, whole: Column) -> Column:
    return ratio(cents(part) * 100, cents(whole))


def money_mean(total: Column, rows: Column) -> Column:
    return ratio(cents(total), rows * 100)


def month_number(ts: Column) -> Column:
    """Months since year 0: an integer key that sorts, subtracts and shuffles cheaply."""
    return F.year(ts) * 12 + F.month(ts) - 1


def month_label(number: Column) -> Column:
    year = F.floor(number / 12).cast("int").cast("string")
    month = (number % 12 + 1).cast("string")
    return F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"))


def month_start(number: Column) -> Column:
    return F.make_date(F.floor(number / 12).cast("int"), number % 12 + 1, F.lit(1))


def category_name() -> Column:
    return F.coalesce(
        "product_category_name_english", "product_category_name", F.lit("Unknown")
    )


def is_late() -> Column:
    """Delivered after the estimate, to the second; NULL if either time is missing."""
    return F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date")


def count_where(condition: Column) -> Column:
    return F.count_if(condition)

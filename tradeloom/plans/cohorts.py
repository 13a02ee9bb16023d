"""Monthly cohorts: people by the month of their first delivered order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.functions.columns import DELIVERED, month_label, month_number, percent
from tradeloom.operators import bitmaps
from tradeloom.operators.rollup import with_customer
from tradeloom.tables import Tables

LAST_INDEX = 6


def _delivered_months(t: Tables) -> DataFrame:
    month = month_number(F.col("order_purchase_timestamp")).alias("month_no")
    return t["orders"].where(F.col("order_status") == DELIVERED).select("customer_id", month)


def _person() -> Column:
    return F.col("customer_unique_id").alias("person")


def _people(t: Tables) -> DataFrame:
    return t["customers"].select("customer_id", _person())


def first_purchase(t: Tables) -> DataFrame:
    per_customer = with_customer(t, _delivered_months(t), [_person()], F.min("month_no").alias("first"))
    return (
        per_customer.groupBy(F.col("person").alias("customer_id"))
        .agg(month_label(F.min("first")).alias("cohort_month"))
    )


#: Months of data up to which a person's months are a bitmap (40 years); dirty dates may exceed it.
_MOST_WORDS = 8


def _base_and_words(t: Tables) -> tuple[int, int]:
    """First month of the orders, and the words that a bitmap of their months needs."""
    first, last = t.once("order_months", _month_range)
    return first, (last - first) // bitmaps.WORD + 1


def _month_range(t: Tables) -> tuple[int, int]:
    month = month_number(F.col("order_purchase_timestamp"))
    return tuple(m or 0 for m in t["orders"].agg(F.min(month), F.max(month)).first())


def _month_sets(t: Tables, base: int, words: int) -> DataFrame:
    """(person, bitmap of active months, first, undated) of everyone with a delivered order.

    Orders are sets of months per customer id before they meet their person, and a set of one
    row per person after it: three exchanges, and a person with very many orders collapses on the
    map side both times.
    """
    undated = F.bool_or(F.col("month_no").isNull()).alias("undated")
    per_customer = with_customer(t, _delivered_months(t), [_person()], undated, *bitmaps.collected(f"month_no - {base}", words))
    sets = per_customer.groupBy("person").agg(F.bool_or("undated").alias("undated"), *bitmaps.merged(words))
    return sets.withColumn("first", bitmaps.lowest(words))


def _listed_months(t: Tables) -> DataFrame:
    """(person, month_no, first) of distinct months, for dates over more years than a bitmap holds."""
    months = _delivered_months(t).distinct().join(_people(t), "customer_id").select("person", "month_no").distinct()
    return months.withColumn("first", F.min("month_no").over(Window.partitionBy("person")))


def cohort_activity(t: Tables) -> DataFrame:
    """One row per person and active month; an order without a date counts as a month of its own."""
    base, words = _base_and_words(t)
    if words <= _MOST_WORDS:
        months = bitmaps.members(words)
        months = F.when(F.col("undated"), F.array_append(months, F.lit(None))).otherwise(months)
        active = _month_sets(t, base, words).select("person", (F.col("first") + base).alias("first"), F.explode(months).alias("p"))
        rows = active.select("person", "first", (F.col("p") + base).alias("month_no"))
    else:
        rows = _listed_months(t)
    return rows.select(
        F.col("person").alias("customer_id"),
        month_label(F.col("first")).alias("cohort_month"),
        month_label(F.col("month_no")).alias("order_month"),
        (F.col("month_no") - F.col("first")).alias("month_index"),
    )


def _cohort_counts(t: Tables) -> DataFrame:
    """(first, month_index, active, size) per cohort and index up to LAST_INDEX that has anyone."""
    base, words = _base_and_words(t)
    indexes = range(LAST_INDEX + 1)
    if words <= _MOST_WORDS:
        people = _month_sets(t, base, words).select("first", bitmaps.following("first", words, LAST_INDEX + 1).alias("months"))
        active = [F.expr(f"count_if(months & {1 << i} != 0)") for i in indexes]
        first = F.col("first") + base
    else:
        people, first = _listed_months(t), F.col("first")
        active = [F.expr(f"count_if(month_no = first + {i})") for i in indexes]
    counts = people.groupBy(first.alias("first")).agg(*(a.alias(f"a{i}") for i, a in enumerate(active)))
    stacked = F.expr(f"stack({len(indexes)}, {', '.join(f'{i}, a{i}' for i in indexes)}) AS (month_index, active)")
    return counts.select("first", F.col("a0").alias("size"), stacked).where("active > 0")


def cohort_size(t: Tables) -> DataFrame:
    return (
        _cohort_counts(t)
        .where(F.col("month_index") == 0)
        .select(month_label(F.col("first")).alias("cohort_month"), F.col("size").alias("cohort_customers"))
        .orderBy("cohort_month")
    )


def cohort_retention(t: Tables) -> DataFrame:
    return (
        _cohort_counts(t)
        .select(
            month_label(F.col("first")).alias("cohort_month"),
            F.col("size").alias("cohort_customers"),
            "month_index",
            F.col("active").alias("active_customers"),
            percent(F.col("active"), F.col("size")).alias("retention_rate_pct"),
        )
        .orderBy("cohort_month", "month_index")
    )


def avg_retention_by_month(t: Tables) -> DataFrame:
    """Plain mean over the cohorts that have anyone back at that index."""
    share = (F.col("active") * 100.0 / F.col("size")).cast("decimal(20,10)")
    return (
        _cohort_counts(t)
        .where(F.col("month_index") > 0)
        .groupBy("month_index")
        .agg(F.round(F.avg(share), 2).alias("avg_retention_pct"))
        .orderBy("month_index")
    )

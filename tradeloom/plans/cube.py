"""A cube from which the measures follow in any filter context, without reading the facts again.

Sums add up over cells; counts of different orders and people do not. The cube therefore holds sets:
orders and people get dense numbers, and per cell the numbers are bits of 60-bit words, which
`bit_or` merges over any cells. Numbers follow the attributes that an order (or a person) has only
one of, so neighbours in a word mostly share their cell, and words that hold nothing do not exist.

One table: `kind` is "lines" (sums per cell), "orders" or "people" (a word per row). Rows number at
most the order lines; most cells share words of 60.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.functions.columns import money_mean, month_label, month_number, ratio
from tradeloom.operators.bitmaps import WORD
from tradeloom.operators.scratch import written
from tradeloom.operators.sizing import dealt, tasks_for, within
from tradeloom.operators.skew import find_hot_keys, lookup_join
from tradeloom.plans import star
from tradeloom.tables import Tables

DIMENSIONS = ("order_month", "customer_state", "category", "seller_state")
_OF_ORDER, _OF_PERSON = ("order_month", "customer_state"), ("customer_state",)
_ROWS_PER_BUCKET = 200_000
_SUMS = ("revenue", "lines", "late")
_SETS = ("bits", "repeated")


@dataclass(frozen=True)
class Cube:
    rows: DataFrame
    dimensions: tuple[str, ...]

    def measures(self, *by: str, where: Column | str | None = None) -> DataFrame:
        """All measures per value of `by` over the cells that `where` keeps: two shuffles of cells."""
        rows = self.rows if where is None else self.rows.where(where)
        merged = rows.groupBy(*by, "kind", "word").agg(
            *(F.sum(c).alias(c) for c in _SUMS), *(F.bit_or(c).alias(c) for c in _SETS)
        )
        held = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.bit_count(c))), F.lit(0))
        totals = merged.groupBy(*by).agg(
            *(F.sum(c).alias(c) for c in _SUMS), held("orders", "bits").alias("orders"),
            held("people", "bits").alias("people"), held("people", "repeated").alias("repeated"),
        )
        return totals.select(
            *by, F.col("revenue").alias("total_revenue"), "orders", "people",
            money_mean(F.col("revenue"), F.col("orders")).alias("avg_order_value"),
            ratio(F.col("repeated"), F.col("people"), 4).alias("retention_rate"),
            ratio(F.col("late"), F.col("lines"), 4).alias("late_rate"),
        )


def _cells(t: Tables, dimensions: tuple[str, ...]) -> DataFrame:
    """Facts per order and cell, written: a hot order is one row per cell before it meets its person."""
    fact, shuffled = star.fact_sales(t), False
    for dimension, key, column in ((star.dim_product, "product_id", "category"), (star.dim_seller, "seller_id", "seller_state")):
        if column in dimensions:
            side = dimension(t).select(key, column)
            shuffled |= not within(side, "spark.tradeloom.broadcastBytes")
            fact = lookup_join(fact, side, key, lambda k=key: t.hot("order_items", k), ["order_id"], "left", sized=True)
    if shuffled and not t.hot("order_items", "order_id"):
        fact = dealt(fact, tasks_for(fact), "order_id")
    fact = fact.withColumn("order_month", month_label(month_number(F.col("order_date"))))
    fact = fact.withColumn("repeats", F.col("order_count") > 1)
    own = [d for d in dimensions if d != "customer_state"]
    cells = fact.groupBy("order_id", "customer_id", "repeats", *own).agg(
        F.sum("revenue").alias("revenue"), F.count("*").alias("lines"), F.sum("is_late").alias("late")
    )
    if "customer_state" in dimensions:
        people = star.dim_customer(t).select("customer_id", "customer_state")
        cells = lookup_join(cells, people, "customer_id", lambda: find_hot_keys(cells, "customer_id"), ["order_id"], "left", sized=True)
    return written(cells, "cube_cells")


def _numbered(rows: DataFrame, key: str, first: list[str]) -> DataFrame:
    """`rows` with the word and bit of each key; keys are numbered in hashed buckets."""
    rows = rows.where(F.col(key).isNotNull())
    buckets = max(1, math.ceil(rows.count() / _ROWS_PER_BUCKET))
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    if buckets > rows.sparkSession.sparkContext.defaultParallelism:
        bucketed = dealt(bucketed, buckets, "bucket")
    number = F.dense_rank().over(Window.partitionBy("bucket").orderBy(*first, key)) - 1
    numbered = bucketed.withColumn("number", number)
    bit = F.expr(f"shiftleft(1L, CAST(number % {WORD} AS INT))")
    word = F.expr(f"shiftleft(CAST(bucket AS BIGINT), 32) + number DIV {WORD}")
    return numbered.withColumn("word", word).withColumn("bit", bit)


def build(t: Tables, dimensions: tuple[str, ...] = DIMENSIONS) -> Cube:
    """The cube of the facts over some of the DIMENSIONS, written to scratch."""
    cells = _cells(t, dimensions)
    none = F.lit(0).cast("long")
    orders = _numbered(cells, "order_id", [d for d in _OF_ORDER if d in dimensions])
    # A person with very many orders collapses before the shuffle; without one, tasks are sized.
    tasks = None if find_hot_keys(cells, "customer_id") else tasks_for(cells)
    persons = dealt(cells, tasks, "customer_id", *dimensions).groupBy("customer_id", "repeats", *dimensions).agg(F.lit(1).alias("one"))
    people = _numbered(written(persons, "cube_people"), "customer_id", [d for d in _OF_PERSON if d in dimensions])
    own = lambda kind: F.lit(kind).alias("kind")
    lines = cells.groupBy(*dimensions).agg(*(F.sum(c).alias(c) for c in _SUMS))
    parts = [lines.select(*dimensions, own("lines"), F.lit(None).cast("long").alias("word"), *_SUMS, none.alias("bits"), none.alias("repeated"))]
    for kind, rows, repeated in (("orders", orders, none), ("people", people, F.when(F.col("repeats"), F.col("bit")).otherwise(none))):
        # A word lies in one bucket: grouped by both, words are merged where they were numbered.
        words = rows.groupBy(*dimensions, "bucket", "word").agg(F.bit_or("bit").alias("bits"), F.bit_or(repeated).alias("repeated"))
        empty = [F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in _SUMS]
        parts.append(words.select(*dimensions, own(kind), "word", *empty, *_SETS))
    return Cube(written(parts[0].unionByName(parts[1]).unionByName(parts[2]), "cube"), dimensions)


def bi_measures(t: Tables, category: str) -> DataFrame:
    """The measures in three contexts of one cube: overall, by category, and of one category by
    state and month."""
    dimensions = ("order_month", "customer_state", "category")
    cube = build(t, dimensions)
    contexts = [
        ("overall", cube.measures()),
        ("by category", cube.measures("category")),
        ("one category", cube.measures("customer_state", "order_month", where=F.col("category") == category)),
    ]
    filled = []
    for name, found in contexts:
        own = [F.col(d) if d in found.columns else F.lit(None).cast("string").alias(d) for d in dimensions]
        rest = [c for c in found.columns if c not in dimensions]
        filled.append(found.select(F.lit(name).alias("context"), *own, *rest))
    return filled[0].unionByName(filled[1]).unionByName(filled[2])

"""Numbering, ranks and running sums over all rows of a table, without a task that sees them all.

The rows are cut into ranges of the order, numbered and summed inside their range, and then shifted
by what the ranges before add up to. One shuffle brings the rows of a range together; only one row
per range, at most MOST_PARTS, meets in a single task.

Range borders come from a sample chosen by a hash. They decide how even the ranges are, never the
result. A value shared by very many rows is split over ranges by the tie-breaking id, and its rank
is carried from the range in which its run of rows begins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.operators.ordering import Order
from tradeloom.operators.scratch import written

ROWS_PER_PART = 1_000_000
MOST_PARTS = 1024
_SAMPLES_PER_PART = 64

_KEY, _PART, _VALUE = "_key", "_part", "_value"
_LOCAL = ["_row", "_rank", "_dense", "_running"]


def _borders(keyed: DataFrame, rows: int, parts: int) -> list[tuple]:
    """Keys that cut the rows into about equal ranges, ascending and distinct."""
    share = max(1, rows // (parts * _SAMPLES_PER_PART))
    sample = keyed.where(F.pmod(F.xxhash64(_KEY), F.lit(share)) == 0)
    in_order = sample.select(_KEY).distinct().orderBy(_KEY).collect()
    step = len(in_order) / parts
    at = sorted({int(step * i) for i in range(1, parts)})
    return [tuple(in_order[i][0]) for i in at if i < len(in_order)]


def _part_of(key: Column, borders: list[Column]) -> Column:
    """How many borders lie before the key: a tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key <= borders[middle], tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(borders))


def ranked(df: DataFrame, order: Order, summed: str, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """`df` with row_number, rank, dense_rank, running_sum and total_sum by `order`.

    As SQL's ROW_NUMBER, RANK, DENSE_RANK (of the ordered value alone), SUM over the rows up to
    this one, and SUM over all. `order` breaks ties by a unique id. `df` is scanned several times,
    so it should be a table on storage.
    """
    parts = order.parts()
    keyed = df.withColumn(_KEY, F.struct(*(p.alias(n) for p, n in zip(parts, "fvt", strict=True))))
    rows = df.count()
    count = min(MOST_PARTS, math.ceil(rows / rows_per_part))
    borders = _borders(keyed, rows, count) if count > 1 else []
    types = [field.dataType for field in keyed.schema[_KEY].dataType]
    literals = [F.struct(*(F.lit(v).cast(t).alias(n) for v, t, n in zip(b, types, "fvt", strict=True))) for b in borders]
    cut = keyed.withColumn(_PART, _part_of(F.col(_KEY), literals)).withColumn(_VALUE, F.col(_KEY)["v"])

    in_part = Window.partitionBy(_PART).orderBy(_KEY)
    by_value = Window.partitionBy(_PART).orderBy(F.struct(F.col(_KEY)["f"], F.col(_KEY)["v"]))
    running = in_part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.select(
        *df.columns, _PART, _VALUE, F.row_number().over(in_part).alias("_row"), F.rank().over(by_value).alias("_rank"),
        F.dense_rank().over(by_value).alias("_dense"), F.sum(summed).over(running).alias("_running"),
    )
    local = written(local, "ranked")
    found = local.join(F.broadcast(_offsets(local, summed)), _PART)

    carried = F.col("continues") & (F.col("_dense") == 1)
    nothing = F.col("_running").isNull() & F.col("sum_before").isNull()
    zero = F.lit(0)
    return found.select(
        *df.columns,
        (F.col("rows_before") + F.col("_row")).alias("row_number"),
        F.when(carried, F.col("carried")).otherwise(F.col("rows_before") + F.col("_rank")).alias("rank"),
        (F.col("values_before") + F.col("_dense")).alias("dense_rank"),
        F.when(~nothing, F.coalesce("_running", zero) + F.coalesce("sum_before", zero)).alias("running_sum"),
        "total_sum",
    )


def _offsets(local: DataFrame, summed: str) -> DataFrame:
    """One row per range: what comes before it, and where the run of its first value begins."""
    per_part = local.groupBy(_PART).agg(
        F.count("*").alias("rows"), F.sum(summed).alias("sum"), F.max("_dense").alias("values"), F.max("_rank").alias("last_start"),
        F.min_by(F.struct(_VALUE), "_row").alias("first_value"), F.max_by(F.struct(_VALUE), "_row").alias("last_value"),
    )
    in_order = Window.orderBy(_PART)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    continues = F.coalesce(F.lag("last_value").over(in_order).eqNullSafe(F.col("first_value")) & F.lag(_PART).over(in_order).isNotNull(), F.lit(False))
    placed = per_part.select(
        "*", continues.alias("continues"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("sum").over(before).alias("sum_before"), F.sum("sum").over(Window.partitionBy()).alias("total_sum"),
    )
    # The run of the last value begins in this range unless the range holds that value alone and continues.
    begins = F.when(~(F.col("continues") & (F.col("values") == 1)), F.col("rows_before") + F.col("last_start"))
    again = F.col("continues").cast("int")
    return placed.select(
        _PART, "continues", "rows_before", "sum_before", "total_sum", F.last(begins, ignorenulls=True).over(before).alias("carried"),
        (F.coalesce(F.sum(F.col("values") - again).over(before), F.lit(0)) - again).alias("values_before"),
    )

"""Joins that stay balanced when one key holds a large share of the rows.

Most reports never need this: they aggregate to the join key first (partial aggregation
collapses a hot key on the map side), so both join inputs hold each key once. Where rows
have to keep their grain, `spread_join` splits the hot keys.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeloom.operators.sizing import dealt, tasks_for, within

SALT = "_salt"
_SPLITS = "_splits"
_SAMPLE_ROWS = 2_000_000
_MIN_SHARE = 1 / 1000  # at most 1000 keys can reach it, so the list is bounded


@dataclass(frozen=True)
class HotKeys:
    """(key, splits) rows, at most 1000 of them, plus the splits for NULL keys."""

    splits: DataFrame | None = None
    null_splits: int = 1

    def __bool__(self) -> bool:
        return self.splits is not None or self.null_splits > 1


NO_HOT_KEYS = HotKeys()


def find_hot_keys(df: DataFrame, key: str) -> HotKeys:
    """Heavy keys of `df`, from a row sample.

    The sample only decides how rows are spread; join results do not depend on it.
    The list is fixed on the driver so that both join sides see the same splits even if
    a task is run again.
    """
    spark = df.sparkSession
    if within(df, "spark.tradeloom.skewMinBytes"):
        return NO_HOT_KEYS
    rows = df.count()
    fraction = min(1.0, _SAMPLE_ROWS / max(rows, 1))
    counts = df.select(key).sample(fraction, seed=7).groupBy(key).count()
    return hot_keys_from_counts(counts, key, "count", rows * fraction)


def hot_keys_from_counts(counts: DataFrame, key: str, rows: str, total: float) -> HotKeys:
    """The keys whose `rows` are a large share of `total`, with splits to even them out."""
    spark = counts.sparkSession
    heavy = counts.where(F.col(rows) > total * _MIN_SHARE).select(key, rows).collect()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splits = {r[key]: math.ceil(r[rows] / total * partitions) + 1 for r in heavy}
    null_splits = splits.pop(None, 1)
    if not splits:
        return HotKeys(None, null_splits)
    schema = T.StructType([counts.schema[key], T.StructField(_SPLITS, T.IntegerType())])
    return HotKeys(spark.createDataFrame(list(splits.items()), schema), null_splits)


def spread_join(
    rows: DataFrame,
    side: DataFrame,
    key: str,
    hot: HotKeys,
    spread_by: list[str],
    how: str = "inner",
    side_tasks: int | None = None,
    sized: bool = True,
) -> DataFrame:
    """Join `rows` to `side` (one row per key), splitting hot keys over several tasks.

    Each row of a hot key gets a salt from the hash of `spread_by`, which is the same on
    every attempt of a task; the few hot rows of `side` are repeated once per salt. The
    result keeps the salt column, `SALT`, so that later grouping can reuse the partitioning. The
    number of tasks grows with `rows` if it is `sized`, so that what one of them holds does not;
    `side_tasks` says that `side` has been dealt to so many by its key, and `rows` then go to as many.
    """
    tasks = side_tasks or (tasks_for(rows) if sized else None)
    if not hot:
        met = side if side_tasks == tasks else dealt(side, tasks, key)
        return dealt(rows, tasks, key).join(met, key, how)
    spread = F.xxhash64(*spread_by)
    splits: Column = F.lit(1)
    if hot.splits is not None:
        lookup = F.broadcast(hot.splits)
        rows = rows.join(lookup, key, "left")
        side = side.join(lookup, key, "left")
        splits = F.coalesce(F.col(_SPLITS), F.lit(1))
    rows_salt = F.when(F.col(key).isNull(), F.pmod(spread, F.lit(hot.null_splits))).otherwise(
        F.pmod(spread, splits)
    )
    rows = rows.withColumn(SALT, rows_salt.cast("int")).drop(_SPLITS)
    side = side.withColumn(SALT, F.explode(F.sequence(F.lit(0), splits - 1))).drop(_SPLITS)
    return dealt(rows, tasks, key, SALT).join(dealt(side, tasks, key, SALT), [key, SALT], how)


def lookup_join(
    rows: DataFrame,
    side: DataFrame,
    key: str,
    hot: Callable[[], HotKeys],
    spread_by: list[str],
    how: str = "inner",
    sized: bool = False,
) -> DataFrame:
    """Broadcast `side` if its checked size allows, else shuffle with hot keys split.

    `sized` has the number of tasks grow with `rows`; otherwise adaptive execution may split tasks.
    """
    if within(side, "spark.tradeloom.broadcastBytes"):
        return rows.join(F.broadcast(side), key, how)
    return spread_join(rows, side, key, hot(), spread_by, how, sized=sized).drop(SALT)

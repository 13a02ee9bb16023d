"""Size checks that choose between a small-data and a distributed plan."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

MB = 1024 * 1024

# Session settings that move the limits, with their defaults in bytes of scanned input.
LIMITS = {
    "spark.tradeloom.broadcastBytes": 32 * MB,  # sides up to this size may be broadcast
    "spark.tradeloom.skewMinBytes": 1024 * MB,  # below this a hot key cannot hurt
}

# Scanned bytes for each task of a join or an aggregation by key (`spark.tradeloom.taskBytes`).
_TASK_BYTES = 8 * MB
_UNKNOWN_BYTES = 1 << 55
_MOST_TASKS = 100_000  # beyond it tasks grow, and spill, but the driver can still list them


def limit(spark: SparkSession, name: str) -> int:
    return int(spark.conf.get(name, str(LIMITS[name])))


def input_bytes(df: DataFrame) -> int:
    """Bytes of all files and local rows the plan reads, known without running a job.

    Sums the leaves: the optimizer's own estimate multiplies both sides of a join.
    """
    return sum(_leaf_bytes(df))


def _leaf_bytes(df: DataFrame) -> list[int]:
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]


def within(df: DataFrame, name: str) -> bool:
    return input_bytes(df) <= limit(df.sparkSession, name)


def tasks_for(df: DataFrame, *others: DataFrame) -> int | None:
    """How many tasks `df` needs after a shuffle, None if one for each core is enough; with `others`,
    how many they all need where they meet.

    Compressed columns grow to many times their size in a hash map or a sort. The session's number
    of shuffle partitions does not grow with the input, and adaptive execution merges them by
    compressed size, so a task's memory would. Leaves of unknown size are lists from the driver.
    """
    spark = df.sparkSession
    scanned = sum(b for each in (df, *others) for b in _leaf_bytes(each) if b < _UNKNOWN_BYTES)
    needed = math.ceil(scanned / int(spark.conf.get("spark.tradeloom.taskBytes", str(_TASK_BYTES))))
    if needed <= spark.sparkContext.defaultParallelism:
        return None
    return max(min(needed, _MOST_TASKS), int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """`df` shuffled by its keys to that many tasks; a join or an aggregation by these keys, or by
    more, then takes place in these tasks. Both sides of a join need the same number."""
    return df if tasks is None else df.repartition(tasks, *keys)

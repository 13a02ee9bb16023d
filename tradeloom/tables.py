"""The set of input tables a report reads, built on first use."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Mapping
from threading import RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.operators.scratch import discard, scratch_path
from tradeloom.operators.skew import HotKeys, find_hot_keys


class Tables:
    """Lazy name -> DataFrame mapping that also remembers which keys are hot."""

    def __init__(
        self, spark: SparkSession, loaders: Mapping[str, Callable[[], DataFrame]], rows: Mapping[str, Callable[[], int]] | None = None
    ):
        self.spark = spark
        self._rows = dict(rows or {})
        self._loaders = dict(loaders)
        self._frames: dict[str, DataFrame] = {}
        self._hot: dict[tuple[str, str], HotKeys] = {}
        self._facts: dict[str, object] = {}
        self._shared: dict[str, tuple[DataFrame, str]] = {}
        self._readers: Counter[str] = Counter()
        self._locks: dict[str, RLock] = {}
        self._lock = RLock()

    @classmethod
    def of(cls, spark: SparkSession, **frames: DataFrame) -> Tables:
        return cls(spark, {name: (lambda df=df: df) for name, df in frames.items()})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._loaders[name]()
        return self._frames[name]

    def __contains__(self, name: str) -> bool:
        return name in self._loaders

    def names(self) -> list[str]:
        return list(self._loaders)

    def row_count(self, table: str) -> DataFrame:
        """One row with the table's number of rows: known from its metadata, or counted."""
        if table in self._rows:
            return self.spark.range(1).select(F.lit(self._rows[table]()).cast("long").alias("row_count"))
        return self[table].agg(F.count("*").alias("row_count"))

    def hot(self, table: str, key: str) -> HotKeys:
        """Keys that hold an outsized share of a table's rows (looked up once)."""
        if (table, key) not in self._hot:
            self._hot[table, key] = find_hot_keys(self[table], key)
        return self._hot[table, key]

    def _lock_of(self, name: str) -> RLock:
        with self._lock:
            return self._locks.setdefault(name, RLock())

    def once(self, name: str, find: Callable[[Tables], object]):
        """What is found out about the tables by a job, looked up once."""
        with self._lock_of(name):
            if name not in self._facts:
                self._facts[name] = find(self)
            return self._facts[name]

    def shared(self, name: str, make: Callable[[Tables], DataFrame], always: bool = False) -> DataFrame:
        """A frame that several reports read.

        With several readers in a run (`expect`), or `always`, it is computed once and written to
        scratch. Every name has its own lock, so a report waits only for what it reads. A single
        report otherwise gets the plan, but the last reader of a run still gets what is written.
        """
        if not always and self._readers[name] < (1 if name in self._shared else 2):
            return make(self)
        with self._lock_of(name):
            if name not in self._shared:
                path = scratch_path(self.spark, name)
                made = make(self)
                made.write.parquet(path)
                self._shared[name] = self.spark.read.schema(made.schema).parquet(path), path
            return self._shared[name][0]

    def expect(self, readers: Iterable[str]) -> None:
        """Begin a run in which the shared frames have these readers, one mention each."""
        self._readers = Counter(readers)

    def read_by_one(self, names: Iterable[str]) -> None:
        """A reader of these frames is done; after its last reader a frame's files are deleted."""
        for name in names:
            with self._lock_of(name):
                self._readers[name] -= 1
                if self._readers[name] <= 0:
                    self._facts.pop(name, None)
                    _, path = self._shared.pop(name, (None, None))
                    if path:
                        discard(self.spark, path)

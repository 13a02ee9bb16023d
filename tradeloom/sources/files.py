"""Table folders: where they are, and how they are written and read."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeloom.functions.columns import month_label, month_number
from tradeloom.schemas import TABLES, TableSpec
from tradeloom.sources import snapshots
from tradeloom.sources.snapshots import FATE, LOADED
from tradeloom.tables import Tables

_CONCURRENT = 4
ORDER_MONTH = "order_month"
BUCKETED = ("orders", "order_items", "order_payments", "order_reviews")


def find(spark: SparkSession, pattern: str) -> list[str]:
    """Existing paths that match, on whatever file system the pattern names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in system.globStatus(path) or [])


def table_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def stored_schema(name: str) -> T.StructType:
    """The columns of a stored table: the declared ones and, of orders, the month."""
    month = [T.StructField(ORDER_MONTH, T.StringType())] if name == "orders" else []
    return T.StructType([*TABLES[name].schema.fields, *month])


def is_stored(spark: SparkSession, folder: str, name: str) -> bool:
    path = table_path(folder, name)
    return snapshots.current(spark, path) is not None or snapshots.is_plain(spark, path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The current version of a stored table, or a plain folder of Parquet files."""
    path = table_path(folder, name)
    seen = snapshots.current(spark, path)
    if seen is None:
        if not snapshots.is_plain(spark, path):
            raise FileNotFoundError(f"no table {path}")
        return spark.read.parquet(path)
    return snapshots.read(spark, path, seen, stored_schema(name))


def read_between(spark: SparkSession, folder: str, name: str, least: str | None, greatest: str | None) -> DataFrame:
    """Rows whose first key column lies between two values; loads without such keys are not read."""
    path, key = table_path(folder, name), TABLES[name].key[0]
    seen = snapshots.current(spark, path)
    if seen is None:
        rows = read_table(spark, folder, name)
    else:
        rows = snapshots.read(spark, path, seen, stored_schema(name), (least, greatest))
    return rows.where(F.lit(least is not None) & F.col(key).between(least, greatest))


def count_rows(spark: SparkSession, folder: str, name: str) -> int:
    """Rows of a stored table: of its version, or of a plain folder from the footers of its files."""
    path = table_path(folder, name)
    seen = snapshots.current(spark, path)
    return seen.rows if seen is not None else footer_count(spark, path).first()["row_count"]


def footer_count(spark: SparkSession, path: str) -> DataFrame:
    """A count that Parquet footers answer, planned in a session of its own."""
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session.read.parquet(path).agg(F.count("*").alias("row_count"))


def load(spark: SparkSession, folder: str) -> Tables:
    return Tables(
        spark,
        {name: (lambda n=name: read_table(spark, folder, n)) for name in TABLES},
        {name: (lambda n=name: count_rows(spark, folder, n)) for name in TABLES},
    )


def with_month(df: DataFrame) -> DataFrame:
    month = month_label(month_number(F.col("order_purchase_timestamp")))
    return df.withColumn(ORDER_MONTH, month)


def write_load(df: DataFrame, path: str, name: str) -> None:
    """The files of one load, in a folder per fate and, of orders, per purchase month.

    The rebalance gives each month few files and splits a month that is too large for one.
    """
    split = [FATE]
    if name == "orders":
        split = [FATE, ORDER_MONTH]
        df = with_month(df).hint("rebalance", *split)
    df.write.option("compression", "zstd").partitionBy(*split).parquet(path)


def replace_table(df: DataFrame, folder: str, name: str) -> snapshots.Snapshot:
    """Store `df` as the whole table; readers see the old rows until all new ones are written."""
    spark, table = df.sparkSession, table_path(folder, name)
    seen = snapshots.current(spark, table)
    path = snapshots.new_load(table, seen)
    write_load(df.withColumn(FATE, F.lit(LOADED)), path, name)
    load = snapshots.described(spark, path, stored_schema(name), TABLES[name].key[0])
    return snapshots.publish(spark, table, seen, (load,))


def save(t: Tables, folder: str) -> None:
    """Tables are independent jobs, so a few are stored at a time and share the executors."""

    def store(spec: TableSpec) -> None:
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in spec.schema]
        replace_table(t[spec.name].select(*columns), folder, spec.name)

    with ThreadPoolExecutor(_CONCURRENT) as pool:
        list(pool.map(store, TABLES.values()))


def save_bucketed(t: Tables, prefix: str, buckets: int) -> None:
    """Catalogue tables with the order tables bucketed by order, to join without a shuffle.

    A bucket is read by one task, so a table in which an order is hot stays unbucketed and
    its joins shuffle.
    """
    for name in TABLES:
        writer = t[name].write.mode("overwrite").format("parquet")
        if name in BUCKETED and not t.hot(name, "order_id"):
            rows = t[name].repartition(buckets, "order_id")
            writer = rows.write.mode("overwrite").format("parquet")
            writer = writer.bucketBy(buckets, "order_id").sortBy("order_id")
        writer.saveAsTable(f"{prefix}{name}")


def load_bucketed(spark: SparkSession, prefix: str) -> Tables:
    return Tables(
        spark, {name: (lambda n=name: spark.table(f"{prefix}{n}")) for name in TABLES}
    )

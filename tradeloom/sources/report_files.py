"""Reports written as CSV, one by one or as a full run."""

from __future__ import annotations

import logging
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.operators.scratch import discard, scratch_path
from tradeloom.plans.catalog import READERS, RUN, Report
from tradeloom.tables import Tables

_CONCURRENT = 4
_AT = "_report_position"
_LOG = logging.getLogger(__name__)


def write_report(report: DataFrame, path: str) -> int:
    """Write a bounded report as the one CSV file `path`, with a header.

    The rows are computed once, by as many tasks as they take, and only the finished rows meet in
    one file, in the order of the report; catalogue reports have at most a row per month and
    cohort, state, category or listed seller. The file is finished under another name and then
    renamed, so an older one stays until it is replaced. An empty report removes it.
    """
    spark = report.sparkSession
    kept, staged = scratch_path(spark, "report"), f"{path}.{uuid.uuid4().hex}"
    rows = report.withColumn(_AT, F.monotonically_increasing_id())
    rows.write.parquet(kept)
    try:
        rows = spark.read.schema(rows.schema).parquet(kept)
        count = rows.count()
        if not count:
            discard(spark, path)
            return 0
        writer = rows.orderBy(_AT).drop(_AT).coalesce(1).write
        writer.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(staged, header=True)
        _replace(spark, staged, path)
        return count
    finally:
        discard(spark, kept)
        discard(spark, staged)


def _replace(spark: SparkSession, staged: str, path: str) -> None:
    """Rename the one data file in a folder to `path`, over an older file."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(target) and system.getFileStatus(target).isDirectory():
        discard(spark, path)  # a folder of part files, as earlier versions wrote
    (part,) = [s.getPath() for s in system.globStatus(hadoop.Path(f"{staged}/part-*"))]
    options = spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(part, system.makeQualified(target), options)


def write_wide_report(report: DataFrame, path: str) -> None:
    """Write a report of customer or seller grain as Parquet, in as many files as it has tasks."""
    report.write.mode("overwrite").parquet(path)


def run_all_reports(t: Tables, folder: str) -> DataFrame:
    """Write every report and key answer to `<folder>/<prefix>_q<position>.csv`; list what happened.

    A failing report does not stop the others. Reports are independent jobs, so a few run at
    a time and share the executors. Frames with several readers are computed once, and deleted
    after the last one.
    """
    work = [
        (f"{prefix}_q{position}.csv", report)
        for prefix, reports in RUN.items()
        for position, report in enumerate(reports, start=1)
    ]

    def run(item: tuple[str, Report]) -> tuple[str, str, str, int]:
        file, report = item
        try:
            rows = write_report(report(t), f"{folder.rstrip('/')}/{file}")
            return file, report.__name__, "written" if rows else "no rows", rows
        except Exception as error:
            _LOG.exception("report %s failed", file)
            return file, report.__name__, f"error: {type(error).__name__}: {error}"[:500], 0
        finally:
            t.read_by_one(reads[report.__name__])

    names = {report.__name__ for _, report in work}
    reads = {n: [frame for frame, readers in READERS.items() if n in readers] for n in names}
    t.expect(frame for frame, readers in READERS.items() for r in readers if r in names or r in READERS)
    with ThreadPoolExecutor(_CONCURRENT) as pool:
        results = list(pool.map(run, work))
    t.read_by_one(frame for frame, readers in READERS.items() for r in readers if r in READERS)
    t.expect(())
    return t.spark.createDataFrame(
        results, "file string, report string, status string, row_count bigint"
    )

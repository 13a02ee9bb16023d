"""Job entries for spark-submit.

spark-submit tradeloom/jobs.py load SOURCE TARGET
spark-submit tradeloom/jobs.py run TABLES RESULTS
spark-submit tradeloom/jobs.py report TABLES RESULT NAME
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tradeloom.operators.scratch import clear_scratch  # noqa: E402
from tradeloom.plans import catalog  # noqa: E402
from tradeloom.sources import files, ingest  # noqa: E402
from tradeloom.sources.report_files import run_all_reports, write_wide_report  # noqa: E402


def _arguments(words: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tradeloom.jobs")
    jobs = parser.add_subparsers(dest="job", required=True)
    load = jobs.add_parser("load", help="CSV files into typed tables")
    load.add_argument("source")
    load.add_argument("target")
    run = jobs.add_parser("run", help="all reports and key answers as CSV")
    run.add_argument("tables")
    run.add_argument("results")
    report = jobs.add_parser("report", help="one report of any size as Parquet")
    report.add_argument("tables")
    report.add_argument("result")
    report.add_argument("name", choices=sorted(catalog.reports()))
    return parser.parse_args(words)


def run(spark: SparkSession, words: list[str]) -> DataFrame | None:
    """Do one job; what load and run return says what happened to each table or report."""
    given = _arguments(words)
    if given.job == "load":
        return ingest.load_folder(spark, given.source, given.target)
    tables = files.load(spark, given.tables)
    if given.job == "run":
        return run_all_reports(tables, given.results)
    write_wide_report(catalog.reports()[given.name](tables), given.result)
    return None


def main() -> int:
    spark = SparkSession.builder.appName("tradeloom").getOrCreate()
    found = run(spark, sys.argv[1:])
    failed = 0
    if found is not None:
        found.show(100, truncate=False)
        failed = found.where("status LIKE 'error%'").count()
    clear_scratch(spark)
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())

from __future__ import annotations

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL, as_set, rows
from tests.test_skew import plan, skewed
from tradeloom.operators.scratch import _own_folder, clear_scratch
from tradeloom.plans import catalog, customers, exploration, revenue, sellers, star
from tradeloom.schemas import TABLES
from tradeloom.sources import files, orderlines, snapshots
from tradeloom.sources.report_files import run_all_reports, write_report
from tradeloom.tables import Tables


def test_month_folders_are_pruned(spark, tmp_path):
    t = orderlines.load(spark, SMALL)
    files.save(t, str(tmp_path))
    stored = files.load(spark, str(tmp_path))
    report = revenue.monthly_revenue_report(stored, "1997-01", "1997-03")
    assert as_set(report) == as_set(revenue.monthly_revenue_report(t, "1997-01", "1997-03"))
    assert "PartitionFilters: [isnotnull(order_month" in plan(report)
    assert "EqualTo(order_status,delivered)" in plan(report)


def test_row_counts_read_no_file(spark, tmp_path):
    t = orderlines.load(spark, SMALL)
    files.save(t, str(tmp_path / "stored"))
    stored = files.load(spark, str(tmp_path / "stored"))
    report = exploration.table_row_counts(stored)
    assert as_set(report) == as_set(exploration.table_row_counts(t))
    assert "FileScan" not in plan(report) and "BatchScan" not in plan(report)
    for name in ("orders", "sellers"):
        stored[name].write.parquet(str(tmp_path / "plain" / name))
        count = files.footer_count(spark, str(tmp_path / "plain" / name))
        assert "PushedAggregation: [COUNT(*)]" in plan(count)
        assert files.count_rows(spark, str(tmp_path / "plain"), name) == t[name].count()
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_bucketed_tables_join_without_a_shuffle(spark):
    t = orderlines.load(spark, SMALL)
    files.save_bucketed(t, "b_", 4)
    stored = files.load_bucketed(spark, "b_")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    text = plan(revenue.paid_orders(stored))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "Exchange" not in text
    assert as_set(revenue.paid_orders(stored)) == as_set(revenue.paid_orders(t))


def test_a_hot_order_keeps_its_table_unbucketed(spark, forced):
    files.save_bucketed(skewed(spark), "hot_", 4)
    detail = {
        name: {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED hot_{name}").collect()}
        for name in ("orders", "order_items")
    }
    assert "Num Buckets" in detail["orders"]
    assert "Num Buckets" not in detail["order_items"]


def test_run_all_reports(spark, tmp_path):
    found = rows(run_all_reports(orderlines.load(spark, SMALL), str(tmp_path)))
    assert len(found) == 30 and {r["status"] for r in found} == {"written"}
    for r in found:
        with open(f"{tmp_path}/{r['file']}", encoding="utf-8") as lines:
            assert sum(1 for _ in lines) == r["row_count"] + 1
    assert sorted(n for n in os.listdir(tmp_path) if not n.endswith(".crc")) == sorted(r["file"] for r in found)
    with open(f"{tmp_path}/02_exploration_q2.csv", encoding="utf-8") as lines:
        assert lines.read().splitlines()[1].startswith("1995-01-01 ")


def test_a_run_computes_shared_frames_once_and_leaves_no_scratch(spark, tmp_path, monkeypatch):
    made = []
    for module, name in ((customers, "rfm_base"), (sellers, "_seller_metrics"), (revenue, "_paid_orders")):
        original = getattr(module, name)

        def counted(t, *columns, original=original, name=name, **options):
            made.append(name)
            return original(t, *columns, **options)

        monkeypatch.setattr(module, name, counted)
    clear_scratch(spark)
    t = orderlines.load(spark, SMALL)
    found = rows(run_all_reports(t, str(tmp_path)))
    assert [r for r in found if r["status"] != "written"] == []
    assert sorted(made) == ["_paid_orders", "_seller_metrics", "rfm_base"]
    assert not [p for p in glob.glob(f"{_own_folder(spark)}/*")]
    assert not t._shared and not t._facts.get("rfm_base")


def test_the_last_reader_gets_the_shared_frame(spark):
    t, made = Tables.of(spark), []

    def make(_):
        made.append(1)
        return spark.range(3)

    t.expect(["few", "few"])
    for _ in range(2):
        assert t.shared("few", make).count() == 3
        t.read_by_one(["few"])
    assert made == [1] and not t._shared
    assert t.shared("few", make).count() == 3 and made == [1, 1] and not t._shared


def test_declared_readers_are_the_real_ones(spark, monkeypatch):
    t = orderlines.load(spark, SMALL)
    reports = [r for group in catalog.RUN.values() for r in group]
    asked = {}
    original = Tables.shared

    def noted(self, name, make, always=False):
        asked.setdefault(name, set()).add(current[-1])
        current.append(name)
        try:
            return original(self, name, make, always)
        finally:
            current.pop()

    monkeypatch.setattr(Tables, "shared", noted)
    for report in reports:
        current = [report.__name__]
        t._facts.pop("rfm_base", None)
        t._shared.clear()
        report(t)
    assert asked == {name: set(readers) for name, readers in catalog.READERS.items()}


def test_a_report_file_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "r.csv")
    two = spark.createDataFrame([(1, "a"), (2, 'b "q", c')], "k int, v string")
    assert write_report(two, path) == 2
    with open(path, encoding="utf-8") as file:
        assert file.read().splitlines()[0] == "k,v"
    broken = two.withColumn("k", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        write_report(broken, path)
    assert spark.read.csv(path, header=True).count() == 2  # the old one is still there
    assert write_report(two.limit(1), path) == 1 and spark.read.csv(path, header=True).count() == 1
    assert write_report(two.where("k > 5"), path) == 0
    assert [n for n in os.listdir(tmp_path) if not n.endswith(".crc")] == []


def test_a_failing_report_does_not_stop_the_run(spark, tmp_path):
    t = orderlines.load(spark, SMALL)
    frames = {name: t[name] for name in t.names() if name != "order_reviews"}
    found = {r["report"]: r["status"] for r in rows(run_all_reports(Tables.of(spark, **frames), str(tmp_path)))}
    assert found["review_score_distribution"].startswith("error")
    assert found["monthly_revenue_mom"] == "written"


def test_an_empty_report_is_not_written(spark, tmp_path):
    empty = spark.range(3).where(F.lit(False))
    assert write_report(empty, str(tmp_path / "none.csv")) == 0
    assert not (tmp_path / "none.csv").exists()


def _typed(t):
    """The test tables with the declared column types, as a load would store them."""
    def cast(name):
        return t[name].select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].schema))

    return Tables.of(t.spark, **{name: cast(name) for name in TABLES})


def test_write_star(spark, tmp_path):
    t = orderlines.load(spark, SMALL)
    star.write_star(t, str(tmp_path))
    read = star.read_star(spark, str(tmp_path))
    assert as_set(read["fact_sales"]) == as_set(star.fact_sales(t))
    for name in ("dim_customer", "dim_product", "dim_seller", "dim_date"):
        assert read[name].count() > 0


def test_a_month_is_refreshed_alone(spark, tmp_path):
    """Loads of three periods; in one month half of the orders come later, in another all are new."""
    t = _typed(orderlines.load(spark, SMALL))
    tables, out, full = (str(tmp_path / n) for n in ("tables", "star", "full"))
    month = F.date_format("order_purchase_timestamp", "yyyy-MM")
    odd = F.col("order_id").cast("long") % 2 == 1
    late = ((month == "1996-03") & odd) | (month == "1996-04")
    lines = t["order_items"].join(t["orders"].select("order_id", late.alias("late")), "order_id").where("late").drop("late")
    frames = {n: t[n] for n in TABLES}
    files.save(Tables.of(spark, **(frames | {"orders": t["orders"].where(~late), "order_items": t["order_items"].join(lines, "order_id", "left_anti").select(TABLES["order_items"].columns)})), tables)
    star.write_star(files.load(spark, tables), out)
    before = {n: _modified(f"{out}/fact_lines", n) for n in ("1996-02", "1996-03", "1996-05")}
    files.replace_table(t["orders"], tables, "orders")
    files.replace_table(t["order_items"], tables, "order_items")
    star.refresh_star(spark, tables, out, ["1996-03", "1996-04"])
    after = {n: _modified(f"{out}/fact_lines", n) for n in before}
    assert after["1996-02"] == before["1996-02"] and after["1996-05"] == before["1996-05"] and after["1996-03"] != before["1996-03"]
    star.write_star(files.load(spark, tables), full)
    got, wanted = star.read_star(spark, out), star.read_star(spark, full)
    for name in wanted:
        assert as_set(got[name]) == as_set(wanted[name]), name
    # A month without orders any more disappears.
    files.replace_table(t["orders"].where(month != "1996-04"), tables, "orders")
    star.refresh_star(spark, tables, out, ["1996-04"])
    star.write_star(files.load(spark, tables), full)
    assert as_set(star.read_star(spark, out)["fact_sales"]) == as_set(star.read_star(spark, full)["fact_sales"])


def _modified(folder, month):
    return sorted(glob.glob(f"{folder}/order_month={month}/part-*"))


def test_a_refresh_reads_only_the_lines_of_its_loads(spark, tmp_path):
    tables, out = str(tmp_path / "tables"), str(tmp_path / "star")
    t = _typed(orderlines.load(spark, SMALL))
    files.save(t, tables)
    # Lines as three loads by order id; ids of the refreshed month lie in the second.
    table = files.table_path(tables, "order_items")
    month = "1996-03"
    ids = [r[0] for r in t["orders"].where(F.date_format("order_purchase_timestamp", "yyyy-MM") == month).select("order_id").collect()]
    least, greatest = min(ids), max(ids)
    loads, key = [], F.col("order_id")
    for part in (key < least, key.between(least, greatest), key > greatest):
        path = snapshots.new_load(table, snapshots.current(spark, table))
        files.write_load(t["order_items"].where(part).withColumn(snapshots.FATE, F.lit(snapshots.LOADED)), path, "order_items")
        loads.append(snapshots.described(spark, path, files.stored_schema("order_items"), "order_id"))
    snapshots.publish(spark, table, snapshots.current(spark, table), tuple(loads))
    star.write_star(files.load(spark, tables), out)
    some = star.refresh_star(spark, tables, out, [month])
    assert all(loads[1].folder in f for f in some["order_items"].inputFiles())
    assert re.search(rf"PartitionFilters: \[[^]]*order_month#\d+ = {month}\)", plan(some["orders"]))
    assert as_set(star.read_star(spark, out)["fact_sales"]) == as_set(star.fact_sales(t))


def test_a_refresh_joins_the_lines_of_its_months_once_without_moving_them(spark, tmp_path, monkeypatch):
    tables, out = str(tmp_path / "tables"), str(tmp_path / "star")
    files.save(_typed(orderlines.load(spark, SMALL)), tables)
    star.write_star(files.load(spark, tables), out)
    joined, original = [], star._lines_with

    def noted(t, *given):
        joined.append(original(t, *given))
        return joined[-1]

    monkeypatch.setattr(star, "_lines_with", noted)
    star.refresh_star(spark, tables, out, ["1996-03"])
    assert len(joined) == 1 and "Exchange hashpartitioning" not in plan(joined[0])


def test_a_refresh_of_many_orders_moves_the_lines(spark, tmp_path, forced):
    tables, out = str(tmp_path / "tables"), str(tmp_path / "star")
    t = _typed(orderlines.load(spark, SMALL))
    files.save(t, tables)
    star.write_star(files.load(spark, tables), out)
    star.refresh_star(spark, tables, out, ["1996-03"])
    assert as_set(star.read_star(spark, out)["fact_sales"]) == as_set(star.fact_sales(t))

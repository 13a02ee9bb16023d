from __future__ import annotations

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tests.test_skew import plan
from tradeloom import jobs
from tradeloom.operators import bitmaps
from tradeloom.schemas import TABLES
from tradeloom.sources import files, ingest

KINDS = ("malformed", "without_key", "duplicate", "orphan", "stored", "loaded")
BOM = "﻿"
CUSTOMERS = (
    "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state,note\n"
    "c1,p1,01001,NA,SP,x\n"
    "c2,p2,,rio,RJ,x\n"
    "c1,p9,99999,late copy,XX,x\n"
)
ORDERS = (
    "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
    "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
    "o1,c1,delivered,2018-01-02 03:04:05,,,2018-01-09 00:00:00,2018-01-08 00:00:00\n"
    "o2,nobody,delivered,2018-01-02 03:04:05,,,,\n"
    "o3,c2,shipped,not a time,,,,\n"
    ",c2,shipped,2018-01-02 03:04:05,,,,\n"
)
PAYMENTS = (
    "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
    "o1,1,credit_card,2,10.505\n"
    "o1,2,voucher,one,abc\n"
)
REVIEWS = (
    "review_id,order_id,review_score,review_comment_title,review_comment_message,"
    "review_creation_date,review_answer_timestamp\n"
    'r1,o1,5,"said ""yes""","first line\nsecond, line",2018-01-10 00:00:00,2018-01-11 10:00:00\n'
    "r2,o3,1,,,2018-01-10 00:00:00,2018-01-11 10:00:00\n"
)
TRANSLATION = BOM + "product_category_name,product_category_name_english\ncasa,house\nsom,audio"


@pytest.fixture
def source(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in (
        ("shop_customers_dataset.csv", CUSTOMERS),
        ("shop_orders_dataset.csv", ORDERS),
        ("shop_order_payments_dataset.csv", PAYMENTS),
        ("shop_order_reviews_dataset.csv", REVIEWS),
        ("shop_sellers_dataset.csv", "seller_id,seller_zip_code_prefix,seller_city,seller_state\n"),
        ("product_category_name_translation.csv", TRANSLATION),
    ):
        (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


def test_load_folder(spark, source, tmp_path):
    target = str(tmp_path / "out")
    found = {r["table_name"]: r for r in rows(ingest.load_folder(spark, source, target))}
    assert list(found) == list(TABLES)
    assert found["sellers"]["status"] == "skipped: empty"
    assert found["products"]["status"] == "skipped: no file"
    loaded = {n: r["rows_loaded"] for n, r in found.items() if r["status"] == "loaded"}
    assert loaded == {
        "customers": 2,
        "product_category_translation": 2,
        "orders": 2,
        "order_payments": 2,
        "order_reviews": 2,
    }
    assert found["orders"]["rows_without_key"] == 1
    assert found["orders"]["values_rejected"] == 1
    assert found["orders"]["rejects"] == "order_purchase_timestamp:1"
    assert found["orders"]["rows_orphan"] == 1
    assert found["customers"]["rows_duplicate"] == 1
    assert found["order_payments"]["rejects"] == "payment_installments:1,payment_value:1"
    for r in found.values():
        assert r["rows_read"] == sum(r[f"rows_{k}"] for k in KINDS)

    t = files.load(spark, target)
    customers = {r["customer_id"]: r for r in rows(t["customers"])}
    assert customers["c1"]["customer_unique_id"] == "p1"  # the first row of a key wins
    assert customers["c1"]["customer_zip_code"] == "01001"
    assert customers["c1"]["customer_city"] == "NA"
    assert customers["c2"]["customer_zip_code"] is None
    assert {r["order_id"] for r in rows(t["orders"])} == {"o1", "o3"}
    payments = t["order_payments"].orderBy("payment_sequential").collect()
    assert [p.payment_value for p in payments] == [Decimal("10.51"), None]
    review = {r["review_id"]: r for r in rows(t["order_reviews"])}["r1"]
    assert review["review_comment_message"] == "first line\nsecond, line"
    assert review["review_comment_title"] == 'said "yes"'
    translation = rows(t["product_category_translation"].orderBy("product_category_name"))
    assert [r["product_category_name_english"] for r in translation] == ["house", "audio"]
    for name in ("customers", "orders", "order_payments", "order_reviews"):
        stored = [(f.name, f.dataType) for f in t[name].schema if f.name != files.ORDER_MONTH]
        assert stored == [(f.name, f.dataType) for f in TABLES[name].schema]


def test_loading_again_changes_nothing(spark, source, tmp_path):
    target = str(tmp_path / "out")
    ingest.load_folder(spark, source, target)
    again = rows(ingest.load_folder(spark, source, target))
    assert sum(r["rows_loaded"] for r in again) == 0
    assert all(r["rows_read"] == sum(r[f"rows_{k}"] for k in KINDS) for r in again)
    assert sum(r["rows_stored"] for r in again) == 10
    assert files.load(spark, target)["orders"].count() == 2


def test_later_files_add_only_new_keys(spark, source, tmp_path):
    target = str(tmp_path / "out")
    ingest.load_folder(spark, source, target)
    more = tmp_path / "more"
    more.mkdir()
    text = CUSTOMERS + "c3,p3,1,x,SP,x\n"
    (more / "shop_customers_dataset.csv").write_text(text.replace("p2", "changed"))
    ingest.load_folder(spark, str(more), target)
    stored = {r["customer_id"]: r["customer_unique_id"] for r in rows(files.load(spark, target)["customers"])}
    assert stored == {"c1": "p1", "c2": "p2", "c3": "p3"}


def test_one_bad_table_does_not_stop_the_rest(spark, source, tmp_path, monkeypatch):
    original = ingest.load_table

    def failing(spark, source, target, spec):
        if spec.name == "orders":
            raise RuntimeError("broken")
        return original(spark, source, target, spec)

    monkeypatch.setattr(ingest, "load_table", failing)
    found = {r["table_name"]: r for r in rows(ingest.load_folder(spark, source, str(tmp_path / "o")))}
    assert found["orders"]["status"] == "error: RuntimeError: broken"
    assert found["order_reviews"]["status"] == "loaded"


def test_first_row_of_a_key_in_file_order(spark, tmp_path):
    spec = TABLES["sellers"]
    header = "seller_id,seller_zip_code_prefix,seller_city,seller_state\n"
    for part in range(3):
        lines = "".join(f"s{i % 50},{part},{i},ZZ\n" for i in range(1000 * part, 1000 * part + 1000))
        (tmp_path / f"part{part}.csv").write_text(header + lines)
    staged = ingest.stage(ingest.read_text(spark, str(tmp_path)), spec)
    first = ingest.first_per_key(staged.repartition(7), spec.key, staged[ingest.POSITION])
    assert {r["seller_id"]: r["seller_city"] for r in rows(first)} == {
        f"s{i}": str(i) for i in range(50)
    }


def test_only_rows_of_repeated_keys_are_chosen_from(spark, monkeypatch):
    rows_ = [(i % 700, i // 700, f"v{i % 11}") for i in range(800)] + [(None, 1, "n"), (None, 0, "n"), (5, 9, None)] + [(3, 7, "hot")] * 400
    df = spark.createDataFrame(rows_, "k int, p int, v string").repartition(5)
    for order in (None, df["p"]):
        got = {r["k"]: (r["p"], r["v"]) for r in ingest.first_per_key(df, ("k",), order).collect()}
        ranked = sorted(rows_, key=lambda r: (r[1], r[2] is not None, r[2] or ""))
        assert got == {r[0]: r[1:] for r in reversed(ranked)}
    seen = []
    monkeypatch.setattr(ingest, "_chosen", lambda some, *_: seen.append(some.count()) or some.limit(0))
    ingest.first_per_key(df, ("k",)).count()
    assert seen == [100 * 2 + 2 + 1 + 400]  # 3 and 5 are among the hundred repeated ones
    unique = df.dropDuplicates(["k"])
    assert ingest.first_per_key(unique, ("k",)) is unique


def test_first_rows_without_a_broadcast(spark, forced):
    rows_ = [(i % 300 if i % 3 else 7, i, f"v{i}") for i in range(2000)]
    df = spark.createDataFrame(rows_, "k int, p int, v string")
    first: dict = {}
    for k, p, v in rows_:
        first.setdefault(k, (p, v))
    assert {r["k"]: (r["p"], r["v"]) for r in ingest.first_per_key(df, ("k",), df["p"]).collect()} == first


def test_rows_of_single_keys_are_not_moved_beside_many_repeated_ones(spark, forced):
    """With too many repeated keys for a lookup: one shuffle, of the rows that may be among them."""
    df = spark.createDataFrame([(i % 900, i, f"v{i}") for i in range(1200)], "k int, p int, v string").repartition(3)
    first = ingest.first_per_key(df, ("k",), df["p"])
    assert plan(first).count("Exchange hashpartitioning") == 1
    assert {r["k"]: (r["p"], r["v"]) for r in first.collect()} == {i: (i, f"v{i}") for i in range(900)}


def test_very_many_copies_of_a_key_collapse_before_they_are_moved(spark, forced, monkeypatch):
    monkeypatch.setattr(ingest, "_MANY_COPIES", 100)
    df = spark.createDataFrame([(i % 50 if i % 2 else None, i) for i in range(1000)], "k int, p int").repartition(3)
    spark.conf.set("spark.tradeloom.taskBytes", "100")
    try:
        first = ingest.first_per_key(df, ("k",), df["p"])
        assert not re.search(r"hashpartitioning\(_key_hash#\d+L, \d+\), REPARTITION", plan(first))
        assert {r["k"]: r["p"] for r in first.collect()} == {None: 0} | {i: i for i in range(50) if i % 2}
    finally:
        spark.conf.unset("spark.tradeloom.taskBytes")


@pytest.mark.parametrize("count", [1, 3000])
def test_a_bitmap_of_hashes_misses_none_of_them(spark, count):
    rows_ = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    found = bitmaps.may_be_among(rows_, rows_.where(F.col("id") < count).select("h"), "h", count, "held")
    held = {r["id"]: r["held"] for r in found.collect()}
    assert len(held) == 20_000 and all(held[i] for i in range(count))
    assert sum(held.values()) < count + 2_000


def test_orders_are_not_moved_to_find_those_without_a_customer(spark, source, tmp_path, monkeypatch):
    monkeypatch.delattr(ingest, "_marked")
    found = {r["table_name"]: r for r in rows(ingest.load_folder(spark, source, str(tmp_path / "out")))}
    assert (found["orders"]["rows_orphan"], found["orders"]["rows_loaded"]) == (1, 2)


def test_orders_with_too_many_unknown_customers_for_a_lookup(spark, source, tmp_path, forced):
    found = {r["table_name"]: r for r in rows(ingest.load_folder(spark, source, str(tmp_path / "out")))}
    assert (found["orders"]["rows_orphan"], found["orders"]["rows_loaded"]) == (1, 2)


def test_bulk_load_goes_by_position(spark, tmp_path):
    (tmp_path / "p.csv").write_text(PAYMENTS.replace("order_id,payment_seq", "a,b"))
    found = ingest.bulk_load(spark, str(tmp_path / "p.csv"), TABLES["order_payments"])
    assert [r["order_id"] for r in rows(found)] == ["o1", "o1"]
    assert found.schema.names == TABLES["order_payments"].columns


def test_rows_of_a_wrong_length_and_other_column_orders(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    header = "seller_id,seller_zip_code_prefix,seller_city,seller_state\n"
    (source / "a_sellers_dataset.csv").write_text(header + "s1,1,x,AA\ns2,2,y\ns3,3,z,BB,more\n")
    (source / "b_sellers_dataset.csv").write_text("seller_state,seller_id,seller_city,seller_zip_code_prefix\nCC,s4,w,4\n")
    status = ingest.load_table(spark, str(source), str(tmp_path / "out"), TABLES["sellers"])
    assert (status.rows_read, status.rows_malformed, status.rows_loaded) == (4, 2, 2)
    found = {r["seller_id"]: r for r in rows(files.load(spark, str(tmp_path / "out"))["sellers"])}
    assert found["s4"]["seller_zip_code"] == "4" and found["s4"]["seller_state"] == "CC" and set(found) == {"s1", "s4"}


def test_orders_loaded_onto_saved_months_are_read(spark, source, tmp_path):
    target = str(tmp_path / "out")
    ingest.load_folder(spark, source, target)
    more = tmp_path / "more"
    more.mkdir()
    (more / "shop_orders_dataset.csv").write_text(ORDERS.replace("o1,", "o7,"))
    status = ingest.load_table(spark, str(more), target, TABLES["orders"])
    assert (status.rows_loaded, status.rows_stored, status.rows_orphan) == (1, 1, 1)
    assert {r["order_id"] for r in rows(files.load(spark, target)["orders"])} == {"o1", "o3", "o7"}


def test_jobs(spark, source, tmp_path):
    target, result = str(tmp_path / "out"), str(tmp_path / "result")
    found = {r["table_name"]: r["status"] for r in rows(jobs.run(spark, ["load", source, target]))}
    assert found["orders"] == "loaded"
    assert jobs.run(spark, ["report", target, result, "rfm_base"]) is None
    assert spark.read.parquet(result).columns == ["customer_id", "recency_days", "frequency", "monetary"]

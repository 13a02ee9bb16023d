"""Measures from the cube against measures from the facts, in many contexts."""

from __future__ import annotations

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL, as_set, rows
from tests.test_skew import skewed
from tradeloom.functions.columns import month_label, month_number
from tradeloom.plans import cube, star
from tradeloom.sources import orderlines


def from_facts(t, by, where=None):
    fact = star.fact_sales(t).join(star.dim_product(t), "product_id", "left")
    fact = fact.join(star.dim_seller(t).select("seller_id", "seller_state"), "seller_id", "left")
    fact = fact.join(star.dim_customer(t).select("customer_id", "customer_state"), "customer_id", "left")
    fact = fact.withColumn("order_month", month_label(month_number(F.col("order_date"))))
    fact = fact if where is None else fact.where(where)
    found = {}
    for measure, name in ((star.total_revenue, "total_revenue"), (star.avg_order_value, "avg_order_value"), (star.retention_rate, "retention_rate"), (star.late_rate, "late_rate")):
        for r in rows(measure(fact, *by)):
            found.setdefault(tuple(r[b] for b in by), {})[name] = r[name]
    for r in rows(fact.groupBy(*by).agg(F.count_distinct("order_id").alias("orders"), F.count_distinct("customer_id").alias("people"))):
        found[tuple(r[b] for b in by)] |= {"orders": r["orders"], "people": r["people"]}
    return found


def from_cube(made, by, where=None):
    return {tuple(r[b] for b in by): {k: v for k, v in r.items() if k not in by} for r in rows(made.measures(*by, where=where))}


@pytest.mark.parametrize("tables", ["plain", "skewed"])
def test_one_cube_answers_many_contexts(spark, monkeypatch, tables):
    monkeypatch.setattr(cube, "_ROWS_PER_BUCKET", 700)  # several buckets of numbers
    t = orderlines.load(spark, SMALL) if tables == "plain" else skewed(spark)
    made = cube.build(t)
    monkeypatch.setattr(star, "fact_sales", lambda t, fact=star.fact_sales(t): fact)
    assert from_cube(made, ()) == from_facts(t, ())
    for by in (("customer_state",), ("order_month", "category"), ("seller_state",)):
        assert from_cube(made, by) == from_facts(t, by)
    where = (F.col("customer_state") > "C") & F.col("order_month").between("1994-01", "1996-06")
    assert from_cube(made, ("category",), where) == from_facts(t, ("category",), where)


def test_a_cube_is_read_instead_of_facts(spark):
    t = orderlines.load(spark, SMALL)
    made = cube.build(t, ("order_month",))
    read = made.measures("order_month").inputFiles()
    assert read and all("cube-" in f for f in read)
    facts = t["order_items"].count()
    assert made.rows.count() < facts / 5
    assert made.rows.where("kind = 'orders'").agg(F.sum(F.bit_count("bits"))).first()[0] == t["order_items"].select("order_id").distinct().count()


def test_no_facts(shop):
    made = cube.build(shop.tables())
    assert rows(made.measures("category")) == []
    (only,) = rows(made.measures())
    assert only == {"total_revenue": None, "orders": 0, "people": 0, "avg_order_value": None, "retention_rate": None, "late_rate": None}


def test_people_without_a_name_are_not_counted(shop):
    shop.product("x", "toys")
    for i, person in enumerate(["p", "p", None, "q"]):
        shop.order(f"o{i}", person=person, items=(("x", "s", "10.00"), ("x", "s", "5.00")))
    t = shop.tables()
    (only,) = rows(cube.build(t).measures())
    assert (only["orders"], only["people"], only["retention_rate"]) == (3, 2, 0.5)
    assert as_set(cube.build(t).measures("category")) == as_set(cube.build(t, ("category",)).measures("category"))


def test_dimensions_of_subsets(spark):
    t = orderlines.load(spark, SMALL)
    full = cube.build(t, ("order_month", "customer_state"))
    for by in combinations(("order_month", "customer_state"), 1):
        assert as_set(full.measures(*by)) == as_set(cube.build(t, by).measures(*by))

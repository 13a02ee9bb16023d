from __future__ import annotations

import datetime as dt
import os
import sys
from contextlib import contextmanager
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tradeloom.schemas import TABLES  # noqa: E402
from tradeloom.tables import Tables  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@contextmanager
def all_limits_at_zero(spark):
    """All inputs count as too large for the small-data plans."""
    names = ("broadcastBytes", "skewMinBytes")
    for name in names:
        spark.conf.set(f"spark.tradeloom.{name}", "0")
    try:
        yield
    finally:
        for name in names:
            spark.conf.unset(f"spark.tradeloom.{name}")


@pytest.fixture
def forced(spark):
    with all_limits_at_zero(spark):
        yield


def ts(text: str | None) -> dt.datetime | None:
    return None if text is None else dt.datetime.fromisoformat(text)


class Shop:
    """Builds small input tables order by order."""

    def __init__(self, spark):
        self.spark = spark
        self.rows: dict[str, list[dict]] = {name: [] for name in TABLES}

    def add(self, table: str, **values) -> None:
        self.rows[table].append(values)

    def order(
        self,
        order_id: str,
        bought: str = "2020-01-05 10:00:00",
        person: str = "p1",
        state: str = "AA",
        status: str = "delivered",
        arrived: str | None = None,
        due: str | None = None,
        paid: tuple[str, ...] = (),
        items: tuple[tuple[str, str, str], ...] = (),
        scores: tuple[int, ...] = (),
    ) -> None:
        customer = f"c_{order_id}"
        self.add("customers", customer_id=customer, customer_unique_id=person, customer_state=state)
        self.add(
            "orders",
            order_id=order_id,
            customer_id=customer,
            order_status=status,
            order_purchase_timestamp=ts(bought),
            order_delivered_customer_date=ts(arrived),
            order_estimated_delivery_date=ts(due),
        )
        for i, value in enumerate(paid, start=1):
            self.add(
                "order_payments",
                order_id=order_id,
                payment_sequential=i,
                payment_type="card",
                payment_value=Decimal(value),
            )
        for i, (product, seller, price) in enumerate(items, start=1):
            self.add(
                "order_items",
                order_id=order_id,
                order_item_id=i,
                product_id=product,
                seller_id=seller,
                price=Decimal(price),
            )
        for i, score in enumerate(scores, start=1):
            self.add("order_reviews", review_id=f"{order_id}_{i}", order_id=order_id, review_score=score)

    def product(self, product_id: str, category: str | None) -> None:
        self.add("products", product_id=product_id, product_category_name=category)

    def tables(self) -> Tables:
        frames = {}
        for name, spec in TABLES.items():
            arrow = pa.Table.from_pylist(self.rows[name], schema=to_arrow_schema(spec.schema))
            frames[name] = self.spark.createDataFrame(arrow, spec.schema)
        return Tables.of(self.spark, **frames)


@pytest.fixture
def shop(spark):
    return Shop(spark)


def rows(df) -> list[dict]:
    def plain(value):
        return float(value) if isinstance(value, Decimal) else value

    return [{k: plain(v) for k, v in row.asDict().items()} for row in df.collect()]


def as_set(df) -> set:
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))

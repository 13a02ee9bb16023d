"""The eight tables the reports read: columns, keys and raw file names."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

TEXT, WHOLE, SMALL = T.StringType(), T.IntegerType(), T.ByteType()
MONEY, TIME = T.DecimalType(10, 2), T.TimestampNTZType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


@dataclass(frozen=True)
class TableSpec:
    name: str
    file_glob: str
    schema: T.StructType
    key: tuple[str, ...]
    renames: dict[str, str] = field(default_factory=dict)
    parent: tuple[str, str] | None = None  # (column, parent table)
    multiline: bool = False  # free text that may hold line breaks

    @property
    def columns(self) -> list[str]:
        return self.schema.names


# File names, column names, types and keys of the public order dataset.
# Parents come before children, so one pass in this order can check references.
TABLES: dict[str, TableSpec] = {
    spec.name: spec
    for spec in (
        TableSpec(
            "customers",
            "*customers_dataset.csv",
            _schema(
                customer_id=TEXT,
                customer_unique_id=TEXT,
                customer_zip_code=TEXT,
                customer_city=TEXT,
                customer_state=TEXT,
            ),
            ("customer_id",),
            {"customer_zip_code_prefix": "customer_zip_code"},
        ),
        TableSpec(
            "sellers",
            "*sellers_dataset.csv",
            _schema(
                seller_id=TEXT,
                seller_zip_code=TEXT,
                seller_city=TEXT,
                seller_state=TEXT,
            ),
            ("seller_id",),
            {"seller_zip_code_prefix": "seller_zip_code"},
        ),
        TableSpec(
            "products",
            "*products_dataset.csv",
            _schema(
                product_id=TEXT,
                product_category_name=TEXT,
                product_name_length=WHOLE,
                product_description_length=WHOLE,
                product_photos_qty=WHOLE,
                product_weight_g=WHOLE,
                product_length_cm=WHOLE,
                product_height_cm=WHOLE,
                product_width_cm=WHOLE,
            ),
            ("product_id",),
            {
                "product_name_lenght": "product_name_length",
                "product_description_lenght": "product_description_length",
            },
        ),
        TableSpec(
            "product_category_translation",
            "product_category_name_translation.csv",
            _schema(
                product_category_name=TEXT,
                product_category_name_english=TEXT,
            ),
            ("product_category_name",),
        ),
        TableSpec(
            "orders",
            "*orders_dataset.csv",
            _schema(
                order_id=TEXT,
                customer_id=TEXT,
                order_status=TEXT,
                order_purchase_timestamp=TIME,
                order_approved_at=TIME,
                order_delivered_carrier_date=TIME,
                order_delivered_customer_date=TIME,
                order_estimated_delivery_date=TIME,
            ),
            ("order_id",),
            parent=("customer_id", "customers"),
        ),
        TableSpec(
            "order_items",
            "*order_items_dataset.csv",
            _schema(
                order_id=TEXT,
                order_item_id=WHOLE,
                product_id=TEXT,
                seller_id=TEXT,
                shipping_limit_date=TIME,
                price=MONEY,
                freight_value=MONEY,
            ),
            ("order_id", "order_item_id"),
        ),
        TableSpec(
            "order_payments",
            "*order_payments_dataset.csv",
            _schema(
                order_id=TEXT,
                payment_sequential=WHOLE,
                payment_type=TEXT,
                payment_installments=WHOLE,
                payment_value=MONEY,
            ),
            ("order_id", "payment_sequential"),
        ),
        TableSpec(
            "order_reviews",
            "*order_reviews_dataset.csv",
            _schema(
                review_id=TEXT,
                order_id=TEXT,
                review_score=SMALL,
                review_comment_title=TEXT,
                review_comment_message=TEXT,
                review_creation_date=TIME,
                review_answer_timestamp=TIME,
            ),
            ("review_id", "order_id"),
            multiline=True,
        ),
    )
}

"""Ingestion queries on text files that Spark writes from the given tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.base import month, statement
from tradeloom.operators.scratch import scratch_path
from tradeloom.plans import catalog, star
from tradeloom.plans.exploration import table_row_counts
from tradeloom.plans.revenue import monthly_revenue_mom
from tradeloom.schemas import TABLES, TableSpec
from tradeloom.sources import files, ingest, orderlines
from tradeloom.sources.report_files import run_all_reports, write_report
from tradeloom.tables import Tables


#: The month whose orders come in two parts.
REFRESHED = "1996-03"


def file_path(folder: str, spec: TableSpec) -> str:
    return f"{folder}/{spec.file_glob.replace('*', 'shop_')}"


def as_text(t: Tables, spec: TableSpec) -> DataFrame:
    """The table as its source file has it: text under the file's column names."""
    names = {column: name for name, column in spec.renames.items()}
    return t[spec.name].select(
        *(F.col(c).cast("string").alias(names.get(c, c)) for c in spec.columns)
    )


def write_text(df: DataFrame, path: str) -> str:
    df.write.csv(path, header=True, quote='"', escape='"')
    return path


def write_files(t: Tables, names: list[str]) -> str:
    folder = scratch_path(t.spark, "files")
    for name in names:
        write_text(as_text(t, TABLES[name]), file_path(folder, TABLES[name]))
    return folder


def ingest_csv(t: Tables) -> DataFrame:
    spec = TABLES["order_reviews"]
    folder = write_files(t, [spec.name])
    raw = ingest.read_text(t.spark, file_path(folder, spec), spec.multiline)
    return ingest.stage(raw, spec).select(spec.columns)


def ingest_registry(t: Tables) -> DataFrame:
    folder = write_files(t, list(TABLES))
    return ingest.load_folder(t.spark, folder, scratch_path(t.spark, "loaded"))


def ingest_skip(t: Tables) -> DataFrame:
    """Two files as usual, one with a header only, the others missing."""
    folder = write_files(t, ["customers", "orders"])
    empty = TABLES["sellers"]
    write_text(as_text(t, empty).limit(0), file_path(folder, empty))
    return ingest.load_folder(t.spark, folder, scratch_path(t.spark, "loaded"))


def load_verification(t: Tables) -> DataFrame:
    folder, target = write_files(t, list(TABLES)), scratch_path(t.spark, "loaded")
    ingest.load_folder(t.spark, folder, target)
    return table_row_counts(files.load(t.spark, target))


def _raw_products(t: Tables) -> DataFrame:
    return as_text(t, TABLES["products"]).select(F.lit("red").alias("colour"), "*")


def ingest_project(t: Tables) -> DataFrame:
    return ingest.project(_raw_products(t), TABLES["products"])


def ingest_rename(t: Tables) -> DataFrame:
    return ingest.rename(ingest_project(t), TABLES["products"])


def ingest_empty_to_null(t: Tables) -> DataFrame:
    raw = as_text(t, TABLES["orders"]).na.fill("")
    status = F.when(F.col("order_id").cast("long") % 13 == 0, "NA").otherwise(F.col("order_status"))
    return ingest.empty_to_null(raw.withColumn("order_status", status))


def ingest_cast(t: Tables) -> DataFrame:
    k = F.col("order_id").cast("long")
    raw = as_text(t, TABLES["order_items"]).withColumns(
        {
            "price": F.when(k % 101 == 0, "n/a").otherwise(F.col("price")),
            "shipping_limit_date": F.when(k % 103 == 0, "2018-13-45 00:00:00").otherwise(
                F.col("shipping_limit_date")
            ),
        }
    )
    checked = ingest.typed(raw, TABLES["order_items"])
    return checked.withColumn("rejected", F.array_join(ingest.REJECTED, ",")).drop(ingest.REJECTED)


def bulk_load_csv(t: Tables) -> DataFrame:
    spec = TABLES["order_payments"]
    renamed = as_text(t, spec).toDF(*(f"field{i}" for i in range(len(spec.columns))))
    path = write_text(renamed, f"{scratch_path(t.spark, 'files')}/payments.csv")
    return ingest.bulk_load(t.spark, path, spec)


def dedupe_on_key(t: Tables) -> DataFrame:
    return ingest.first_per_key(t["order_items"], TABLES["order_items"].key)


def _some_customers(t: Tables) -> DataFrame:
    return t["customers"].where(F.col("customer_id") % 11 != 0)


def orphan_check(t: Tables) -> DataFrame:
    orders = t["orders"].select("order_id", "customer_id", "order_status")
    return ingest.with_parent(orders, _some_customers(t), "customer_id", "order_id")


def orphan_check_rejected(t: Tables) -> DataFrame:
    orders = t["orders"].select("order_id", "customer_id", "order_status")
    return ingest.orphans(orders, _some_customers(t), "customer_id", "order_id")


def create_tables(t: Tables) -> DataFrame:
    """All eight tables written with their layout; the orders read back."""
    folder = scratch_path(t.spark, "tables")
    files.save(t, folder)
    stored, ids = files.load(t.spark, folder)["orders"], t["orders"].schema
    return stored.withColumns({c: F.col(c).cast(ids[c].dataType) for c in ("order_id", "customer_id")})


def ingest_append(t: Tables) -> DataFrame:
    """Half of the orders saved by month, then a file with all of them loaded on top."""
    target = scratch_path(t.spark, "tables")
    frames = {n: t[n] for n in TABLES}
    half = t["orders"].where(F.col("order_id").cast("long") % 2 == 0)
    half = half.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES["orders"].schema))
    files.save(Tables.of(t.spark, **(frames | {"orders": half})), target)
    ingest.load_table(t.spark, write_files(t, ["orders"]), target, TABLES["orders"])
    return files.load(t.spark, target)["orders"].select(TABLES["orders"].columns)


def star_refresh(t: Tables) -> DataFrame:
    """A star without the second half of the orders of a month, refreshed when these have come."""
    tables, folder = scratch_path(t.spark, "tables"), scratch_path(t.spark, "star")
    typed = {n: t[n].select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[n].schema)) for n in TABLES}
    late = (F.date_format("order_purchase_timestamp", "yyyy-MM") == REFRESHED) & (F.col("order_id").cast("long") % 2 == 0)
    files.save(Tables.of(t.spark, **(typed | {"orders": typed["orders"].where(~late)})), tables)
    star.write_star(files.load(t.spark, tables), folder)
    files.replace_table(typed["orders"], tables, "orders")
    star.refresh_star(t.spark, tables, folder, [REFRESHED])
    ids = [F.col(c).cast("long").alias(c) for c in ("order_id", "customer_id", "product_id", "seller_id")]
    fact = star.read_star(t.spark, folder)["fact_sales"]
    return fact.select(*ids, "revenue", "order_date", "order_count", "is_late")


def create_tables_content(t: Tables) -> DataFrame:
    """Rows and content of all eight tables, written with their layout and read back."""
    folder = scratch_path(t.spark, "tables")
    files.save(t, folder)
    stored = files.load(t.spark, folder)
    counted = []
    for name, spec in TABLES.items():
        texts = [F.coalesce(_plain(f), F.lit("")) for f in spec.schema]
        number = F.conv(F.substring(F.md5(F.concat_ws("|", *texts).cast("binary")), 1, 8), 16, 10).cast("long")
        content = stored[name].agg(F.count("*").alias("row_count"), F.sum(number).alias("content"))
        counted.append(content.select(F.lit(name).alias("table_name"), "*"))
    return reduce(DataFrame.unionByName, counted)


def _plain(field: T.StructField):
    if isinstance(field.dataType, T.DecimalType):
        return (F.col(field.name) * 100).cast("long").cast("string")
    if isinstance(field.dataType, T.TimestampNTZType):
        return F.date_format(field.name, "yyyy-MM-dd HH:mm:ss")
    return F.col(field.name).cast("string")


def ingest_parts(t: Tables) -> DataFrame:
    """Seller files with other column orders, and one whose rows all have a field too many."""
    spec = TABLES["sellers"]
    raw = as_text(t, spec)
    folder = f"{scratch_path(t.spark, 'files')}"
    part = F.col("seller_id").cast("long") % 3
    write_text(raw.where(part == 0), f"{folder}/a_sellers_dataset.csv")
    write_text(raw.where(part == 1).select(*reversed(raw.columns)), f"{folder}/b_sellers_dataset.csv")
    names = ",".join(raw.columns)
    lines = raw.where(part == 2).select(F.concat_ws(",", *raw.columns, F.lit("more")).alias(names))
    # With another separator a line is one field, and its commas are not quoted.
    lines.coalesce(1).write.option("sep", "|").csv(f"{folder}/c_sellers_dataset.csv", header=True)
    target = scratch_path(t.spark, "loaded")
    status = ingest.load_table(t.spark, folder, target, spec)
    rows = files.load(t.spark, target)["sellers"]
    return rows.withColumn("rows_malformed", F.lit(status.rows_malformed).cast("long"))


def write_report_csv(t: Tables) -> DataFrame:
    path = f"{scratch_path(t.spark, 'results')}/report.csv"
    report = monthly_revenue_mom(t)
    write_report(report, path)
    return t.spark.read.schema(report.schema).csv(path, header=True)


def run_all(t: Tables) -> DataFrame:
    return run_all_reports(t, scratch_path(t.spark, "results"))


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    f.__name__: f
    for f in (
        ingest_csv,
        ingest_registry,
        ingest_project,
        ingest_rename,
        ingest_empty_to_null,
        ingest_cast,
        dedupe_on_key,
        orphan_check,
        orphan_check_rejected,
        ingest_skip,
        ingest_append,
        ingest_parts,
        load_verification,
        bulk_load_csv,
        create_tables,
        create_tables_content,
        star_refresh,
    )
} | {"write_report": write_report_csv, "run_all_reports": run_all}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def on_tables(query):
        return lambda spark, folder: catalog.plain_types(query(orderlines.load(spark, folder)))

    return {name: on_tables(query) for name, query in QUERIES.items()}


_COUNTED = {
    "customers": ("x_customers", "customer_id"),
    "sellers": ("x_sellers", "seller_id"),
    "products": ("x_products", "product_id"),
    "product_category_translation": ("x_translation", "native"),
    "orders": ("x_orders", "order_id"),
    "order_items": ("x_items", "(order_id, item_no)"),
    "order_payments": ("x_payments", "(order_id, seq)"),
    "order_reviews": ("x_reviews", "review_id"),
}


def _or_empty(text: str) -> str:
    return f"coalesce(({text})::VARCHAR, '')"


_MADE = "o_orderdate + to_days((25 + o_orderkey % 15)::INT)"
# Every column of the eight tables as text: whole cents, and times to the second.
_CONTENT = {
    "customers": ("x_customers", ["customer_id", "person", "zip", "city", "state"]),
    "sellers": ("x_sellers", ["seller_id", "zip", "city", "state"]),
    "products": ("x_products", ["product_id", "native", "name_length", "description_length", "photos", "p_size * 100", "p_size", "p_size", "p_size"]),
    "product_category_translation": ("x_translation", ["native", "english"]),
    "orders": ("x_orders", ["order_id", "customer_id", "order_status"] + [f"strftime({c}, '%Y-%m-%d %H:%M:%S')" for c in ("bought_at", "approved_at", "carrier_at", "arrived_at", "due_at")]),
    "order_items": ("x_items", ["order_id", "item_no", "product_id", "seller_id", "strftime(ship_by, '%Y-%m-%d %H:%M:%S')", "price_c", "freight_c"]),
    "order_payments": ("x_payments", ["order_id", "seq", "kind", "installments", "paid_c"]),
    "order_reviews": (
        f"x_reviews JOIN (SELECT o_orderkey AS order_id, {_MADE} AS made FROM orders) USING (order_id)",
        [
            "review_id", "order_id", "score", "CASE WHEN order_id % 4 = 0 THEN 'Order ' || order_id END",
            "CASE WHEN order_id % 7 = 0 THEN 'It was \"fine\",' || chr(10) || 'number ' || order_id END",
            "strftime(made, '%Y-%m-%d %H:%M:%S')", "strftime(made + to_days(1) + to_hours((order_id % 24)::INT), '%Y-%m-%d %H:%M:%S')",
        ],
    ),
}


def _loaded(name: str) -> str:
    view, key = _COUNTED[name]
    return f"""SELECT '{name}' AS table_name, 'loaded' AS status, count(*) AS rows_read,
  0::BIGINT AS rows_malformed, 0::BIGINT AS rows_without_key, count(*) - count(DISTINCT {key}) AS rows_duplicate,
  0::BIGINT AS rows_orphan, 0::BIGINT AS rows_stored, count(DISTINCT {key}) AS rows_loaded,
  0::BIGINT AS values_rejected, '' AS rejects
FROM {view}"""


def _skipped(name: str, why: str) -> str:
    return f"SELECT '{name}', 'skipped: {why}', 0, 0, 0, 0, 0, 0, 0, 0, ''"


def _text(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def _products(lengths: str) -> str:
    first, second = lengths.split()
    sizes = ", ".join(f"p_size::VARCHAR AS product_{d}_cm" for d in ("length", "height", "width"))
    return statement(f"""
SELECT product_id::VARCHAR AS product_id, native AS product_category_name,
       name_length::VARCHAR AS {first}, description_length::VARCHAR AS {second},
       photos::VARCHAR AS product_photos_qty, (p_size * 100)::VARCHAR AS product_weight_g, {sizes}
FROM x_products""")


def expected(reports: dict[str, str]) -> dict[str, str]:
    reviews = f"""
SELECT review_id::VARCHAR AS review_id, r.order_id::VARCHAR AS order_id, score::BIGINT AS review_score,
       CASE WHEN r.order_id % 4 = 0 THEN 'Order ' || r.order_id END AS review_comment_title,
       CASE WHEN r.order_id % 7 = 0
            THEN 'It was "fine",' || chr(10) || 'number ' || r.order_id END AS review_comment_message,
       made AS review_creation_date,
       made + to_days(1) + to_hours((r.order_id % 24)::INT) AS review_answer_timestamp
FROM x_reviews r JOIN (SELECT o_orderkey AS order_id,
                              o_orderdate + to_days((25 + o_orderkey % 15)::INT) AS made FROM orders)
     USING (order_id)"""
    counted = (n for n in _COUNTED if n != "product_category_translation")
    verification = "\nUNION ALL\n".join(
        f"SELECT '{n}' AS table_name, count(DISTINCT {_COUNTED[n][1]}) AS row_count FROM {_COUNTED[n][0]}"
        for n in counted
    )
    orders = {
        "order_purchase_timestamp": "bought_at",
        "order_approved_at": "approved_at",
        "order_delivered_carrier_date": "carrier_at",
        "order_delivered_customer_date": "arrived_at",
        "order_estimated_delivery_date": "due_at",
    }
    times = ", ".join(f"{ts} AS {name}" for name, ts in orders.items())
    texts = ", ".join(f"{_text(ts)} AS {name}" for name, ts in orders.items())
    written = "\nUNION ALL\n".join(
        f"SELECT '{prefix}_q{i}.csv' AS file, '{report.__name__}' AS report,"
        f" if(count(*) > 0, 'written', 'no rows') AS status, count(*) AS row_count"
        f" FROM ({reports[report.__name__]})"
        for prefix, group in catalog.RUN.items()
        for i, report in enumerate(group, start=1)
    )
    orphaned = "SELECT order_id, customer_id, order_status FROM x_orders WHERE customer_id % 11"
    return {
        "ingest_csv": statement(reviews),
        "ingest_registry": statement("\nUNION ALL\n".join(map(_loaded, _COUNTED))),
        "ingest_skip": statement(
            "\nUNION ALL\n".join(
                [_loaded("customers"), _loaded("orders"), _skipped("sellers", "empty")]
                + [
                    _skipped(n, "no file")
                    for n in _COUNTED
                    if n not in ("customers", "orders", "sellers")
                ]
            )
        ),
        "ingest_append": statement(f"""
SELECT order_id::VARCHAR AS order_id, customer_id::VARCHAR AS customer_id, order_status, {times}
FROM x_orders"""),
        "ingest_parts": statement("""
SELECT seller_id::VARCHAR AS seller_id, zip AS seller_zip_code, city AS seller_city, state AS seller_state,
       (SELECT count(*) FROM x_sellers WHERE seller_id % 3 = 2) AS rows_malformed
FROM x_sellers WHERE seller_id % 3 <> 2"""),
        "load_verification": statement(verification),
        "ingest_project": _products("product_name_lenght product_description_lenght"),
        "ingest_rename": _products("product_name_length product_description_length"),
        "ingest_empty_to_null": statement(f"""
SELECT order_id::VARCHAR AS order_id, customer_id::VARCHAR AS customer_id,
       if(order_id % 13 = 0, 'NA', order_status) AS order_status, {texts} FROM x_orders"""),
        "ingest_cast": statement("""
SELECT order_id::VARCHAR AS order_id, item_no::BIGINT AS order_item_id, product_id::VARCHAR AS product_id,
       seller_id::VARCHAR AS seller_id,
       CASE WHEN order_id % 103 <> 0 THEN ship_by END AS shipping_limit_date,
       CASE WHEN order_id % 101 <> 0 THEN price_c / 100.0 END AS price, freight_c / 100.0 AS freight_value,
       concat_ws(',', CASE WHEN order_id % 103 = 0 THEN 'shipping_limit_date' END,
                      CASE WHEN order_id % 101 = 0 THEN 'price' END) AS rejected
FROM x_items"""),
        "bulk_load_csv": statement("""
SELECT order_id::VARCHAR AS order_id, seq::BIGINT AS payment_sequential, kind AS payment_type,
       installments::BIGINT AS payment_installments, paid_c / 100.0 AS payment_value FROM x_payments"""),
        "dedupe_on_key": statement("""
SELECT order_id, item_no::BIGINT AS order_item_id, product_id, seller_id, ship_by AS shipping_limit_date,
       price_c / 100.0 AS price, freight_c / 100.0 AS freight_value
FROM x_items QUALIFY row_number() OVER (PARTITION BY order_id, item_no
                                        ORDER BY product_id, seller_id, ship_by, price_c, freight_c) = 1"""),
        "orphan_check": statement(f"{orphaned} <> 0"),
        "orphan_check_rejected": statement(f"{orphaned} = 0"),
        "create_tables": statement(f"""
SELECT order_id, customer_id, order_status, {times}, {month("bought_at")} AS order_month FROM x_orders"""),
        "create_tables_content": statement(
            "\nUNION ALL\n".join(
                f"SELECT '{name}' AS table_name, count(*) AS row_count, sum(('0x' || substr(md5(concat_ws('|', {', '.join(map(_or_empty, columns))})), 1, 8))::BIGINT)::BIGINT AS content FROM {source}"
                for name, (source, columns) in _CONTENT.items()
            )
        ),
        "write_report": reports["monthly_revenue_mom"],
        "run_all_reports": written,
    }

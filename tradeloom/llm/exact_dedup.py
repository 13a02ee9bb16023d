"""Exact deduplication of a new batch against an immutable snapshot.

Texts are equal when they are identical after lower-casing A-Z only. Each snapshot shard gets a
static binary fuse filter of its digests, built once. The digests of a new batch are grouped
among themselves first, so a text that is copied a million times is one digest, and are then
screened by the filter of their shard: negatives are new for certain, positives join the exact
buckets of the snapshot. Rows that share a bucket have their texts compared byte by byte.

A null text is empty. A null `doc_id` ranks below every other. Of repeated rows with the same
`doc_id` and text one stays. Empty inputs give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.llm import fuse
from tradeloom.llm.tasks import boxed, importable, unboxed, written

_KEYS_PER_SHARD = 500_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BUCKET = ["digest", "second"]


def normalised(text: str = "text") -> Column:
    """The text with A-Z lower-cased; `lower` does just that where all is ASCII."""
    t = F.coalesce(F.col(text), F.lit(""))
    ascii_only = F.octet_length(t) == F.char_length(t)
    return F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, _UPPER, _UPPER.lower()))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, second): SHA-256 and a second hash of each normalised text."""
    text = docs.select("doc_id", normalised().alias("norm"))
    return text.select(
        "doc_id",
        F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"),
        F.xxhash64("norm").alias("second"),
    )


def build_filters(groups: DataFrame, shards: int) -> DataFrame:
    """(shard, seed, segment, span, prints): one static filter per shard of the snapshot."""
    importable(groups.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        made = fuse.build(table.column("second").to_numpy().view(np.uint64))
        row = {
            "shard": [table.column("shard")[0].as_py()], "seed": [made.seed],
            "segment": [made.segment], "span": [made.span], "prints": [made.prints.tobytes()],
        }
        return pa.table(row, pa.schema([("shard", pa.int64()), ("seed", pa.int64()), ("segment", pa.int64()), ("span", pa.int64()), ("prints", pa.binary())]))

    keys = groups.select(F.pmod("second", F.lit(shards)).alias("shard"), "second")
    return keys.groupBy("shard").applyInArrow(run, "shard long, seed long, segment long, span long, prints binary")


def screen(groups: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """`groups` with `maybe`: whether the snapshot can hold the digest."""

    def run(table: pa.Table, own: pa.Table) -> pa.Table:
        if own.num_rows:
            row = own.to_pylist()[0]
            made = fuse.Fuse(row["seed"], row["segment"], row["span"], np.frombuffer(row["prints"], np.uint8))
            maybe = made.maybe(table.column("second").to_numpy().view(np.uint64))
        else:
            maybe = np.zeros(table.num_rows, bool)
        return table.drop_columns(["shard"]).append_column("maybe", pa.array(maybe))

    keyed = groups.withColumn("shard", F.pmod("second", F.lit(shards)))
    pairs = keyed.groupBy("shard").cogroup(filters.groupBy("shard"))
    schema = ", ".join(f"{n} {t}" for n, t in groups.dtypes)
    return pairs.applyInArrow(run, f"{schema}, maybe boolean")


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_BUCKET).agg(F.max("doc_id").alias("top"), F.sum("copies").alias("n"))


def check_bytes(docs: DataFrame, rows: DataFrame) -> None:
    """Compare the whole texts of all rows that share a bucket; raise if two differ.

    Copies collapse before the shuffle, so a hot bucket sends one text per task.
    """
    own = docs.select("doc_id", normalised().alias("norm"))
    shared = rows.select("doc_id", *_BUCKET).hint("shuffle_hash")
    texts = own.join(shared, own["doc_id"].eqNullSafe(shared["doc_id"])).where(
        (F.unhex(F.sha2(F.col("norm").cast("binary"), 256)) == F.col("digest"))
        & (F.xxhash64("norm") == F.col("second"))
    )
    distinct = texts.groupBy(*_BUCKET, "norm").agg(F.lit(1).alias("one"))
    if distinct.groupBy(*_BUCKET).count().where("count > 1").take(1):
        raise RuntimeError("different texts share a SHA-256 and a second hash")


def deduplicate(snapshot: DataFrame, incoming: DataFrame) -> DataFrame:
    """Per row of both: doc_id, keep_id, group_size, kept, digest, second."""

    def side(docs: DataFrame, name: str) -> DataFrame:
        # Equal rows collapse to a count, and are told apart again at the end.
        counted = digests(docs).groupBy("doc_id", *_BUCKET).agg(F.count("*").alias("copies"))
        return written(counted, name)

    old, new = side(snapshot, "snapshot"), side(incoming, "incoming")
    shards = max(64, math.ceil(old.count() / _KEYS_PER_SHARD))
    old_groups, new_groups = _grouped(old), _grouped(new)
    filters = written(build_filters(old_groups.select("second"), shards), "filters")
    screened = written(screen(new_groups, filters, shards), "screened")

    held = old_groups.select(*_BUCKET, F.col("top").alias("old_top"), F.col("n").alias("old_n"))
    met = held.join(screened.where("maybe").drop("maybe"), _BUCKET, "full").select(
        *_BUCKET,
        F.greatest("old_top", "top").alias("keep_id"),
        (F.coalesce("old_n", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("group_size"),
    )
    fresh = screened.where(~F.col("maybe")).select(
        *_BUCKET, F.col("top").alias("keep_id"), F.col("n").alias("group_size")
    )
    shared = written(met.union(fresh).where("group_size > 1"), "shared")

    rows = old.union(new).groupBy("doc_id", *_BUCKET).agg(F.sum("copies").alias("copies"))
    with_group = written(rows.join(shared, _BUCKET, "left"), "rows")
    docs = snapshot.select("doc_id", "text").union(incoming.select("doc_id", "text"))
    check_bytes(docs, with_group.where("group_size > 1"))

    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return with_group.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.posexplode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy", "_"),
        *_BUCKET,
    ).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)).alias("kept"),
        *_BUCKET,
    )


def halves(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents of the lower half of the id range as snapshot, and the rest as new batch."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    old = F.coalesce(F.col("doc_id") <= (((low or 0) + (high or 0)) // 2), F.lit(False))
    return docs.where(old), docs.where(~old)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents, all columns, without those whose text another kept row has."""
    rows = deduplicate(*halves(docs)).where("kept")
    keys = rows.select(F.col("doc_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in _BUCKET])
    keys = keys.hint("shuffle_hash")
    keyed = boxed(docs).withColumn("_norm", normalised()).select(
        "doc_id", "text", "_others",
        F.unhex(F.sha2(F.col("_norm").cast("binary"), 256)).alias("_d"),
        F.xxhash64("_norm").alias("_s"),
    )
    match = keyed["doc_id"].eqNullSafe(keys["_id"])
    found = keyed.join(keys, match & (keyed["_d"] == keys["_digest"]) & (keyed["_s"] == keys["_second"]))
    if docs.groupBy("doc_id").count().where("count > 1").take(1):
        # Rows that repeat an id can also repeat its text.
        found = found.dropDuplicates(["_id", "_digest", "_second"])
    return unboxed(found, docs.columns)


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return deduplicate(*halves(docs)).select(
        "doc_id", "keep_id", "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM t JOIN g USING (text_sha256)
"""

"""How the operators hand work to Spark tasks and share intermediate tables."""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.operators.scratch import written
from tradeloom.operators.sizing import input_bytes

__all__ = [
    "add_columns", "boxed", "bucket_count", "by_bucket", "components", "importable", "map_batches", "packed", "packed_runs", "packed_schema",
    "unboxed", "written",
]

Batches = Iterator[pa.RecordBatch]
_ROWS_PER_FILE = 250_000
_UNKNOWN_BYTES = 1 << 55


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it.

    On a cluster that installs the package elsewhere (or gets it by --py-files) that copy is
    found as well: the path is only appended.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([p for p in (known, root) if p])


def map_batches(df: DataFrame, columns: list[str], work: Callable[[Batches], Batches], schema: str):
    """`work` over the Arrow batches of the named columns only; others never leave the scan."""
    importable(df.sparkSession)
    return df.select(*columns).mapInArrow(work, schema)


def add_columns(
    df: DataFrame, work: Callable[[pa.RecordBatch], list[pa.Array]], schema: str, text: str = "text"
) -> DataFrame:
    """All columns of `df`, and after them those that `work` makes from each batch.

    New columns take the place of equally named old ones.
    """
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(schema)
    kept = df.select(*[c for c in df.columns if c not in new.names])
    position = kept.columns.index(text)
    names = [*kept.columns, *new.names]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                made = work(pa.record_batch([batch.column(position)], names=["text"]))
                yield pa.record_batch([*batch.columns, *made], names=names)

    importable(df.sparkSession)
    return kept.mapInArrow(run, StructType([*kept.schema.fields, *new.fields]))


def boxed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one, so that no name of theirs can clash."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others or [F.lit(0).alias("none")]).alias("_others"))


def unboxed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The documents that `boxed` made, with their columns in the given order."""
    own = [F.col(c) if c in ("doc_id", "text") else F.col(f"_others.`{c}`").alias(c) for c in columns]
    return rows.select(*own)


def bucket_count(df: DataFrame, bytes_each: int, least: int = 64) -> int:
    """Buckets for data of the order of the texts, so that each fits in a task's memory."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    if size >= _UNKNOWN_BYTES:  # the rows don't come from files
        size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, 2 * partitions, math.ceil(size / bytes_each))


def packed(buckets: np.ndarray, arrays: list[np.ndarray]) -> pa.RecordBatch | None:
    """One row per bucket that occurs: the bucket and the bytes of its part of each array."""
    if not len(buckets):
        return None
    order = np.argsort(buckets, kind="stable")
    ordered = buckets[order]
    at = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    ends = np.r_[at[1:], len(ordered)]
    columns = [pa.array(ordered[at].astype(np.int32), pa.int32())]
    for values in arrays:
        values = np.ascontiguousarray(values[order])
        columns.append(
            pa.array([values[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())
        )
    return pa.record_batch(columns, names=["bucket", *[f"a{i}" for i in range(len(arrays))]])


def packed_runs(
    buckets: np.ndarray, owner: np.ndarray, heads: list[np.ndarray], items: list[np.ndarray]
) -> pa.RecordBatch | None:
    """One row per bucket for entries that come in runs of one owner.

    Per bucket: the `heads` of each owner that occurs, how many entries it has there, and the
    entries' `items`. heads are indexed by owner, items by entry.
    """
    if not len(buckets):
        return None
    order = np.lexsort((owner, buckets))
    buckets, owner = buckets[order], owner[order]
    new_bucket = np.r_[True, buckets[1:] != buckets[:-1]]
    run = np.flatnonzero(new_bucket | np.r_[True, owner[1:] != owner[:-1]])
    many = np.diff(np.r_[run, len(owner)]).astype(np.uint32)
    at = np.flatnonzero(new_bucket)
    ends = np.r_[at[1:], len(buckets)]
    first, last = np.searchsorted(run, at), np.searchsorted(run, ends)

    def blobs(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
        values = np.ascontiguousarray(values)
        return pa.array([values[x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary())

    columns = [pa.array(buckets[at].astype(np.int32))]
    columns += [blobs(h[owner[run]], first, last) for h in heads]
    columns += [blobs(many, first, last), *[blobs(i[order], at, ends) for i in items]]
    return pa.record_batch(columns, names=["bucket", *[f"a{i}" for i in range(len(columns) - 1)]])


def packed_schema(arrays: int) -> str:
    return ", ".join(["bucket int", *[f"a{i} binary" for i in range(arrays)]])


def by_bucket(
    df: DataFrame, types: list, work: Callable[..., pa.Table | None], schema: str
) -> DataFrame:
    """Shuffle packed rows by bucket and call `work` with each bucket's joined arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(table: pa.Table) -> pa.Table:
        arrays = [
            np.frombuffer(b"".join(table.column(i + 1).to_pylist()), kind)
            for i, kind in enumerate(types)
        ]
        made = work(*arrays)
        return arrow_schema.empty_table() if made is None else made.cast(arrow_schema)

    importable(df.sparkSession)
    return df.groupBy("bucket").applyInArrow(run, schema)


def _few_files(df: DataFrame, rows: int, name: str) -> DataFrame:
    """Write a table of at most `rows` rows in files of a useful size, not one per shuffle task."""
    return written(df.coalesce(max(1, math.ceil(rows / _ROWS_PER_FILE))), name)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of the connected components of undirected edges (u, v) of long ids.

    Each round joins every node to the neighbour of least hash and contracts the edges, which
    leaves a fraction of them; a hot node's neighbours collapse in the map-side aggregation.
    Rounds are written to the shared folder. Nodes without an edge are not returned.
    """
    spark: SparkSession = edges.sparkSession
    current = written(edges.where("u <> v").select("u", "v").distinct(), name)
    hops: list[DataFrame] = []
    while rows := current.count():
        seed = F.lit(len(hops))
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), seed).alias("h"), F.col(c).alias("id"))
        best = both.groupBy("u").agg(
            F.min(F.xxhash64("v", seed)).alias("h"), F.min_by("v", rank("v")).alias("v")
        )
        down = F.col("h") < F.xxhash64("u", seed)
        hop = _few_files(best.select("u", F.when(down, F.col("v")).otherwise(F.col("u")).alias("to")), 2 * rows, name)
        hops.append(hop)
        left = current.join(hop, "u").select(F.col("to").alias("a"), "v")
        right = hop.select(F.col("u").alias("v"), F.col("to").alias("b"))
        met = left.join(right, "v").where("a <> b")
        pairs = met.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        current = _few_files(pairs.distinct(), rows, name)
    if not hops:
        return spark.createDataFrame([], "node long, root long")
    roots = hops[-1].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for hop in reversed(hops[:-1]):
        later = roots.select(F.col("node").alias("to"), F.col("root").alias("end"))
        roots = hop.join(later, "to", "left").select(
            F.col("u").alias("node"), F.coalesce("end", "to").alias("root")
        )
    return roots

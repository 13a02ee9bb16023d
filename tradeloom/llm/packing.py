"""Packing into length buckets that waste the least padding.

Documents become sequences of at most `max_len` tokens (a longer one is cut into full pieces
and a rest; nothing is dropped). The histogram of all sequence lengths has at most `max_len`
entries and goes to the driver, where dynamic programming picks the `buckets` upper bounds with
the least total padding. Inside a bucket, batches of `budget // bound` sequences are formed by
exact numbering: sequences are dealt to hashed shards, each shard counts, and a shard's numbers
start where those before it end, so no task sees a whole bucket.

Tokens are the words `[^\\x20\\x09-\\x0D]+` and one end token, or what `count` makes of a batch of
texts. Null and empty texts are one end token. Ties are numbered by shard, doc_id and piece.
An empty table gives an empty result; repeated rows are sequences of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.llm import text as tx
from tradeloom.llm.tasks import map_batches, written

_ROWS_PER_SHARD = 50_000


def word_tokens(texts: pa.Array) -> np.ndarray:
    """Words of each text and one end token."""
    counts = [tx.Words(b, tx.WHITE, lower=False).counts for b in tx.blocks(texts)]
    return np.concatenate(counts) + 1 if counts else np.zeros(0, np.int64)


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The at most `buckets` upper bounds with the least total padding.

    cost[j]: least padding of the j shortest distinct lengths. The best last cut moves right
    with j, so each layer is solved by halving: O(buckets * n * log n).
    """
    order = np.argsort(lengths)
    lengths, counts = lengths[order].astype(np.float64), counts[order].astype(np.float64)
    n = len(lengths)
    if not n:
        return []
    rows = np.r_[0.0, np.cumsum(counts)]
    tokens = np.r_[0.0, np.cumsum(counts * lengths)]
    cost = np.r_[0.0, np.full(n, np.inf)]
    cuts = []
    for _ in range(min(buckets, n)):
        best, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        best[0] = 0.0
        stack = [(1, n, 0, n - 1)]
        while stack:
            low, high, first, last = stack.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            total = cost[i] + lengths[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])
            at = int(np.argmin(total))
            best[j], cut[j] = total[at], i[at]
            stack += [(low, j - 1, first, int(i[at])), (j + 1, high, int(i[at]), last)]
        cost = best
        cuts.append(cut)
    bounds, j = [], n
    for cut in reversed(cuts):
        if j:
            bounds.append(int(lengths[j - 1]))
            j = int(cut[j])
    return sorted(set(bounds))


def sequences(docs: DataFrame, max_len: int, count: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """(doc_id, piece, n_tokens): every document's sequences."""

    def run(batches):
        for batch in batches:
            tokens = count(batch.column(1))
            pieces = -(-tokens // max_len)
            doc = np.repeat(np.arange(batch.num_rows), pieces)
            piece = tx.spans(np.zeros(len(pieces), np.int64), pieces)
            size = np.minimum(max_len, tokens[doc] - piece * max_len)
            ids = batch.column(0).take(pa.array(doc))
            yield pa.record_batch([ids, pa.array(piece), pa.array(size, pa.int64())], names=["doc_id", "piece", "n_tokens"])

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(typed, ["doc_id", "text"], run, "doc_id long, piece long, n_tokens long")


def pack(
    docs: DataFrame,
    buckets: int = 16,
    budget: int = 65_536,
    max_len: int = 4_096,
    count: Callable[[pa.Array], np.ndarray] = word_tokens,
) -> DataFrame:
    """Per sequence: doc_id, piece, n_tokens, bucket, bucket_len, batch (in its bucket), slot."""
    if budget < max_len:
        raise ValueError("a batch must hold at least one sequence of max_len")
    rows = written(sequences(docs, max_len, count), "sequences")
    histogram = rows.groupBy("n_tokens").count().collect()  # at most max_len rows
    lengths = np.array([r["n_tokens"] for r in histogram], np.int64)
    counts = np.array([r["count"] for r in histogram], np.int64)
    bounds = best_bounds(lengths, counts, buckets)
    shards = max(64, math.ceil(int(counts.sum()) / _ROWS_PER_SHARD))

    at = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        at = F.when(F.col("n_tokens") <= bounds[i], F.lit(i)).otherwise(at)
    bound = F.get(F.array(*[F.lit(b) for b in bounds] or [F.lit(0)]), F.col("bucket"))
    dealt = rows.withColumn("bucket", at.cast("int")).withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.lit(shards)).cast("int")
    )
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("bucket", "shard").count()  # at most buckets * shards rows
    starts = sizes.select("bucket", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("bucket", "shard").orderBy("doc_id", "piece")
    numbered = dealt.withColumn("own", F.row_number().over(own) - 1).join(starts, ["bucket", "shard"])
    number = F.col("start") + F.col("own")
    capacity = F.floor(F.lit(budget) / F.col("bucket_len")).cast("long")
    return numbered.withColumn("bucket_len", bound.cast("long")).select(
        "doc_id",
        "piece",
        "n_tokens",
        F.col("bucket").cast("long").alias("bucket"),
        "bucket_len",
        F.floor(number / capacity).cast("long").alias("batch"),
        F.pmod(number, capacity).cast("long").alias("slot"),
    )


def query(spark, folder: str) -> DataFrame:
    return pack(spark.read.parquet(f"{folder}/documents.parquet"))


ORACLE = None

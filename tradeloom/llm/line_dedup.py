"""Line deduplication that returns keep bitmaps.

Line hashes are range-partitioned by (hash, document) and sorted inside each partition by hash,
then document from the largest down, then position. Each partition is streamed: the first
document of a hash keeps its lines, and if the hash is held by enough documents all others lose
theirs. Ranges include the document, so one very common line spreads over many partitions; the
at most two hashes per partition that may go on in a neighbour are summed up in a second small
step. The result is one compressed bitmap per document, not text.

A line's key is the line without `[\\x20\\x09-\\x0D]` at its ends and with A-Z lower-cased; keys of
fewer than `min_chars` code points are never dropped. Null and empty texts are one empty line.
A null `doc_id` ranks below all others. Rows that repeat a doc_id are one document when holders
are counted, and each gets its own result row. Lines and texts of any length are taken whole. An
empty table gives no rows. `doc_id` is cast to long.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.llm import text as tx
from tradeloom.llm.tasks import importable, map_batches, written

_NULL_ID = -(1 << 63)


class Lines:
    """Lines of a block: byte ranges, and ranges and hashes of their keys."""

    def __init__(self, block: tx.Block):
        data = block.lowered()
        breaks = np.flatnonzero(data == 0x0A)
        self.counts = np.diff(np.searchsorted(breaks, block.offsets)) + 1
        doc_start, doc_end = block.offsets[:-1], block.offsets[1:]
        self.starts = np.sort(np.concatenate([doc_start, breaks + 1]), kind="stable")
        self.ends = np.sort(np.concatenate([doc_end, breaks]), kind="stable")
        solid = np.flatnonzero(~tx.WHITE[data])
        first, last = np.searchsorted(solid, self.starts), np.searchsorted(solid, self.ends)
        some = first < last
        solid = np.r_[solid, 0]
        self.key_starts = np.where(some, solid[first], self.starts)
        self.key_ends = np.where(some, solid[last - 1] + 1, self.starts)
        points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        self.key_chars = points[self.key_ends] - points[self.key_starts]
        self._data = data

    def hashes(self, at: np.ndarray) -> np.ndarray:
        return tx.byte_range_hash(self._data, self.key_starts[at], self.key_ends[at])


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, mark, n_lines, at, keys): the hashed lines of each row."""

    def run(batches):
        for batch in batches:
            counts, ats, keys = [], [], []
            for block in tx.blocks(batch.column(2)):
                lines = Lines(block)
                long = np.flatnonzero(lines.key_chars >= min_chars)
                bounds = np.r_[0, np.cumsum(lines.counts)]
                edges = np.searchsorted(long, bounds)
                ats.append((np.diff(edges), long - np.repeat(bounds[:-1], np.diff(edges))))
                keys.append(lines.hashes(long).view(np.int64))
                counts.append(lines.counts)
            sizes = np.concatenate([a for a, _ in ats]) if ats else np.zeros(0, np.int64)
            offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            join = lambda xs, kind: np.concatenate(xs).astype(kind) if xs else np.zeros(0, kind)
            yield pa.record_batch(
                [
                    batch.column(0), batch.column(1), pa.array(join(counts, np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(join([x for _, x in ats], np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(join(keys, np.int64))),
                ],
                names=["doc_id", "mark", "n_lines", "at", "keys"],
            )

    return map_batches(_marked(docs), ["doc_id", "mark", "text"], run, "doc_id long, mark long, n_lines long, at array<int>, keys array<long>")


def _marked(docs: DataFrame) -> DataFrame:
    """`mark` tells apart rows of one doc_id with different texts."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _decide(holders: int):
    """Stream sorted (key, doc, mark, at) rows; `open` marks groups that may go on elsewhere."""

    def settle(rows: pa.Table):
        key, doc = rows["key"].to_numpy(), rows["doc"].to_numpy()
        new_key = np.r_[True, key[1:] != key[:-1]]
        new_doc = new_key | np.r_[True, doc[1:] != doc[:-1]]
        group = np.cumsum(new_key) - 1
        docs = np.bincount(group, weights=new_doc)
        first = doc[np.flatnonzero(new_key)]
        drop = (docs[group] >= holders) & (doc != first[group])
        return rows.filter(pa.array(drop))

    def out(rows: pa.Table, is_open: bool):
        return rows.append_column("open", pa.array(np.full(rows.num_rows, is_open))).combine_chunks().to_batches()

    def run(batches):
        carry, at_start = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if carry is None else pa.concat_tables([carry, rows])
            key = rows["key"].to_numpy()
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            if at_start and len(cuts):
                yield from out(rows.slice(0, cuts[0]), True)
                rows, cuts, at_start = rows.slice(cuts[0]), cuts[1:] - cuts[0], False
            if len(cuts):
                yield from out(settle(rows.slice(0, cuts[-1])), False)
                rows = rows.slice(cuts[-1])
            carry = rows
        if carry is not None:
            yield from out(carry, True)

    return run


def dropped_lines(keyed: DataFrame, holders: int) -> DataFrame:
    """(doc, mark, at) of every line that goes."""
    importable(keyed.sparkSession)
    doc = F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc")
    one = keyed.select(doc, "mark", F.explode(F.arrays_zip("keys", "at")).alias("l"))
    one = one.select(F.col("l.keys").alias("key"), "doc", "mark", F.col("l.at").alias("at"))
    order = [F.col("key"), F.col("doc").desc(), F.col("mark"), F.col("at")]
    ranged = one.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "key long, doc long, mark long, at int, open boolean"
    seen = written(ranged.mapInArrow(_decide(holders), schema), "lines")
    edge = seen.where("open")
    totals = edge.groupBy("key", "doc").agg(F.lit(1).alias("one")).groupBy("key")
    totals = totals.agg(F.count("*").alias("docs"), F.max("doc").alias("top"))
    # At most two keys per partition are open, so `totals` is bounded by the partition count.
    rest = edge.join(F.broadcast(totals.where(F.col("docs") >= holders)), "key").where("doc <> top")
    return seen.where("not open").select("doc", "mark", "at").union(rest.select("doc", "mark", "at"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, holders: int = 3) -> DataFrame:
    """Per distinct (doc_id, text): doc_id, mark, n_lines, n_dropped, keep (zlib bitmap; null: all)."""
    keyed = written(line_keys(docs, min_chars), "line_keys")
    gone = dropped_lines(keyed, holders).distinct()
    gone = gone.groupBy("doc", "mark").agg(F.collect_list("at").alias("gone"))
    rows = keyed.select("doc_id", "mark", "n_lines").distinct()
    doc = F.coalesce(rows["doc_id"], F.lit(_NULL_ID))
    joined = rows.join(gone, (doc == gone["doc"]) & (rows["mark"] == gone["mark"]), "left")
    joined = joined.select("doc_id", rows["mark"], "n_lines", "gone")

    def run(batches):
        for batch in batches:
            n, maps = [], []
            for lines, gone in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                at = gone.values.to_numpy() if gone.is_valid else None
                n.append(0 if at is None else len(at))
                if at is None:
                    maps.append(None)
                    continue
                keep = np.ones(lines, bool)
                keep[at] = False
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
            yield pa.record_batch(
                [*batch.columns[:3], pa.array(n, pa.int64()), pa.array(maps, pa.binary())],
                names=["doc_id", "mark", "n_lines", "n_dropped", "keep"],
            )

    return joined.mapInArrow(run, "doc_id long, mark long, n_lines long, n_dropped long, keep binary")


def apply_bitmap(text: bytes, n_lines: int, keep: bytes | None) -> bytes:
    if keep is None:
        return text
    kept = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:n_lines]
    return b"\n".join(line for line, k in zip(text.split(b"\n"), kept, strict=True) if k)


def _same(left: Column, right: Column) -> Column:
    return F.coalesce(left, F.lit(_NULL_ID)) == F.coalesce(right, F.lit(_NULL_ID))


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    maps = keep_bitmaps(docs).hint("shuffle_hash")
    rows = _marked(docs)
    joined = rows.join(maps, _same(rows["doc_id"], maps["doc_id"]) & (rows["mark"] == maps["mark"]))
    joined = joined.select(rows["doc_id"], "n_lines", "n_dropped", "keep", F.col("text").cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            n, keep, text = (batch.column(i) for i in (1, 3, 4))
            shas = [
                hashlib.sha256(apply_bitmap(t.as_py(), k.as_py(), b.as_py())).hexdigest()
                for t, k, b in zip(text, n, keep, strict=True)
            ]
            yield pa.record_batch([*batch.columns[:3], pa.array(shas, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


_STRIPPED = r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
ORACLE = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents
), k AS (
  SELECT doc_id, i, line, translate({_STRIPPED}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), h AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), f AS (
  SELECT doc_id, i, line, top IS NOT NULL AND doc_id <> top AS gone FROM k LEFT JOIN h USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

"""Removal of passages that repeat across documents, by groups of equal windows.

A window is `window` consecutive words of one document. Windows are what the suffixes of the word
sequences begin with, and two documents repeat each other where their suffixes share one. No
suffix tree is built and prefixes do not vary in length: windows are grouped by the hash of all
their words, which finds equal ones without sorting suffixes.

1. Screen. Among the `_PREFIX`-word parts that start inside a window, the one of least hash stands
   for the window. Equal windows have equal parts, so a window can only repeat if its part does.
   The parts of all documents are grouped; a document none of whose parts occurs in another
   document is done.
2. Groups. Every window of the other documents is dealt by its hash to buckets, whose number grows
   with the input. A task keeps only those of the smallest document per hash and settles the
   rest, so a passage that very many documents share reaches its bucket once per task.
3. Repeats. Windows of all but the smallest document of a hash go; runs of them are merged to
   maximal repeats per document, and their words are removed.

Windows are told apart by 64-bit hashes. Null texts have no words; an empty text stays empty; texts
of any length are cut whole. A null `doc_id` ranks below all others. Rows with one doc_id do not repeat
each other, and each gets its own row. An empty table gives no rows. `doc_id` is cast to long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.llm import text as tx
from tradeloom.llm.tasks import (
    bucket_count,
    by_bucket,
    map_batches,
    packed,
    packed_runs,
    packed_schema,
    written,
)
from tradeloom.llm.text import U64, mix

_PREFIX = 25
_CHUNK = 600_000  # suffixes a task sorts at once; some 200 bytes each
_BUCKET_BYTES = 4 << 20  # input bytes per group of suffixes
_NULL_ID = -(1 << 63)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, its rank `d`, a `row` id that equal rows share, and the text."""
    doc_id = F.col("doc_id").cast("long")
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        doc_id.alias("doc_id"),
        F.coalesce(doc_id, F.lit(_NULL_ID)).alias("d"),
        F.xxhash64(doc_id, text).alias("row"),
        text.alias("text"),
    )


def _buckets_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> U64(40)).astype(np.int64) * buckets >> 24


def prefix_hashes(hashes: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, least prefix hash) of the windows of each text, neighbours of equal hash once."""
    size = min(_PREFIX, window)
    starts, _ = tx.windows(hashes, bounds, window)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    every = np.arange(len(hashes) - size + 1)
    least = tx.range_hash(hashes, every, every + size)
    width, done = window - size + 1, 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    least = least[starts]
    doc = np.searchsorted(bounds, starts, "right") - 1
    new = np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])]
    return doc[new], least[new]


def sharing_documents(rows: DataFrame, window: int, buckets: int) -> DataFrame:
    """(d): ranks of documents that have a prefix in common with another document."""

    def run(batches):
        held, size = [], 0

        def flush():
            prefix = np.concatenate([p for p, _ in held])
            d = np.concatenate([x for _, x in held])
            order = np.lexsort((d, prefix))
            prefix, d = prefix[order], d[order]
            new = np.r_[True, prefix[1:] != prefix[:-1]]
            keep = new | np.r_[True, d[1:] != d[:-1]]
            prefix, d, new = prefix[keep], d[keep], new[keep]
            # A prefix goes on for its least document only. All documents of a prefix that has
            # several here are known to share: each says so under a private prefix, which it
            # has in common with another one of them.
            least = d[new][np.cumsum(new) - 1]
            known = np.unique(np.concatenate([d[~new], least[~new]]))
            private = mix(known.view(U64) ^ U64(0xA0761D6478BD642F))
            prefix = np.concatenate([prefix[new], private, private])
            d = np.concatenate([d[new], known, np.roll(known, 1)])
            return packed(_buckets_of(mix(prefix), buckets), [prefix, d])

        for batch in batches:
            ranks = batch.column(0).to_numpy()
            for block in tx.blocks(batch.column(1)):
                words = tx.Words(block, tx.WHITE, lower=False)
                doc, prefix = prefix_hashes(words.hashes(), words.bounds, window)
                held.append((prefix, ranks[block.first + doc]))
                size += len(prefix)
                if size >= _CHUNK:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def meet(prefix: np.ndarray, d: np.ndarray) -> pa.Table:
        order = np.lexsort((d, prefix))
        prefix, d = prefix[order], d[order]
        new = np.r_[True, prefix[1:] != prefix[:-1]]
        group = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        tail = np.r_[head[1:], len(d)] - 1
        several = d[head] != d[tail]
        return pa.table({"d": np.unique(d[several[group]])})

    sent = map_batches(rows, ["d", "text"], run, packed_schema(2))
    return by_bucket(sent, [U64, np.int64], meet, "d long").distinct()


def _settle(rows: DataFrame, sharing: DataFrame) -> DataFrame:
    """doc_id, d, row, n_words, and the text where it can lose words or else its final hash."""
    mark = sharing.withColumnRenamed("d", "shared").hint("shuffle_hash")
    joined = rows.join(mark, rows["d"] == mark["shared"], "left")
    joined = joined.select("doc_id", "d", "row", F.col("shared").isNotNull().alias("open"), "text")

    def run(batches):
        for batch in batches:
            is_open = batch.column(3).to_numpy(zero_copy_only=False)
            counts, shas = [], []
            for block in tx.blocks(batch.column(4)):
                words = tx.Words(block, tx.WHITE, lower=False)
                counts.append(words.counts)
                shas += [
                    None if is_open[block.first + i] else kept_hash(words, i, None)
                    for i in range(block.n)
                ]
            if counts:
                text = pc.if_else(batch.column(3), batch.column(4), pa.scalar(None, batch.column(4).type))
                columns = [*batch.columns[:3], pa.array(np.concatenate(counts), pa.int64()), pa.array(shas, pa.string()), text]
                yield pa.record_batch(columns, names=["doc_id", "d", "row", "n_words", "sha", "text"])

    return joined.mapInArrow(run, "doc_id long, d long, row long, n_words long, sha string, text string")


def kept_hash(words: tx.Words, i: int, gone: np.ndarray | None) -> str:
    """SHA-256 of the words of text i that are not gone, joined by one space."""
    a, b = int(words.bounds[i]), int(words.bounds[i + 1])
    starts, ends = words.starts[a:b], words.ends[a:b]
    if gone is not None:
        starts, ends = starts[~gone], ends[~gone]
    if not len(starts):
        return hashlib.sha256(b"").hexdigest()
    # Each word with one byte after it; that byte becomes a space and the last one goes.
    lengths = ends - starts + 1
    at = tx.spans(starts, lengths)
    last = np.cumsum(lengths) - 1
    at[last] = 0
    kept = words.bytes[at]
    kept[last] = 0x20
    return hashlib.sha256(kept[:-1].tobytes()).hexdigest()


def repeated_suffixes(rows: DataFrame, window: int, buckets: int) -> DataFrame:
    """Packed (row, position) of the suffixes that a smaller document holds too, by row."""
    none = [np.zeros(0, t) for t in (np.int64, np.int64, np.uint32, U64, np.uint32)]

    def by_row(row: np.ndarray, at: np.ndarray, owner: np.ndarray) -> pa.RecordBatch | None:
        return packed_runs(_buckets_of(mix(row[owner].view(U64)), buckets), owner, [row], [at])

    def run(batches):
        held, size = [], 0

        def flush():
            node, d, row, at = (np.concatenate([h[k] for h in held]) for k in range(4))
            held.clear()
            order = np.lexsort((d, node))
            node, d, row, at = node[order], d[order], row[order], at[order]
            new = np.r_[True, node[1:] != node[:-1]]
            least = d[new][np.cumsum(new) - 1] == d
            for chosen, decided in ((least, False), (~least, True)):
                who, owner = np.unique(row[chosen], return_inverse=True)
                if not len(who):
                    continue
                rank = np.zeros(len(who), np.int64)
                rank[owner] = d[chosen]
                target = mix(row[chosen].view(U64)) if decided else mix(node[chosen])
                yield packed_runs(
                    _buckets_of(target, buckets), owner,
                    [who, np.full(len(who), 0, np.int64) if decided else rank],
                    [np.zeros(int(chosen.sum()), U64) if decided else node[chosen], at[chosen]],
                ).append_column("decided", pa.array([decided] * len(np.unique(_buckets_of(target, buckets)))))

        for batch in batches:
            d, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for block in tx.blocks(batch.column(2)):
                words = tx.Words(block, tx.WHITE, lower=False)
                starts, nodes = tx.windows(words.hashes(), words.bounds, window)
                doc = np.searchsorted(words.bounds, starts, "right") - 1
                own = block.first + doc
                held.append((nodes, d[own], row[own], (starts - words.bounds[doc]).astype(np.uint32)))
                size += len(nodes)
                if size >= _CHUNK:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    sent = map_batches(rows, ["d", "row", "text"], run, packed_schema(5) + ", decided boolean")

    def meet(table: pa.Table) -> pa.Table:
        kinds = (np.int64, np.int64, np.uint32, U64, np.uint32)
        decided = table.column("decided")

        def arrays(which: pa.Table):
            if not which.num_rows:
                return none
            return [np.frombuffer(b"".join(which.column(f"a{i}").to_pylist()), k) for i, k in enumerate(kinds)]

        row, rank, many, node, at = arrays(table.filter(pc.invert(decided)))
        owner, d = np.repeat(np.arange(len(row)), many), np.repeat(rank, many)
        order = np.lexsort((d, node))
        node, d, owner, at = node[order], d[order], owner[order], at[order]
        new = np.ones(len(node), bool)
        new[1:] = node[1:] != node[:-1]
        least = d[new][np.cumsum(new) - 1] if len(node) else d
        gone = d != least
        more = arrays(table.filter(decided))
        rows_ = np.concatenate([row, more[0]])
        owners = np.concatenate([owner[gone], len(row) + np.repeat(np.arange(len(more[0])), more[2])])
        made = by_row(rows_, np.concatenate([at[gone], more[4]]), owners)
        empty = pa.table({"bucket": pa.array([], pa.int32()), **{f"a{i}": pa.array([], pa.binary()) for i in range(3)}})
        return empty if made is None else pa.Table.from_batches([made])

    return sent.groupBy("bucket").applyInArrow(meet, packed_schema(3))


def maximal_repeats(rows: DataFrame, window: int, buckets: int) -> DataFrame:
    """(row, starts, ends): the word ranges that each row loses."""

    def merge(row: np.ndarray, many: np.ndarray, at: np.ndarray) -> pa.Table | None:
        row, at = np.repeat(row, many), at.astype(np.int64)
        order = np.lexsort((at, row))
        row, at = row[order], at[order]
        if not len(row):
            return None
        new = np.r_[True, (row[1:] != row[:-1]) | (at[1:] > at[:-1] + window)]
        head = np.flatnonzero(new)
        tail = np.r_[head[1:], len(row)] - 1
        first = np.flatnonzero(np.r_[True, row[head][1:] != row[head][:-1]])
        offsets = pa.array(np.r_[first, len(head)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (at[head], at[tail] + window)]
        return pa.table({"row": pa.array(row[head][first]), "starts": lists[0], "ends": lists[1]})

    sent = repeated_suffixes(rows, window, buckets)
    return by_bucket(sent, [np.int64, np.uint32, np.uint32], merge, "row long, starts array<int>, ends array<int>")


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """Per row: doc_id, n_words, starts and ends of the removed word ranges, n_removed, kept_sha256."""
    buckets = bucket_count(docs, _BUCKET_BYTES)
    keyed = _keyed(docs)
    settled = written(_settle(keyed, sharing_documents(keyed, window, buckets)), "settled")
    rows = settled.where("text IS NOT NULL")
    gone = maximal_repeats(rows, window, buckets).withColumnRenamed("row", "own").hint("shuffle_hash")
    joined = rows.join(gone, rows["row"] == gone["own"], "left").select("doc_id", "n_words", "starts", "ends", "text")

    def run(batches):
        for batch in batches:
            shas, removed = [], []
            for block in tx.blocks(batch.column(4)):
                words = tx.Words(block, tx.WHITE, lower=False)
                for i in range(block.n):
                    starts, ends = (batch.column(k)[block.first + i] for k in (2, 3))
                    gone = np.zeros(int(words.counts[i]), bool)
                    if starts.is_valid:
                        for a, b in zip(starts.as_py(), ends.as_py(), strict=True):
                            gone[a:b] = True
                    removed.append(int(gone.sum()))
                    shas.append(kept_hash(words, i, gone))
            yield pa.record_batch(
                [*batch.columns[:4], pa.array(removed, pa.int64()), pa.array(shas, pa.string())],
                names=["doc_id", "n_words", "starts", "ends", "n_removed", "kept_sha256"],
            )

    schema = "doc_id long, n_words long, starts array<int>, ends array<int>, n_removed long, kept_sha256 string"
    none = F.lit(None).cast("array<int>")
    whole = settled.where("text IS NULL").select(
        "doc_id", "n_words", none.alias("starts"), none.alias("ends"),
        F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"),
    )
    return whole.union(joined.mapInArrow(run, schema))


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50
), v AS (
  SELECT doc_id, k, md5(array_to_string(w[k : k + 49], ' ')) AS win FROM p
), again AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY win) AS first FROM v) WHERE first < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS pos FROM again
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def brute_force(documents: list, window: int = 50) -> dict:
    """The same with a dictionary of all windows, for tests: {doc_id: (n_words, n_removed, hash)}."""
    import re

    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in documents}
    least: dict[tuple, int] = {}
    for i, own in words.items():
        for at in range(len(own) - window + 1):
            key = tuple(own[at : at + window])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, own in words.items():
        gone = set()
        for at in range(len(own) - window + 1):
            if least[tuple(own[at : at + window])] < i:
                gone |= set(range(at, at + window))
        kept = " ".join(w for k, w in enumerate(own) if k not in gone)
        out[i] = (len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out

"""Benchmark decontamination by a prefix-filtered set join.

Items are cut into windows of `window` consecutive words (a shorter item is one window). A
window is a set of shingles, all of which must occur in a document that contains it, so one
shingle per window is a sufficient prefix: the one that is rarest over all documents. Document
shingles are joined with those prefixes; a match fixes where the window would have to start,
which must lie inside the text (positional bound) with enough words after it (length bound);
what is left is verified against the window's hash and then word by word.

The window index is cut into blocks of at most `WINDOWS_PER_BLOCK` windows, each of which is
broadcast and passed over all documents; a larger benchmark takes more passes, never less work.

Null text has no words. Items or documents without words match nothing. A null `item_id` hits
words but is not listed. Repeated items with one id count once; repeated documents each get a row.
Texts of any length are searched whole. Without items nothing is hit; without documents there are
no rows. `doc_id` is cast to long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.llm import text as tx
from tradeloom.llm.tasks import add_columns, boxed, map_batches, unboxed, written

WINDOWS_PER_BLOCK = 100_000
SHINGLE = 5

_WINDOW = "item_id long, win long, size int, words array<string>"


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, win, size, words): each distinct window of each item."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {"item_id": [], "win": [], "size": [], "words": []}
            ids = batch.column(0).to_pylist()
            for block in tx.blocks(batch.column(1)):
                words = tx.Words(block, tx.NOT_ALNUM, lower=True)
                hashes = words.hashes()
                for d in range(block.n):
                    first, last = int(words.bounds[d]), int(words.bounds[d + 1])
                    size = min(window, last - first)
                    if not size:
                        continue
                    starts = np.arange(first, last - size + 1)
                    wins = tx.range_hash(hashes, starts, starts + size).view(np.int64)
                    for win, at in zip(*np.unique(wins, return_index=True), strict=True):
                        out["item_id"].append(ids[block.first + d])
                        out["win"].append(int(win))
                        out["size"].append(size)
                        out["words"].append(
                            [words.word(i).decode() for i in range(first + at, first + at + size)]
                        )
            yield pa.RecordBatch.from_pydict(
                out,
                pa.schema(
                    [("item_id", pa.int64()), ("win", pa.int64()), ("size", pa.int32()), ("words", pa.list_(pa.string()))]
                ),
            )

    typed = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return map_batches(typed, ["item_id", "text"], run, _WINDOW)


class _Lookup:
    """Which of many hashes are among a few sorted ones, and where."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self._seen = np.zeros(1 << 22, bool)
        self._seen[keys >> np.uint64(42)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `hashes` that match, and the index of the first equal key."""
        maybe = np.flatnonzero(self._seen[hashes >> np.uint64(42)])
        at = np.searchsorted(self.keys, hashes[maybe])
        same = self.keys[np.minimum(at, len(self.keys) - 1)] == hashes[maybe]
        return maybe[same], at[same]


def _shingles(words: list[str]) -> list[int]:
    hashes = np.array([tx.word_hash(w.encode()) for w in words], np.uint64)
    width = min(SHINGLE, len(words))
    starts = np.arange(len(words) - width + 1)
    return tx.range_hash(hashes, starts, starts + width).tolist()


def _rarity(docs: DataFrame, keys: np.ndarray, widths: list[int]) -> np.ndarray:
    """How often each of the block's shingles occurs in all documents."""
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast(keys)

    def run(batches):
        lookup = _Lookup(sent.value)
        counts = np.zeros(len(lookup.keys), np.int64)
        for batch in batches:
            for block in tx.blocks(batch.column(0)):
                words = tx.Words(block, tx.NOT_ALNUM, lower=True)
                hashes = words.hashes()
                for width in widths:
                    _, shingles = tx.windows(hashes, words.bounds, width)
                    _, at = lookup.find(shingles)
                    counts += np.bincount(at, minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at), pa.array(counts[at])], names=["at", "n"])

    found = map_batches(docs, ["text"], run, "at long, n long")
    counts = np.zeros(len(keys), np.int64)
    for row in found.groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[row["at"]] = row["n"]
    return counts


class _Index:
    """The windows of one block by the hash of their rarest shingle."""

    def __init__(self, windows: list, docs: DataFrame):
        shingles = [_shingles(w["words"]) for w in windows]
        self.widths = sorted({min(SHINGLE, w["size"]) for w in windows})
        keys = np.unique(np.array([s for row in shingles for s in row], np.uint64))
        counts = _rarity(docs, keys, self.widths)
        rows = []
        for w, own in zip(windows, shingles, strict=True):
            at = np.searchsorted(keys, np.array(own, np.uint64))
            offset = min(range(len(own)), key=lambda i: (counts[at[i]], own[i]))
            rows.append((own[offset], offset, w["size"], w["win"], w["words"]))
        rows.sort(key=lambda r: r[:4])
        self.prefix = np.array([r[0] for r in rows], np.uint64)
        self.offset = np.array([r[1] for r in rows], np.int64)
        self.size = np.array([r[2] for r in rows], np.int64)
        self.win = np.array([r[3] for r in rows], np.int64).view(np.uint64)
        self.words = [" ".join(r[4]).encode() for r in rows]


def _occurrences(index: _Index, lookup: _Lookup, words: tx.Words) -> tuple[np.ndarray, np.ndarray]:
    """Word position and index entry of every window occurrence in a block of texts."""
    hashes = words.hashes()
    docs = words.docs()
    starts, entries = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ends = np.searchsorted(index.prefix, index.prefix, "right")
    for width in index.widths:
        places, shingles = tx.windows(hashes, words.bounds, width)
        hit, first = lookup.find(shingles)
        several = ends[first] - first
        entry = tx.spans(first, several)
        place = np.repeat(places[hit], several)
        start = place - index.offset[entry]
        doc = docs[place]
        fits = (start >= words.bounds[doc]) & (start + index.size[entry] <= words.bounds[doc + 1])
        fits &= np.minimum(index.size[entry], SHINGLE) == width
        start, entry = start[fits], entry[fits]
        same = tx.range_hash(hashes, start, start + index.size[entry]) == index.win[entry]
        starts.append(start[same])
        entries.append(entry[same])
    start, entry = np.concatenate(starts), np.concatenate(entries)
    exact = [
        b" ".join(words.word(i) for i in range(s, s + index.size[e]))
        == index.words[e]
        for s, e in zip(start.tolist(), entry.tolist(), strict=True)
    ]
    exact = np.array(exact, bool)
    return start[exact], entry[exact]


def _ints(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values).cast(kind))


def find_windows(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """`docs` with _n_words, _at, _len (arrays: each occurrence's word range) and _wins.

    windows: distinct (win, size, words) rows, read block by block.
    """
    sc = docs.sparkSession.sparkContext
    blocks = max(1, -(-windows.count() // WINDOWS_PER_BLOCK))
    texts = docs.select("text")
    found = docs
    schema = "_n_words long, _at array<int>, _len array<int>, _wins array<long>"
    for number in range(blocks):
        block = windows.where(F.pmod("win", F.lit(blocks)) == number).collect()
        index = sc.broadcast(_Index(block, texts) if block else None)

        def look(batch: pa.RecordBatch, sent=index) -> list[pa.Array]:
            index = sent.value
            lookup = _Lookup(index.prefix) if index else None
            counts, at, sizes, wins = [], [], [], []
            for block in tx.blocks(batch.column(0)):
                words = tx.Words(block, tx.NOT_ALNUM, lower=True)
                counts.append(words.counts)
                start, entry = _occurrences(index, lookup, words) if index else (np.zeros(0, np.int64),) * 2
                order = np.lexsort((entry, start))
                start, entry = start[order], entry[order]
                edges = np.searchsorted(start, words.bounds)
                for d in range(block.n):
                    own = slice(edges[d], edges[d + 1])
                    at.append(start[own] - words.bounds[d])
                    sizes.append(index.size[entry[own]] if index else start[own])
                    wins.append(np.unique(index.win[entry[own]]).view(np.int64) if index else start[own])
            return [
                pa.array(np.concatenate(counts), pa.int64()),
                _ints(at, pa.int32()), _ints(sizes, pa.int32()), _ints(wins, pa.int64()),
            ]

        if number == 0:
            found = add_columns(found, look, schema)
        else:
            more = add_columns(found, look, schema.replace("_n_words", "_n2").replace("_at", "_at2").replace("_len", "_len2").replace("_wins", "_wins2"))
            found = more.select(
                *[c for c in docs.columns],
                "_n_words", *[F.concat(c, f"{c}2").alias(c) for c in ("_at", "_len", "_wins")],
            )
    return found


def _covered() -> Column:
    """Words covered by the union of the ranges in _at and _len."""
    ranges = F.array_sort(F.arrays_zip("_at", "_len"))
    start = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("n"))

    def add(acc, r):
        end = r["_at"] + r["_len"]
        new = F.greatest(F.lit(0), end - F.greatest(r["_at"], acc["reach"]))
        return F.struct(F.greatest(end, acc["reach"]).alias("reach"), (acc["n"] + new).alias("n"))

    return F.aggregate(ranges, start, add, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, at and sizes (the hit ranges), items (sorted ids)."""
    pairs = written(item_windows(items, window), "windows")
    windows = written(pairs.groupBy("win").agg(F.first("size").alias("size"), F.first("words").alias("words")), "windows")
    found = find_windows(docs.select("doc_id", "text"), windows).drop("text")
    # The row number is frozen by writing the rows: it tells repeated doc_ids apart.
    found = written(found.withColumn("_row", F.monotonically_increasing_id()), "hits")
    named = pairs.select("win", F.col("item_id").cast("string").alias("item"))
    listed = (
        found.select("_row", F.explode("_wins").alias("win"))
        .join(named, "win")
        .groupBy("_row")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    n_hit = _covered().cast("long")
    return found.join(listed, "_row", "left").select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.col("_at").alias("at"),
        F.col("_len").alias("sizes"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The documents, all columns, that hold no window of any item."""
    pairs = written(item_windows(items, window), "windows")
    windows = written(pairs.groupBy("win").agg(F.first("size").alias("size"), F.first("words").alias("words")), "windows")
    found = find_windows(boxed(docs), windows)
    return unboxed(found.where(F.size("_at") == 0), docs.columns)


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontaminate(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), p AS (
  SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0
), iw AS (
  SELECT DISTINCT item_id, size, array_to_string(w[k : k + size - 1], ' ') AS win FROM p
), q AS (
  SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size
), hits AS (
  SELECT DISTINCT rid, k, size, item_id FROM (SELECT rid, k, size, array_to_string(w[k : k + size - 1], ' ') AS win FROM q) JOIN iw USING (win, size)
), words AS (
  SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(k, k + size)) AS pos FROM (SELECT DISTINCT rid, k, size FROM hits)) GROUP BY rid
), names AS (
  SELECT rid, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS name FROM hits) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN names USING (rid)
"""


def brute_force(documents: list, items: list, window: int = 10) -> dict:
    """The same by plain search, for tests: {doc_id: (n_words, n_hit, items)}."""
    import re

    def split(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    grams = []
    for item_id, text in items:
        words = split(text)
        size = min(window, len(words))
        grams += [(item_id, tuple(words[i : i + size])) for i in range(len(words) - size + 1) if size]
    out = {}
    for doc_id, text in documents:
        words, hit, names = split(text), set(), set()
        for item_id, gram in grams:
            for i in range(len(words) - len(gram) + 1):
                if tuple(words[i : i + len(gram)]) == gram:
                    hit |= set(range(i, i + len(gram)))
                    names.add(str(item_id))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out[doc_id] = (len(words), len(hit), len(names), digest)
    return out

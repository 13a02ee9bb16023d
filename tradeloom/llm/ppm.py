"""Language-model scores by prediction by partial matching over bytes.

Every context of up to ORDER symbols that occurs in the training texts is in the model, with exact
counts. Seen symbols share n / (n + q), the escape has q / (n + q) for q distinct symbols (method
C), and what escapes goes to the next shorter context, in which symbols that the longer ones have
seen are excluded. A text's code length is the sum over its bytes, A-Z lower-cased, and one end
symbol.

The contexts of order 0 to ROOT, a bounded number, are counted in one pass and sent to all tasks. The
longer ones are spread over buckets by their last three symbols, so a context and its suffixes
meet. Texts are dealt to chunks of a bounded size; a chunk sends each distinct gram (ORDER symbols
and the next one) once to its bucket, with its count in training texts, gets its log-probability
back, and sums these over its texts.

For comparison each text also gets an add-one word model's score. Its word counts are exact:
the most frequent words, a bounded list, are looked up where the text is; all others meet in
buckets by hash, where they are counted and scored at once.

Null texts are empty and have just the end symbol. Without training texts all scores are those
of uniform models. Repeated rows each count and each get a row. Texts of any length are scored
whole. An empty table gives no rows. `doc_id` is cast to long; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.llm import text as tx
from tradeloom.llm.tasks import (
    bucket_count,
    by_bucket,
    importable,
    map_batches,
    packed,
    packed_runs,
    packed_schema,
    written,
)
from tradeloom.llm.text import U64, mix

SYMBOLS = 257  # the end of a text, which also stands before it, and 256 bytes
ORDER = 6
ROOT = 2  # contexts up to this order are sent to all tasks
_BITS = 9  # of a symbol in a code
_CHUNK_BYTES = 10 << 20  # input bytes per chunk of texts whose grams are collapsed
_HEAVY = 1 << 17  # words that are looked up in place
_CHUNK = 1_000_000  # distinct entries a task holds
_BUCKET_BYTES = 8 << 20  # input bytes per bucket of words


def symbols(block: tx.Block) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, ORDER ends before each and one after, and the places to predict."""
    lengths = np.diff(block.offsets)
    texts = np.arange(block.n)
    out = np.zeros(len(block.bytes) + (ORDER + 1) * block.n, np.int32)
    shift = np.repeat((ORDER + 1) * texts + ORDER, lengths)
    out[np.arange(len(block.bytes)) + shift] = block.lowered().astype(np.int32) + 1
    starts = block.offsets[:-1] + (ORDER + 1) * texts + ORDER
    return out, tx.spans(starts, lengths + 1)


def grams(s: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The codes of the symbols at the places, after `order` others.

    A code holds the context backwards, then the symbol: a shorter context is a prefix of it.
    """
    code = s[at - 1].astype(np.int64) if order else np.zeros(len(at), np.int64)
    for k in range(2, order + 1):
        code <<= _BITS
        code |= s[at - k]
    code <<= _BITS
    code |= s[at]
    return code


def _shortened(codes: np.ndarray, dropped: int) -> np.ndarray:
    """The codes with contexts that lack the `dropped` earliest symbols."""
    symbol = codes & ((1 << _BITS) - 1)
    return (codes >> (_BITS * (dropped + 1))) << _BITS | symbol


class _Counter:
    """Counts of codes, kept sorted and distinct in chunks."""

    def __init__(self):
        self._codes: list[np.ndarray] = []
        self._counts: list[np.ndarray] = []
        self._most = _CHUNK
        self.held = 0

    def add(self, codes: np.ndarray, counts: np.ndarray | None = None) -> None:
        if not len(codes):
            return
        if counts is None:
            codes = np.sort(codes)
            head = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            counts = np.diff(np.r_[head, len(codes)])
            codes = codes[head]
        self._codes.append(codes)
        self._counts.append(counts)
        self.held += len(codes)
        if self.held > self._most and len(self._codes) > 1:
            self.merge()
            self._most = max(_CHUNK, 2 * self.held)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self._codes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes, counts = np.concatenate(self._codes), np.concatenate(self._counts)
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        head = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        self._codes, self._counts = [codes[head]], [np.add.reduceat(counts, head)]
        self.held = len(head)
        return self._codes[0], self._counts[0]


def _sum_codes(rows: DataFrame, codes_of, buckets: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """All (code, count) of a bounded code space, summed over the training texts."""

    def run(batches):
        counter = _Counter()
        for batch in batches:
            for block in tx.blocks(batch.column(0)):
                counter.add(codes_of(*symbols(block)))
        codes, counts = counter.merge()
        made = packed(codes % buckets, [codes.astype(np.int64), counts.astype(np.int64)])
        if made is not None:
            yield made

    def add(codes: np.ndarray, counts: np.ndarray) -> pa.Table:
        counter = _Counter()
        counter.add(codes, counts)
        codes, counts = counter.merge()
        return pa.table({"codes": [codes.tobytes()], "counts": [counts.tobytes()]})

    sent = map_batches(rows, ["text"], run, packed_schema(2))
    parts = by_bucket(sent, [np.int64, np.int64], add, "codes binary, counts binary").collect()
    join = lambda k: np.frombuffer(b"".join(bytes(p[k]) for p in parts), np.int64)
    order = np.argsort(join("codes"))
    return join("codes")[order], join("counts")[order]


@dataclass
class Level:
    """Counts of the symbols after the contexts of one order.

    codes, counts  of (context, symbol), sorted
    contexts       sorted; with each one's sum `n` of counts, its number `q` of symbols and the
                   sum `below` of the counts that these symbols have in its suffix
    """

    codes: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    n: np.ndarray
    q: np.ndarray
    below: np.ndarray


def _find(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of `wanted` are among the sorted values, and their places."""
    if not len(values):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return values[at] == wanted, at


def levels(codes: np.ndarray, counts: np.ndarray, order: int, shorter: list[Level]) -> list[Level]:
    """All levels up to `order` from the sorted codes of that order, given those in `shorter`."""
    tables = [(codes, counts)]
    for _ in range(order - len(shorter)):
        codes = _shortened(codes, 1)
        by = np.argsort(codes, kind="stable")
        codes, counts = codes[by], counts[by]
        head = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
        codes, counts = codes[head], np.add.reduceat(counts, head) if len(head) else counts
        tables.append((codes, counts))
    made = list(shorter)
    for codes, counts in reversed(tables):
        context = codes >> _BITS
        head = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(codes) else np.zeros(0, np.int64)
        n = np.add.reduceat(counts, head) if len(head) else counts
        below = np.zeros(len(head), np.int64)
        if made and len(head):
            _, at = _find(made[-1].codes, _shortened(codes, 1))
            below = np.add.reduceat(made[-1].counts[at], head)
        made.append(Level(codes, counts, context[head], n, np.diff(np.r_[head, len(codes)]), below))
    return made


def log10(made: list[Level], codes: np.ndarray) -> np.ndarray:
    """log10 probabilities of the symbols of codes of the longest order in their contexts."""
    out = np.zeros(len(codes))
    left = np.arange(len(codes))
    excluded = np.zeros((2, len(codes)), np.int64)  # counts and symbols that longer contexts have seen
    for order in range(len(made) - 1, -1, -1):
        level = made[order]
        own = _shortened(codes[left], len(made) - 1 - order)
        seen, at = _find(level.contexts, own >> _BITS)
        now, at = left[seen], at[seen]
        n, q = level.n[at] - excluded[0, now], level.q[at] - excluded[1, now]
        q = np.where(level.q[at] == SYMBOLS, 0, q)  # nothing is left to escape to
        excluded[:, now] = level.below[at], level.q[at]
        hit, place = _find(level.codes, own[seen])
        part = np.where(hit, level.counts[np.minimum(place, len(level.counts) - 1)] if len(place) else 0, q)
        new = n > 0
        out[now[new]] += np.log10(part[new] / (n + q)[new])
        done = np.zeros(len(codes), bool)
        done[now[hit]] = True
        left = left[~done[left]]
        if not len(left):
            break
    if len(left):
        out[left] -= np.log10(SYMBOLS - excluded[1, left])
    return out


class Trie:
    """The levels of order 0 to ROOT, which all longer contexts end in."""

    def __init__(self, made: list[Level]):
        self.levels = made

    @property
    def rows(self) -> dict[int, np.ndarray]:
        """log10 rows of the contexts of order 0 and 1: symbols that training saw, then one other."""
        used = self.levels[0].codes
        others = np.setdiff1d(np.arange(SYMBOLS), used)
        columns = np.r_[used, others[:1]]
        made = {}
        for order, contexts in ((0, np.zeros(1, np.int64)), (1, np.arange(SYMBOLS))):
            codes = (contexts[:, None] << _BITS | columns).ravel()
            made[order] = log10(self.levels[: order + 1], codes).reshape(len(contexts), -1)
            if not len(others):
                made[order] = np.c_[made[order], np.full(len(contexts), -300.0)]
        return made


def grow(rows: DataFrame) -> Trie:
    """The bounded part of the model of the texts of `rows`."""
    codes, counts = _sum_codes(rows, lambda s, at: grams(s, at, ROOT))
    return Trie(levels(codes, counts, ROOT, []))


def _planes(values: np.ndarray) -> bytes:
    """Integers by byte planes, of which those of the high bytes compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _whole(planes: np.ndarray, kind) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _gram_bucket(codes: np.ndarray, buckets: int) -> np.ndarray:
    return _word_bucket(mix((codes >> (_BITS * (ORDER - ROOT))).view(U64)), buckets)


def _sent(texts: pa.Table, buckets: int) -> pa.Table:
    """The distinct grams of a chunk and how often its training texts hold them, packed by bucket."""
    counter = _Counter()
    out = texts.column("held_out").combine_chunks().to_numpy(zero_copy_only=False)
    for block in tx.blocks(texts.column("text")):
        s, at = symbols(block)
        held = np.repeat(out[block.first : block.first + block.n], np.diff(block.offsets) + 1)
        counter.add(grams(s, at[~held], ORDER))
        other = np.unique(grams(s, at[held], ORDER))
        counter.add(other, np.zeros(len(other), np.int64))
    codes, counts = counter.merge()
    bucket = _gram_bucket(codes, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, codes, counts = bucket[order], codes[order], counts[order]
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends = np.r_[at[1:], len(codes)]
    delta = [np.diff(codes[a:b], prepend=0) for a, b in zip(at, ends, strict=True)]
    chunk = texts.column("chunk")[0].as_py()
    return pa.table({
        "bucket": pa.array(bucket[at].astype(np.int32)),
        "a0": pa.array([np.int64(chunk).tobytes()] * len(at), pa.binary()),
        "a1": pa.array([np.int64(n).tobytes() for n in ends - at], pa.binary()),
        "a2": pa.array([_planes(d) for d in delta], pa.binary()),
        "a3": pa.array([_planes(counts[a:b].astype(np.uint32)) for a, b in zip(at, ends, strict=True)], pa.binary()),
    })


def _answered(entries: DataFrame, trie) -> DataFrame:
    """(chunk, codes, log10) of the grams, per chunk and bucket."""

    def meet(chunk, many, codes, counts) -> pa.Table:
        ends = np.cumsum(many)
        spans = list(zip(ends - many, ends, strict=True))
        every = np.concatenate([np.cumsum(_whole(codes[8 * a : 8 * b], np.int64)) for a, b in spans])
        times = np.concatenate([_whole(counts[4 * a : 4 * b], np.uint32) for a, b in spans]).astype(np.int64)
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        head = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        grams, n = ordered[head], np.add.reduceat(times[order], head)
        made = levels(grams[n > 0], n[n > 0], ORDER, trie.value.levels)
        answers = np.empty(len(every), np.float32)
        answers[order] = np.repeat(log10(made, grams), np.diff(np.r_[head, len(every)]))
        return pa.table({
            "chunk": chunk, "codes": pa.array([codes[8 * a : 8 * b].tobytes() for a, b in spans], pa.binary()),
            "log10": pa.array([answers[a:b].tobytes() for a, b in spans], pa.binary()),
        })

    kinds = [np.int64, np.int64, np.uint8, np.uint8]
    return by_bucket(entries, kinds, meet, "chunk long, codes binary, log10 binary")


class _Answers:
    """Looks up the log-probabilities of a chunk's grams, by open hashing."""

    _SPREAD = U64(0x9E3779B97F4A7C15)

    def __init__(self, table: pa.Table):
        parts = [np.cumsum(_whole(np.frombuffer(c, np.uint8), np.int64)) for c in table.column("codes").to_pylist()]
        hashes = np.concatenate(parts).view(U64) * self._SPREAD
        order = np.argsort(hashes)
        self._hashes = hashes[order]
        self._values = np.frombuffer(b"".join(table.column("log10").to_pylist()), np.float32)[order]
        bits = max(1, int(len(order)).bit_length())
        self._shift = U64(64 - bits)
        sizes = np.bincount((self._hashes >> self._shift).astype(np.int64), minlength=1 << bits)
        self._first = (np.cumsum(sizes) - sizes).astype(np.int32)

    def __getitem__(self, codes: np.ndarray) -> np.ndarray:
        hashes = codes.view(U64) * self._SPREAD
        at = self._first[(hashes >> self._shift).view(np.int64)]
        left = np.flatnonzero(self._hashes[at] != hashes)
        while len(left):  # every gram is there
            at[left] += 1
            left = left[self._hashes[at[left]] != hashes[left]]
        return self._values[at]


def word_counts(rows: DataFrame, buckets: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Tokens and distinct tokens of the texts without ends, and the heavy words with counts."""
    most = max(1, _HEAVY // buckets)

    def run(batches):
        counter = _Counter()
        for batch in batches:
            for block in tx.blocks(batch.column(0)):
                counter.add(tx.Words(block, tx.WHITE, lower=True).hashes())
                if counter.held > _CHUNK:
                    hashes, counts = counter.merge()
                    counter = _Counter()
                    yield packed(_word_bucket(hashes, buckets), [hashes, counts])
        hashes, counts = counter.merge()
        made = packed(_word_bucket(hashes.view(U64), buckets), [hashes.view(U64), counts])
        if made is not None:
            yield made

    def total(hashes: np.ndarray, counts: np.ndarray) -> pa.Table:
        counter = _Counter()
        counter.add(hashes, counts)
        hashes, counts = counter.merge()
        top = np.argsort(-counts, kind="stable")[:most]
        return pa.table({
            "tokens": [int(counts.sum())], "distinct": [len(counts)],
            "words": [hashes[top].tobytes()], "counts": [counts[top].tobytes()],
        })

    sent = map_batches(rows, ["text"], run, packed_schema(2))
    parts = by_bucket(sent, [U64, np.int64], total, "tokens long, distinct long, words binary, counts binary").collect()
    words = np.frombuffer(b"".join(bytes(p["words"]) for p in parts), U64)
    counts = np.frombuffer(b"".join(bytes(p["counts"]) for p in parts), np.int64)
    order = np.argsort(words)
    return sum(p["tokens"] for p in parts), sum(p["distinct"] for p in parts), words[order], counts[order]


def _word_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(hashes) >> U64(40)).astype(np.int64) * buckets >> 24


def score(docs: DataFrame, modulus: int = 7, held_out: int = 2) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes.

    Rows whose crc32 of doc_id modulo `modulus` is `held_out` are not learnt from.
    """
    spark = docs.sparkSession
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "text", (crc % modulus == held_out).alias("held_out"))
    train = rows.where(~F.col("held_out"))
    buckets = bucket_count(docs, _BUCKET_BYTES)
    chunks = -(-bucket_count(docs, 1) // _CHUNK_BYTES)
    ends = train.count()
    tokens, distinct, heavy, heavy_counts = word_counts(train, buckets)
    trie = spark.sparkContext.broadcast(grow(train))
    words = spark.sparkContext.broadcast((heavy, heavy_counts))

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(summed(table.combine_chunks().to_batches(), _Answers(answers))))

    def summed(batches, answers):
        heavy, counts = words.value
        hits = _Heavy(heavy)
        held: list[tuple] = []
        size = 0

        def flush():
            owner, hashes, times = (np.concatenate([h[k] for h in held]) for k in (0, 1, 2))
            ids, learnt = (np.concatenate([h[k] for h in held]) for k in (3, 4))
            return packed_runs(_word_bucket(hashes, buckets), owner, [ids, learnt], [hashes, times.astype(np.uint32)])

        texts = 0
        for batch in batches:
            row, out = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            for block in tx.blocks(batch.column(3)):
                s, at = symbols(block)
                starts = np.r_[0, np.cumsum(np.diff(block.offsets) + 1)[:-1]]
                log10 = np.add.reduceat(answers[grams(s, at, ORDER)].astype(np.float64), starts)
                own = tx.Words(block, tx.WHITE, lower=True)
                hashes, doc = own.hashes(), own.docs()
                found, place = hits.find(hashes)
                base = np.bincount(doc[found], np.log10(counts[place] + 1.0), block.n).astype(np.float64)
                known = np.bincount(doc[found], minlength=block.n)
                rare = np.ones(len(hashes), bool)
                rare[found] = False
                order = np.lexsort((hashes[rare], doc[rare]))
                d, h = doc[rare][order], hashes[rare][order]
                head = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])]) if len(d) else np.zeros(0, np.int64)
                span = slice(block.first, block.first + block.n)
                held.append((texts + d[head], h[head], np.diff(np.r_[head, len(d)]), row[span], ~out[span]))
                texts += block.n
                size += len(head)
                yield pa.record_batch(
                    [
                        pa.nulls(block.n, pa.int32()), *[pa.nulls(block.n, pa.binary())] * 5,
                        *[batch.column(i).slice(block.first, block.n) for i in range(3)],
                        pa.array(own.counts + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(base),
                        pa.array(log10), pa.array(np.diff(block.offsets), pa.int64()),
                    ],
                    names=names,
                )
                if size > _CHUNK:
                    yield entries(flush())
                    held, size, texts = [], 0, 0
        if size:
            yield entries(flush())

    names = ["bucket", *[f"a{i}" for i in range(5)], "row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "n_bytes"]
    schema = packed_schema(5) + ", row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, n_bytes long"
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]

    def entries(made: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([*made.columns, *[pa.nulls(made.num_rows, k) for k in kinds]], names=names)

    # The chunk depends on the row alone, as the rows are dealt twice.
    typed = rows.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text",
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"),
    )
    importable(spark)
    dealt = typed.groupBy("chunk")
    answers = _answered(dealt.applyInArrow(lambda texts: _sent(texts, buckets), packed_schema(4)), trie)
    made = dealt.cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)
    scored = written(made, "scored")
    rest = _rare_words(scored.where("bucket IS NOT NULL"), buckets).withColumnRenamed("row", "own")
    own = scored.where("bucket IS NULL")
    end_known = int(ends > 0)
    total = tokens + ends
    spread = total + (distinct + end_known) + 1
    joined = own.join(rest, own["row"] == rest["own"], "left")
    part = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + part("more_known") + end_known).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (
            F.col("base") + part("more_base") + F.log10(F.lit(float(ends + 1)))
            - F.col("n_tokens") * F.log10(F.lit(float(spread)))
        ).alias("base_score"),
        "score",
        "n_bytes",
    )


class _Heavy:
    """Which hashes are in a sorted list."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self._seen = np.zeros(1 << 22, bool)
        self._seen[words >> U64(42)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        maybe = np.flatnonzero(self._seen[hashes >> U64(42)])
        if not len(maybe):
            return maybe, maybe
        at = np.minimum(np.searchsorted(self.words, hashes[maybe]), len(self.words) - 1)
        same = self.words[at] == hashes[maybe]
        return maybe[same], at[same]


def _rare_words(entries: DataFrame, buckets: int) -> DataFrame:
    """(row, more_base, more_known) of the words that are not heavy, counted where they meet."""

    def meet(row, learnt, many, hashes, times) -> pa.Table:
        owner = np.repeat(np.arange(len(row)), many)
        order = np.argsort(hashes, kind="stable")
        head = np.flatnonzero(np.r_[True, hashes[order][1:] != hashes[order][:-1]])
        weight = np.where(learnt[owner], times, 0).astype(np.int64)
        sums = np.add.reduceat(weight[order], head)
        count = np.empty(len(hashes), np.int64)
        count[order] = np.repeat(sums, np.diff(np.r_[head, len(hashes)]))
        base = np.bincount(owner, times * np.log10(count + 1.0), len(row))
        known = np.bincount(owner, times * (count > 0), len(row)).astype(np.int64)
        ids, place = np.unique(row, return_inverse=True)
        made = packed(
            _word_bucket(ids.view(U64), buckets),
            [ids, np.bincount(place, base), np.bincount(place, known).astype(np.int64)],
        )
        return pa.Table.from_batches([made])

    def add(row, base, known) -> pa.Table:
        ids, place = np.unique(row, return_inverse=True)
        return pa.table({
            "row": ids, "more_base": np.bincount(place, base), "more_known": np.bincount(place, known).astype(np.int64)
        })

    first = by_bucket(entries, [np.int64, bool, np.uint32, U64, np.uint32], meet, packed_schema(3))
    return by_bucket(first, [np.int64, np.float64, np.int64], add, "row long, more_base double, more_known long")


def query(spark, folder: str) -> DataFrame:
    return score(spark.read.parquet(f"{folder}/documents.parquet"))


ORACLE = None


def brute_force(documents: list, modulus: int = 7, held_out: int = 2) -> dict:
    """The same with dictionaries, for tests: {doc_id: (held_out, n_tokens, n_known, N, base, score)}."""
    import math
    import re
    import zlib
    from collections import Counter, defaultdict

    low = {
        i: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for i, t in documents
    }
    out = {i: zlib.crc32(str(i).encode()) % modulus == held_out for i in low}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", t), None] for i, t in low.items()}
    words = Counter(w for i in low if not out[i] for w in tokens[i])
    total = sum(words.values())
    base = lambda i: sum(math.log10((words[w] + 1) / (total + len(words) + 1)) for w in tokens[i])

    stream = {i: [0] * ORDER + [b + 1 for b in t.encode()] + [0] for i, t in low.items()}
    seen: dict[tuple, Counter] = defaultdict(Counter)
    for i, s in stream.items():
        for at in range(ORDER, len(s)):
            for k in range(ORDER + 1) if not out[i] else ():
                seen[tuple(s[at - k : at])][s[at]] += 1
    def symbol(s: list, at: int) -> float:
        p, gone = 1.0, set()
        for k in range(ORDER, -1, -1):
            context = tuple(s[at - k : at])
            own = {x: c for x, c in seen[context].items() if x not in gone} if context in seen else {}
            if not own:
                continue
            n, q = sum(own.values()), len(own)
            q = 0 if len(gone) + q == SYMBOLS else q
            if s[at] in own:
                return p * own[s[at]] / (n + q)
            p *= q / (n + q)
            gone |= set(own)
        return p / (SYMBOLS - len(gone))

    return {
        i: (
            out[i], len(tokens[i]), sum(words[w] > 0 for w in tokens[i]), total, base(i),
            sum(math.log10(symbol(s, at)) for at in range(ORDER, len(s))),
        )
        for i, s in stream.items()
    }

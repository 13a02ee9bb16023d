"""Spelling variants: words one edit apart, each pointed to a much more frequent one.

Words are maximal runs of letters, counted over all texts. Pairs of words that differ by exactly
one inserted, deleted or replaced letter come from composing the minimised acceptor of the
vocabulary with a one-edit transducer and the acceptor again (`acceptor`). The composition is
enumerated per initial-state partition: the acceptor's words are split so that the two words of
every pair meet in exactly one group.

A group is (j, low, high, prefix, suffix): words of j or j + 1 letters that share their first
`low` letters and all letters of the shorter word from `high` on. It answers for the pairs whose
first difference lies in [low, high). Each word goes to the two halves of its positions; a group
of more than `group_words` words is split in halves again, and since its words then share more
letters, a group of one position holds no more words than there are letters and pairs of letters.
So no group grows with the vocabulary, whatever prefix or suffix most words share.

Per task words are counted before they are shuffled, and a group's pairs are reduced to one row per
word: near words, and the most frequent of them. Forms strictly gain in frequency, so that chains
to the root are at most as long as the logarithm of the largest count; they are doubled in as many
rounds as that needs.

Null and empty texts have no words; a null doc_id counts as an empty one where it is hashed.
Repeated rows count each. Texts and words may have any length. Ties between near words go to the
smallest in code-point order. An empty table, or one without frequent words, gives no rows. Other
columns play no part.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.llm import text as tx
from tradeloom.llm.acceptor import Acceptor, pairs
from tradeloom.llm.tasks import Batches, importable, map_batches, written
from tradeloom.operators.skew import find_hot_keys, lookup_join

LEAST_LETTERS, LEAST_COUNT, GAIN = 5, 3, 2
SLIP = 97
GROUP_WORDS = 50_000
_BUCKET_ROWS = 100_000
_HELD = 200_000
_NO_LETTER = tx.byte_set((0x00, 0x60), (0x7B, 0xFF))
_LEAD = 0xC3  # the first byte of U+00C0 to U+00FF in UTF-8


# Words


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return table


_CRC = _crc_table()


def checksums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of data[start:start + length] for each range, carrying on from the crc `before`."""
    state = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-lengths, kind="stable")
    short = order[lengths[order] <= 64]
    ascending = lengths[short][::-1]
    for place in range(int(lengths[short].max(initial=0))):
        live = short[: len(short) - np.searchsorted(ascending, place, "right")]
        s = state[live]
        state[live] = _CRC[(s ^ data[starts[live] + place]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
    for i in order[: len(order) - len(short)]:
        raw = data[starts[i] : starts[i] + lengths[i]].tobytes()
        state[i] = zlib.crc32(raw, int(before[i])) ^ 0xFFFFFFFF
    return state ^ np.uint32(0xFFFFFFFF)


def _words(block: tx.Block, ids: list) -> pa.Array:
    """The words of a block of texts: runs of letters, some with a letter left out, long enough."""
    data = block.lowered()
    lead = data == _LEAD
    inside = ~_NO_LETTER[data] | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[block.offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    letters = data[inside]
    starts = np.flatnonzero(opens[inside])
    ends = np.r_[starts[1:], len(letters)] if len(starts) else starts
    marks = np.r_[0, np.cumsum(letters == _LEAD)]
    points = ends - starts - (marks[ends] - marks[starts])
    doc = np.searchsorted(block.offsets, np.flatnonzero(opens), "right") - 1
    salt = np.array([zlib.crc32(b":" if i is None else f"{i}:".encode()) for i in ids], np.uint32)
    crc = checksums(letters, starts, ends - starts, salt[doc])
    slip = crc % SLIP == 0
    runs = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.r_[starts, len(letters)].astype(np.int32)), pa.py_buffer(letters))
    whole = runs.filter(pa.array(~slip & (points >= LEAST_LETTERS)))
    rest = []
    for i in np.flatnonzero(slip & (points > LEAST_LETTERS)):
        word, at = runs[i].as_py(), int(crc[i]) % int(points[i])
        rest.append(word[:at] + word[at + 1 :])
    return pa.concat_arrays([whole, pa.array(rest, pa.string())])


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of all words with at least LEAST_COUNT occurrences."""

    def total(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def run(batches: Batches) -> Batches:
        parts, rows = [], 0
        for batch in batches:
            for block in tx.blocks(batch.column("text")):
                ids = batch.column("doc_id").slice(block.first, block.n).to_pylist()
                counted = _words(block, ids).value_counts()
                parts.append(pa.table([counted.field("values"), counted.field("counts")], names=["word", "n"]))
                rows += len(counted)
                if rows > _HELD:
                    parts = [total(parts)]
                    rows = parts[0].num_rows
                    if rows > _HELD // 2:
                        yield from parts[0].to_batches()
                        parts, rows = [], 0
        if parts:
            yield from total(parts).to_batches()

    counts = map_batches(docs, ["doc_id", "text"], run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# Groups


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows of (word, n, j, longer, low, high) with the key of their group."""
    shared = F.greatest(F.col("j") - F.col("high"), F.lit(0))
    parts = [F.substring("word", F.lit(1), F.col("low")), F.when(shared > 0, F.expr("right(word, greatest(j - high, 0))")).otherwise("")]
    return rows.withColumn("key", F.xxhash64("j", "low", "high", *parts))


def groups(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """Every word in the groups that answer for its pairs: word, n, j, longer, low, high, key."""
    length = F.length("word")
    classes = F.array(
        F.struct(length.alias("j"), F.lit(False).alias("longer")), F.struct((length - 1).alias("j"), F.lit(True).alias("longer"))
    )
    in_class = words.select("word", "n", F.explode(classes).alias("c")).select("word", "n", "c.*").where(F.col("j") >= LEAST_LETTERS)
    rows = _halved(in_class.withColumn("low", F.lit(0)).withColumn("high", F.col("j") + 1))
    rows = _keyed(rows)
    while True:
        counts = rows.where("high - low > 1").groupBy("key").agg(F.count("*").alias("rows"))
        large = written(counts.where(F.col("rows") > group_words).select("key", F.lit(True).alias("large")), "large_groups")
        if not large.take(1):
            return rows
        marked = written(lookup_join(rows, large, "key", lambda r=rows: find_hot_keys(r, "key"), ["word"], "left"), "groups")
        wide = F.coalesce("large", F.lit(False)) & (F.col("high") - F.col("low") > 1)
        split = _keyed(_halved(marked.where(wide).drop("large", "key")))
        rows = marked.where(~wide).drop("large").unionByName(split)


def _halved(rows: DataFrame) -> DataFrame:
    middle = F.expr("low + (high - low) div 2").cast("int")
    halves = F.array(
        F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high"))
    )
    others = [c for c in rows.columns if c not in ("low", "high")]
    return rows.select(*others, F.explode(halves).alias("half")).select(*others, "half.*")


def find_near(table: pa.Table) -> pa.Table | None:
    """Per word of some groups: how many near words these show, and the most frequent of them."""
    given = [table.column(c).to_pylist() for c in ("word", "n", "j", "longer", "low", "high")]
    cells: dict[tuple, list] = {}
    for word, n, j, longer, low, high in zip(*given, strict=True):
        raw = word.encode("latin-1")
        stop = len(raw) - max(0, j - high)
        cells.setdefault((j, low, high, raw[:low], raw[stop:]), []).append((longer, raw[low:stop], word, n))
    words, named, counts, number = [], [], [], []
    short, long, at_end = [], [], []
    for (j, _, high, _, _), members in cells.items():
        members.sort()
        first_long = sum(not m[0] for m in members)
        if len(members) < 2 or not first_long:
            continue
        short.append(len(words))
        long.append(len(words) + first_long if first_long < len(members) else -1)
        at_end.append(high > j)
        number += [2 * len(short) + m[0] for m in members]
        words += [m[1] for m in members]
        named += [m[2] for m in members]
        counts += [m[3] for m in members]
    if not words:
        return None
    acceptor = Acceptor(words, np.array(number))
    left, right = pairs(acceptor, np.array(short), np.array(long), np.array(at_end))
    if not len(left):
        return None
    one, other = np.r_[left, right], np.r_[right, left]
    distinct, place = np.unique(np.array(named, object), return_inverse=True)  # in code-point order
    n = np.zeros(len(distinct), np.int64)
    n[place] = counts
    one, other = place[one], place[other]
    order = np.lexsort((other, -n[other], one))
    one, other = one[order], other[order]
    at = np.flatnonzero(np.r_[True, one[1:] != one[:-1]])
    many = np.diff(np.r_[at, len(one)])
    best = other[at]
    return pa.table(
        [pa.array(distinct[one[at]], pa.string()), pa.array(many), pa.array(-n[best]), pa.array(distinct[best], pa.string())],
        names=["word", "n_near", "less", "form"],
    )


def near_words(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, n_near, form_n, form) of the words that have near ones; form is the most frequent."""
    rows = 4 * words.count()
    least = 2 * int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, math.ceil(rows / _BUCKET_ROWS))
    schema = "word string, n_near long, less long, form string"
    empty = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("less", pa.int64()), ("form", pa.string())]).empty_table()

    def run(table: pa.Table) -> pa.Table:
        made = find_near(table)
        return empty if made is None else made

    importable(words.sparkSession)
    bucketed = groups(words, group_words).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    found = bucketed.groupBy("bucket").applyInArrow(run, schema)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("best"))
    return best.select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


# Forms


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of the words that have a form; `most` is the largest count of a word."""
    longest = max(1, int(math.log(max(most, 1) / LEAST_COUNT, GAIN)) + 1)
    jump = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(longest + 1))):
        further = jump.select(F.col("word").alias("root"), F.col("root").alias("end"))
        step = jump.join(further, "root", "left")
        jump = written(step.select("word", F.coalesce("end", "root").alias("root")), "roots")
    return jump


def variants(docs: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    words = written(vocabulary(docs), "vocabulary")
    joined = words.join(near_words(words, group_words), "word", "left")
    formed = F.col("form_n") >= GAIN * F.col("n")
    table = written(
        joined.select(
            "word", F.when(formed, F.col("form")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("form_n")).alias("form_n"),
        ),
        "forms",
    )
    most = words.agg(F.max("n")).first()[0] or 0
    ends = roots(table.where("form is not null"), most)
    return table.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def query(spark, folder: str) -> DataFrame:
    return variants(spark.read.parquet(f"{folder}/documents.parquet"))


#: crc32 of every run of letters is out of reach of SQL on whole tables; tests use plain search.
ORACLE = None


def brute_force(rows: list[tuple]) -> list[tuple]:
    """The result for (doc_id, text) pairs, by comparing all words."""
    import re
    from collections import Counter

    counts: Counter[str] = Counter()
    for doc_id, text in rows:
        for found in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in found)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % SLIP == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= LEAST_LETTERS
    words = {w: n for w, n in counts.items() if n >= LEAST_COUNT}

    def one_edit(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: sorted((-words[v], v) for v in words if one_edit(w, v)) for w in words}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= GAIN * n else None for w, n in words.items()}

    def root(w: str) -> str:
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, len(near[w]), form[w] and words[form[w]]) for w, n in words.items())
